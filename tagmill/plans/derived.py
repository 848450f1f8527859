"""Tables that several queries derive from the given ones, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators.recognise import RULES, candidates, mentions
from tagmill.sources import table

#: SQL for the pseudo-random number of a seed and a key.
U = "(('0x' || substr(md5('{seed}|' || {key}), 1, 8))::bigint / 4294967296.0)"

LUHN = """(list_sum([case when i % 2 = 0 then d else case when d * 2 > 9 then d * 2 - 9 else d * 2 end end
  for d, i in [cast(x as int) for x in string_split(reverse(regexp_replace({0}, '[ -]', '', 'g')), '')]]) % 10 = 0)"""


def u_sql(seed: int, key: str) -> str:
    return U.format(seed=seed, key=key)


def _hits_sql() -> str:
    parts = [
        f"select doc_id, lang, source, '{r.label}' as label, {r.confidence} as confidence, regexp_extract_all(text, '{r.pattern}') as ms, string_split_regex(text, '{r.pattern}') as ps from documents where regexp_matches(text, '{r.pattern}')"
        for r in RULES
    ]
    return " union all ".join(parts)


#: Rule matches with offsets, before and after confirmation; greedy choice without overlaps.
CANDIDATES_SQL = f"""hits as ({_hits_sql()}),
found as (select doc_id, lang, source, label, confidence, ms[i] as surface,
  cast(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as int) as "start"
  from (select *, unnest(range(1, len(ms) + 1)) as i from hits)),
digits as (select *, [cast(x as int) for x in string_split(reverse(regexp_replace(surface, '[ -]', '', 'g')), '') if label = 'card'] as ds from found),
cands as (select doc_id, lang, source, label, confidence, surface, "start", cast("start" + length(surface) as int) as "end" from digits
  where (label <> 'card' or list_sum(list_transform(range(1, len(ds) + 1), lambda i: case when i % 2 = 1 then ds[i] when ds[i] > 4 then ds[i] * 2 - 9 else ds[i] * 2 end)) % 10 = 0)
    and (label <> 'ipv4' or len(list_filter(string_split(surface, '.'), lambda x: cast(x as int) > 255)) = 0))"""

MENTIONS_SQL = f"""{CANDIDATES_SQL},
ranked as (select *, row_number() over (partition by doc_id order by confidence desc, "end" - "start" desc, "start", "end", label) as r from cands),
walk as (
  select doc_id, 0 as r, [{{'s': -1, 'e': -1, 'r': cast(0 as bigint)}}] as kept from (select distinct doc_id from ranked)
  union all
  select w.doc_id, w.r + 1, case when len(list_filter(w.kept, lambda k: k.s < x."end" and x."start" < k.e)) > 0 then w.kept else list_append(w.kept, {{'s': x."start", 'e': x."end", 'r': x.r}}) end
  from walk w join ranked x on x.doc_id = w.doc_id and x.r = w.r + 1),
final as (select doc_id, arg_max(kept, r) as kept from walk group by doc_id),
mentions as (select x.* exclude (r) from ranked x join (select doc_id, unnest(kept).r as r from final) k on x.doc_id = k.doc_id and x.r = k.r)"""


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents", *(columns or ("doc_id", "lang", "source", "text")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confirmed rule matches: doc_id, lang, source, start, end, surface, label, confidence."""
    return candidates(documents(spark, sf_dir))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule mentions without overlaps, taken as gold."""
    return mentions(documents(spark, sf_dir))


def key_of(frame: DataFrame):
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start").cast("string"))


def predictions(gold_spans: DataFrame) -> DataFrame:
    """Gold, disturbed by hash: a fifth dropped, a fifth shifted, a fifth of another label, each with a confidence."""
    u, c = hash_uniform(1, key_of(gold_spans)), hash_uniform(2, key_of(gold_spans))
    p = gold_spans.withColumn("u", u).withColumn("confidence", F.round(c, 6)).filter("u >= 0.2")
    shifted = p.withColumn("start", F.when(F.col("u") < 0.4, F.col("start") + 2).otherwise(F.col("start")).cast("int")).withColumn("end", F.when(F.col("u") < 0.4, F.col("end") + 2).otherwise(F.col("end")).cast("int"))
    other = F.when((F.col("u") >= 0.4) & (F.col("u") < 0.6), F.when(F.col("label") == "email", "phone").otherwise("email")).otherwise(F.col("label"))
    return shifted.withColumn("label", other).withColumn("surface", F.when(F.col("u") < 0.4, F.concat(F.lit("~"), "surface")).otherwise(F.col("surface"))).drop("u")


_KEY = "doc_id || ':' || \"start\""
PREDICTIONS_SQL = f"""{MENTIONS_SQL},
disturbed as (select *, {u_sql(1, _KEY)} as u, round({u_sql(2, _KEY)}, 6) as c from mentions),
preds as (select doc_id, lang, source, case when u >= 0.4 and u < 0.6 then case when label = 'email' then 'phone' else 'email' end else label end as label,
  c as confidence, case when u < 0.4 then '~' || surface else surface end as surface,
  cast(case when u < 0.4 then "start" + 2 else "start" end as int) as "start", cast(case when u < 0.4 then "end" + 2 else "end" end as int) as "end"
  from disturbed where u >= 0.2)"""
