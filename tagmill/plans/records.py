"""Queries on token sequences, records and relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.functions.text import WORD, junk_reason, words
from tagmill.operators.corpus import beside
from tagmill.operators.formatting import format_results
from tagmill.operators.relations import match_counts
from tagmill.operators.sanitize import RECORD, sanitize
from tagmill.operators.tokens import detokenise_rows, pack_sentences
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.sources import table
from tagmill.written import cut

_WORD_SQL = WORD.replace("'", "''")


def _detokenise(spark, d):
    """Conversation turns tokenised and joined again: length of the joined text and a digest of the token ends."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws(":", "conv_id", "turn").alias("k"), "text")
    turns = c.groupBy("k").agg(F.collect_list("text").alias("texts"))
    found = F.flatten(F.transform("texts", lambda x: F.transform(words(x), lambda w, i: F.struct(i.alias("pos"), w.alias("token")))))
    # rows of one turn are one list, by place
    lists = turns.select("k", F.when(F.size("texts") > 1, F.sort_array(found)).otherwise(found).alias("tokens"))
    joined = detokenise_rows(lists, "k", dots=True)
    return joined.groupBy("k").agg(F.count("*").alias("tokens"), F.max("end").alias("chars"), F.sum(F.col("start") * (F.col("pos") + 1)).alias("start_sum"), F.count(F.when(F.col("sep") == "", 1)).alias("glued"))


_CL = "('.', ',', ';', ':', '!', '?', ')', ']', '}', '”', '»', '’', '''')"
_W = r"'^[\p{L}\p{N}_]+([-_][\p{L}\p{N}_]+)*$'"
_DETOKENISE = rf"""with t0 as (select conv_id || ':' || turn as k, generate_subscripts(regexp_extract_all(text, '{_WORD_SQL}'), 1) - 1 as pos, unnest(regexp_extract_all(text, '{_WORD_SQL}')) as u0 from conversations),
t1 as (select *, row_number() over (partition by k order by pos) - row_number() over (partition by k, u0 = '.' order by pos) as run from t0),
t2 as (select *, u0 = '.' and count(*) over (partition by k, u0 = '.', run) > 2 as long, min(pos) over (partition by k, u0 = '.', run) as first from t1),
t as (select k, pos, case when long then '...' else u0 end as u0 from t2 where not long or pos = first),
w as (select *, lag(u0, 1) over p as u1, lag(u0, 2) over p as u2, lead(u0, 1) over p as u3, coalesce(sum(case when u0 = '"' then 1 else 0 end) over (partition by k order by pos rows between unbounded preceding and 1 preceding), 0) as q from t window p as (partition by k order by pos)),
s as (select *, case when u1 is null or coalesce(u0 in {_CL} or u1 in ('(', '[', '{{', '“', '«', '‘') or ((u0 = '"' or u1 = '"') and q % 2 = 1) or (u1 in ('''', '’') and regexp_matches(u0, '^\p{{Ll}}') and regexp_matches(u0, {_W}))
  or (u1 = '.' and regexp_matches(u2, '^[0-9]+$') and regexp_matches(u0, '^[0-9]+$')) or (u1 = ':' and regexp_matches(u2, '^[0-9]{{1,2}}$') and regexp_matches(u0, '^[0-9]{{1,2}}$'))
  or (u1 = '.' and regexp_matches(u2, '^\p{{Lu}}$') and regexp_matches(u0, '^\p{{Lu}}$') and u3 = '.') or (u0 = '/' and regexp_matches(u1, {_W}) and regexp_matches(u3, {_W})) or (u1 = '/' and regexp_matches(u2, {_W}) and regexp_matches(u0, {_W})) or (u1 = '%' and regexp_matches(u0, '^[0-9]')), false) then 0 else 1 end as sep from w),
e as (select *, sum(sep + length(u0)) over (partition by k order by pos) as e from s)
select k, count(*) as tokens, cast(max(e) as bigint) as chars, cast(sum((e - length(u0)) * (pos + 1)) as bigint) as start_sum, count(*) filter (sep = 0) as glued from e group by k"""


def _pack(spark, d):
    """Turns of a conversation as its sentences: greedily packed into pieces of at most 1,500 characters."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", F.col("turn").cast("int").alias("pos"), F.length("text").alias("size"))
    return pack_sentences(c, "conv_id", 1500).groupBy("conv_id", "piece").agg(F.count("*").alias("turns"), F.sum("size").alias("chars"))


_PACK = """with recursive c as (select conv_id, length(text) as size, row_number() over (partition by conv_id order by turn) as r from conversations),
w as (select conv_id, r, 0 as piece, size as held, size from c where r = 1
  union all select c.conv_id, c.r, case when w.held + c.size <= 1500 then w.piece else w.piece + 1 end, case when w.held + c.size <= 1500 then w.held + c.size else c.size end, c.size from w join c on c.conv_id = w.conv_id and c.r = w.r + 1)
select conv_id, piece, count(*) as turns, cast(sum(size) as bigint) as chars from w group by conv_id, piece"""


def _relations(spark, d):
    """Order lines as relation triples: part and supplier as head and tail; predictions drop a fifth and turn a fifth round."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    key = F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    t = li.select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("relation"), nth.alias("i"), name("Part ", "l_partkey").alias("head"), name("Supplier ", "l_suppkey").alias("tail"), hash_uniform(5, key).alias("u"))
    gold = t.select("record", "relation", "i", F.array("head", F.upper("head")).alias("heads"), F.array("tail").alias("tails"))
    turned = (F.col("u") >= 0.2) & (F.col("u") < 0.4)
    pred = t.filter("u >= 0.2").select("record", "relation", "i", F.when(turned, F.col("tail")).otherwise(F.upper("head")).alias("head"), F.when(turned, F.col("head")).otherwise(F.col("tail")).alias("tail"))
    counts = match_counts(gold, pred).filter("relation is not null")
    return counts.groupBy("relation").agg(*(F.sum(c).alias(f"strict_{c}") for c in ("tp", "fp", "fn")), *(F.sum(f"lenient_{c}").alias(f"lenient_{c}") for c in ("tp", "fp", "fn")))


_RELATIONS = f"""with t as (select l_orderkey as record, l_returnflag as relation, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, 'part ' || l_partkey as head, 'supplier ' || l_suppkey as tail, {u_sql(5, "l_orderkey || ':' || l_linenumber")} as u from lineitem),
p as (select record, relation, i, case when u < 0.4 then tail else head end as head, case when u < 0.4 then head else tail end as tail from t where u >= 0.2),
n as (select relation, (select count(*) from p where p.relation = t.relation) as preds, count(*) as golds from t group by relation),
gs as (select *, row_number() over (partition by record, relation, head, tail order by i) as k from t), ps as (select *, row_number() over (partition by record, relation, head, tail order by i) as k from p),
strict as (select gs.relation, count(*) as tp from gs join ps using (record, relation, head, tail, k) group by 1),
gl as (select *, row_number() over (partition by record, relation, least(head, tail), greatest(head, tail) order by i) as k from t), pl as (select *, row_number() over (partition by record, relation, least(head, tail), greatest(head, tail) order by i) as k from p),
lenient as (select gl.relation, count(*) as tp from gl join pl on gl.record = pl.record and gl.relation = pl.relation and least(gl.head, gl.tail) = least(pl.head, pl.tail) and greatest(gl.head, gl.tail) = greatest(pl.head, pl.tail) and gl.k = pl.k group by 1)
select n.relation, s.tp as strict_tp, preds - s.tp as strict_fp, golds - s.tp as strict_fn, l.tp as lenient_tp, preds - l.tp as lenient_fp, golds - l.tp as lenient_fn from n join strict s using (relation) join lenient l using (relation)"""


#: Code points of a document's rows up to which their texts meet in one row.
_TOGETHER = 1 << 24


def _mentions(docs, *columns):
    """``columns``, the words of ``texts`` and the different ones in them, a row each with its place from 0; of the spellings of a mention the least."""
    said = F.flatten(F.transform("texts", lambda x: F.regexp_extract_all(x, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))))
    # arrays of one hold what is used more than once; of the spellings of a mention the least stands first
    first = lambda a: F.filter(a, lambda x, i: (i == 0) | (x["key"] != F.element_at(a, F.greatest(i, F.lit(1)))["key"]))
    once = lambda w: F.flatten(F.transform(F.array(F.sort_array(F.transform(F.array_distinct(w), lambda x: F.struct(F.lower(x).alias("key"), x.alias("mention"))))), first))
    per = docs.select(*columns, F.inline(F.transform(F.array(said), lambda w: F.struct(F.size(w).cast("long").alias("raw"), once(w).alias("mentions")))))
    return per.select(*columns, "raw", F.posexplode("mentions").alias("at", "m")).select(*columns, "raw", "at", "m.key", "m.mention")


def _conservation(spark, d):
    """Mentions of each label are raw ones, less repeats in a document, less junk, and what is left; the parts add up.

    A row's words are counted where it is read. Only documents of several rows are read again: their texts meet in one row, or their
    words by themselves where the texts have more than ``_TOGETHER`` code points.
    """
    key = ["doc_id", "lang"]
    docs = documents(spark, d, *key, "text").filter(F.col("text").rlike(r"[^ \t\n\r\f\x0B]"))
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).alias(c)
    judged = lambda m: m.withColumn("junk", junk_reason(F.col("mention")).isNotNull())
    parts = (F.count("*").alias("kept"), F.count_if("junk").alias("junk"), F.count_if(~F.col("junk")).alias("final"))
    begun, alone = F.col("at") == 0, F.col("rows") == 1
    found = judged(_mentions(docs.withColumns({"size": F.length("text"), "texts": F.array("text")}), *key, "size"))
    rows = cut(found.groupBy(*key).agg(F.count_if(begun).alias("rows"), total("size", begun), total("raw", begun), *parts), "counts")
    # tables of their own, so that their size is known and a small one needs no shuffle of the texts
    again = cut(rows.filter("rows > 1").select(*key, "size"), "several")
    met = beside(docs, again, key)  # where both parts below shuffle the texts, Spark does it once
    spread = _mentions(met.filter(F.col("size") > _TOGETHER).withColumn("texts", F.array("text")), *key).groupBy(*key, "key").agg(F.min("mention").alias("mention"))
    small = met.filter(F.col("size") <= _TOGETHER).groupBy(*key).agg(F.collect_list("text").alias("texts"))
    counts = rows.groupBy("lang").agg(F.sum("raw").alias("raw"), *(total(c, alone) for c in ("kept", "junk", "final")))
    for mentions in (spread, _mentions(small, "lang")):
        counts = counts.unionByName(judged(mentions).groupBy("lang").agg(F.lit(0).cast("long").alias("raw"), *parts))
    sums = counts.groupBy("lang").agg(*(F.sum(c).alias(c) for c in ("raw", "kept", "junk", "final")))
    return sums.select("lang", "raw", (F.col("raw") - F.col("kept")).alias("repeats"), "junk", "final", (F.col("raw") == F.col("raw") - F.col("kept") + F.col("junk") + F.col("final")).alias("adds_up"))


_CONSERVATION = r"""with m as (select doc_id, lang, unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) as m from documents),
o as (select doc_id, lang, lower(m) as k, count(*) as n, min(m) as m from m group by all),
j as (select *, length(regexp_replace(m, '\p{P}', '', 'g')) as o, length(regexp_replace(m, '[^\p{L}]', '', 'g')) as l from o),
r as (select *, o = 0 or l < 4 or 1 - o / length(m) > 0.3 as junk from j)
select lang, cast(sum(n) as bigint) as raw, cast(sum(n - 1) as bigint) as repeats, count(*) filter (junk) as junk, count(*) filter (not junk) as final, sum(n) = sum(n - 1) + count(*) as adds_up from r group by lang"""


def _sanitize(spark, d):
    """Recognised mentions as nested records, with planted mentions, choices, values and relation ends that are not in the text."""
    m = cut(gold(spark, d).select("doc_id", "start", "label", "surface"), "mentions")
    k = F.col("doc_id")
    per = m.groupBy("doc_id", "label").agg(F.array_sort(F.collect_set("surface")).alias("said"))
    lied = per.withColumn("mentions", F.when((k % 7 == 0) & (F.col("label") == "email"), F.concat("said", F.array(F.lit("absent@mention")))).otherwise(F.transform("said", lambda x: F.upper(x))))
    none = F.lit(None).cast("array<string>")
    types = lied.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("label").alias("type"), "mentions")).alias("entities"), F.collect_list(F.struct(F.col("label").alias("name"), F.col("mentions").alias("values"), none.alias("choices"))).alias("own"))
    after = Window.partitionBy("doc_id").orderBy("start")
    pairs = m.withColumn("next", F.lead("surface").over(after)).withColumn("nth", F.row_number().over(after)).filter("next is not null")
    ends = F.array(F.struct(F.lit("head").alias("name"), F.col("surface").alias("value")), F.struct(F.lit("tail").alias("name"), F.when((k % 3 == 0) & (F.col("nth") == 1), "nowhere to be found").otherwise(F.col("next")).alias("value")))
    rels = pairs.groupBy("doc_id").agg(F.collect_list(F.struct(F.lit("before").alias("name"), ends.alias("fields"))).alias("relations"))
    docs = documents(spark, d, "doc_id", "text", "lang", "n_chars").join(types, "doc_id").join(rels, "doc_id", "left")
    size = F.when(k % 5 == 0, "odd").when(F.col("n_chars") > 3000, "long").otherwise("short")
    more = F.array(F.struct(F.lit("lang").alias("name"), F.array("lang").alias("values"), none.alias("choices")), F.struct(F.lit("size").alias("name"), F.array(size).alias("values"), F.array(F.lit("short"), F.lit("long")).alias("choices")))
    record = F.struct(
        "entities", F.array(F.struct(F.lit("size").alias("task"), F.array(F.lit("short"), F.lit("long")).alias("labels"), F.array(size).alias("chosen"))).alias("classes"),
        F.array(F.struct(F.lit("facts").alias("name"), F.concat("own", more).alias("fields"))).alias("structures"), "relations",
    )
    clean = sanitize(docs.withColumn("record", record.cast(RECORD)), "text", "record")
    names = lambda c, f: F.array_join(F.array_sort(F.transform(c, f)), ",")
    return clean.select("doc_id", names("record.entities", lambda e: e["type"]).alias("types"), F.size("record.classes").alias("classes"), names(F.flatten(F.transform("record.structures", lambda s: s["fields"])), lambda f: f["name"]).alias("fields"), F.size("record.relations").alias("relations"), "valid")


_SANITIZE = f"""with recursive {MENTIONS_SQL}, m as (select doc_id, "start" as s, label, surface from mentions), t as (select distinct doc_id, label from m where not (doc_id % 7 = 0 and label = 'email')),
o as (select *, lead(surface) over (partition by doc_id order by s) as nx, row_number() over (partition by doc_id order by s) as k from m),
r as (select doc_id, count(*) as n from o where nx is not null and not (doc_id % 3 = 0 and k = 1) group by doc_id),
f as (select doc_id, label as f from t union all select doc_id, 'lang' from documents where contains(lower(text), lang) union all select doc_id, 'size' from documents where doc_id % 5 <> 0)
select *, types <> '' or classes > 0 or fields <> '' or relations > 0 as valid from (select d.doc_id, coalesce((select string_agg(label, ',' order by label) from t where t.doc_id = d.doc_id), '') as types, cast(case when d.doc_id % 5 = 0 then 0 else 1 end as int) as classes,
  coalesce((select string_agg(f, ',' order by f) from f where f.doc_id = d.doc_id), '') as fields, cast(coalesce(r.n, 0) as int) as relations
from documents d left join r on r.doc_id = d.doc_id where d.doc_id in (select doc_id from m))"""


def _formatted(spark, d):
    """Mentions, neighbouring pairs and labels of documents as formatted results, of which some were asked for in vain; one row a document and name."""
    docs = documents(spark, d, "doc_id")
    m = cut(gold(spark, d).select("doc_id", "label", F.col("surface").alias("text"), "start", "end", "confidence"), "mentions")
    loud = m.withColumn("text", F.upper("text")).withColumn("confidence", F.col("confidence") - 0.01)
    pairs = m.withColumn("tail", F.lead("text").over(Window.partitionBy("doc_id").orderBy("start"))).filter("tail is not null").select("doc_id", F.lit("before").alias("relation"), F.col("text").alias("head"), "tail", F.lit(1.0).alias("confidence"))
    labels = table(spark, d, "labels", "doc_id", "quality").select("doc_id", F.lit("quality").alias("task"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("label"), F.lit(0.9).alias("confidence"))
    out = format_results(docs, m.unionByName(loud), pairs, labels, "doc_id", {"entities": ["email", "passport"], "relations": ["before", "after"], "classes": ["quality", "tone"]})
    each = lambda part, items: out.select("doc_id", F.lit(part).alias("part"), F.explode(items).alias("name", "items")).select("doc_id", "part", "name", F.size("items").cast("long").alias("n"), F.md5(F.array_join("items", "|")).alias("items"))
    plain = F.transform_values("relations", lambda _, v: F.transform(v, lambda p: F.concat_ws(">", p["head"], p["tail"])))
    return each("entities", F.col("entities")).unionByName(each("relations", plain)).unionByName(each("classes", F.col("classes")))


_FORMATTED = f"""with recursive {MENTIONS_SQL}, o as (select doc_id, "start" as s, surface, lead(surface) over (partition by doc_id order by "start") as nx from mentions), p as (select distinct doc_id, surface || '>' || nx as x, surface as h, nx from o where nx is not null),
i as (select doc_id, 'entities' as part, label as name, count(*) as n, string_agg(surface, '|' order by "start") as items from mentions group by all union all select doc_id, 'relations', 'before', count(*), string_agg(x, '|' order by h, nx) from p group by doc_id
  union all select doc_id, 'classes', 'quality', count(distinct quality), string_agg(distinct case quality when 1 then 'good' else 'bad' end, '|') from labels where doc_id in (select doc_id from documents) group by doc_id),
a as (select doc_id, unnest([{{'p': 'entities', 'n': 'email'}}, {{'p': 'entities', 'n': 'passport'}}, {{'p': 'relations', 'n': 'before'}}, {{'p': 'relations', 'n': 'after'}}, {{'p': 'classes', 'n': 'quality'}}, {{'p': 'classes', 'n': 'tone'}}]) as x from (select distinct doc_id from documents))
select doc_id, part, name, n, md5(items) as items from i union all select doc_id, x.p, x.n, 0, md5('') from a where (doc_id, x.p, x.n) not in (select (doc_id, part, name) from i)"""

ITEMS = {
    "detokenise": Item(_detokenise, _DETOKENISE),
    "sentence_packing": Item(_pack, _PACK),
    "relation_eval": Item(_relations, _RELATIONS),
    "conservation_check": Item(_conservation, _CONSERVATION),
    "sanitize_records": Item(_sanitize, _SANITIZE),
    "formatted_results": Item(_formatted, _FORMATTED),
}
