"""Queries on evaluation variants, sweeps over relations, pages and training-set statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.functions.text import trim_span
from tagmill.operators import matching, spans
from tagmill.operators.ranking import running_total
from tagmill.operators.relations import match_counts
from tagmill.operators.variants import name_problems, variants
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.plans.recognition import _BIO
from tagmill.sources import readers, table, writers
from tagmill.written import cut, new_folder

_LABELS = ("card", "email", "ipv4", "phone")


def _names(spark, d):
    """Training names of the recognised labels (their own and two aliases) and two held-out pools, from the table of nations' letters."""
    n = table(spark, d, "nation", "n_nationkey", "n_name").filter(f"n_nationkey < {3 * len(_LABELS)}")
    label = F.element_at(F.array(*(F.lit(x) for x in _LABELS)), (F.col("n_nationkey") % len(_LABELS) + 1).cast("int"))
    own = spark.range(1).select(F.explode(F.array(*(F.lit(x) for x in _LABELS))).alias("label")).select(F.lit("training").alias("pool"), "label", F.col("label").alias("name"))
    pool = F.when(F.col("n_nationkey") < len(_LABELS), "training").when(F.col("n_nationkey") < 2 * len(_LABELS), "unseen1").otherwise("unseen2")
    more = n.select(F.lit("training").alias("pool"), label.alias("label"), F.concat(F.lower("n_name"), F.lit(" number")).alias("name"))
    return own.unionByName(more).unionByName(n.select(pool.alias("pool"), label.alias("label"), F.lower("n_name").alias("name")))


def _variants(spark, d):
    """Documents' labels under each variant, by variant, label and name."""
    out = variants(gold(spark, d).select("doc_id", "label"), _names(spark, d), "doc_id", canonical=0.25)
    return out.groupBy("variant", "label", "name").agg(F.count("*").alias("docs"))


_NAMES_SQL = f"""l as (select unnest({list(_LABELS)}) as label, unnest(range({len(_LABELS)})) as i), n as (select n_nationkey as k, lower(n_name) as name, label from nation join l on n_nationkey % {len(_LABELS)} = i where n_nationkey < {3 * len(_LABELS)}),
names as (select 'training' as pool, label, label as name from l union all select 'training', label, name || ' number' from n union all select case when k < {len(_LABELS)} then 'training' when k < {2 * len(_LABELS)} then 'unseen1' else 'unseen2' end, label, name from n)"""
_VARIANTS = f"""with recursive {MENTIONS_SQL}, {_NAMES_SQL}, r as (select distinct doc_id, label from mentions), t as (select label, list_sort(list(distinct name)) as ns from names where pool = 'training' and name <> label group by label),
v as (select doc_id, pool as variant, r.label, min(name) as name from r join names on names.label = r.label and pool <> 'training' group by all
  union all select doc_id, 'training', r.label, case when {u_sql(7, "doc_id || '|' || r.label")} < 0.25 then r.label else ns[cast(floor({u_sql(8, "doc_id || '|' || r.label")} * len(ns)) as int) + 1] end from r join t on t.label = r.label)
select variant, label, name, count(*) as docs from v group by all"""


def _problems(spark, d):
    """The pools as they are, and with planted faults: a training name, a name of the other pool, a repeated one, a label left out."""
    names = _names(spark, d)
    wrong = names.filter("not (pool = 'unseen2' and label = 'phone')").unionByName(spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(p).alias("pool"), F.lit(x).alias("label"), F.lit(n).alias("name")) for p, x, n in (("unseen1", "card", "Email"), ("unseen1", "card", "both"), ("unseen2", "card", "Both"), ("unseen2", "email", "again"), ("unseen2", "ipv4", "AGAIN")))))))
    return name_problems(names).withColumn("pools", F.lit("given")).unionByName(name_problems(wrong).withColumn("pools", F.lit("wrong")))


_PROBLEMS = f"""with {_NAMES_SQL}, w as (select 'given' as pools, * from names union all select 'wrong', * from names where not (pool = 'unseen2' and label = 'phone') union all select 'wrong', unnest(['unseen1', 'unseen1', 'unseen2', 'unseen2', 'unseen2']), unnest(['card', 'card', 'card', 'email', 'ipv4']), unnest(['email', 'both', 'both', 'again', 'again'])),
h as (select * from w where pool <> 'training'), t as (select * from w where pool = 'training')
select distinct 'in training' as problem, name, pools from h where exists (select 1 from t where t.pools = h.pools and t.name = h.name) union all select 'in two pools', name, pools from h group by all having count(distinct pool) > 1
union all select 'twice in a pool', name, pools from h group by all having count(*) > count(distinct pool) union all select 'label without a held-out name', label, t.pools from (select distinct pools, label from t) t where (select count(distinct pool) from h where h.pools = t.pools and h.label = t.label) < 2"""


def _relation_sweep(spark, d):
    """Relations of order lines at three thresholds of the prediction's confidence: strict and lenient counts by relation, and F1."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    t = li.select(F.col("l_orderkey").alias("record"), F.col("l_returnflag").alias("relation"), nth.cast("long").alias("i"), F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("head"), F.concat(F.lit("supplier "), F.col("l_suppkey").cast("string")).alias("tail"))
    u = F.round(hash_uniform(61, F.col("record"), F.col("i")), 6)
    turned = u * 10 - F.floor(u * 10) < 0.3
    p = t.select("record", "relation", "i", F.when(turned, F.col("tail")).otherwise(F.col("head")).alias("head"), F.when(turned, F.col("head")).otherwise(F.col("tail")).alias("tail"), u.alias("u"))
    g = t.select("record", "relation", "i", F.array("head").alias("heads"), F.array("tail").alias("tails"))
    counts = match_counts(g, p, [0.2, 0.5, 0.8]).filter("relation is not null")
    both = counts.groupBy("threshold", "relation").agg(*(F.sum(c).alias(f"strict_{c}") for c in ("tp", "fp", "fn")), *(F.sum(f"lenient_{c}").alias(f"lenient_{c}") for c in ("tp", "fp", "fn")))
    f1 = lambda n: F.round(matching.ratio(2 * F.col(f"{n}_tp"), 2 * F.col(f"{n}_tp") + F.col(f"{n}_fp") + F.col(f"{n}_fn")), 9).alias(f"{n}_f1")
    return both.select("*", f1("strict"), f1("lenient"))


_RELATION_SWEEP = f"""with t as (select l_orderkey as record, l_returnflag as relation, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i, 'part ' || l_partkey as head, 'supplier ' || l_suppkey as tail from lineitem),
x as (select *, round({u_sql(61, "record || '|' || i")}, 6) as u, unnest([0.2, 0.5, 0.8]) as threshold from t),
p as (select record, relation, threshold, case when u * 10 - floor(u * 10) < 0.3 then tail else head end as head, case when u * 10 - floor(u * 10) < 0.3 then head else tail end as tail from x where u >= threshold),
gc as (select threshold, record, relation, head, tail, count(*) as n from x group by all), pc as (select threshold, record, relation, head, tail, count(*) as n from p group by all),
s as (select threshold, relation, sum(least(gc.n, pc.n)) as tp from gc join pc using (threshold, record, relation, head, tail) group by all),
gl as (select threshold, record, relation, least(head, tail) as a, greatest(head, tail) as b, count(*) as n from x group by all), pl as (select threshold, record, relation, least(head, tail) as a, greatest(head, tail) as b, count(*) as n from p group by all),
l as (select threshold, relation, sum(least(gl.n, pl.n)) as tp from gl join pl using (threshold, record, relation, a, b) group by all),
n as (select threshold, relation, count(*) as golds, count(*) filter (u >= threshold) as preds from x group by all)
select cast(threshold as double) as threshold, relation, cast(s.tp as bigint) as strict_tp, cast(preds - s.tp as bigint) as strict_fp, cast(golds - s.tp as bigint) as strict_fn, cast(l.tp as bigint) as lenient_tp, cast(preds - l.tp as bigint) as lenient_fp, cast(golds - l.tp as bigint) as lenient_fn,
  round(2 * s.tp / (preds + golds), 9) as strict_f1, round(2 * l.tp / (preds + golds), 9) as lenient_f1 from n join s using (threshold, relation) join l using (threshold, relation)"""


def _pages(spark, d):
    """BIO tags of documents by pages of 1,000 characters: an entity that goes on over the page's end begins anew there."""
    m = cut(gold(spark, d), "mentions")
    docs = documents(spark, d, "doc_id", "text").join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = docs.select("doc_id", F.length(F.regexp_extract("text", r"^[ \t\n\r\f\x0B]*", 0)).alias("lead"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*"), F.lit(0))).alias("pos", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (F.col("lead") + before).cast("int")
    page = lambda c: F.floor(c / 1000).cast("int")
    tokens = pieces.select("doc_id", page(start).alias("page"), "pos", start.alias("start"), (start + F.length(F.regexp_extract("piece", r"^[^ \t\n\r\f\x0B]+", 0))).alias("end"))
    # a token of the page before may reach over its end, so an entity also belongs to the page where such a token began
    parts = m.select("doc_id", "start", "end", "label", F.explode(F.sequence(F.greatest(page(F.col("start")) - 1, F.lit(0)), page(F.col("end") - 1))).alias("page"))
    tagged = spans.bio_encode(tokens, parts, ["doc_id", "page"])
    return tagged.groupBy("doc_id", "page", "tag").agg(F.count("*").alias("tokens"), F.min("pos").cast("bigint").alias("first_pos"))


_PAGES = f"""{_BIO}, paged as (select *, cast("start" // 1000 as int) as page from hit),
tags as (select doc_id, page, pos, case when ms is null then 'O' when lag(ms) over (partition by doc_id, page order by pos) = ms then 'I-' || label else 'B-' || label end as tag from paged)
select doc_id, page, tag, count(*) as tokens, cast(min(pos) as bigint) as first_pos from tags group by doc_id, page, tag"""


def _mix(spark, d):
    """Documents by the tasks they train (entities, classes, relations), with least, most, mean and upper median length.

    The upper median comes from running counts of lengths, so no group's lengths are gathered.
    """
    per = gold(spark, d).groupBy("doc_id").agg(F.count("*").alias("mentions"))
    labels = table(spark, d, "labels", "doc_id").distinct().withColumn("labelled", F.lit(True))
    docs = documents(spark, d, "doc_id", "n_chars").join(per, "doc_id", "left").join(labels, "doc_id", "left")
    tasks = F.array_join(F.filter(F.array(F.when(F.col("labelled"), "classes"), F.when(F.col("mentions") > 0, "entities"), F.when(F.col("mentions") > 1, "relations")), lambda x: x.isNotNull()), "+")
    mixed = cut(docs.select(F.when(tasks == "", "none").otherwise(tasks).alias("mix"), "n_chars"), "mix")
    counted = running_total(mixed.groupBy("mix", "n_chars").agg(F.count("*").alias("n")), ["mix"], ["n_chars"], "n", "upto")
    median = counted.filter("upto > floor(upto_all / 2)").groupBy("mix").agg(F.min("n_chars").alias("upper_median"))
    return mixed.groupBy("mix").agg(F.count("*").alias("docs"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"), F.round(F.avg("n_chars"), 6).alias("mean")).join(median, "mix")


_MIX = f"""with recursive {MENTIONS_SQL}, k as (select doc_id, count(*) as n from mentions group by 1), x as (select n_chars, array_to_string(list_filter([case when d.doc_id in (select doc_id from labels) then 'classes' end, case when n > 0 then 'entities' end, case when n > 1 then 'relations' end], lambda x: x is not null), '+') as mix from documents d left join k on k.doc_id = d.doc_id)
select case when mix = '' then 'none' else mix end as mix, count(*) as docs, min(n_chars) as least, max(n_chars) as most, round(avg(n_chars), 6) as mean, list_sort(list(n_chars))[count(*) // 2 + 1] as upper_median from x group by mix"""


def _typed(spark, d):
    """Mentions of documents as JSON text in a Parquet table, read back and taken apart."""
    path = new_folder(spark, "typed")
    nested = "array<struct<start:int,end:int,label:string,surface:string>>"
    m = gold(spark, d).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "label", "surface"))).alias("mentions"))
    writers.write_typed(documents(spark, d, "doc_id", "lang").join(m, "doc_id", "left"), path)
    back = readers.read_typed(spark, path, {"mentions": nested})
    return back.groupBy("lang").agg(F.count("*").alias("docs"), F.count("mentions").alias("with_mentions"), F.sum(F.coalesce(F.aggregate("mentions", F.lit(0), lambda a, s: a + s["end"] - s["start"]), F.lit(0))).alias("chars"))


_TYPED = f"""with recursive {MENTIONS_SQL}, m as (select doc_id, sum("end" - "start") as chars from mentions group by 1)
select lang, count(*) as docs, count(m.doc_id) as with_mentions, cast(coalesce(sum(chars), 0) as bigint) as chars from documents d left join m on m.doc_id = d.doc_id group by lang"""


def _clamped(spark, d):
    """Words of turns with a margin on both sides, trimmed to what is no white space and no mark at an edge; empty ones are no spans."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    wide = c.select("conv_id", "turn", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(9))).alias("at"))
    start, said = trim_span(F.col("at"), F.substring("text", F.col("at") + 1, F.lit(7)))
    kept = wide.select("conv_id", "turn", start.alias("start"), said.alias("said")).filter("said <> ''")
    return kept.groupBy("conv_id", "turn").agg(F.count("*").alias("spans"), F.sum("start").alias("starts"), F.sum(F.length("said")).alias("chars"))


_WS = r"[ \t\n\r\f\v]+"
_CLAMPED = rf"""with w as (select conv_id, turn, text, unnest(range(0, greatest(length(text) - 1, 0) + 1, 9)) as a from conversations), x as (select *, substr(text, a + 1, 7) as t from w),
l as (select *, regexp_replace(t, '^{_WS}', '') as lt from x), r as (select *, regexp_replace(regexp_replace(lt, '{_WS}$', ''), '[,.;:!?)\]}}"'']+$', '') as rt from l), f as (select *, regexp_replace(rt, '^[(\[{{"'']+', '') as ft from r),
k as (select conv_id, turn, a + length(t) - length(lt) + length(rt) - length(ft) as s, regexp_replace(ft, '{_WS}$', '') as said from f)
select conv_id, turn, count(*) as spans, cast(sum(s) as bigint) as starts, cast(sum(length(said)) as bigint) as chars from k where said <> '' group by all"""

ITEMS = {
    "eval_variants": Item(_variants, _VARIANTS),
    "variant_names": Item(_problems, _PROBLEMS),
    "relation_sweep": Item(_relation_sweep, _RELATION_SWEEP),
    "bio_pages": Item(_pages, _PAGES),
    "task_mix": Item(_mix, _MIX),
    "typed_parquet": Item(_typed, _TYPED),
    "span_clamp": Item(_clamped, _CLAMPED),
}
