"""Queries on further statistics, reports, pickers and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import reports as r
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, PREDICTIONS_SQL, documents, gold, predictions, u_sql
from tagmill.sources import table
from tagmill.written import cut


def _schemas(spark, d):
    """Orders grouped by the set of line states they declare, numbered by first order."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linestatus").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("labels"))
    return r.schema_groups(li, "labels", "l_orderkey").select("labels", "n", "first", "nth")


_SCHEMAS = """with o as (select l_orderkey as k, array_to_string(list_sort(list(distinct l_returnflag || l_linestatus)), ',') as labels from lineitem group by 1)
select labels, count(*) as n, min(k) as first, row_number() over (order by min(k)) as nth from o group by labels"""


def _tiers(spark, d):
    """Mentions and distinct documents by source within a language, a language, and all."""
    docs = documents(spark, d, "doc_id", "lang", "source", "n_chars")
    out = docs.withColumn("group", F.substring("source", -1, 1)).rollup("lang", "group").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"), F.sum("n_chars").alias("chars"))
    return out.select(F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce("group", F.lit("all")).alias("group"), "mentions", "docs", "chars")


def _strata(spark, d):
    docs = documents(spark, d, "doc_id", "lang", "n_chars").withColumn("hard", F.col("n_chars") > 3000).withColumn("split", F.when(hash_uniform(42, F.col("doc_id")) < 0.2, "test").otherwise("train"))
    return docs.cube("split", "lang", "hard").agg(F.count("*").alias("n")).select(F.coalesce("split", F.lit("all")).alias("split"), F.coalesce("lang", F.lit("all")).alias("lang"), F.coalesce(F.col("hard").cast("string"), F.lit("all")).alias("hard"), "n")


_STRATA = f"""with d as (select lang, n_chars > 3000 as hard, case when {u_sql(42, 'doc_id')} < 0.2 then 'test' else 'train' end as split from documents)
select coalesce(split, 'all') as split, coalesce(lang, 'all') as lang, coalesce(cast(hard as varchar), 'all') as hard, count(*) as n from d group by cube (split, lang, hard)"""


def _reviews(spark, d):
    """Turns reviewed twice: five-point scores, a verdict and an issue with a quote that may not stand in the text."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    score = lambda s: (F.floor(hash_uniform(s, F.col("conv_id"), F.col("turn")) * 5) + 1).cast("int")
    quote = F.when(F.col("turn") % 2 == 0, F.substring("text", 3, 12)).otherwise(F.lit("not there at all"))
    rows = c.select("text", F.explode(F.array(F.struct(F.lit("a").alias("reviewer"), score(61).alias("score"), quote.alias("quote")), F.struct(F.lit("b").alias("reviewer"), score(62).alias("score"), F.lit(None).cast("string").alias("quote")))).alias("r"), F.concat_ws(":", "conv_id", "turn").alias("item")).select("item", "text", "r.*")
    return r.review_summary(rows, "item")


_REVIEWS = f"""with c as (select text, turn, floor({u_sql(61, "conv_id || '|' || turn")} * 5) + 1 as a, floor({u_sql(62, "conv_id || '|' || turn")} * 5) + 1 as b, case when turn % 2 = 0 then substr(text, 3, 12) else 'not there at all' end as q from conversations)
select count(*) as items, 2 * count(*) as reviews, round(avg((a + b) / 2), 9) as mean_score, round(avg(case when abs(a - b) <= 1 then 1.0 else 0.0 end), 9) as within_one, count(q) filter (q <> '') as quotes, count(*) filter (q <> '' and contains(text, q)) as quotes_found from c"""


def _recalls(spark, d):
    """Share of gold spans predicted with any label, and whose start or end at least is; and exact counts."""
    g = cut(gold(spark, d).select("doc_id", "start", "end", "label"), "gold")
    p = predictions(gold(spark, d)).select("doc_id", "start", "end", "label")
    out = r.boundary_recall(g, cut(p, "pred"), ["doc_id"])
    return out.select("gold", "pred", "both", *(F.round(c, 9).alias(c) for c in ("span_recall", "start_recall", "end_recall")))


_RECALLS = f"""with recursive {PREDICTIONS_SQL}, g as (select distinct doc_id, "start" as s, "end" as e from mentions), p as (select distinct doc_id, "start" as s, "end" as e from preds),
x as (select g.*, exists (select 1 from p where p.doc_id = g.doc_id and p.s = g.s and p.e = g.e) as b, exists (select 1 from p where p.doc_id = g.doc_id and p.s = g.s) as bs, exists (select 1 from p where p.doc_id = g.doc_id and p.e = g.e) as be from g)
select count(*) as gold, (select count(*) from p) as pred, count(*) filter (b) as both, round(coalesce(count(*) filter (b) / nullif(count(*), 0), 0), 9) as span_recall, round(coalesce(count(*) filter (bs) / nullif(count(*), 0), 0), 9) as start_recall, round(coalesce(count(*) filter (be) / nullif(count(*), 0), 0), 9) as end_recall from x"""


def _histogram(spark, d):
    """Documents by their number of lines: a histogram by powers of two, and the twenty with most."""
    n = documents(spark, d, "doc_id", "text").select("doc_id", F.size(F.split("text", "\n", -1)).alias("n"))
    hist = n.groupBy(F.floor(F.log2(F.col("n"))).cast("int").alias("class")).agg(F.count("*").alias("docs"), F.max("n").alias("most")).select("class", "docs", "most", F.lit(None).cast("bigint").alias("doc_id"))
    top = n.orderBy(F.desc("n"), "doc_id").limit(20).select(F.lit(-1).alias("class"), F.lit(1).cast("bigint").alias("docs"), F.col("n").alias("most"), "doc_id")
    return hist.unionByName(top).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)))


_HISTOGRAM = """with n as (select doc_id, len(string_split(text, chr(10))) as n from documents)
select cast(floor(log2(n)) as int) as class, count(*) as docs, cast(max(n) as int) as most, -1 as doc_id from n group by 1 union all select * from (select -1, 1, cast(n as int), doc_id from n order by n desc, doc_id limit 20)"""


def _capacity(spark, d):
    m = gold(spark, d).groupBy("doc_id", "label").agg(F.count_distinct("surface").alias("n"))
    return m.groupBy("label").agg(F.max("n").alias("most"), F.count_if(F.col("n") > 3).alias("over"), F.count("*").alias("docs"))


def _pivot(spark, d):
    """Mean length by source group and language, a column a language, best first."""
    docs = documents(spark, d, "doc_id", "lang", "source", "n_chars").withColumn("model", F.substring("source", -1, 1))
    return r.leaderboard(docs, "model", "lang", ["de", "en", "es", "fr"], "n_chars")


_PIVOT = """with m as (select right(source, 1) as model, round(avg(n_chars) filter (lang = 'de'), 4) as de, round(avg(n_chars) filter (lang = 'en'), 4) as en, round(avg(n_chars) filter (lang = 'es'), 4) as es, round(avg(n_chars) filter (lang = 'fr'), 4) as fr, round(avg(n_chars), 4) as overall from documents group by 1)
select model, coalesce(de, 0) as de, coalesce(en, 0) as en, coalesce(es, 0) as es, coalesce(fr, 0) as fr, overall, cast(row_number() over (order by overall desc, model) as int) as place from m"""


def _names(spark, d):
    """Part names by brand: how many hold one kind of vowel, several, or none, and how many names there are."""
    p = table(spark, d, "part", "p_brand", "p_name")
    kinds = sum((F.col("p_name").rlike(v).cast("int") for v in "aeiou"), F.lit(0))
    return p.groupBy("p_brand").agg(F.count_if(kinds == 1).alias("plain"), F.count_if(kinds > 1).alias("mixed"), F.count_distinct("p_name").alias("names"))


def _pickers(spark, d):
    """One document for each of four titles, none twice: the longest, the shortest, the one with most digits, the one with most lines."""
    docs = documents(spark, d, "doc_id", "text", "n_chars").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^0-9]", "")).alias("digits"), F.size(F.split("text", "\n", -1)).alias("lines"))
    return r.pick_examples(docs, {"longest": F.desc("n_chars"), "shortest": F.asc("n_chars"), "digits": F.desc("digits"), "lines": F.desc("lines")}, "doc_id")


_PICKERS = """with x as (select doc_id, n_chars, length(regexp_replace(text, '[^0-9]', '', 'g')) as digits, len(string_split(text, chr(10))) as lines from documents),
a as (select doc_id from x order by n_chars desc, doc_id limit 1), b as (select doc_id from x where doc_id not in (select doc_id from a) order by n_chars, doc_id limit 1), c as (select doc_id from x where doc_id not in (select doc_id from a union all select doc_id from b) order by digits desc, doc_id limit 1)
select 'longest' as title, doc_id from a union all select 'shortest', doc_id from b union all select 'digits', doc_id from c union all select * from (select 'lines', doc_id from x where doc_id not in (select doc_id from a union all select doc_id from b union all select doc_id from c) order by lines desc, doc_id limit 1)"""


def _sound(spark, d):
    """Of each language: sources under a floor of three documents, and its documents by thousands of characters, however many."""
    docs = documents(spark, d, "doc_id", "lang", "source", "n_chars")
    per = docs.groupBy("lang", "source").agg(F.count("*").alias("n"))
    floors = per.groupBy("lang").agg(F.count_if(F.col("n") < 3).alias("under_floor"), F.count("*").alias("sources"))
    hist = docs.groupBy("lang", F.floor(F.col("n_chars") / 1000).alias("thousand")).agg(F.count("*").alias("docs"))
    return floors.join(hist, "lang")


ITEMS = {
    "schema_groups": Item(_schemas, _SCHEMAS),
    "tier_rollup": Item(_tiers, "select coalesce(lang, 'all') as lang, coalesce(g, 'all') as \"group\", count(*) as mentions, count(distinct doc_id) as docs, cast(sum(n_chars) as bigint) as chars from (select *, right(source, 1) as g from documents) group by rollup (lang, g)"),
    "split_strata": Item(_strata, _STRATA),
    "review_summary": Item(_reviews, _REVIEWS),
    "boundary_recall": Item(_recalls, _RECALLS),
    "line_histogram": Item(_histogram, _HISTOGRAM),
    "capacity_counts": Item(_capacity, f"with recursive {MENTIONS_SQL}, n as (select doc_id, label, count(distinct surface) as n from mentions group by all) select label, max(n) as most, count(*) filter (n > 3) as over, count(*) as docs from n group by label"),
    "leaderboard_pivot": Item(_pivot, _PIVOT),
    "name_mix": Item(_names, "with k as (select p_brand, p_name, len(list_filter(['a', 'e', 'i', 'o', 'u'], lambda v: contains(p_name, v))) as k from part) select p_brand, count(*) filter (k = 1) as plain, count(*) filter (k > 1) as mixed, count(distinct p_name) as names from k group by 1"),
    "example_pickers": Item(_pickers, _PICKERS),
    "sampler_soundness": Item(_sound, "with p as (select lang, source, count(*) as n from documents group by all), f as (select lang, count(*) filter (n < 3) as under_floor, count(*) as sources from p group by lang) select f.*, h.* exclude (lang) from f join (select lang, n_chars // 1000 as thousand, count(*) as docs from documents group by all) h using (lang)"),
}
