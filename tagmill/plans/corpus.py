"""Queries on corpus building: duplicates, splits, samples, catalogues, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_order, hash_uniform
from tagmill.operators import corpus as c
from tagmill.operators.leakage import shared_passages
from tagmill.operators.ranking import ranked
from tagmill.plans import Item
from tagmill.plans.derived import documents, u_sql
from tagmill.sources import table


def _labelled(spark, d):
    """Labelled documents with a stratum of both labels."""
    labels = table(spark, d, "labels", "doc_id", "quality", "toxic")
    return documents(spark, d, "doc_id", "lang", "source", "n_chars").join(labels, "doc_id").withColumn("stratum", F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")))


_LABELLED = "l as (select d.doc_id, lang, source, n_chars, quality, toxic, quality || '/' || toxic as stratum from documents d join labels using (doc_id))"


def _ci(spark, d):
    return c.keep_first(documents(spark, d, "doc_id", "text").select("doc_id", F.md5(F.lower("text")).alias("k")), [F.col("k")], ["doc_id"]).select("doc_id")


def _conflict(spark, d):
    rows = documents(spark, d, "doc_id", "text").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.md5("text").alias("k"), F.concat_ws("/", F.col("quality").cast("string"), F.col("toxic").cast("string")).alias("tag"))
    return c.conflict_drop(rows, F.col("k"), F.col("tag"), "doc_id").select("doc_id", "tag")


_CONFLICT = "with r as (select d.doc_id, md5(text) as k, quality || '/' || toxic as tag from documents d join labels using (doc_id)), g as (select k, min(doc_id) as doc_id, count(distinct tag) as n from r group by k) select r.doc_id, r.tag from r join g using (doc_id) where n <= 1"


def _stratified(spark, d):
    s = c.stratified_split(_labelled(spark, d), "stratum", "doc_id", {"test": 0.1, "validation": 0.1})
    return s.select("doc_id", "stratum", "split")


def _quota_sql(name: str) -> str:
    return f"""e_{name} as (select stratum, size, floor(t * size / n) as f, round(t * size / n - floor(t * size / n), 9) as frac, t from (select stratum, size, sum(size) over () as n, cast(round_even(sum(size) over () * 0.1, 0) as bigint) as t from sizes)),
q_{name} as (select stratum, cast(f as bigint) + case when row_number() over (order by frac desc, stratum) <= t - sum(f) over () then 1 else 0 end as quota from e_{name})"""


_STRATIFIED = f"""with {_LABELLED}, sizes as (select stratum, count(*) as size from l group by stratum), {_quota_sql("test")}, {_quota_sql("val")},
r as (select doc_id, stratum, row_number() over (partition by stratum order by md5('42|' || doc_id), doc_id) as r from l)
select doc_id, r.stratum, case when r <= a.quota then 'test' when r <= a.quota + b.quota then 'validation' else 'train' end as split from r join q_test a on a.stratum = r.stratum join q_val b on b.stratum = r.stratum"""


def _group(spark, d):
    return c.group_split(_labelled(spark, d), "source", "lang", 0.2).select("doc_id", "lang", "source", "split")


_GROUP = f"""with {_LABELLED}, g as (select lang, source, count(*) as n from l group by all),
t as (select *, coalesce(sum(n) over (partition by lang order by md5('42|' || source), source rows between unbounded preceding and 1 preceding), 0) as before, round_even(sum(n) over (partition by lang) * 0.2, 0) as quota from g)
select doc_id, l.lang, l.source, case when before < quota then 'test' else 'train' end as split from l join t on l.lang = t.lang and l.source = t.source"""


def _ratio(spark, d):
    u = hash_uniform(42, F.col("doc_id"))
    return documents(spark, d, "doc_id").withColumn("split", F.when(u < 0.1, "test").when(u < 0.2, "validation").otherwise("train"))


_RATIO = f"select doc_id, case when {u_sql(42, 'doc_id')} < 0.1 then 'test' when {u_sql(42, 'doc_id')} < 0.2 then 'validation' else 'train' end as split from documents"


def _sources(spark, d):
    return documents(spark, d, "doc_id", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


_SOURCES = "s as (select lang, source, count(*) as n, min(doc_id) as first_doc from documents group by all)"


def _round_robin(spark, d):
    return c.round_robin(_sources(spark, d), "lang", "n", "source", 30).select("lang", "source", "n", "turn")


_ROUND = f"with {_SOURCES}, t as (select *, cast(row_number() over (partition by lang order by n desc, md5('42|' || source), source) as int) as turn from s) select lang, source, n, turn from t order by turn, lang limit 30"


def _weighted(spark, d):
    return c.weighted_choice(_sources(spark, d), ["lang"], "n", "source").select("lang", "source", "n")


_WEIGHTED = f"with {_SOURCES} select lang, source, n from (select *, row_number() over (partition by lang order by -ln(1 - {u_sql(42, 'source')}) / n, source) as r from s) where r = 1"


def _negative_types(spark, d):
    """For each user with events of high value, one event type among the absent ones, chosen by hash."""
    e = table(spark, d, "events", "user_id", "event_type", "value").filter("value > 90")
    have = e.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    types = e.agg(F.sort_array(F.collect_set("event_type")).alias("types"))  # the vocabulary, one row
    absent = c.with_row(have, types).select("user_id", F.explode(F.array_except("types", "have")).alias("event_type"))
    return c.keep_first(absent.withColumn("h", hash_order(7, F.col("user_id"), F.col("event_type"))), [F.col("user_id")], ["h", "event_type"]).select("user_id", "event_type")


_NEGATIVE = """with e as (select * from events where value > 90), u as (select distinct user_id from e), t as (select distinct event_type from e), a as (select user_id, event_type from u, t except select user_id, event_type from e)
select user_id, event_type from (select *, row_number() over (partition by user_id order by md5('7|' || user_id || '|' || event_type), event_type) as r from a) where r = 1"""


def _aliases(spark, d):
    u = hash_uniform(9, F.col("doc_id"), F.col("lang"))
    names = F.create_map(*(F.lit(x) for k, vs in {"en": ("english", "anglais"), "fr": ("french", "francais"), "de": ("german", "allemand"), "es": ("spanish", "espagnol")}.items() for x in (k, "|".join(vs))))
    alias = F.element_at(F.split(F.element_at(names, F.col("lang")), r"\|"), (F.floor(u * 1000) % 2 + 1).cast("int"))
    return documents(spark, d, "doc_id", "lang").withColumn("name", F.when(u < 0.5, F.col("lang")).otherwise(alias))


_ALIASES = f"""with a as (select doc_id, lang, {u_sql(9, "doc_id || '|' || lang")} as u from documents)
select doc_id, lang, case when u < 0.5 then lang else case lang when 'en' then ['english', 'anglais'] when 'fr' then ['french', 'francais'] when 'de' then ['german', 'allemand'] when 'es' then ['spanish', 'espagnol'] end[cast(floor(u * 1000) as int) % 2 + 1] end as name from a"""


def _batches(spark, d):
    return c.length_batches(documents(spark, d, "doc_id", "n_chars"), "n_chars", "doc_id", batch=16, pool=8).select("doc_id", "pool", "batch")


_BATCHES = f"""with p as (select doc_id, n_chars, cast(floor({u_sql(42, 'doc_id')} * greatest(1, (select cast(ceil(count(*) / 128.0) as int) from documents))) as int) as pool from documents)
select doc_id, pool, cast(floor((row_number() over (partition by pool order by n_chars, doc_id) - 1) / 16) as int) as batch from p"""


def _collapse(spark, d):
    rows = documents(spark, d, "doc_id", "lang", "source", "n_chars").withColumn("size_class", F.floor(F.log10(F.col("n_chars") + 1)).cast("int"))
    return c.catalogue_collapse(rows, ["lang", "source"], ["n_chars"], ["size_class"], "doc_id")


_COLLAPSE = """with r as (select doc_id, lang, source, n_chars, cast(floor(log10(n_chars + 1)) as int) as size_class from documents),
m as (select lang, source, size_class, row_number() over (partition by lang, source order by count(*) desc, min(doc_id)) as k from r group by lang, source, size_class)
select g.lang, g.source, g.n_chars, g.n, m.size_class from (select lang, source, arg_min(n_chars, doc_id) as n_chars, count(*) as n from r group by lang, source) g join m on m.lang = g.lang and m.source = g.source and m.k = 1"""


def _fresh(spark, d):
    """Sources of long documents that have no toxic label."""
    docs = documents(spark, d, "doc_id", "source", "n_chars")
    long_ = docs.filter("n_chars > 8000").select("source").distinct()
    toxic = docs.join(table(spark, d, "labels").filter("toxic = 1").select("doc_id"), "doc_id").select("source").distinct()
    return long_.join(toxic, "source", "left_anti")


_FRESH = "select distinct source from documents where n_chars > 8000 and source not in (select source from documents d join labels l using (doc_id) where toxic = 1)"


def _diff(spark, d):
    docs = documents(spark, d, "doc_id", "lang", "source")
    old = docs.filter("doc_id % 2 = 0").groupBy("lang", "source").agg(F.count("*").alias("n_old"))
    new = docs.filter("doc_id % 2 = 1").groupBy("lang", "source").agg(F.count("*").alias("n_new"))
    both = old.join(new, ["lang", "source"], "full_outer")
    status = F.when(F.col("n_old").isNull(), "added").when(F.col("n_new").isNull(), "removed").when(F.col("n_old") == F.col("n_new"), "same").otherwise("changed")
    return both.select("lang", "source", F.coalesce("n_old", F.lit(0)).alias("n_old"), F.coalesce("n_new", F.lit(0)).alias("n_new"), status.alias("status"))


_DIFF = """with o as (select lang, source, count(*) as n_old from documents where doc_id % 2 = 0 group by all), n as (select lang, source, count(*) as n_new from documents where doc_id % 2 = 1 group by all)
select coalesce(o.lang, n.lang) as lang, coalesce(o.source, n.source) as source, coalesce(n_old, 0) as n_old, coalesce(n_new, 0) as n_new, case when n_old is null then 'added' when n_new is null then 'removed' when n_old = n_new then 'same' else 'changed' end as status from o full join n on o.lang = n.lang and o.source = n.source"""


def _buckets(spark, d):
    """Bucket precedence over four sources of records, then counts by bucket and stage."""
    docs = documents(spark, d, "doc_id")
    source = lambda name, cond: docs.filter(cond).select("doc_id", F.lit(True).alias(name))
    j = docs
    for name, cond in _BUCKET_SOURCES.items():
        j = j.join(source(name, cond), "doc_id", "left")
    stage = F.coalesce(*(F.when(F.col(n), F.lit(f"{b}/{s}")) for n, b, s in _BUCKET_ORDER), F.lit("missing/gen"))
    parts = F.split(stage, "/")
    return j.groupBy(parts[0].alias("bucket"), parts[1].alias("stage")).agg(F.count("*").alias("n"))


_BUCKET_SOURCES = {"sexfix": "doc_id % 13 = 0", "first": "doc_id % 2 = 0", "repaired": "doc_id % 3 = 0", "repair_flagged": "doc_id % 5 = 0", "repair_rejected": "doc_id % 7 = 0", "flagged": "doc_id % 11 = 0", "rejected": "doc_id % 17 = 0"}
_BUCKET_ORDER = (("sexfix", "accepted", "sexfix"), ("first", "accepted", "gen"), ("repaired", "accepted", "repair"), ("repair_flagged", "flagged", "repair"), ("repair_rejected", "discarded", "repair"), ("flagged", "flagged", "gen"), ("rejected", "discarded", "gen"))
_BUCKETS = "with b as (select case " + " ".join(f"when {_BUCKET_SOURCES[n]} then ['{b}', '{s}']" for n, b, s in _BUCKET_ORDER) + " else ['missing', 'gen'] end as b from documents) select b[1] as bucket, b[2] as stage, count(*) as n from b group by all"


def _router(spark, d):
    """Problems of a document route it: any hard one rejects, only flags flag, none accepts."""
    docs = documents(spark, d, "doc_id", "text", "n_chars")
    problems = F.filter(F.array(F.when(F.col("n_chars") < 200, "short: text"), F.when(F.col("text").contains("%%%"), "FLAG symbols: text"), F.when(F.col("text").contains("!!"), "FLAG shouting: text"), F.when(F.col("n_chars") > 20000, "long: text")), lambda x: x.isNotNull())
    hard = F.exists(problems, lambda x: ~x.startswith("FLAG"))
    routed = docs.select("doc_id", problems.alias("problems"), F.when(hard, "reject").when(F.size(problems) > 0, "flag").otherwise("accept").alias("route"))
    reasons = routed.select("route", F.explode_outer("problems").alias("p"))
    return reasons.groupBy("route", F.coalesce(F.split_part("p", F.lit(":"), F.lit(1)), F.lit("none")).alias("reason")).agg(F.count("*").alias("n"))


_ROUTER = """with p as (select doc_id, list_filter([case when n_chars < 200 then 'short: text' end, case when contains(text, '%%%') then 'FLAG symbols: text' end, case when contains(text, '!!') then 'FLAG shouting: text' end, case when n_chars > 20000 then 'long: text' end], lambda x: x is not null) as p from documents),
r as (select *, case when len(list_filter(p, lambda x: not starts_with(x, 'FLAG'))) > 0 then 'reject' when len(p) > 0 then 'flag' else 'accept' end as route from p)
select route, coalesce(split_part(x, ':', 1), 'none') as reason, count(*) as n from (select route, unnest(case when len(p) = 0 then [null] else p end) as x from r) group by all"""


def _audit(spark, d):
    """Offered and expressed by event type; broken where at least 50 were offered and under 2 % expressed, or 10 and under half for the named."""
    e = table(spark, d, "events", "event_type", "value", "user_id")
    g = e.groupBy("event_type").agg(F.count("*").alias("offered"), F.count(F.when(F.col("value") > 90, 1)).alias("expressed"), F.count(F.when(F.col("user_id") % 10 == 0, 1)).alias("named"))
    rate = F.col("expressed") / F.col("offered")
    return g.withColumn("pool_broken", (F.col("offered") >= 50) & (rate < 0.02)).withColumn("named_broken", (F.col("named") >= 10) & (F.col("expressed") / F.col("named") < 0.5))


_AUDIT = """with g as (select event_type, count(*) as offered, count(*) filter (value > 90) as expressed, count(*) filter (user_id % 10 = 0) as named from events group by event_type)
select *, offered >= 50 and expressed / offered < 0.02 as pool_broken, named >= 10 and coalesce(expressed / nullif(named, 0) < 0.5, false) as named_broken from g"""


def _leak(spark, d):
    """Documents that hold a benchmark item's five words in a row, with the numbers of items and of passages."""
    shared = shared_passages(documents(spark, d, "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text"), "doc_id", "item_id")
    return shared.groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"), F.count_distinct("said").alias("shared"))


_SH = "trim(regexp_replace(lower(translate(text, chr(10) || chr(9) || chr(13), '   ')), ' +', ' ', 'g'))"
_LEAK = f"""with b as (select item_id, string_split({_SH}, ' ') as w from benchmark), c as (select doc_id, string_split({_SH}, ' ') as w from documents),
bs as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from b where len(w) >= 5),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) as s from c where len(w) >= 5)
select doc_id, count(distinct item_id) as items, count(distinct s) as shared from ds join bs using (s) group by doc_id"""


def _resume(spark, d):
    e = table(spark, d, "events", "event_id", "event_type")
    done = e.filter("event_id % 3 = 0 and event_id % 9 <> 0").select("event_id")
    return e.join(done, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("left_to_do"))


def _review(spark, d):
    """Review files of 50 documents a language, in doc_id order: counted inside the language."""
    placed = ranked(documents(spark, d, "doc_id", "lang"), ["lang"], ["doc_id"])
    return placed.withColumn("file", F.floor((F.col("rank") - 1) / 50).cast("int")).groupBy("lang", "file").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


ITEMS = {
    "ci_dedup_keep_first": Item(_ci, "select min(doc_id) as doc_id from documents group by md5(lower(text))"),
    "conflict_drop": Item(_conflict, _CONFLICT),
    "stratified_split": Item(_stratified, _STRATIFIED),
    "group_disjoint_split": Item(_group, _GROUP),
    "ratio_split": Item(_ratio, _RATIO),
    "round_robin_sample": Item(_round_robin, _ROUND),
    "weighted_choice": Item(_weighted, _WEIGHTED),
    "negative_type_sample": Item(_negative_types, _NEGATIVE),
    "alias_augment": Item(_aliases, _ALIASES),
    "length_grouped_batches": Item(_batches, _BATCHES),
    "catalogue_collapse": Item(_collapse, _COLLAPSE),
    "catalogue_fresh": Item(_fresh, _FRESH),
    "catalogue_diff": Item(_diff, _DIFF),
    "bucket_precedence": Item(_buckets, _BUCKETS),
    "accept_flag_reject": Item(_router, _ROUTER),
    "audit_gate": Item(_audit, _AUDIT),
    "benchmark_leak": Item(_leak, _LEAK),
    "resume_left_anti": Item(_resume, "select event_type, count(*) as left_to_do from events where not (event_id % 3 = 0 and event_id % 9 <> 0) group by event_type"),
    "review_chunks": Item(_review, "select lang, file, min(doc_id) as first_doc, count(*) as n from (select lang, doc_id, cast(floor((row_number() over (partition by lang order by doc_id) - 1) / 50) as int) as file from documents) group by all"),
}
