"""Queries on further samples, splits and deals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import corpus as c
from tagmill.operators.balance import least_used
from tagmill.plans import Item
from tagmill.plans.derived import documents, u_sql
from tagmill.sources import table
from tagmill.written import cut


def _sorted_sample(spark, d):
    return c.seeded_sample(documents(spark, d, "doc_id", "lang"), "doc_id", 25)


def _quotas(spark, d):
    """A fixed number from each (language, length class): shares of 60, none over its class."""
    docs = documents(spark, d, "doc_id", "lang", "n_chars").withColumn("cell", F.concat_ws("/", F.col("lang"), F.when(F.col("n_chars") > 3000, "long").otherwise("short")))
    q = c.capped_remainder(docs.groupBy("cell").agg(F.count("*").alias("size")), "size", F.lit(60).cast("bigint"), "cell")
    return c.quota_sample(docs.select("doc_id", "cell"), "cell", "doc_id", q, seed=7)


_QUOTAS = """with x as (select doc_id, lang || '/' || case when n_chars > 3000 then 'long' else 'short' end as cell from documents), s as (select cell, count(*) as n from x group by 1),
e as (select *, floor(60 * n / sum(n) over ()) as f, round(60 * n / sum(n) over () - floor(60 * n / sum(n) over ()), 9) as r from s),
q as (select cell, least(n, cast(f as bigint) + case when row_number() over (order by r desc, cell) <= 60 - sum(f) over () then 1 else 0 end) as quota from e)
select doc_id, cell from (select doc_id, cell, row_number() over (partition by cell order by md5('7|' || doc_id), doc_id) as k from x) join q using (cell) where k <= quota"""


def _precedence(spark, d):
    """A review set: twelve long documents, eight shouting ones, six with a digit, the rest any, thirty together."""
    docs = documents(spark, d, "doc_id", "n_chars", "text").select("doc_id", (F.col("n_chars") > 4000).alias("long"), F.contains("text", F.lit("!")).alias("loud"), F.col("text").rlike("[0-9]").alias("digits"))
    return c.precedence_quotas(docs, {"long": (F.col("long"), 12), "loud": (F.col("loud"), 8), "digits": (F.col("digits"), 6)}, "doc_id", 30).select("doc_id", "picked_for")


_PRECEDENCE = """with d as (select doc_id, n_chars > 4000 as a, contains(text, '!') as b, regexp_matches(text, '[0-9]') as c, md5('42|' || doc_id) as h from documents),
x as (select doc_id from d where a order by h, doc_id limit 12), y as (select doc_id from d where b and doc_id not in (select doc_id from x) order by h, doc_id limit 8),
z as (select doc_id from d where c and doc_id not in (select doc_id from x union all select doc_id from y) order by h, doc_id limit 6), t as (select doc_id, 'long' as picked_for from x union all select doc_id, 'loud' from y union all select doc_id, 'digits' from z),
f as (select doc_id, row_number() over (order by h, doc_id) as k from d where doc_id not in (select doc_id from t))
select * from t union all select doc_id, 'fill' from f where k <= 30 - (select count(*) from t)"""


def _reuse(spark, d):
    s = documents(spark, d, "doc_id", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n")).filter("n > 2")
    return c.round_robin_reused(s, "lang", "n", "source", 80, 3)


_REUSE = """with s as (select lang, source, count(*) as n from documents group by all having count(*) > 2), t as (select *, row_number() over (partition by lang order by n desc, md5('42|' || source), source) as k, count(*) over (partition by lang) as own from s),
u as (select lang, source, n, cast(u as int) as use, k + u * own as turn from t, range(3) r(u)), p as (select lang, source, n, use, cast(row_number() over (order by turn, lang) as int) as pick from u)
select * from p where pick <= 80"""


def _renamed(spark, d):
    """Label maps of documents with names flipped to aliases by hash."""
    docs = documents(spark, d, "doc_id", "lang", "source")
    values = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"))
    names = F.create_map(F.lit("lang"), F.array(F.lit("language"), F.lit("tongue")), F.lit("source"), F.array(F.lit("origin")))
    return docs.select("doc_id", F.explode(c.rename_keys(values, names, 15, F.col("doc_id"), 0.4)).alias("name", "value"))


def _renamed_sql(name: str, names: str) -> str:
    u = u_sql(15, f"doc_id || '|{name}'")
    return f"select doc_id, case when {u} < 0.4 then '{name}' else {names}[cast(floor({u} * 1000003) % len({names}) as int) + 1] end as name, {name} as value from documents"


_RENAMED = _renamed_sql("lang", "['language', 'tongue']") + " union all " + _renamed_sql("source", "['origin']")


def _expand(spark, d):
    """Every event type of the vocabulary for each user: those the user lacks with no value."""
    e = table(spark, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("value"))
    types = e.agg(F.sort_array(F.collect_set("event_type")).alias("types"))
    have = c.with_row(e.groupBy("user_id").agg(F.collect_set("event_type").alias("have")), types)
    absent = have.select("user_id", F.explode(F.array_except("types", "have")).alias("event_type")).withColumn("value", F.lit(None).cast("double"))
    return e.unionByName(absent).groupBy("event_type").agg(F.count("value").alias("there"), F.count_if(F.col("value").isNull()).alias("absent"))


def _shards(spark, d):
    return c.rank_shards(documents(spark, d, "doc_id", "n_chars"), ["n_chars", "doc_id"], 7).groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _spread(spark, d):
    """Each document with one of the sources of its language, dealt so that these are used evenly."""
    docs = documents(spark, d, "doc_id", "lang", "source")
    options = docs.groupBy("lang").agg(F.collect_set("source").alias("options"))
    return least_used(docs.join(options, "lang"), "options", "doc_id", ["lang"]).select("doc_id", "lang", "chosen")


_SPREAD = """with o as (select lang, source, cast(row_number() over (partition by lang order by source) as int) as place, count(*) over (partition by lang) as k from (select distinct lang, source from documents)),
n as (select lang, count(*) as n from documents group by lang), x as (select o.lang, source, sum(n // k + case when place <= n % k then 1 else 0 end) over (partition by o.lang order by place) as upto, n // k + case when place <= n % k then 1 else 0 end as x from o join n using (lang)),
r as (select doc_id, lang, row_number() over (partition by lang order by md5('42|' || doc_id), doc_id) as r from documents)
select doc_id, r.lang, source as chosen from r join x on x.lang = r.lang and r.r <= upto and r.r > upto - x"""


def _least_used(spark, d):
    """For each order one of the depots of its own lines, inside its priority: the most and the least that a depot is used, and the greatest lead over a depot that the same orders could have taken."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.collect_set((F.col("l_suppkey") % 7).cast("string")).alias("depots"))
    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    rows = o.join(li, o["o_orderkey"] == li["l_orderkey"]).select("o_orderkey", "o_orderpriority", "depots")
    dealt = cut(least_used(rows, "depots", "o_orderkey", ["o_orderpriority"]), "dealt")
    uses = dealt.groupBy("o_orderpriority", F.col("chosen").alias("depot")).agg(F.count("*").alias("n"))
    classes = dealt.groupBy("o_orderpriority", "depots", "chosen").agg(F.count("*").alias("orders"))
    each = classes.select("o_orderpriority", "chosen", "orders", F.explode("depots").alias("depot")).join(uses, ["o_orderpriority", "depot"], "left").na.fill(0, ["n"])
    led = each.join(uses.withColumnsRenamed({"depot": "chosen", "n": "used"}), ["o_orderpriority", "chosen"])
    return led.groupBy("o_orderpriority").agg(F.sum(F.when(F.col("depot") == F.col("chosen"), F.col("orders"))).alias("orders"), F.max("n").alias("most"), F.min("n").alias("least"), F.max(F.col("used") - F.col("n")).alias("lead"))


# Whatever is dealt, the depots of a set T carry the orders that have no other depot, and no more than those that have one of T.
_LEAST_USED = """with s as (select o_orderpriority, o_orderkey, bit_or(1 << cast(l_suppkey % 7 as int)) as mask from orders join lineitem on l_orderkey = o_orderkey group by all), c as (select o_orderpriority, mask, count(*) as n from s group by all),
t as (select unnest(range(1, 128)) as t), u as (select o_orderpriority, t, sum(n) filter ((mask & ~t) = 0) as inside, sum(n) filter ((mask & t) <> 0) as touching from c, t group by all)
select o_orderpriority, cast(max(touching) as bigint) as orders, cast(max(ceil(coalesce(inside, 0) / bit_count(t))) as bigint) as most, cast(min(floor(touching / bit_count(t))) as bigint) as least, case when max(ceil(coalesce(inside, 0) / bit_count(t))) > min(floor(touching / bit_count(t))) then 1 else 0 end as lead from u group by o_orderpriority"""


def _leaks(spark, d):
    """Evaluation variants: names that training may see and names it must not; what both hold is counted."""
    docs = documents(spark, d, "doc_id", "source", "lang").withColumn("part", F.when(hash_uniform(14, F.col("doc_id")) < 0.2, "unseen").otherwise("seen"))
    name = F.when((F.col("part") == "seen") & (F.col("doc_id") % 3 == 0), F.concat("source", F.lit("-alias"))).otherwise(F.col("source"))
    names = docs.select("lang", "part", name.alias("name")).distinct().groupBy("lang", "name").agg(F.count_distinct("part").alias("parts"))
    return names.groupBy("lang").agg(F.count("*").alias("names"), F.count_if(F.col("parts") > 1).alias("in_both"))


_LEAKS = f"""with d as (select lang, doc_id, source, case when {u_sql(14, 'doc_id')} < 0.2 then 'unseen' else 'seen' end as part from documents), n as (select lang, case when part = 'seen' and doc_id % 3 = 0 then source || '-alias' else source end as name, count(distinct part) as parts from d group by all)
select lang, count(*) as names, count(*) filter (parts > 1) as in_both from n group by lang"""

ITEMS = {
    "sorted_sample": Item(_sorted_sample, "select doc_id, lang from documents order by md5('42|' || doc_id), doc_id limit 25"),
    "quota_sample": Item(_quotas, _QUOTAS),
    "precedence_quotas": Item(_precedence, _PRECEDENCE),
    "round_robin_reused": Item(_reuse, _REUSE),
    "alias_flip": Item(_renamed, _RENAMED),
    "schema_expansion": Item(_expand, "with u as (select count(distinct user_id) as n from events), t as (select event_type, count(distinct user_id) as there from events group by 1) select event_type, there, n - there as absent from t, u"),
    "rank_shards": Item(_shards, "select cast((r - 1) % 7 as int) as shard, count(*) as n, cast(sum(n_chars) as bigint) as chars from (select n_chars, row_number() over (order by n_chars, doc_id) as r from documents) group by 1"),
    "spread_choice": Item(_spread, _SPREAD),
    "least_used_options": Item(_least_used, _LEAST_USED),
    "variant_leaks": Item(_leaks, _LEAKS),
}
