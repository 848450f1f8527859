"""Queries on constraints, statistics, embeddings, merges and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import graph, matching
from tagmill.operators.constraints import at_least_level, cardinality, excludes, iff, implies
from tagmill.operators.corpus import beside, with_row
from tagmill.operators.ranking import ranked
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.sources import table
from tagmill.written import cut


def _kleene(spark, d):
    """Three-valued constraints over labels, of which the outer join leaves some unknown."""
    rows = documents(spark, d, "doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    q, x, long_ = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") > 3000
    said = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return rows.select("doc_id", said(implies(x, ~q)).alias("toxic_implies_bad"), said(excludes(q, x)).alias("good_excludes_toxic"), said(iff(q, long_)).alias("good_iff_long"), said(cardinality([q, x, long_], 1, 2)).alias("one_or_two"))


_KLEENE = """with r as (select d.doc_id, quality = 1 as q, toxic = 1 as x, n_chars > 3000 as l from documents d left join labels using (doc_id)),
s as (select *, (case when q then 1 else 0 end) + (case when x then 1 else 0 end) + (case when l then 1 else 0 end) as lo, (case when q is null or q then 1 else 0 end) + (case when x is null or x then 1 else 0 end) + (case when l is null or l then 1 else 0 end) as hi from r)
select doc_id, coalesce(cast(not x or not q as varchar), 'unknown') as toxic_implies_bad, coalesce(cast(not (q and x) as varchar), 'unknown') as good_excludes_toxic, coalesce(cast(q = l as varchar), 'unknown') as good_iff_long,
coalesce(cast(case when lo > 2 or hi < 1 then false when lo >= 1 and hi <= 2 then true end as varchar), 'unknown') as one_or_two from s"""


def _levels(spark, d):
    o = table(spark, d, "orders", "o_orderpriority", "o_orderkey")
    ok = at_least_level(F.col("o_orderpriority"), ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"], "3-MEDIUM")
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.min(ok.cast("int")).alias("passes"))


_LEVELS = "select o_orderpriority, count(*) as n, min(case when left(o_orderpriority, 1) in ('1', '2', '3') then 1 when left(o_orderpriority, 1) in ('4', '5') then 0 end) as passes from orders group by 1"


def _ece(spark, d):
    scored = table(spark, d, "labels", "doc_id", "quality").select(hash_uniform(3, F.col("doc_id")).alias("p"), F.col("quality").cast("double").alias("y"))
    return matching.calibration_error(scored).select(F.round("ece", 9).alias("ece"), "n")


_ECE = f"""with s as (select {u_sql(3, 'doc_id')} as p, cast(quality as double) as y from labels), b as (select least(floor(p * 15), 14) as bin, count(*) as n, abs(avg(p) - avg(y)) as gap from s group by 1)
select round(sum(n * gap) / sum(n), 9) as ece, cast(sum(n) as bigint) as n from b"""


def _agreement(spark, d):
    scored = table(spark, d, "labels", "doc_id", "quality", "toxic").select("quality", "toxic", F.floor(hash_uniform(4, F.col("doc_id")) * 5 + 1).alias("score"))
    within = F.avg((F.abs(F.col("score") - 1 - 4 * F.col("quality")) <= 1).cast("double"))
    return scored.agg(F.round(F.corr("score", "quality"), 9).alias("r"), F.round(within, 9).alias("within_one"), F.count("*").alias("n"))


_AGREEMENT = f"with s as (select quality, floor({u_sql(4, 'doc_id')} * 5 + 1) as score from labels) select round(corr(score, quality), 9) as r, round(avg(case when abs(score - 1 - 4 * quality) <= 1 then 1.0 else 0.0 end), 9) as within_one, count(*) as n from s"


def _distribution(spark, d):
    """Share, rank and entropy term of each source in its language; the vocabulary is small, so its windows are too."""
    n = documents(spark, d, "doc_id", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("n"))
    by = Window.partitionBy("lang")
    p = F.col("n") / F.sum("n").over(by)
    r = F.row_number().over(by.orderBy(F.desc("n"), "source"))
    shared = n.withColumn("p", p).withColumn("r", r)
    return shared.groupBy("lang").agg(F.count("*").alias("labels"), F.sum("n").alias("mentions"), F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("entropy"), F.round(F.sum(F.when(F.col("r") <= 5, F.col("p")).otherwise(0.0)), 9).alias("top5_share"))


_DISTRIBUTION = """with n as (select lang, source, count(*) as n from documents group by all), p as (select *, n / sum(n) over (partition by lang) as p, row_number() over (partition by lang order by n desc, source) as r from n)
select lang, count(*) as labels, cast(sum(n) as bigint) as mentions, round(-sum(p * log2(p)), 9) as entropy, round(sum(case when r <= 5 then p else 0 end), 9) as top5_share from p group by lang"""


def _statistics(spark, d):
    n = F.col("n_chars")
    return documents(spark, d, "doc_id", "lang", "n_chars").rollup("lang").agg(F.count("*").alias("docs"), F.round(F.avg(n), 6).alias("mean_chars"), F.percentile(n, F.lit(0.5)).cast("int").alias("median_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.count(F.when(n < 200, 1)).alias("below_floor"))


_STATISTICS = "select lang, count(*) as docs, round(avg(n_chars), 6) as mean_chars, cast(floor(quantile_cont(n_chars, 0.5)) as int) as median_chars, min(n_chars) as min_chars, max(n_chars) as max_chars, count(*) filter (n_chars < 200) as below_floor from documents group by rollup (lang)"


def _never_seen(spark, d):
    return table(spark, d, "part", "p_partkey").join(table(spark, d, "lineitem", "l_partkey").filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")).distinct(), "p_partkey", "left_anti")


def _centred(spark, d):
    """For each label's mean vector, the ten vectors of largest cosine after taking off the vector's mean score.

    The label means are as many as labels, so scoring them against every vector is one pass over the vectors.
    """
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    long_ = e.select("label", F.posexplode("embedding").alias("i", "x"))
    means = long_.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))
    nodes = means.agg(F.sort_array(F.collect_list(F.struct("label", "mean"))).alias("nodes"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)
    scored = with_row(e, nodes).select("vec_id", F.transform("nodes", lambda n: F.struct(n["label"].alias("node"), (dot(F.col("embedding"), n["mean"]) / F.sqrt(dot(n["mean"], n["mean"])) / F.sqrt(dot(F.col("embedding"), F.col("embedding")))).alias("c"))).alias("s"))
    mean = F.aggregate("s", F.lit(0.0).cast("double"), lambda a, x: a + x["c"]) / F.size("s")
    flat = scored.withColumn("mean", mean).select("vec_id", "mean", F.inline("s")).select("vec_id", "node", F.round(F.col("c") - F.col("mean"), 7).alias("centred"))
    nth = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("centred"), "vec_id"))
    return flat.withColumn("rank", nth).filter("rank <= 10")


_CENTRED = """with x as (select label, i, avg(cast(embedding[i] as double)) as m from (select label, embedding, unnest(range(1, len(embedding) + 1)) as i from embeddings) group by all),
m as (select label, list(m order by i) as mean from x group by label),
c as (select vec_id, m.label as node, list_dot_product(cast(embedding as double[]), mean) / sqrt(list_dot_product(mean, mean)) / sqrt(list_dot_product(cast(embedding as double[]), cast(embedding as double[]))) as c from embeddings, m),
d as (select vec_id, node, round(c - avg(c) over (partition by vec_id), 7) as centred from c)
select vec_id, node, centred, cast(r as int) as rank from (select *, row_number() over (partition by node order by centred desc, vec_id) as r from d) where r <= 10"""


def _profiles(spark, d):
    """Density classes by length inside each language: 8, 22 and 45 per cent, the rest dense."""
    docs = documents(spark, d, "doc_id", "lang", "n_chars")
    placed = beside(ranked(docs, ["lang"], ["n_chars", "doc_id"], "r"), docs.groupBy("lang").agg(F.count("*").alias("n")), ["lang"])
    r, n = F.col("r"), F.col("n")
    zero, sparse, normal = (F.bround(n * s) for s in (0.08, 0.22, 0.45))
    return placed.select("doc_id", F.when(r <= zero, "zero").when(r <= zero + sparse, "sparse").when(r <= zero + sparse + normal, "normal").otherwise("dense").alias("profile"))


_PROFILES = """with r as (select doc_id, row_number() over (partition by lang order by n_chars, doc_id) as r, count(*) over (partition by lang) as n from documents),
q as (select *, round_even(n * 0.08, 0) as a, round_even(n * 0.22, 0) as b, round_even(n * 0.45, 0) as c from r)
select doc_id, case when r <= a then 'zero' when r <= a + b then 'sparse' when r <= a + b + c then 'normal' else 'dense' end as profile from q"""


def _merge(spark, d):
    """Chunk merge: of the turns of a conversation, one item per (conversation, role, first word), the most confident kept, first on ties."""
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    conf = F.round(F.length("text") % 97 / 97, 4)
    rows = c.select("conv_id", "turn", "role", F.lower(F.regexp_extract("text", "^[A-Za-z]+", 0)).alias("word"), conf.alias("confidence"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "word").orderBy(F.desc("confidence"), "turn"))
    return rows.withColumn("n", nth).filter("n = 1").drop("n")


_MERGE = """with r as (select conv_id, turn, role, lower(regexp_extract(text, '^[A-Za-z]+')) as word, round(length(text) % 97 / 97, 4) as confidence from conversations)
select * exclude (n) from (select *, row_number() over (partition by conv_id, role, word order by confidence desc, turn) as n from r) where n = 1"""


def _classify(spark, d):
    """Long-text classification: logits of turns are averaged over the conversation, then decided once; several labels, the best if none passes."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    each = c.select("conv_id", F.explode(F.array(*(F.struct(F.lit(n).alias("label"), (F.length("text") % k / k * 6 - 4).alias("logit")) for n, k in (("short", 31), ("formal", 53), ("question", 71))))).alias("s")).select("conv_id", "s.*")
    mean = each.groupBy("conv_id", "label").agg(F.round(F.avg("logit"), 9).alias("logit")).withColumn("p", F.round(1 / (1 + F.exp(-F.col("logit"))), 9))
    by = Window.partitionBy("conv_id")
    ranked = mean.withColumn("best", F.max("p").over(by)).withColumn("r", F.row_number().over(by.orderBy(F.desc("p"), "label")))
    return ranked.filter((F.col("p") >= 0.5) | ((F.col("best") < 0.5) & (F.col("r") == 1))).select("conv_id", "label", "p")


_CLASSIFY = """with e as (select conv_id, 'short' as label, length(text) % 31 / 31 * 6 - 4 as logit from conversations union all select conv_id, 'formal', length(text) % 53 / 53 * 6 - 4 from conversations union all select conv_id, 'question', length(text) % 71 / 71 * 6 - 4 from conversations),
m as (select conv_id, label, round(1 / (1 + exp(-round(avg(logit), 9))), 9) as p from e group by all),
r as (select *, max(p) over (partition by conv_id) as best, row_number() over (partition by conv_id order by p desc, label) as r from m)
select conv_id, label, p from r where p >= 0.5 or (best < 0.5 and r = 1)"""


def _components(spark, d):
    """Documents that mention the same surface of a label are coreferent, through others too; the component is the smallest doc_id.

    A document points at the least one that shares a surface; minima are pre-aggregated, so a frequent surface makes no pairs.
    """
    m = cut(gold(spark, d).select("doc_id", "label", "surface").distinct(), "mentions")
    least = m.groupBy("label", "surface").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).filter("n > 1")
    return graph.components(m.join(least, ["label", "surface"]).select(F.col("doc_id").alias("a"), "b"))


_COMPONENTS = f"""with recursive {MENTIONS_SQL}, k as (select distinct doc_id, label, surface from mentions),
e as (select doc_id as a, min(doc_id) over (partition by label, surface) as b, count(*) over (partition by label, surface) as n from k),
both_ways as (select distinct a, b from e where n > 1 union select b, a from e where n > 1),
r as (select a as id, a as seen from both_ways union select r.id, e.b from r join both_ways e on e.a = r.seen)
select id, min(seen) as component from r group by id"""


def _reach(spark, d):
    """Nodes of region, nation, customer and orders that edges reach from one region."""
    edge = lambda t, a, p, b, q: table(spark, d, t).select(F.concat(F.lit(p), F.col(a).cast("string")).alias("a"), F.concat(F.lit(q), F.col(b).cast("string")).alias("b"))
    edges = edge("nation", "n_regionkey", "r", "n_nationkey", "n").union(edge("customer", "c_nationkey", "n", "c_custkey", "c")).union(edge("orders", "o_custkey", "c", "o_orderkey", "o"))
    start = table(spark, d, "region").filter("r_name = 'ASIA'").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return graph.reachable(edges, start).groupBy(F.substring("id", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


_REACH = """with recursive e as (select 'r' || n_regionkey as a, 'n' || n_nationkey as b from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer union all select 'c' || o_custkey, 'o' || o_orderkey from orders),
s as (select 'r' || r_regionkey as id from region where r_name = 'ASIA' union select e.b from s join e on e.a = s.id)
select left(id, 1) as kind, count(*) as n from s group by 1"""


def _cycles(spark, d):
    """Suppliers pointing at suppliers: chains end, two rings stay, and the path from one ring to the other lies on no cycle."""
    s = table(spark, d, "supplier", "s_suppkey")
    n = F.col("s_suppkey")
    to = F.explode(F.when(n == 3, F.array(F.lit(1), F.lit(4)).cast("array<bigint>")).otherwise(F.array(F.when(n < 3, n + 1).when(n == 4, 8).when(n == 8, 9).when(n == 9, 8).otherwise(F.floor(n / 2))).cast("array<bigint>")))
    return graph.cyclic_nodes(s.select(F.col("s_suppkey").alias("a"), to.alias("b")))


_CYCLES = """with recursive e as (select s_suppkey as a, unnest(case when s_suppkey = 3 then [1, 4] else [case when s_suppkey < 3 then s_suppkey + 1 when s_suppkey = 4 then 8 when s_suppkey = 8 then 9 when s_suppkey = 9 then 8 else s_suppkey // 2 end] end) as b from supplier),
w as (select a as origin, b as here from e union select w.origin, e.b from w join e on e.a = w.here) select distinct origin as id from w where origin = here"""


def _typed(spark, d):
    """Relations order-of-customer-by-nation against allowed (segment, priority) pairs: closed policy drops the unlabelled and the forbidden."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 11 != 0, F.col("c_mktsegment")))
    allowed = c.select(F.col("c_mktsegment").alias("head")).distinct().filter("head is not null").withColumn("tail", F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))).filter("head <> 'MACHINERY'").withColumn("ok", F.lit(True))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", F.col("c_mktsegment").alias("head"), F.col("o_orderpriority").alias("tail")).join(allowed, ["head", "tail"], "left")
    reason = F.when(F.col("head").isNull(), "unlabelled").when(F.col("ok").isNull(), "not allowed").otherwise("kept")
    return j.groupBy(reason.alias("outcome")).agg(F.count("*").alias("n"))


_TYPED = """with c as (select c_custkey, case when c_custkey % 11 <> 0 then c_mktsegment end as head from customer), j as (select head, o_orderpriority as tail from orders join c on o_custkey = c_custkey)
select case when head is null then 'unlabelled' when head <> 'MACHINERY' and tail in ('1-URGENT', '2-HIGH') then 'kept' else 'not allowed' end as outcome, count(*) as n from j group by 1"""

ITEMS = {
    "kleene_constraints": Item(_kleene, _KLEENE),
    "ordinal_levels": Item(_levels, _LEVELS),
    "calibration_ece": Item(_ece, _ECE),
    "judge_agreement": Item(_agreement, _AGREEMENT),
    "label_distribution_entropy": Item(_distribution, _DISTRIBUTION),
    "dataset_statistics": Item(_statistics, _STATISTICS),
    "never_seen": Item(_never_seen, "select p_partkey from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)"),
    "cosine_centred_topk": Item(_centred, _CENTRED),
    "profile_quantiles": Item(_profiles, _PROFILES),
    "chunk_merge_items": Item(_merge, _MERGE),
    "classify_long_aggregate": Item(_classify, _CLASSIFY),
    "coref_components": Item(_components, _COMPONENTS),
    "reachability": Item(_reach, _REACH),
    "cyclic_nodes": Item(_cycles, _CYCLES),
    "type_constraint_filter": Item(_typed, _TYPED),
}
