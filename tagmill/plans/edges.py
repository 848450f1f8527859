"""Queries on edges, caps, templates and rendering."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import edges as e
from tagmill.operators.graph import broken_symmetry
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.sources import table


def _constrained(spark, d):
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    p = F.round(hash_uniform(31, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")), 6)
    edges = li.select((F.col("l_orderkey") % 500).alias("record"), (F.col("l_partkey") % 40).alias("head"), (F.col("l_suppkey") % 40).alias("tail"), F.col("l_returnflag").alias("relation"), p.alias("p")).distinct()
    return e.constrain_edges(edges, ["record"], per_head=2, per_tail=3)


_CONSTRAINED = f"""with x as (select distinct l_orderkey % 500 as record, l_partkey % 40 as head, l_suppkey % 40 as tail, l_returnflag as relation, round({u_sql(31, "l_orderkey || '|' || l_partkey || '|' || l_suppkey")}, 6) as p from lineitem),
a as (select * exclude (n) from (select *, row_number() over (partition by record, relation, head, tail order by p desc, head, tail) as n from x where head <> tail) where n = 1),
b as (select * exclude (n) from (select *, row_number() over (partition by record, relation, head order by p desc, head, tail) as n from a) where n <= 2)
select * exclude (n) from (select *, row_number() over (partition by record, relation, tail order by p desc, head, tail) as n from b) where n <= 3"""


def _symmetric(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey").select((F.col("l_partkey") % 97).alias("a"), (F.col("l_suppkey") % 89).alias("b")).distinct()
    return broken_symmetry(li)


def _caps(spark, d):
    c = table(spark, d, "conversations", "conv_id", "turn", "role", "text").select("conv_id", "role", F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"))
    return e.cap_mentions(c, ["conv_id", "role"], 2).groupBy("role", "kept").agg(F.count("*").alias("n"))


def _templates(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment")
    template = F.when(F.col("c_custkey") % 2 == 0, "the {tail} of {head} is known").otherwise("{head} works in {tail}.")
    return c.select("c_custkey", e.fill_template(template, F.col("c_name"), F.col("c_mktsegment")).alias("f")).select("c_custkey", "f.*")


_TEMPLATES = """select c_custkey, case when c_custkey % 2 = 0 then 'the ' || c_mktsegment || ' of ' || c_name || ' is known' else c_name || ' works in ' || c_mktsegment || '.' end as text,
cast(case when c_custkey % 2 = 0 then 8 + length(c_mktsegment) else 0 end as int) as head_start, cast(case when c_custkey % 2 = 0 then 4 else length(c_name) + 10 end as int) as tail_start from customer"""


def _marks(spark, d):
    out = e.render_marks(documents(spark, d, "doc_id", "text"), gold(spark, d).select("doc_id", "start", "end", "label"), "doc_id")
    return out.select("doc_id", F.length("rendered").alias("chars"), F.md5("rendered").alias("rendered_md5"))


_MARKS = f"""with recursive {MENTIONS_SQL}, m as (select m.doc_id, m."start" as s, m."end" as e, m.label, d.text, coalesce(lag(m."end") over w, 0) as f, lead(m."start") over w is null as last from mentions m join documents d using (doc_id) window w as (partition by m.doc_id order by m."start")),
r as (select doc_id, string_agg(substr(text, f + 1, s - f) || '[' || substr(text, s + 1, e - s) || '](' || label || ')' || case when last then substr(text, e + 1) else '' end, '' order by s) as r from m group by doc_id)
select doc_id, cast(length(r) as int) as chars, md5(r) as rendered_md5 from r"""

ITEMS = {
    "joint_edge_constraints": Item(_constrained, _CONSTRAINED),
    "symmetric_relation_check": Item(_symmetric, "with x as (select distinct l_partkey % 97 as a, l_suppkey % 89 as b from lineitem) select a, b from x where not exists (select 1 from x y where y.a = x.b and y.b = x.a)"),
    "mention_caps": Item(_caps, "select role, n <= 2 as kept, count(*) as n from (select role, row_number() over (partition by conv_id, role order by turn) as n from conversations) group by 1, 2"),
    "template_fill": Item(_templates, _TEMPLATES),
    "markup_render": Item(_marks, _MARKS),
}
