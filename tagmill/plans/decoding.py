"""Queries on constraints, retention and constrained decoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import decoding as dc
from tagmill.operators.constraints import any_other_selected, any_selected, at_level, at_most_level, exactly_one
from tagmill.operators.graph import broken_inverse, neighbourhoods
from tagmill.operators.searching import Rule, decode_by_search
from tagmill.plans import Item
from tagmill.plans.derived import documents, u_sql
from tagmill.sources import table

_LEVELS = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


def _nodes(spark, d):
    """Three-valued nodes over labels of which some are unknown, and ordinal levels."""
    rows = documents(spark, d, "doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    q, x, long_ = F.col("quality") == 1, F.col("toxic") == 1, F.col("n_chars") > 3000
    level = F.element_at(F.array(*(F.lit(v) for v in [*_LEVELS, "none"])), (F.col("doc_id") % 6 + 1).cast("int"))
    said = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    return rows.select("doc_id", said(any_selected([q, x])).alias("any_label"), said(any_other_selected({"q": q, "x": x, "l": long_}, "q")).alias("other_than_q"), said(exactly_one([q, x, long_])).alias("one"), said(at_most_level(level, _LEVELS, "3-MEDIUM")).alias("up_to_medium"), said(at_level(level, _LEVELS, "2-HIGH")).alias("high"))


_NODES = """with r as (select d.doc_id, quality = 1 as q, toxic = 1 as x, n_chars > 3000 as l, d.doc_id % 6 as v from documents d left join labels using (doc_id)),
s as (select *, (case when q then 1 else 0 end) + (case when x then 1 else 0 end) + (case when l then 1 else 0 end) as lo, (case when q is null or q then 1 else 0 end) + (case when x is null or x then 1 else 0 end) + (case when l is null or l then 1 else 0 end) as hi from r)
select doc_id, coalesce(cast(q or x as varchar), 'unknown') as any_label, coalesce(cast(x or l as varchar), 'unknown') as other_than_q, coalesce(cast(case when lo > 1 or hi < 1 then false when lo = 1 and hi = 1 then true end as varchar), 'unknown') as one,
  coalesce(cast(case when v < 5 then v < 3 end as varchar), 'unknown') as up_to_medium, coalesce(cast(case when v < 5 then v = 3 end as varchar), 'unknown') as high from s"""

_TONES, _TOPICS = ("angry", "calm", "sad"), ("code", "long", "news", "spam")


def _candidates(spark, d, labels, seed):
    docs = documents(spark, d, "doc_id")
    u = lambda i: F.round(hash_uniform(seed + i, F.col("doc_id")) * 2 - 1, 6)
    return docs.select("doc_id", F.inline(F.array(*(F.struct(F.lit(n).alias("label"), u(i).alias("utility")) for i, n in enumerate(labels)))))


def _retained(spark, d):
    c = _candidates(spark, d, _TOPICS, 80)
    return dc.retain(c, ["doc_id"], 2, F.col("label") == "spam").groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("utility"), 5).alias("utility"))


_RETAINED = f"""with c as (select doc_id, unnest([{", ".join(f"{{'l': '{n}', 'u': round({u_sql(80 + i, 'doc_id')} * 2 - 1, 6)}}" for i, n in enumerate(_TOPICS))}]) as c from documents),
r as (select c.l as label, c.u as u, row_number() over (partition by doc_id order by c.l = 'spam' desc, c.u desc, c.l) as k from c) select label, count(*) as n, round(sum(u), 5) as utility from r where k <= 2 group by label"""


def _joint(spark, d):
    """One tone and up to two of three topics: spam excludes calm, code wants long, sad and long together are not wanted; some rules must give."""
    tone = dc.assignments(_candidates(spark, d, _TONES, 70), ["doc_id"], 1, 1)
    topic = dc.assignments(dc.retain(_candidates(spark, d, _TOPICS, 80), ["doc_id"], 3), ["doc_id"], 1, 2)
    has = F.array_contains
    rules = {
        "spam_not_calm": lambda t: ~(has(t["topic"], "spam") & has(t["tone"], "calm")),
        "code_is_long": lambda t: ~has(t["topic"], "code") | has(t["topic"], "long"),
        "long_not_sad": lambda t: ~(has(t["topic"], "long") & has(t["tone"], "sad")),
        "news_alone": lambda t: ~has(t["topic"], "news") | (F.size(t["topic"]) == 1),
        "never_two": lambda t: F.size(t["topic"]) == 1,
    }
    out = dc.decode({"tone": tone, "topic": topic}, ["doc_id"], rules)
    return out.select("doc_id", F.array_join("tone", ",").alias("tone"), F.array_join("topic", ",").alias("topic"), F.round("utility", 6).alias("utility"), F.array_join("broken", ",").alias("broken"))


_JOINT = f"""with t as (select doc_id, unnest([{", ".join(f"{{'l': '{n}', 'u': round({u_sql(70 + i, 'doc_id')} * 2 - 1, 6)}}" for i, n in enumerate(_TONES))}]) as c from documents),
c as (select doc_id, unnest([{", ".join(f"{{'l': '{n}', 'u': round({u_sql(80 + i, 'doc_id')} * 2 - 1, 6)}}" for i, n in enumerate(_TOPICS))}]) as c from documents),
k as (select doc_id, c.l as l, c.u as u from (select *, row_number() over (partition by doc_id order by c.u desc, c.l) as n from c) where n <= 3),
s as (select doc_id, [l] as ls, u from k union all select a.doc_id, [a.l, b.l], a.u + b.u from k a join k b on a.doc_id = b.doc_id and a.l < b.l),
j as (select s.doc_id, t.c.l as tone, ls, round(t.c.u + s.u, 9) as u, list_filter([case when list_contains(ls, 'spam') and t.c.l = 'calm' then 'spam_not_calm' end, case when list_contains(ls, 'code') and not list_contains(ls, 'long') then 'code_is_long' end,
  case when list_contains(ls, 'long') and t.c.l = 'sad' then 'long_not_sad' end, case when list_contains(ls, 'news') and len(ls) > 1 then 'news_alone' end, case when len(ls) > 1 then 'never_two' end], lambda x: x is not null) as broken from s join t on t.doc_id = s.doc_id),
b as (select *, row_number() over (partition by doc_id order by len(broken), u desc, tone, ls) as n from j)
select doc_id, tone, array_to_string(ls, ',') as topic, round(u, 6) as utility, array_to_string(broken, ',') as broken from b where n = 1"""


_MANY = ("art", "code", "food", "long", "news", "play", "spam", "work")


def _searched(spark, d):
    """One tone and one to three of eight topics by search; rules as numbers of labels that hold, some against each other."""
    tone = _candidates(spark, d, _TONES, 70).withColumn("task", F.lit("tone"))
    topic = _candidates(spark, d, _MANY, 80).withColumn("task", F.lit("topic"))
    rules = [
        Rule("spam_not_calm", ("topic:spam", "tone:calm"), most=1),
        Rule("code_is_long", ("!topic:code", "topic:long"), least=1),
        Rule("work_or_play", ("topic:work", "topic:play"), 1, 1),
        Rule("art_needs_two", ("!topic:art", "topic:food", "topic:news"), least=1),
        Rule("sad_has_no_play", ("tone:sad", "topic:play"), most=1),
        Rule("angry_works_not", ("!tone:angry", "!topic:work"), least=1),
        Rule("angry_plays_not", ("tone:angry", "topic:play"), most=1),
    ]
    out = decode_by_search(tone.unionByName(topic), ["doc_id"], {"tone": (1, 1), "topic": (1, 3)}, rules)
    return out.select("doc_id", F.array_join("tone", ",").alias("tone"), F.array_join("topic", ",").alias("topic"), F.round("utility", 6).alias("utility"), F.array_join("broken", ",").alias("broken"), "how")


_SEARCHED = f"""with t as (select doc_id, unnest([{", ".join(f"{{'l': '{n}', 'u': round({u_sql(70 + i, 'doc_id')} * 2 - 1, 6)}}" for i, n in enumerate(_TONES))}]) as c from documents),
k as (select doc_id, c.l as l, c.u as u from (select doc_id, unnest([{", ".join(f"{{'l': '{n}', 'u': round({u_sql(80 + i, 'doc_id')} * 2 - 1, 6)}}" for i, n in enumerate(_MANY))}]) as c from documents)),
s as (select doc_id, [l] as ls, u from k union all select a.doc_id, [a.l, b.l], a.u + b.u from k a join k b on a.doc_id = b.doc_id and a.l < b.l union all select a.doc_id, [a.l, b.l, c.l], a.u + b.u + c.u from k a join k b on a.doc_id = b.doc_id and a.l < b.l join k c on c.doc_id = a.doc_id and b.l < c.l),
h as (select s.doc_id, t.c.l as tone, ls, round(t.c.u + s.u, 9) as u, list_contains(ls, 'spam') as spam, list_contains(ls, 'code') as code, list_contains(ls, 'long') as long, list_contains(ls, 'work') as work, list_contains(ls, 'play') as play, list_contains(ls, 'art') as art, list_contains(ls, 'food') or list_contains(ls, 'news') as two from s join t on t.doc_id = s.doc_id),
j as (select *, list_filter([case when spam and tone = 'calm' then 'spam_not_calm' end, case when code and not long then 'code_is_long' end, case when work = play then 'work_or_play' end, case when art and not two then 'art_needs_two' end,
  case when tone = 'sad' and play then 'sad_has_no_play' end, case when tone = 'angry' and work then 'angry_works_not' end, case when tone = 'angry' and play then 'angry_plays_not' end], lambda x: x is not null) as broken from h),
b as (select *, row_number() over (partition by doc_id order by len(broken), u desc, tone, ls) as n from j)
select doc_id, tone, array_to_string(ls, ',') as topic, round(u, 6) as utility, array_to_string(broken, ',') as broken, 'exact' as how from b where n = 1"""


def _inverse(spark, d):
    """Part-supplier edges named by return flag: A and R should be each other's inverse."""
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey", "l_returnflag").select((F.col("l_partkey") % 37).alias("a"), (F.col("l_suppkey") % 37).alias("b"), F.col("l_returnflag").alias("relation")).distinct()
    return broken_inverse(li, "A", "R").groupBy("relation").agg(F.count("*").alias("n"))


_INVERSE = """with x as (select distinct l_partkey % 37 as a, l_suppkey % 37 as b, l_returnflag as r from lineitem)
select r as relation, count(*) as n from x where r in ('A', 'R') and not exists (select 1 from x y where y.a = x.b and y.b = x.a and y.r = case x.r when 'A' then 'R' else 'A' end) group by r"""


def _neighbours(spark, d):
    li = table(spark, d, "lineitem", "l_partkey", "l_suppkey").select((F.col("l_partkey") % 53).alias("a"), (F.col("l_suppkey") % 53).alias("b"))
    return neighbourhoods(li)


_NEIGHBOURS = """with x as (select l_partkey % 53 as a, l_suppkey % 53 as b from lineitem), e as (select a as id, b as o, 1 as out from x union all select b, a, 0 from x)
select id, cast(sum(out) as bigint) as outgoing, cast(sum(1 - out) as bigint) as incoming, count(distinct case when o <> id then o end) as neighbours from e group by id"""

ITEMS = {
    "constraint_nodes": Item(_nodes, _NODES),
    "retained_candidates": Item(_retained, _RETAINED),
    "joint_decode": Item(_joint, _JOINT),
    "searched_decode": Item(_searched, _SEARCHED),
    "inverse_relation_check": Item(_inverse, _INVERSE),
    "neighbourhoods": Item(_neighbours, _NEIGHBOURS),
}
