"""Queries on record building and on relations matched through coreference."""

from __future__ import annotations

from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.functions.text import WORD
from tagmill.operators import building as b
from tagmill.operators import relations as r
from tagmill.plans import Item
from tagmill.plans.derived import u_sql
from tagmill.sources import table
from tagmill.written import cut

_WORD_SQL = WORD.replace("'", "''")


def _turns(spark, d):
    """Turns as documents; entities are letter runs at the beginning and places near the end, some inside a word, some under a wrong span."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text")
    n = F.length(F.regexp_extract("text", "^[A-Za-z]+", 0))
    ent = lambda i, label, a, e, span=None: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), a.cast("int").alias("start"), e.cast("int").alias("end"), (span if span is not None else F.substring("text", a + 1, e - a)).alias("span"))
    zero, late = F.lit(0), F.greatest(F.length("text") - 11, F.lit(0))
    es = F.array(ent("x", "first", zero, n), ent("y", "next", n + 1, n + 6), ent("z", "first", zero, n, F.lit("other")), ent("w", "blank", n, n + 1), ent("y", "tail", late, F.greatest(F.length("text") - 1, late)))
    ents = c.filter(n > 0).select("doc", F.inline(es))
    rel = lambda i, name, h, t: F.struct(F.lit(i).alias("i"), F.lit(name).alias("relation"), F.lit(h).alias("head"), F.lit(t).alias("tail"))
    rels = c.filter(n > 0).select("doc", F.inline(F.array(rel(0, "follows", "x", "y"), rel(1, "follows", "z", "y"), rel(2, "holds", "w", "x"))))
    types = table(spark, d, "nation", "n_name").select(F.lower("n_name").alias("relation"))
    return c, ents, rels, types


def _built(spark, d):
    c, ents, rels, types = _turns(spark, d)
    return b.build_records(c, ents, rels, "doc", types, negatives=2)


_SEP = "chr(31)"
_J = lambda w: f"{_SEP} || array_to_string({w}, {_SEP} || {_SEP}) || {_SEP}"
_LOW = lambda x: f"list_transform(regexp_extract_all({x}, '{_WORD_SQL}'), lambda q: lower(q))"
_BUILT = f"""c as (select conv_id || ':' || turn as doc, text, length(regexp_extract(text, '^[A-Za-z]+')) as n from conversations),
e0 as (select doc, text, unnest([{{'id': 'x', 'l': 'first', 'a': 0, 'e': n, 'sp': null}}, {{'id': 'y', 'l': 'next', 'a': n + 1, 'e': n + 6, 'sp': null}}, {{'id': 'z', 'l': 'first', 'a': 0, 'e': n, 'sp': 'other'}}, {{'id': 'w', 'l': 'blank', 'a': n, 'e': n + 1, 'sp': null}}, {{'id': 'y', 'l': 'tail', 'a': greatest(length(text) - 11, 0), 'e': greatest(length(text) - 1, length(text) - 11, 0), 'sp': null}}]) as e from c where n > 0),
e1 as (select doc, text, e.id, e.l as label, e.a, substr(text, e.a + 1, e.e - e.a) as surface, e.sp from e0),
ents as (select *, len({_LOW('surface')}) > 0 and contains({_J(_LOW('text'))}, {_J(_LOW('surface'))}) as ok from e1),
rels as (select doc, unnest([{{'i': 0, 'r': 'follows', 'h': 'x', 't': 'y'}}, {{'i': 1, 'r': 'follows', 'h': 'z', 't': 'y'}}, {{'i': 2, 'r': 'holds', 'h': 'w', 't': 'x'}}]) as r from c where n > 0),
cl as (select distinct doc, id, surface from ents where ok and trim(surface) <> ''),
pairs as (select rels.doc, r.i, r.r as relation, h.surface as head, t.surface as tail from rels join cl h on h.doc = rels.doc and h.id = r.h join cl t on t.doc = rels.doc and t.id = r.t)"""


def _entities(spark, d):
    return _built(spark, d).entities.select("doc", "label", "surface", F.col("nth").cast("int").alias("nth"))


def _warnings(spark, d):
    return _built(spark, d).warnings.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"), F.min("detail").alias("least"))


_WARNINGS = f"""with {_BUILT}, w as (select doc, 'span_slice_mismatch' as kind, sp || '/' || surface as detail from ents where sp <> surface
  union all select distinct doc, 'entity_surface_unmatchable', label || '/' || surface from ents where not ok and trim(surface) <> ''
  union all select doc, 'triple_unmatchable', r.r || '/' || r.h || '/' || r.t from rels where not exists (select 1 from pairs p where p.doc = rels.doc and p.i = rels.r.i))
select kind, count(*) as n, count(distinct doc) as docs, min(detail) as least from w group by kind"""


def _triples(spark, d):
    return b.gold_triples(_built(spark, d), "doc").groupBy("relation", "head_label", "tail_label").agg(F.count("*").alias("n"))


_TRIPLES = f"""with {_BUILT}, f as (select doc, lower(surface) as s, min(label) as l from ents where ok and trim(surface) <> '' group by all), p as (select distinct doc, relation, head, tail from pairs)
select relation, h.l as head_label, t.l as tail_label, count(*) as n from p left join f h on h.doc = p.doc and h.s = lower(head) left join f t on t.doc = p.doc and t.s = lower(tail) group by all"""


def _negatives(spark, d):
    return _built(spark, d).relations.filter("negative").select("doc", "relation")


_NEGATIVES = """with c as (select conv_id || ':' || turn as doc from conversations), g as (select doc, lower(n_name) as relation from (select distinct doc from c), nation)
select doc, relation from (select *, row_number() over (partition by doc order by md5('42|' || doc || '|' || relation), relation) as k from g) where k <= 2"""


def _preflight(spark, d):
    c, ents, _, _ = _turns(spark, d)
    s = ents.join(c, "doc").select("doc", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("surface")).filter("trim(surface) <> ''")
    good, bad = b.preflight(c, s, "doc")
    return good.select(F.lit("kept").alias("outcome"), "doc").union(bad.select(F.concat(F.lit("unmatched "), F.col("unmatched").cast("string")), "doc")).groupBy("outcome").agg(F.count("*").alias("docs"))


_PREFLIGHT = f"""with {_BUILT}, t as (select distinct doc, surface, len({_LOW('surface')}) > 0 and contains({_J(_LOW("case when right(text, 1) in ('.', '!', '?') then text else text || '.' end"))}, {_J(_LOW('surface'))}) as ok from ents where trim(surface) <> ''),
n as (select c.doc, count(t.doc) filter (not ok) as n from c left join t on t.doc = c.doc group by c.doc)
select case when n = 0 then 'kept' else 'unmatched ' || n end as outcome, count(*) as docs from n group by 1"""


def _coref(spark, d):
    """Orders as documents: line numbers are entities, mentions lie by part and supplier, every third entity is the one before.

    Gold relations go from a line to the next of the order; predictions point at places, some exchanged, some elsewhere.
    """
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_returnflag").alias("relation"))
    li = cut(li.filter("l_orderkey is not null and l_linenumber is not null"), "lines")  # every table below reads them
    key, n = F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long")
    ents = li.select(key, n.alias("id"), F.when(n % 3 == 0, n - 1).alias("same_as"))
    at = (F.col("p") % 10 * 40 + F.col("s") % 4 * 10).cast("int")
    ments = li.select(key, n.alias("id"), at.alias("start"), (at + 6).alias("end"))
    gold = li.select(key, n.alias("i"), "relation", n.alias("head"), (n + 1).alias("tail"))
    place = ments.select("doc", "id", "start")
    p = gold.join(place.select("doc", F.col("id").alias("head"), F.col("start").alias("a")), ["doc", "head"]).join(place.select("doc", F.col("id").alias("tail"), F.col("start").alias("b")), ["doc", "tail"])
    p = p.withColumn("u", F.round(hash_uniform(51, F.col("doc"), F.col("i")), 6)).filter("u >= 0.2")
    turned = F.col("u") < 0.4
    a, e = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    a = F.when(F.col("u") > 0.9, a + 7).otherwise(a + 2)
    pred = p.select("doc", "i", "relation", a.alias("head_start"), (a + 3).alias("head_end"), (e + 1).alias("tail_start"), (e + 4).alias("tail_end"))
    return ents, ments, gold, cut(pred, "pred")


def _coref_match(spark, d):
    items = r.match_coreferent(*_coref(spark, d), "doc")
    return items.groupBy("doc", "relation", "status").agg(F.count("*").alias("n"))


_COREF = f"""li as (select l_orderkey as doc, cast(l_linenumber as bigint) as n, min(l_partkey) % 10 * 40 + min(l_suppkey) % 4 * 10 as pos, min(l_returnflag) as relation from lineitem group by all),
cls as (select a.doc, a.n, case when a.n % 3 = 0 and b.n is not null then a.n - 1 else a.n end as c from li a left join li b on b.doc = a.doc and b.n = a.n - 1),
m as (select distinct cls.doc, c, pos from cls join li using (doc, n)),
g as (select li.doc, li.n as i, relation, h.c as h, t.c as t from li join cls h on h.doc = li.doc and h.n = li.n left join cls t on t.doc = li.doc and t.n = li.n + 1),
p0 as (select a.doc, a.n as i, a.relation, a.pos as a, b.pos as b, round({u_sql(51, "a.doc || '|' || a.n")}, 6) as u from li a join li b on b.doc = a.doc and b.n = a.n + 1),
p as (select doc, i, relation, case when u < 0.4 then b else a end + case when u > 0.9 then 7 else 2 end as hs, case when u < 0.4 then a else b end + 1 as ts from p0 where u >= 0.2),
hh as (select distinct p.doc, p.i, m.c from p join m on m.doc = p.doc and m.pos < p.hs + 3 and p.hs < m.pos + 6), ht as (select distinct p.doc, p.i, m.c from p join m on m.doc = p.doc and m.pos < p.ts + 3 and p.ts < m.pos + 6),
pairs as (select distinct p.doc, p.relation, p.i as p, g.i as g, x.turned from p join g on g.doc = p.doc and g.relation = p.relation, (values (0), (1)) x(turned)
  where exists (select 1 from hh where hh.doc = p.doc and hh.i = p.i and hh.c = case when turned = 0 then g.h else g.t end) and exists (select 1 from ht where ht.doc = p.doc and ht.i = p.i and ht.c = case when turned = 0 then g.t else g.h end)),
o as (select *, row_number() over (partition by doc, relation order by turned, p, g) as k from pairs),
walk as (select doc, relation, 0 as k, cast([] as struct(p bigint, g bigint, turned int)[]) as kept from (select distinct doc, relation from o)
  union all select w.doc, w.relation, w.k + 1, case when len(list_filter(w.kept, lambda z: z.p = o.p or z.g = o.g)) > 0 then w.kept else list_append(w.kept, {{'p': o.p, 'g': o.g, 'turned': o.turned}}) end from walk w join o on o.doc = w.doc and o.relation = w.relation and o.k = w.k + 1),
taken as (select doc, relation, unnest(arg_max(kept, k)) as z from walk group by doc, relation),
items as (select doc, relation, case z.turned when 0 then 'match' else 'reversed' end as status from taken
  union all select doc, relation, 'fn' from g where not exists (select 1 from taken t where t.doc = g.doc and t.z.g = g.i) union all select doc, relation, 'fp' from p where not exists (select 1 from taken t where t.doc = p.doc and t.z.p = p.i))"""


def _report(spark, d):
    """Relations of all orders by name and together, by status; precision and recall of straight matches."""
    items = r.match_coreferent(*_coref(spark, d), "doc")
    out = r.status_report(items.select("relation", "status", F.col("gold_i").isNotNull().alias("has_gold"), F.col("pred_i").isNotNull().alias("has_pred")), "relation")
    return out.select(F.coalesce("relation", F.lit("all")).alias("relation"), "gold", "pred", "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_REPORT = f"""with recursive {_COREF}, n as (select coalesce(relation, 'all') as relation, count(*) filter (status <> 'fp') as gold, count(*) filter (status <> 'fn') as pred, count(*) filter (status = 'match') as tp, count(*) filter (status in ('fp', 'reversed')) as fp, count(*) filter (status in ('fn', 'reversed')) as fn from items group by rollup (relation)),
q as (select *, coalesce(tp / nullif(tp + fp, 0), 0) as precision, coalesce(tp / nullif(tp + fn, 0), 0) as recall from n)
select relation, gold, pred, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) as f1 from q"""


def _best_label(spark, d):
    """Which event's interval overlaps a customer's probe most."""
    c = table(spark, d, "customer", "c_custkey", "c_nationkey").select((F.col("c_nationkey")).cast("int").alias("doc"), F.col("c_custkey").alias("probe"), (F.col("c_custkey") * 13 % 500).cast("int").alias("start")).withColumn("end", F.col("start") + 40)
    s = table(spark, d, "supplier", "s_suppkey", "s_nationkey").select(F.col("s_nationkey").cast("int").alias("doc"), F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 29 % 480).cast("int").alias("start"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("label")).withColumn("end", F.col("start") + 60)
    return r.best_label(c, s, "doc").select("doc", "probe", "start", F.coalesce("label", F.lit("none")).alias("label"))


_BEST = """with c as (select c_nationkey as doc, c_custkey as probe, cast(c_custkey * 13 % 500 as int) as s from customer), t as (select s_nationkey as doc, s_suppkey as i, cast(s_suppkey * 29 % 480 as int) as s from supplier),
o as (select c.doc, probe, c.s, i, least(c.s + 40, t.s + 60) - greatest(c.s, t.s) as o from c left join t on t.doc = c.doc)
select doc, probe, s as "start", coalesce(arg_max('s' || i, o * 100000 - i) filter (o > 0), 'none') as label from o group by all"""


def _typed_open(spark, d):
    """Orders between segment and priority, under constraints of which one names a label that was never asked for."""
    o = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.col("o_orderstatus").alias("relation"), F.col("o_orderpriority").alias("head"), F.col("o_orderstatus").alias("tail"))
    labels = o.filter("o_orderkey % 3 <> 0").select("doc", F.col("head").alias("surface"), F.when(F.col("head") < "3", "urgent").otherwise("calm").alias("label"))
    allowed = o.sparkSession.range(1).select(F.inline(F.array(*(F.struct(F.lit(x).alias("relation"), F.lit(y).alias("side"), F.lit(z).alias("label")) for x, y, z in (("F", "head", "urgent"), ("O", "head", "urgent"), ("O", "head", "other"), ("P", "tail", "calm"))))))
    out = r.typed_ends_open(o, labels, allowed, "doc", ["urgent", "calm"])
    return out.groupBy("relation", "valid").agg(F.count("*").alias("n"))


_TYPED_OPEN = """with l as (select distinct o_custkey as doc, o_orderpriority as s, case when o_orderpriority < '3' then 'urgent' else 'calm' end as l from orders where o_orderkey % 3 <> 0),
v as (select o_orderstatus as relation, case o_orderstatus when 'F' then exists (select 1 from l where doc = o_custkey and s = o_orderpriority and l.l = 'urgent') when 'O' then true else exists (select 1 from l where doc = o_custkey and s = o_orderstatus and l.l = 'calm') end as valid from orders)
select relation, valid, count(*) as n from v group by all"""

ITEMS = {
    "record_build": Item(_entities, f"with {_BUILT} select doc, label, surface, cast(row_number() over (partition by doc, label order by min(a), surface) - 1 as int) as nth from ents where ok and trim(surface) <> '' group by doc, label, surface"),
    "record_warnings": Item(_warnings, _WARNINGS),
    "gold_triples": Item(_triples, _TRIPLES),
    "record_negatives": Item(_negatives, _NEGATIVES),
    "preflight_unmatchable": Item(_preflight, _PREFLIGHT),
    "relation_match_coref": Item(_coref_match, f"with recursive {_COREF} select doc, relation, status, count(*) as n from items group by all"),
    "aggregate_report": Item(_report, _REPORT),
    "best_overlap_label": Item(_best_label, _BEST),
    "typed_ends_open": Item(_typed_open, _TYPED_OPEN),
}
