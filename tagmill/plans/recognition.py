"""Queries on recognised spans: recognisers, overlap policies, BIO, scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import matching, spans
from tagmill.operators.recognise import RULES
from tagmill.plans import Item
from tagmill.plans.derived import CANDIDATES_SQL, MENTIONS_SQL, PREDICTIONS_SQL, documents, found, gold, key_of, predictions, u_sql
from tagmill.written import cut

_SPAN = ["doc_id", "start", "end", "label", "surface"]
_SPAN_SQL = 'doc_id, "start", "end", label, surface'


def _by_lang(spark, d):
    m = gold(spark, d)
    return m.groupBy("lang", "label").agg(F.count("*").alias("mentions"), F.count_distinct("doc_id").alias("docs"), F.sum(F.col("end") - F.col("start")).alias("chars"))


def _one(label):
    return lambda spark, d: found(spark, d).filter(F.col("label") == label).select("doc_id", "start", "end", "surface")


def _one_sql(label):
    return f"with {CANDIDATES_SQL} select doc_id, \"start\", \"end\", surface from cands where label = '{label}'"


def _near_spans(spark, d):
    """Rule spans and, beside each, a longer and a shifted one of less confidence, so that every policy has work."""
    m = cut(found(spark, d).select(*_SPAN, "confidence"), "found")
    longer = m.withColumn("end", F.col("end") + 3).withColumn("confidence", F.col("confidence") - 0.15).withColumn("label", F.lit("wide"))
    moved = m.withColumn("start", F.col("start") + 2).withColumn("end", F.col("end") + 5).withColumn("confidence", F.col("confidence") - 0.25).withColumn("label", F.lit("moved"))
    return m.unionByName(longer).unionByName(moved).withColumn("start", F.col("start").cast("int")).withColumn("end", F.col("end").cast("int")).withColumn("confidence", F.round("confidence", 6))


_NEAR = f"""{CANDIDATES_SQL},
near as (select {_SPAN_SQL}, round(cast(confidence as double), 6) as confidence from cands
  union all select doc_id, "start", "end" + 3, 'wide', surface, round(cast(confidence as double) - 0.15, 6) from cands
  union all select doc_id, "start" + 2, "end" + 5, 'moved', surface, round(cast(confidence as double) - 0.25, 6) from cands),
uniq as (select * exclude (n) from (select *, row_number() over (partition by doc_id, "start", "end" order by confidence desc, label) as n from near) where n = 1)"""


def _walk(order: str, clash: str, source: str) -> str:
    """SQL of a greedy fold: in ``order`` a row is kept unless it clashes with a kept k; x is the row."""
    return f"""with recursive {_NEAR},
ranked as (select *, row_number() over (partition by doc_id order by {order}) as r from {source}),
walk as (select doc_id, 0 as r, [{{'s': -1, 'e': -1, 'r': cast(0 as bigint)}}] as kept from (select distinct doc_id from ranked)
  union all select w.doc_id, w.r + 1, case when len(list_filter(w.kept, lambda k: {clash})) > 0 then w.kept else list_append(w.kept, {{'s': x."start", 'e': x."end", 'r': x.r}}) end
  from walk w join ranked x on x.doc_id = w.doc_id and x.r = w.r + 1),
final as (select doc_id, arg_max(kept, r) as kept from walk group by doc_id)
select x.doc_id, x."start", x."end", x.label, x.surface from ranked x join (select doc_id, unnest(kept).r as r from final) k on x.doc_id = k.doc_id and x.r = k.r"""


_OVER = 'k.s < x."end" and x."start" < k.e'
_CROSS = '(x."start" < k.s and k.s < x."end" and x."end" < k.e) or (k.s < x."start" and x."start" < k.e and k.e < x."end")'


def _policy(fn):
    return lambda spark, d: fn(_near_spans(spark, d), ["doc_id"]).select(*_SPAN)


def _bio(spark, d):
    m = cut(gold(spark, d), "mentions")
    docs = documents(spark, d, "doc_id", "text").join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = docs.select("doc_id", F.length(F.regexp_extract("text", r"^[ \t\n\r\f\x0B]*", 0)).alias("lead"), F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\r\f\x0B]+[ \t\n\r\f\x0B]*"), F.lit(0))).alias("pos", "piece"))
    before = F.coalesce(F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = (F.col("lead") + before).cast("int")
    tokens = pieces.select("doc_id", "pos", start.alias("start"), (start + F.length(F.regexp_extract("piece", r"^[^ \t\n\r\f\x0B]+", 0))).alias("end"))
    return spans.bio_encode(tokens, m.select("doc_id", "start", "end", "label"), ["doc_id"])


_BIO = rf"""with recursive {MENTIONS_SQL},
pieces as (select doc_id, length(regexp_extract(text, '^[ \t\n\r\f\v]*')) as lead, unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*')) as piece, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*'), 1) - 1 as pos from documents where doc_id in (select doc_id from mentions)),
toks as (select doc_id, pos, s as "start", s + length(regexp_extract(piece, '^[^ \t\n\r\f\v]+')) as "end" from (select *, lead + coalesce(sum(length(piece)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as s from pieces)),
hit as (select t.doc_id, t.pos, t."start", t."end", max(m."start") as ms, arg_max(m.label, m."start") as label from toks t left join mentions m on m.doc_id = t.doc_id and m."start" < t."end" and t."start" < m."end" group by all),
tagged as (select doc_id, pos, "start", "end", case when ms is null then 'O' when lag(ms) over (partition by doc_id order by pos) = ms then 'I-' || label else 'B-' || label end as tag from hit)"""


def _bio_counts(spark, d):
    return _bio(spark, d).groupBy("doc_id", "tag").agg(F.count("*").alias("tokens"), F.min("pos").cast("bigint").alias("first_pos"))


def _bio_decode(spark, d):
    return spans.bio_decode(_bio(spark, d), ["doc_id"]).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "label")


_DECODE = f"""{_BIO}, opened as (select *, case when tag <> 'O' and (tag like 'B-%' or coalesce(lag(tag) over (partition by doc_id order by pos), 'O') = 'O' or substr(lag(tag) over (partition by doc_id order by pos), 3) <> substr(tag, 3)) then 1 else 0 end as o from tagged),
numbered as (select *, sum(o) over (partition by doc_id order by pos) as n from opened where true)
select doc_id, cast(min("start") as bigint) as "start", cast(max("end") as bigint) as "end", substr(min(tag), 3) as label from numbered where tag <> 'O' group by doc_id, n"""


def _both(spark, d):
    g = cut(gold(spark, d), "mentions")  # used several times: the texts are read once
    return g, predictions(g)


def _surface(spark, d):
    g, p = _both(spark, d)
    return matching.surface_counts(g, p, ["doc_id"])


_SURFACE = f"""with recursive {PREDICTIONS_SQL},
g as (select distinct doc_id, label, surface from mentions), p as (select distinct doc_id, label, surface from preds),
counts as (select coalesce(g.label, p.label) as label, count(*) filter (g.doc_id is not null and p.doc_id is not null) as tp, count(*) filter (g.doc_id is null) as fp,
  count(*) filter (p.doc_id is null) as fn, count(*) filter (g.doc_id is not null) as support
  from g full join p on g.doc_id = p.doc_id and g.label = p.label and g.surface = p.surface group by 1)"""
_PRF = "case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as recall"


def _micro(spark, d):
    m = matching.micro_macro(_surface(spark, d))
    return m.select("tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1")), "n_labels")


_MICRO = f"""{_SURFACE}, pr as (select *, {_PRF} from counts), f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end as f1 from pr),
pool as (select cast(sum(tp) as bigint) as tp, cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn, avg(precision) filter (support > 0) as macro_precision, avg(recall) filter (support > 0) as macro_recall, avg(f1) filter (support > 0) as macro_f1, count(*) filter (support > 0) as n_labels from f),
m as (select *, {_PRF} from pool)
select tp, fp, fn, round(precision, 9) as micro_precision, round(recall, 9) as micro_recall, round(2 * precision * recall / (precision + recall), 9) as micro_f1, round(macro_precision, 9) as macro_precision, round(macro_recall, 9) as macro_recall, round(macro_f1, 9) as macro_f1, n_labels from m"""


def _contested(spark, d):
    """Gold and predictions, to which each third mention adds a wide one that reaches into its neighbours: overlaps are contested."""
    g, p = _both(spark, d)
    wide = g.filter(hash_uniform(3, key_of(g)) < 0.34).select("doc_id", F.greatest(F.col("start") - 60, F.lit(0)).cast("int").alias("start"), (F.col("end") + 60).cast("int").alias("end"), "label")
    return g.select("doc_id", "start", "end", "label"), p.select("doc_id", "start", "end", "label").unionByName(wide)


def _statuses(spark, d):
    g, p = _contested(spark, d)
    return matching.offset_statuses(g, p, "doc_id").groupBy("status", "gold_label", "pred_label").agg(F.count("*").alias("n"))


_STATUS = f"""with recursive {PREDICTIONS_SQL},
g as (select doc_id, "start" as s, "end" as e, label, row_number() over (partition by doc_id order by "start", "end", label) as i from mentions),
p as (select *, row_number() over (partition by doc_id order by s, e, label) as i from (select doc_id, "start" as s, "end" as e, label from preds union all select doc_id, greatest("start" - 60, 0), "end" + 60, label from mentions where {u_sql(3, "doc_id || ':' || start")} < 0.34)),
gm as (select *, row_number() over (partition by doc_id, s, e, label order by i) as n from g), pm as (select *, row_number() over (partition by doc_id, s, e, label order by i) as n from p),
m1 as (select gm.doc_id, gm.i as gi, pm.i as pi from gm join pm using (doc_id, s, e, label, n)),
g1 as (select *, row_number() over (partition by doc_id, s, e order by i) as n from g where (doc_id, i) not in (select (doc_id, gi) from m1)), p1 as (select *, row_number() over (partition by doc_id, s, e order by i) as n from p where (doc_id, i) not in (select (doc_id, pi) from m1)),
m2 as (select g1.doc_id, g1.i as gi, p1.i as pi from g1 join p1 using (doc_id, s, e, n)),
pairs as (select a.doc_id, a.i as gi, b.i as pi, row_number() over (partition by a.doc_id order by least(a.e, b.e) - greatest(a.s, b.s) desc, a.i desc, b.i desc) as r from g1 a join p1 b on a.doc_id = b.doc_id and a.s < b.e and b.s < a.e
  where (a.doc_id, a.i) not in (select (doc_id, gi) from m2) and (b.doc_id, b.i) not in (select (doc_id, pi) from m2)),
turns as (select doc_id, 0 as r, cast([] as struct(gi bigint, pi bigint)[]) as taken from (select distinct doc_id from pairs)
  union all select t.doc_id, t.r + 1, case when len(list_filter(t.taken, lambda k: k.gi = x.gi or k.pi = x.pi)) > 0 then t.taken else list_append(t.taken, {{'gi': x.gi, 'pi': x.pi}}) end from turns t join pairs x on x.doc_id = t.doc_id and x.r = t.r + 1),
m3 as (select doc_id, t.gi, t.pi from (select doc_id, unnest(arg_max(taken, r)) as t from turns group by doc_id)),
m as (select *, 'match' as status from m1 union all select *, 'label_mismatch' from m2 union all select *, 'boundary_mismatch' from m3),
st as (select coalesce(status, case when g.doc_id is null then 'fp' else 'fn' end) as status, g.label as gold_label, p.label as pred_label from m full join g on g.doc_id = m.doc_id and g.i = m.gi full join p on p.doc_id = m.doc_id and p.i = m.pi)"""


def _offset_scores(spark, d):
    g, p = _contested(spark, d)
    return matching.offset_scores(matching.offset_statuses(g, p, "doc_id"))


_OFFSET = f"""{_STATUS}, sides as (select gold_label as label, 1 as gold, status = 'match' as strict, status = 'match' or (status = 'boundary_mismatch' and gold_label = pred_label) as lenient from st where gold_label is not null
  union all select pred_label, 0, status = 'match', status = 'match' or (status = 'boundary_mismatch' and gold_label = pred_label) from st where pred_label is not null)
select label, count(*) filter (gold = 1) as n_gold, count(*) filter (gold = 0) as n_pred, count(*) filter (gold = 1 and strict) as strict_tp, count(*) filter (gold = 1 and lenient) as lenient_tp from sides group by label"""


def _sweep(spark, d):
    g, p = _both(spark, d)
    steps = F.explode(F.array(*(F.lit(x / 10) for x in range(1, 10)))).alias("threshold")
    at = p.select("doc_id", "label", "surface", "confidence", steps).filter("confidence >= threshold")
    every = g.select("doc_id", "label", "surface", steps)
    both = every.distinct().withColumn("g", F.lit(1)).join(at.drop("confidence").distinct().withColumn("p", F.lit(1)), ["doc_id", "label", "surface", "threshold"], "full_outer")
    n = both.groupBy("threshold").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("tp", F.col("g").isNotNull() & F.col("p").isNotNull()), ("fp", F.col("g").isNull()), ("fn", F.col("p").isNull()))))
    return matching.prf(n).select(F.col("threshold").cast("double").alias("threshold"), "tp", "fp", "fn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


_SWEEP = f"""with recursive {PREDICTIONS_SQL}, steps as (select x / 10.0 as threshold from range(1, 10) r(x)),
g as (select distinct threshold, doc_id, label, surface from mentions, steps), p as (select distinct threshold, doc_id, label, surface from preds, steps where confidence >= threshold),
n as (select coalesce(g.threshold, p.threshold) as threshold, count(*) filter (g.doc_id is not null and p.doc_id is not null) as tp, count(*) filter (g.doc_id is null) as fp, count(*) filter (p.doc_id is null) as fn
  from g full join p on g.threshold = p.threshold and g.doc_id = p.doc_id and g.label = p.label and g.surface = p.surface group by 1), pr as (select *, {_PRF} from n)
select cast(threshold as double) as threshold, tp, fp, fn, round(precision, 9) as precision, round(recall, 9) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0.0 end, 9) as f1 from pr"""

ITEMS = {
    "pii_mentions_by_lang": Item(_by_lang, f"with recursive {MENTIONS_SQL} select lang, label, count(*) as mentions, count(distinct doc_id) as docs, cast(sum(\"end\" - \"start\") as bigint) as chars from mentions group by lang, label"),
    **{f"{r.label}_mentions": Item(_one(r.label), _one_sql(r.label)) for r in RULES},
    "overlap_allow": Item(_policy(spans.allow), f"with {_NEAR} select {_SPAN_SQL} from uniq"),
    "overlap_greedy": Item(_policy(spans.greedy), _walk('confidence desc, "end" - "start" desc, "start", "end", label, surface', _OVER, "near")),
    "overlap_longest_first": Item(_policy(spans.longest_first), _walk('"end" - "start" desc, "start", label, surface', _OVER, "near")),
    "overlap_nested": Item(_policy(spans.nested), _walk('confidence desc, "start", "end", label, surface', _CROSS, "uniq")),
    "overlap_outermost": Item(_policy(spans.outermost), f'with {_NEAR} select {_SPAN_SQL} from uniq a where not exists (select 1 from uniq b where b.doc_id = a.doc_id and b."start" <= a."start" and b."end" >= a."end" and (b."start" <> a."start" or b."end" <> a."end"))'),
    "overlap_max_score": Item(_policy(spans.best_total)),
    "bio_encode": Item(_bio_counts, f"{_BIO} select doc_id, tag, count(*) as tokens, cast(min(pos) as bigint) as first_pos from tagged group by doc_id, tag"),
    "bio_decode": Item(_bio_decode, _DECODE),
    "span_eval_exact": Item(_surface, f"{_SURFACE} select * from counts"),
    "span_eval_micro_macro": Item(_micro, _MICRO),
    "offset_statuses": Item(_statuses, f"{_STATUS} select status, gold_label, pred_label, count(*) as n from st group by all"),
    "offset_eval": Item(_offset_scores, _OFFSET),
    "threshold_sweep": Item(_sweep, _SWEEP),
}
