"""Relation triples against gold, by the surfaces of their ends."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.operators.graph import components_within
from tagmill.operators.matching import prf
from tagmill.written import cut

#: Pairs of a record's gold and predicted triples that are compared as lists; longer rows go through a table.
SHORT = 64


def surface_key(text: Column) -> Column:
    """White space squeezed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " ")))


def _in_turn(pairs: Column) -> Column:
    """Of ``pairs`` (p, g), in their order, those neither of whose sides is taken yet; for short lists."""
    clash = lambda x, y: (x["p"] == y["p"]) | (x["g"] == y["g"])
    return F.aggregate(pairs, F.slice(pairs, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))


def _long_counts(batches: Iterator[pa.RecordBatch], thresholds: list[float], modes: int) -> Iterator[pa.RecordBatch]:
    """Pairs taken by threshold and mode, of rows (golds, preds) too long for lists: golds wait under their surfaces, least number first."""
    for batch in batches:
        counts = []
        for golds, preds in zip(batch.column("golds").to_pylist(), batch.column("preds").to_pylist(), strict=True):
            for mode in range(modes):
                lines: dict = {}
                for g in sorted(golds, key=lambda x: x["g"]):
                    ends = {(h, t) for h in g["gh"] or () for t in g["gt"] or () if h is not None and t is not None}
                    for end in ends | {(t, h) for h, t in ends} if mode else ends:
                        lines.setdefault(end, []).append(g["g"])
                asked: dict = {}
                for p in sorted((p for p in preds if p["u"] is not None), key=lambda x: x["p"]):
                    if (p["ph"], p["pt"]) in lines:
                        asked.setdefault(p["p"], []).append((p["u"], (p["ph"], p["pt"])))
                for least in thresholds:
                    used, at = set(), dict.fromkeys(lines, 0)
                    for offers in asked.values():
                        first = []
                        for end in {end for u, end in offers if u >= least}:
                            line = lines[end]
                            while at[end] < len(line) and line[at[end]] in used:
                                at[end] += 1
                            first += line[at[end] : at[end] + 1]
                        if first:
                            used.add(min(first))
                    counts.append(len(used))
        counts_ = pa.ListArray.from_arrays(pa.array(range(0, len(counts) + 1, modes * len(thresholds)), pa.int32()), pa.array(counts, pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), counts_], [*batch.schema.names[:4], "taken"])


def match_counts(gold: DataFrame, pred: DataFrame, thresholds: list[float] | None = None, swapped: bool = True) -> DataFrame:
    """(record, relation, threshold, tp, fp, fn and, if ``swapped``, lenient_tp, lenient_fp, lenient_fn) of triples (record, relation, i, head[s], tail[s]).

    In order, each prediction takes the first free gold. Gold ends are arrays of surfaces, predicted ends single surfaces; the lenient
    counts also accept the ends the wrong way round. With ``thresholds``, predictions have a column ``u`` and those from the
    threshold count. Taking turns is sequential inside a record and relation, so the triples of one meet in a row, by one
    shuffle for all thresholds and both counts; short rows are matched by expressions, long ones through a table of surfaces.
    """
    levels = thresholds or [0.0]
    u = F.col("u").cast("double") if thresholds else F.lit(0.0)
    g = F.struct(F.col("i").alias("g"), F.transform("heads", surface_key).alias("gh"), F.transform("tails", surface_key).alias("gt"))
    p = F.struct(F.col("i").alias("p"), surface_key(F.col("head")).alias("ph"), surface_key(F.col("tail")).alias("pt"), u.alias("u"))
    sides = gold.select("record", "relation", g.alias("gold")).unionByName(pred.select("record", "relation", p.alias("pred")), allowMissingColumns=True)
    met = sides.groupBy("record", "relation").agg(F.collect_list("gold").alias("golds"), F.collect_list("pred").alias("preds"))
    at_least = F.transform(F.array(*(F.lit(x) for x in levels)), lambda x: F.size(F.filter("preds", lambda y: y["u"] >= x)).cast("long"))
    named = F.col("record").isNotNull() & F.col("relation").isNotNull()  # without both, nothing matches
    met = met.select("record", "relation", F.size("golds").cast("long").alias("n_gold"), at_least.alias("n_pred"), *(F.when(named, F.col(c)).otherwise(F.slice(c, 1, 0)).alias(c) for c in ("golds", "preds")))
    fits = lambda x, y, h, t: F.array_contains(x["gh"], y[h]) & F.array_contains(x["gt"], y[t])
    pair = lambda x, y: F.struct(y["p"].alias("p"), x["g"].alias("g"), fits(x, y, "ph", "pt").alias("straight"), y["u"].alias("u"))
    either = lambda x, y: fits(x, y, "ph", "pt") | fits(x, y, "pt", "ph") if swapped else fits(x, y, "ph", "pt")
    pairs = F.sort_array(F.flatten(F.transform("preds", lambda y: F.transform(F.filter("golds", lambda x: either(x, y)), lambda x: pair(x, y)))))
    held = lambda mode, x: F.filter("pairs", lambda y: (y["u"] >= x) & (F.lit(mode == 1) | y["straight"]))
    modes = 2 if swapped else 1
    taken = F.array(*(F.size(_in_turn(held(mode, F.lit(x)))).cast("long") for mode in range(modes) for x in levels))
    short = F.size("golds") * F.size("preds") <= SHORT
    known = ["record", "relation", "n_gold", "n_pred"]
    few = met.filter(short).select(*known, pairs.alias("pairs")).select(*known, F.when(F.size("pairs") == 0, F.array_repeat(F.lit(0).cast("long"), modes * len(levels))).otherwise(taken).alias("taken"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in met.schema if f.name in known)
    many = met.filter(~short).mapInArrow(lambda batches: _long_counts(batches, levels, modes), f"{own}, taken array<bigint>")
    out = few.unionByName(many).select(*known, "taken", F.posexplode(F.array(*(F.lit(x) for x in levels))).alias("_at", "threshold"))
    counts = lambda mode, name: [c.alias(f"{name}{n}") for n, c in (("tp", tp(mode)), ("fp", F.col("n_pred")[F.col("_at")] - tp(mode)), ("fn", F.col("n_gold") - tp(mode)))]
    tp = lambda mode: F.col("taken")[F.col("_at") + mode * len(levels)]
    return out.select("record", "relation", "threshold", *counts(0, ""), *(counts(1, "lenient_") if swapped else []))


def match_records(gold: DataFrame, pred: DataFrame, swapped: bool = False) -> DataFrame:
    """(record, relation, tp, fp, fn) of triples, as ``match_counts``; ``swapped`` also accepts the ends the wrong way round."""
    name = "lenient_" if swapped else ""
    return match_counts(gold, pred, swapped=swapped).select("record", "relation", *(F.col(f"{name}{c}").alias(c) for c in ("tp", "fp", "fn")))


def _long_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's pairs (turned, p, g), in order, those neither of whose sides is taken yet."""
    for batch in batches:
        row, at, before = [], [], 0
        for n, pairs in enumerate(batch.column(2)):
            used_p, used_g = set(), set()
            for i, (a, b) in enumerate(zip(pairs.values.field("p").to_pylist(), pairs.values.field("g").to_pylist(), strict=True)):
                if a not in used_p and b not in used_g:
                    used_p.add(a)
                    used_g.add(b)
                    row.append(n)
                    at.append(before + i)
            before += len(pairs)
        chosen, row = batch.column(2).flatten().take(pa.array(at, pa.int64())), pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(chosen.field(c) for c in ("turned", "p", "g"))], [*batch.schema.names[:2], "turned", "p", "g"])


def best_label(sides: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """``sides`` (key, start, end) with ``label``: that of the span (key, i, start, end, label) of largest overlap, the earlier ``i`` on ties; null where none overlaps.

    Equal places count once on both sides, the earliest span standing for its place; then both are dealt into buckets of
    positions, so only different neighbouring places in a document are compared.
    """
    width = 64
    bucket = F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.greatest(F.col("end") - 1, F.col("start")) / width))).alias("_b")
    place = [key, "start", "end"]
    probes = sides.select(*place).distinct()
    first = spans.groupBy(*place).agg(F.max_by(F.struct("i", "label"), F.struct(-F.col("i"))).alias("_f")).select(*place, "_f.*")
    a = probes.select(key, F.col("start").alias("_s"), F.col("end").alias("_e"), bucket)
    b = first.select(key, "i", F.col("start").alias("_ps"), F.col("end").alias("_pe"), F.col("label").alias("_l"), bucket)
    size = F.least("_e", "_pe") - F.greatest("_s", "_ps")
    met = a.join(b, [key, "_b"]).withColumn("_o", size).filter("_o > 0")
    best = met.groupBy(key, F.col("_s").alias("start"), F.col("_e").alias("end")).agg(F.max_by("_l", F.struct("_o", -F.col("i"))).alias("label"))
    return sides.join(best, place, "left").select(*sides.columns, "label")


def mention_classes(entities: DataFrame, key: str) -> DataFrame:
    """(key, id, class): entities (key, id, same_as) that name each other through same_as, also through others, are one class; unknown names don't count."""
    named = entities.select(key, "id", "same_as")
    known = named.select(key, F.col("id").alias("same_as")).distinct()
    links = named.filter("same_as is not null and same_as <> id").join(known, [key, "same_as"], "left_semi").select(key, F.col("id").alias("a"), F.col("same_as").alias("b"))
    classes = components_within(links, key)
    return named.filter(F.col(key).isNotNull() & F.col("id").isNotNull()).select(key, "id").distinct().join(classes, [key, "id"], "left").select(key, "id", F.coalesce("component", "id").alias("class"))


def match_coreferent(entities: DataFrame, mentions: DataFrame, gold: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(key, relation, status, gold_i, pred_i) of predicted relations against gold ones through any coreferent mention.

    ``entities`` (key, id, same_as), ``mentions`` (key, id, start, end), ``gold`` (key, i, relation, head, tail: ids) and ``pred`` (key,
    i, relation, head_start, head_end, tail_start, tail_end). A predicted side hits an entity if it overlaps any mention of
    its class. Predictions take gold relations in order, straight ones first (match), then with the sides exchanged
    (reversed); the rest are fp and fn. Hits come from joins; taking turns is sequential inside a document's relation.
    """
    classes = cut(mention_classes(entities, key), "classes")
    of_class = classes.join(mentions, [key, "id"]).select(key, "class", "start", "end")
    width = 64
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(F.greatest(b - 1, a) / width)))
    m = of_class.select(key, "class", F.col("start").alias("ms"), F.col("end").alias("me"), bucket(F.col("start"), F.col("end")).alias("b"))
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"{s}_start").alias("s"), F.col(f"{s}_end").alias("e"))
    sides = pred.select(key, F.col("i").alias("p"), "relation", F.inline(F.array(side("head"), side("tail")))).withColumn("b", bucket(F.col("s"), F.col("e")))
    hits = sides.join(m, [key, "b"]).filter("least(e, me) > greatest(s, ms)")
    met = lambda s: F.collect_set(F.when(F.col("side") == s, F.col("class"))).alias(f"hit_{s}")
    both = hits.groupBy(key, "relation", "p").agg(met("head"), met("tail")).withColumn("hit_head", F.explode("hit_head")).withColumn("hit_tail", F.explode("hit_tail"))
    end = lambda c: classes.select(key, F.col("id").alias(c), F.col("class").alias(f"{c}_class"))
    g = gold.join(end("head"), [key, "head"]).join(end("tail"), [key, "tail"])
    way = lambda turned, h, t: F.struct(F.lit(turned).alias("turned"), F.col(h).alias("hit_head"), F.col(t).alias("hit_tail"))
    ways = g.select(key, "relation", F.col("i").alias("g"), F.inline(F.array(way(0, "head_class", "tail_class"), way(1, "tail_class", "head_class"))))
    pairs = both.join(ways, [key, "relation", "hit_head", "hit_tail"]).select(key, "relation", "turned", "p", "g")

    # turns are sequential inside a document's relation: short lists are folded by expressions, long ones in a task
    listed = pairs.groupBy(key, "relation").agg(F.sort_array(F.collect_set(F.struct("turned", "p", "g"))).alias("pairs"))
    own = {f.name: f.dataType.simpleString() for f in pairs.schema}
    short = F.size("pairs") <= SHORT
    few = listed.filter(short).select(key, "relation", F.inline(F.when(F.size("pairs") == 1, F.col("pairs")).otherwise(_in_turn(F.col("pairs")))))
    many = listed.filter(~short).mapInArrow(_long_turns, ", ".join(f"`{c}` {own[c]}" for c in (key, "relation", "turned", "p", "g")))
    status = F.when(F.col("turned") == 1, "reversed").otherwise("match").alias("status")
    taken = cut(few.unionByName(many).select(key, "relation", status, F.col("g").cast("long").alias("gold_i"), F.col("p").cast("long").alias("pred_i")), "taken")
    rest_g = gold.select(key, "relation", F.col("i").cast("long").alias("gold_i")).join(taken.select(key, "gold_i"), [key, "gold_i"], "left_anti")
    rest_p = pred.select(key, "relation", F.col("i").cast("long").alias("pred_i")).join(taken.select(key, "pred_i"), [key, "pred_i"], "left_anti")
    fn = rest_g.select(key, "relation", F.lit("fn").alias("status"), "gold_i", F.lit(None).cast("long").alias("pred_i"))
    fp = rest_p.select(key, "relation", F.lit("fp").alias("status"), F.lit(None).cast("long").alias("gold_i"), "pred_i")
    return taken.unionByName(fn).unionByName(fp)


def status_report(items: DataFrame, group: str) -> DataFrame:
    """(group, gold, pred, tp, fp, fn, precision, recall, f1) of ``items`` (group, status, has_gold, has_pred), and a row for all under a null group.

    Only ``match`` is right; any other item is charged to the side or sides it has.
    """
    ok = F.col("status") == "match"
    n = lambda c: F.count(F.when(c, 1))
    counts = items.rollup(group).agg(n(F.col("has_gold")).alias("gold"), n(F.col("has_pred")).alias("pred"), n(ok).alias("tp"), n(~ok & F.col("has_pred")).alias("fp"), n(~ok & F.col("has_gold")).alias("fn"))
    return prf(counts)


def typed_ends_open(relations: DataFrame, labels: DataFrame, allowed: DataFrame, key: str, asked: list[str]) -> DataFrame:
    """``relations`` (key, relation, head, tail: surfaces) with ``valid``, where doubt passes.

    A side is invalid only if all labels that ``allowed`` (relation, side, label) names for it were asked for, and the surface has
    none of them in ``labels`` (key, surface, label). Relations without an entry are valid.
    """
    asked_ = F.array(*(F.lit(x) for x in asked))
    rules = allowed.groupBy("relation", "side").agg(F.collect_set("label").alias("may")).withColumn("sure", F.size(F.array_except("may", asked_)) == 0)
    out = relations.withColumn("valid", F.lit(True))
    known = labels.groupBy(key, "surface").agg(F.collect_set("label").alias("has"))
    for side in ("head", "tail"):
        rule = rules.filter(F.col("side") == side).select("relation", "may", "sure")
        out = out.join(rule, "relation", "left").join(known.withColumnRenamed("surface", side), [key, side], "left")
        bad = F.col("sure") & ~F.coalesce(F.arrays_overlap("may", "has"), F.lit(False))
        out = out.withColumn("valid", F.col("valid") & ~F.coalesce(bad, F.lit(False))).drop("may", "sure", "has")
    return out
