"""Queries on record building, gates, roll-ups and decoding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions.hashing import hash_uniform
from tagmill.operators import records as r
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, PREDICTIONS_SQL, documents, gold, predictions, u_sql
from tagmill.sources import table

_LABELS = ["card", "email", "ipv4", "phone"]


def _grid(spark, d):
    return r.closed_grid(gold(spark, d), "doc_id", _LABELS).select("doc_id", "label", F.size("surfaces").alias("n"), F.array_join("surfaces", "|").alias("surfaces"))


_GRID = f"""with recursive {MENTIONS_SQL}, f as (select doc_id, label, surface, min("start") as s from mentions group by all), g as (select doc_id, label from (select distinct doc_id from mentions), unnest(['card', 'email', 'ipv4', 'phone']) t(label))
select g.doc_id, g.label, cast(count(surface) as int) as n, coalesce(string_agg(surface, '|' order by s), '') as surfaces from g left join f on f.doc_id = g.doc_id and f.label = g.label group by all"""


def _dimension(spark, d):
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    return r.first_wins(c.withColumn("name", F.concat_ws("/", F.lower("c_mktsegment"), F.col("c_nationkey").cast("string"))).select("name", "c_custkey"), "name", "c_custkey")


def _tags(spark, d):
    """Conversation turns in which the second and fourth word are tagged, parsed back."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    tagged = F.regexp_replace("text", r"^([A-Za-z]+) ([a-z]+) ([a-z]+) ([a-z]+)", r"$1 [$2]second $3 [$4]fourth_word")
    rows = c.select("conv_id", "turn", "text", F.inline(r.parse_tags(tagged)), (r.strip_tags(tagged) == F.col("text")).alias("same_text"))
    return rows.select("conv_id", "turn", "start", "end", "label", "value", "same_text")


_TAGS = r"""with m as (select conv_id, turn, regexp_extract(text, '^([A-Za-z]+) ([a-z]+) ([a-z]+) ([a-z]+)', ['a', 'b', 'c', 'd']) as w from conversations where regexp_matches(text, '^[A-Za-z]+ [a-z]+ [a-z]+ [a-z]+'))
select conv_id, turn, cast(length(w.a) + 1 as int) as "start", cast(length(w.a) + 1 + length(w.b) as int) as "end", 'second' as label, w.b as value, true as same_text from m
union all select conv_id, turn, cast(length(w.a) + length(w.b) + length(w.c) + 3 as int), cast(length(w.a) + length(w.b) + length(w.c) + length(w.d) + 3 as int), 'fourth_word', w.d, true from m"""


def _pages(spark, d):
    offsets = documents(spark, d, "doc_id", "n_chars").filter("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), (F.col("n_chars") - 1).cast("int"), F.lit(3000))).alias("start")).filter("start % 9000 <> 3000")
    return r.page_slices(offsets, "doc_id", "n_chars")


_PAGES = """with o as (select distinct doc_id, n_chars, s from (select doc_id, n_chars, unnest(range(0, n_chars, 3000)) as s from documents) where s % 9000 <> 3000 or s = 0)
select doc_id, cast(row_number() over (partition by doc_id order by s) - 1 as int) as page, cast(s as int) as "start", cast(coalesce(lead(s) over (partition by doc_id order by s), n_chars) as int) as "end" from o"""


_FORMATS = {"Brand#11": r"^[a-z]+ [a-z]+", "Brand#12": r"^[A-Za-z ]+$", "Brand#13": r"."}


def _gate(spark, d):
    """Part names as a writer's values under their brand: some are spoilt, and each brand was offered its own container."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    k = F.col("p_partkey")
    value = F.when(k % 5 == 0, k.cast("string")).when(k % 7 == 0, F.lit("{name}")).when(k % 11 == 0, F.lit(" ")).when(k % 3 == 0, F.substring("p_type", 1, 6)).when(k % 8 == 0, F.concat("p_name", F.lit(" Jo Doe"))).otherwise(F.col("p_name"))
    reason = r.writer_gate(value, F.col("p_brand"), _FORMATS, F.array("p_type"), r"\b[A-Z][a-z]+ [A-Z][a-z]+\b", ("Brand#13",), "(?i)x{3}", "Brand#12")
    return p.select(F.coalesce(reason, F.lit("accepted")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


_GATE = r"""with v as (select p_brand as b, p_type as o, trim(case when p_partkey % 5 = 0 then cast(p_partkey as varchar) when p_partkey % 7 = 0 then '{name}' when p_partkey % 11 = 0 then ' ' when p_partkey % 3 = 0 then substr(p_type, 1, 6) when p_partkey % 8 = 0 then p_name || ' Jo Doe' else p_name end) as v from part)
select case when b not in ('Brand#11', 'Brand#12', 'Brand#13') then 'unknown label' when length(v) = 0 or length(v) > 160 then 'length' when regexp_matches(v, '\{[^}]*\}|<[^>]*>|\.\.\.') then 'placeholder' when regexp_full_match(v, '[0-9]+') then 'digits only'
  when b = 'Brand#12' and regexp_matches(v, '(?i)x{3}') then 'slur' when lower(v) = lower(o) or (length(v) > 3 and contains(lower(o), lower(v))) then 'offered' when b <> 'Brand#13' and regexp_matches(v, '\b[A-Z][a-z]+ [A-Z][a-z]+\b') then 'person name'
  when not regexp_matches(v, case b when 'Brand#11' then '^[a-z]+ [a-z]+' when 'Brand#12' then '^[A-Za-z ]+$' else '.' end) then 'format' else 'accepted' end as reason, count(*) as n from v group by 1"""


def _mismatches(spark, d):
    """Missed gold mentions, at most three of each label, one label after the other."""
    g = gold(spark, d)
    p = predictions(g).select("doc_id", "label", "surface").distinct()
    missed = g.select("doc_id", "label", "surface").distinct().join(p, ["doc_id", "label", "surface"], "left_anti")
    turn = F.row_number().over(Window.partitionBy("label").orderBy("doc_id", "surface"))
    return missed.withColumn("turn", turn).filter("turn <= 3")


_MISMATCHES = f"""with recursive {PREDICTIONS_SQL}, m as (select distinct doc_id, label, surface from mentions except select doc_id, label, surface from preds)
select * from (select *, cast(row_number() over (partition by label order by doc_id, surface) as int) as turn from m) where turn <= 3"""


def _timing(spark, d):
    """Units, characters and made-up model seconds of a language, and their rates; nothing over zero."""
    docs = documents(spark, d, "doc_id", "lang", "n_chars").withColumn("s", F.round(hash_uniform(6, F.col("doc_id")), 6))
    g = docs.groupBy("lang").agg(F.count("*").alias("units"), F.sum("n_chars").alias("chars"), F.round(F.sum("s"), 6).alias("model_s"))
    return g.select("*", F.round(F.try_divide(1000 * F.col("model_s"), F.col("units")), 6).alias("ms_per_unit"), F.round(F.try_divide("chars", "model_s"), 4).alias("chars_per_s"))


_TIMING = f"""with g as (select lang, count(*) as units, cast(sum(n_chars) as bigint) as chars, round(sum(round({u_sql(6, 'doc_id')}, 6)), 6) as model_s from documents group by lang)
select *, round(1000 * model_s / nullif(units, 0), 6) as ms_per_unit, round(chars / nullif(model_s, 0), 4) as chars_per_s from g"""


def _percentiles(spark, d):
    """Nearest-rank percentiles of document length by language."""
    at = ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))
    return documents(spark, d, "doc_id", "lang", "n_chars").groupBy("lang").agg(*(F.expr(f"percentile_disc({q}) within group (order by n_chars)").cast("bigint").alias(n) for q, n in at), F.max("n_chars").alias("longest"))


def _pilot(spark, d):
    """Documents chosen label by label, the rarest first, until each has ten or all it has.

    Labels are few, so the loop is over plans; each step anti-joins what is chosen.
    """
    m = gold(spark, d).select("doc_id", "label").distinct()
    order = [x.label for x in m.groupBy("label").agg(F.count("*").alias("n")).orderBy("n", "label").collect()]
    chosen = None
    for label in order:
        own = m.filter(F.col("label") == label).select("doc_id")
        rest = own if chosen is None else own.join(chosen, "doc_id", "left_anti")
        have = 0 if chosen is None else own.join(chosen, "doc_id", "left_semi").count()
        more = rest.orderBy(F.md5(F.concat_ws("|", F.lit("42"), F.col("doc_id").cast("string"))), "doc_id").limit(max(0, 10 - have)).withColumn("taken_for", F.lit(label))
        chosen = more if chosen is None else chosen.unionByName(more)
    return chosen if chosen is not None else m.select("doc_id", F.col("label").alias("taken_for"))


def _assembly(spark, d):
    """Order lines as scored ends of relation slots: heads are parts, tails suppliers."""
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    end = lambda side, c, seed: F.struct(F.lit(side).alias("side"), F.concat(F.lit(side[0]), F.lpad(F.col(c).cast("string"), 9, "0")).alias("surface"), F.round(hash_uniform(seed, F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")), 6).alias("p"))
    scores = li.select("l_orderkey", (F.col("l_linenumber") % 2).cast("int").alias("slot"), F.explode(F.array(end("head", "l_partkey", 11), end("tail", "l_suppkey", 12))).alias("e")).select("l_orderkey", "slot", "e.*")
    return r.assemble_relations(scores, ["l_orderkey"], 0.5).withColumn("confidence", F.round("confidence", 7))


_U = "l_orderkey || '|' || l_partkey || '|' || l_suppkey"
_ASSEMBLY = f"""with s as (select l_orderkey, cast(l_linenumber % 2 as int) as slot, 'h' || lpad(cast(l_partkey as varchar), 9, '0') as h, round({u_sql(11, _U)}, 6) as hp, 't' || lpad(cast(l_suppkey as varchar), 9, '0') as t, round({u_sql(12, _U)}, 6) as tp from lineitem),
h as (select l_orderkey, slot, h, hp from (select *, row_number() over (partition by l_orderkey, slot order by hp desc, h desc) as n from s where hp >= 0.5) where n = 1), t as (select l_orderkey, slot, t, tp from (select *, row_number() over (partition by l_orderkey, slot order by tp desc, t desc) as n from s where tp >= 0.5) where n = 1)
select l_orderkey, slot, h as head, t as tail, round(exp((ln(hp) + ln(tp)) / 2), 7) as confidence from h join t using (l_orderkey, slot)"""


def _decode(spark, d):
    """Exact decoding of four labels under constraints: exactly one of calm and angry, spam implies angry, not all of them."""
    docs = documents(spark, d, "doc_id")
    utility = {k: F.round(hash_uniform(s, F.col("doc_id")) - 0.5, 6) for s, k in enumerate(("calm", "angry", "spam", "long"), 21)}
    labels, score = r.best_assignment(utility, lambda x: x["calm"] != x["angry"] and (x["angry"] or not x["spam"]) and not all(x.values()))
    return docs.select("doc_id", F.array_join(labels, ",").alias("labels"), F.round(score, 6).alias("score"))


_DECODE = f"""with u as (select doc_id, round({u_sql(21, 'doc_id')} - 0.5, 6) as c, round({u_sql(22, 'doc_id')} - 0.5, 6) as a, round({u_sql(23, 'doc_id')} - 0.5, 6) as s, round({u_sql(24, 'doc_id')} - 0.5, 6) as l from documents),
o as (select doc_id, c * x.c + a * x.a + s * x.s + l * x.l as score, x from u, (select {{'c': i & 1, 'a': i >> 1 & 1, 's': i >> 2 & 1, 'l': i >> 3 & 1}} as x from range(16) t(i)) where x.c <> x.a and (x.a = 1 or x.s = 0)),
b as (select doc_id, arg_max(x, score) as x, max(score) as score from o group by doc_id)
select doc_id, array_to_string(list_filter([case when x.c = 1 then 'calm' end, case when x.a = 1 then 'angry' end, case when x.s = 1 then 'spam' end, case when x.l = 1 then 'long' end], lambda v: v is not null), ',') as labels, round(score, 6) as score from b"""


def _partition_check(spark, d):
    """Hard documents (long, or with a repeated line) and easy ones (short, without symbols): what both or neither of them holds is counted."""
    docs = documents(spark, d, "doc_id", "n_chars", "text").select("doc_id", "n_chars", F.contains("text", F.lit("%")).alias("odd"))
    hard, easy = docs.filter("n_chars > 3000 or odd").select("doc_id"), docs.filter("n_chars <= 3500 and not odd").select("doc_id")
    both = hard.unionByName(easy)
    n = lambda f, name: f.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
    every = docs.select("doc_id")
    return n(every.exceptAll(both), "missing").union(n(both.exceptAll(every), "extra")).union(n(hard.intersect(easy), "shared")).union(n(every, "all"))


_PARTITION = """with x as (select n_chars > 3000 or contains(text, '%') as hard, n_chars <= 3500 and not contains(text, '%') as easy from documents)
select 'missing' as "check", count(*) filter (not coalesce(hard, false) and not coalesce(easy, false)) as n from x union all select 'extra', count(*) filter (hard and easy) from x union all select 'shared', count(*) filter (hard and easy) from x union all select 'all', count(*) from x"""

ITEMS = {
    "closed_label_grid": Item(_grid, _GRID),
    "first_wins_dimension": Item(_dimension, "select lower(c_mktsegment) || '/' || c_nationkey as name, min(c_custkey) as c_custkey from customer group by 1"),
    "tag_parser": Item(_tags, _TAGS),
    "page_slices": Item(_pages, _PAGES),
    "writer_gate": Item(_gate, _GATE),
    "mismatch_sample": Item(_mismatches, _MISMATCHES),
    "timing_rollup": Item(_timing, _TIMING),
    "length_percentiles": Item(_percentiles, "select lang, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.9) as p90, quantile_disc(n_chars, 0.99) as p99, max(n_chars) as longest from documents group by lang"),
    "pilot_selection": Item(_pilot),
    "relation_assembly": Item(_assembly, _ASSEMBLY),
    "exact_decode": Item(_decode, _DECODE),
    "partition_check": Item(_partition_check, _PARTITION),
}
