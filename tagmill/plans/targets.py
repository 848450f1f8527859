"""Queries on surfaces, boundaries, policies and chunk merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tagmill.functions import text as t
from tagmill.functions.hashing import hash_uniform
from tagmill.functions.text import find_all
from tagmill.operators import chunks as ch
from tagmill.operators import targets as tg
from tagmill.operators.structures import cells_to_spans
from tagmill.plans import Item
from tagmill.plans.derived import MENTIONS_SQL, documents, gold, u_sql
from tagmill.sources import table
from tagmill.written import cut

_WS = r"[^ \t\n\r\f\x0B]+"
_WS_SQL = r"[^ \t\n\r\f\v]+"


def _turns(spark, d):
    """Conversation turns as white-space tokens."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text")
    return c.select("conv_id", "turn", F.regexp_extract_all(F.lower("text"), F.lit(_WS), F.lit(0)).alias("w"))


_TURNS = f"t as (select conv_id, turn, regexp_extract_all(lower(text), '{_WS_SQL}') as w from conversations)"


def _runs(spark, d):
    """How often a turn's first two words, and its third, stand in it."""
    turns = _turns(spark, d)
    two, one = F.slice("w", 1, 2), F.slice("w", 3, 1)
    return turns.select("conv_id", "turn", tg.run_count(F.col("w"), two).alias("pairs"), tg.run_count(F.col("w"), one).alias("singles"), tg.has_run(F.col("w"), F.reverse(two)).alias("reversed"))


_RUNS = f"""with {_TURNS}
select conv_id, turn, cast(len(list_filter(range(1, len(w)), lambda i: len(w) > 1 and w[i] = w[1] and w[i + 1] = w[2])) + case when len(w) = 1 then 1 else 0 end as int) as pairs, cast(len(list_filter(w, lambda x: x = w[3])) as int) as singles,
  coalesce(len(list_filter(range(1, len(w)), lambda i: w[i] = w[2] and w[i + 1] = w[1])) > 0, false) or len(w) = 1 as reversed from t"""


def _find(spark, d):
    """The whole-word places of one word in all documents, under two occurrence policies."""
    at = tg.whole_words(F.lower("text"), "e-mail")
    more = tg.whole_words(F.lower("text"), "the")
    docs = documents(spark, d, "doc_id", "text").select("doc_id", F.inline(F.concat(at, tg.by_policy(more, "first"))))
    return docs.select("doc_id", "start", "end", F.col("text").alias("surface"))


_FIND = r"""with s as (select doc_id, lower(text) as t from documents), p as (select doc_id, t, unnest(['e-mail', 'the']) as w from s),
x as (select doc_id, w, string_split(t, w) as ps, t from p), i as (select doc_id, w, t, ps, unnest(range(1, len(ps))) as k from x),
o as (select doc_id, w, t, cast(list_sum(list_transform(ps[1:k], lambda y: length(y))) + (k - 1) * length(w) as int) as s from i),
a as (select *, row_number() over (partition by doc_id, w order by s) as n from o where not regexp_matches(substr(t, s, case when s = 0 then 0 else 1 end), '[\p{L}\p{N}_]') and not regexp_matches(substr(t, s + length(w) + 1, 1), '[\p{L}\p{N}_]'))
select doc_id, s as "start", cast(s + length(w) as int) as "end", w as surface from a where w = 'e-mail' or n = 1"""


def _tokens(spark, d):
    """White-space tokens with offsets of the documents that hold a mention."""
    m = cut(gold(spark, d).select("doc_id", "start", "end", "label"), "mentions")
    docs = documents(spark, d, "doc_id", "text").join(m.select("doc_id").distinct(), "doc_id", "left_semi")
    pieces = docs.select("doc_id", F.posexplode(F.split("text", "(?<=[ \t\n\r\f\x0B])(?=[^ \t\n\r\f\x0B])", -1)).alias("n", "piece"))
    end = F.sum(F.length("piece")).over(Window.partitionBy("doc_id").orderBy("n"))
    word = F.regexp_extract("piece", r"[^ \t\n\r\f\x0B]+", 0)
    t = pieces.withColumn("start", (end - F.length("piece")).cast("int")).filter(F.length(word) > 0)
    return m, t.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("n")) - 1).alias("pos"), "start", (F.col("start") + F.length(word)).alias("end"))


def _boundaries(spark, d):
    """Mentions in tokens: places, what a cut after 200 tokens leaves, and the characters of the tokens."""
    m, t = _tokens(spark, d)
    placed = cut(tg.char_to_token(m, t, ["doc_id"]), "placed")
    back = tg.token_to_char(placed.select("doc_id", F.col("start").alias("s"), "token_start", "token_end"), t, ["doc_id"])
    kept = tg.truncate(placed, ["doc_id"], 200, "drop_target").select("doc_id", F.col("start").alias("s"), F.lit(True).alias("kept"))
    whole = tg.truncate(placed, ["doc_id"], 200, "drop_example").select("doc_id", F.col("start").alias("s"), F.lit(True).alias("whole"))
    out = back.join(kept, ["doc_id", "s"], "left").join(whole, ["doc_id", "s"], "left")
    return out.select("doc_id", F.col("s").alias("start"), "token_start", "token_end", F.col("start").alias("chars_from"), F.col("end").alias("chars_to"), F.coalesce("kept", F.lit(False)).alias("kept"), F.coalesce("whole", F.lit(False)).alias("whole"))


_BOUNDARIES = rf"""with recursive {MENTIONS_SQL},
p as (select doc_id, unnest(regexp_extract_all(text, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*')) as piece, generate_subscripts(regexp_extract_all(text, '[^ \t\n\r\f\v]+[ \t\n\r\f\v]*'), 1) - 1 as pos, length(regexp_extract(text, '^[ \t\n\r\f\v]*')) as lead from documents where doc_id in (select doc_id from mentions)),
o as (select *, lead + coalesce(sum(length(piece)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as s, length(regexp_extract(piece, '[^ \t\n\r\f\v]+')) as n from p),
j as (select m.doc_id, m."start", min(o.pos) as a, max(o.pos) + 1 as b, min(o.s) as f, max(o.s + o.n) as t from mentions m join o on o.doc_id = m.doc_id and o.s < m."end" and m."start" < o.s + o.n group by all)
select doc_id, cast("start" as int) as "start", cast(a as int) as token_start, cast(b as int) as token_end, cast(f as int) as chars_from, cast(t as int) as chars_to, b <= 200 as kept, max(b) over (partition by doc_id) <= 200 as whole from j"""


def _repair(spark, d):
    """Recognised surfaces of which each document's first mention stays tagged: where the others are found again."""
    m = cut(gold(spark, d).select("doc_id", "start", "end", "label", "surface"), "mentions")
    first = m.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("start"))).filter("_n = 1")
    return tg.repair_untagged(documents(spark, d, "doc_id", "text"), first, m.select("doc_id", "label", F.col("surface").alias("value")), "doc_id", most=3, never=("ipv4",))


_REPAIR = rf"""with recursive {MENTIONS_SQL},
f as (select doc_id, "start" as s, "end" as e from (select *, row_number() over (partition by doc_id order by "start") as n from mentions) where n = 1),
v as (select distinct doc_id, label, surface as v from mentions where length(surface) > 3),
i as (select v.*, lower(text) as t, text, string_split(lower(text), lower(v)) as ps from v join documents using (doc_id)),
k as (select *, unnest(range(1, len(ps))) as k from i), o as (select *, cast(list_sum(list_transform(ps[1:k], lambda y: length(y))) + (k - 1) * length(v) as int) as s from k),
a as (select doc_id, label, s, cast(s + length(v) as int) as e, substr(text, s + 1, length(v)) as surface from o where not regexp_matches(substr(t, s, case when s = 0 then 0 else 1 end), '[\p{{L}}\p{{N}}_]') and not regexp_matches(substr(t, s + length(v) + 1, 1), '[\p{{L}}\p{{N}}_]')),
l as (select * from a where not exists (select 1 from a b where b.doc_id = a.doc_id and b.s < a.e and a.s < b.e and (b.e - b.s > a.e - a.s or (b.e - b.s = a.e - a.s and b.s < a.s)))),
g as (select l.* from l where not exists (select 1 from f where f.doc_id = l.doc_id and f.s < l.e and l.s < f.e))
select doc_id, s as "start", e as "end", label, surface from g where doc_id not in (select doc_id from g group by 1 having count(*) > 3 or bool_or(label = 'ipv4'))"""


def _chunked(spark, d):
    """Documents in chunks of 1,000 characters every 800; what looks like an e-mail or a capitalised word pair in a chunk is an item."""
    docs = documents(spark, d, "doc_id", "text")
    starts = docs.select("doc_id", "text", F.posexplode(F.sequence(F.lit(0), F.greatest(F.length("text") - 201, F.lit(0)), F.lit(800))).alias("chunk", "start_char"))
    return docs, starts.withColumn("piece", F.substring("text", F.col("start_char") + 1, F.lit(1000))).select("doc_id", "chunk", "start_char", "piece")


_CHUNKED = "c as (select doc_id, text, cast(s // 800 as int) as chunk, s, substr(text, s + 1, 1000) as piece from (select doc_id, text, unnest(range(0, greatest(length(text) - 201, 0) + 1, 800)) as s from documents))"


def _remap(spark, d):
    docs, chunks = _chunked(spark, d)
    at = chunks.select("doc_id", "chunk", F.inline(find_all(F.col("piece"), "@")))
    items = at.select("doc_id", "chunk", "start", (F.col("start") + 4).alias("end"), F.lit("?").alias("surface"))
    return ch.remap(items, chunks, docs, "doc_id")


_REMAP = f"""with {_CHUNKED}, i as (select doc_id, chunk, s, text, unnest(list_filter(range(1, length(piece) + 1), lambda i: substr(piece, i, 1) = '@')) as a from c where contains(piece, '@'))
select doc_id, chunk, cast(s + a - 1 as int) as "start", cast(s + a + 3 as int) as "end", case when s + a + 3 <= length(text) then substr(text, s + a, 4) else '?' end as surface from i"""


def _votes(spark, d):
    """A document's most confident class and most frequent first letter over its chunks."""
    _, chunks = _chunked(spark, d)
    chunks = chunks.withColumn("n", F.length(F.regexp_replace("piece", "[^aeiou]", "")))
    choice = chunks.select("doc_id", "chunk", F.when(F.col("n") % 3 == 0, "low").when(F.col("n") % 3 == 1, "mid").alias("choice"), (F.col("n") % 7 / 7).alias("confidence"))
    letter = chunks.select("doc_id", "chunk", F.lower(F.regexp_extract("piece", "[A-Za-z]", 0)).alias("value"))
    return ch.merge_choices(choice, ["doc_id"]).join(ch.merge_strings(letter, ["doc_id"]), "doc_id", "full_outer").withColumn("confidence", F.round("confidence", 7))


_VOTES = f"""with {_CHUNKED}, x as (select doc_id, chunk, length(regexp_replace(piece, '[^aeiou]', '', 'g')) as n, lower(regexp_extract(piece, '[A-Za-z]')) as v from c),
a as (select doc_id, case n % 3 when 0 then 'low' else 'mid' end as choice, n % 7 / 7 as confidence from (select *, row_number() over (partition by doc_id order by n % 7 desc, chunk) as r from x where n % 3 < 2) where r = 1),
b as (select doc_id, v as value, votes from (select doc_id, v, count(*) as votes, row_number() over (partition by doc_id order by count(*) desc, min(chunk), v) as r from x where v <> '' group by doc_id, v) where r = 1)
select coalesce(a.doc_id, b.doc_id) as doc_id, choice, round(confidence, 7) as confidence, value, votes from a full join b on a.doc_id = b.doc_id"""


def _graph(spark, d):
    """Turns as chunks of a conversation: words as entities by first letter, an edge from a turn's first word to its second; merged."""
    t = _turns(spark, d).select("conv_id", F.col("turn").cast("int").alias("chunk"), F.slice("w", 1, 2).alias("w"))
    e = t.select("conv_id", "chunk", F.posexplode("w").alias("i", "word"))
    e = e.select("conv_id", "chunk", F.concat(F.lit("x"), F.col("i").cast("string")).alias("id"), F.substring("word", 1, 1).alias("type"), (F.length("word") % 5).alias("start"), (F.length("word") % 5 + 2).alias("end"), (F.length("word") / 32.0).cast("double").alias("confidence"))
    r = t.filter(F.size("w") == 2).select("conv_id", "chunk", F.lit("next").alias("type"), F.lit("x0").alias("head"), F.lit("x1").alias("tail"), (F.length(F.element_at("w", 1)) / 64.0).cast("double").alias("confidence"))
    return ch.merge_graph(e, r, "conv_id")


_GRAPH = f"""with {_TURNS}, e0 as (select conv_id, turn, unnest([0, 1]) as i, unnest(w[1:2]) as word from t), e1 as (select conv_id, turn, i, left(word, 1) as type, length(word) % 5 as s, length(word) / 32.0 as c from e0 where word is not null),
one as (select *, 'e' || row_number() over (partition by conv_id order by s, s + 2, type) as id from (select conv_id, type, s, max(c) as c from e1 group by all)),
o as (select e1.conv_id, turn, i, id from e1 join one using (conv_id, type, s)),"""


def _graph_edges(spark, d):
    return _graph(spark, d)[1].select("conv_id", "type", "head", "tail", F.round("confidence", 6).alias("confidence"))


def _cells(spark, d):
    """One- and two-word spans of turns whose score by hash is high enough, stripped of the full stop's neighbour."""
    c = table(spark, d, "conversations", "conv_id", "turn", "text").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text")
    pieces = c.select("doc", F.posexplode(F.split("text", " ", -1)).alias("pos", "w"))
    end = F.sum(F.length("w") + 1).over(Window.partitionBy("doc").orderBy("pos")) - 1
    tokens = pieces.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("w"))
    width = F.explode(F.array(F.lit(1), F.lit(2))).alias("width")
    cells = tokens.select("doc", F.col("pos").alias("first"), width).withColumn("label", F.when(F.col("width") == 1, "one").otherwise("two")).withColumn("p", F.round(hash_uniform(131, F.col("doc"), F.col("first"), F.col("width")), 6))
    return cells_to_spans(cells, tokens, c, "doc", 0.9)


_CELLS = f"""with t as (select conv_id || ':' || turn as doc, text, unnest(string_split(text, ' ')) as w, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from conversations),
o as (select *, cast(sum(length(w) + 1) over (partition by doc order by pos) - 1 as int) as e from t),
c as (select a.doc, a.text, a.pos, 1 as k, a.e - length(a.w) as s, a.e from o a union all select a.doc, a.text, a.pos, 2, a.e - length(a.w), b.e from o a join o b on b.doc = a.doc and b.pos = a.pos + 1),
p as (select *, round({u_sql(131, "doc || '|' || pos || '|' || k")}, 6) as p from c)
select doc, case k when 1 then 'one' else 'two' end as label, cast(s as int) as "start", e as "end", trim(substr(text, cast(s as int) + 1, cast(e - s as int))) as surface, p from p where p >= 0.9 and trim(substr(text, cast(s as int) + 1, cast(e - s as int))) <> ''"""


def _aligned(spark, d):
    """Sentences with their white space squeezed, sought in the text again: how many, where they start, and whether each says the same."""
    docs = documents(spark, d, "doc_id", "text")
    said = F.transform(t.sentences(F.col("text")), lambda s: t.squeeze(s))
    places = t.align_sentences(F.col("text"), said)
    rows = docs.select("doc_id", said.alias("said"), places.alias("at"), "text")
    same = F.forall(F.arrays_zip("said", "at"), lambda x: F.length(F.regexp_replace(x["said"], r"\s", "")) <= x["at"]["end"] - x["at"]["start"])
    return rows.select("doc_id", F.size("at").alias("sentences"), F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["start"]).alias("starts"), same.alias("fits"))


ITEMS = {
    "token_run_counts": Item(_runs, _RUNS),
    "whole_word_places": Item(_find, _FIND),
    "token_boundaries": Item(_boundaries, _BOUNDARIES),
    "untagged_repair": Item(_repair, _REPAIR),
    "span_cells": Item(_cells, _CELLS),
    "sentence_alignment": Item(_aligned),
    "chunk_remap": Item(_remap, _REMAP),
    "chunk_votes": Item(_votes, _VOTES),
    "chunk_graph_entities": Item(lambda s, d: _graph(s, d)[0].withColumn("confidence", F.round("confidence", 6)), _GRAPH.rstrip(",") + ' select conv_id, id, type, cast(s as int) as "start", cast(s + 2 as int) as "end", round(c, 6) as confidence from one'),
    "chunk_graph_relations": Item(_graph_edges, _GRAPH + " r as (select conv_id, turn, length(w[1]) / 64.0 as c from t where len(w) > 1) select r.conv_id, 'next' as type, a.id as head, b.id as tail, round(max(c), 6) as confidence from r join o a on a.conv_id = r.conv_id and a.turn = r.turn and a.i = 0 join o b on b.conv_id = r.conv_id and b.turn = r.turn and b.i = 1 group by 1, 2, 3, 4"),
}
