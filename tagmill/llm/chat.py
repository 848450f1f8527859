"""Chat formatting: conversations rebuilt from event logs, then rendered with a reversible template.

An event is a row (conv_id, seq, kind, turn, role, text). Events of a conversation are sorted by ``seq`` and folded:
``message`` starts or replaces a turn's text, ``delta`` appends to it, ``edit`` replaces it, ``regenerate`` empties it (and
drops the turns after it), ``delete`` takes the turn away until a message or edit. A turn has the last role it was given. What is left is rendered as
``<|turn|>role<|says|>text<|end|>`` in turn order. Inside roles and texts every ``<``, backslashes, ``|`` gets one more
backslash before the bar, so no marker can occur there, and taking one away restores the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: Roles whose texts are under the loss mask.
LEARNED = ("assistant",)


def escape(text: Column) -> Column:
    """``text`` without any marker in it, reversibly."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    """What ``escape`` was given."""
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def fold_events(events: DataFrame) -> DataFrame:
    """Final turns (conv_id, turn, role, text) of an event log (conv_id, seq, kind, turn, role, text), in any row order.

    The fold is windowed: a turn's text is what its events since the last one that replaces it say, put together; a
    turn is gone if an event after its last one deletes it or regenerates an earlier turn. All windows run over one sort
    of a conversation with running frames, so their cost is linear in its events; texts are gathered per turn only.
    Null texts count as empty, null kinds as ``message``; ties in ``seq`` go by turn, kind, role and text; an event told
    again with the same ``seq`` counts once. A null conv_id or turn is a key of its own. Extra columns are ignored; an
    empty table gives an empty result.
    """
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    e = events.select("conv_id", "seq", kind.alias("kind"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    order = ["seq", "turn", "kind", "role", "text"]
    whole = Window.partitionBy("conv_id").orderBy(*order)
    backwards = Window.partitionBy("conv_id").orderBy(*map(F.desc, order)).rowsBetween(Window.unboundedPreceding, -1)
    per_turn = Window.partitionBy("conv_id", "turn").orderBy(*order)
    so_far = per_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_of_turn = per_turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.struct(*order)
    e = e.withColumn("again", F.coalesce(F.lag(told).over(whole).eqNullSafe(told), F.lit(False))).filter("not again")
    cut_turn = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(backwards)
    e = e.withColumn("dropped", F.coalesce(cut_turn < F.col("turn"), F.lit(False)))
    e = e.withColumn("role", F.last("role", ignorenulls=True).over(all_of_turn)).withColumn("nth", F.row_number().over(per_turn))
    e = e.withColumn("epoch", F.sum((F.col("kind") != "delta").cast("long")).over(so_far))
    live = e.withColumn("last", F.max("epoch").over(Window.partitionBy("conv_id", "turn"))).filter("epoch = last and not dropped")
    said = F.when(F.col("kind").isin("regenerate", "delete"), F.lit("")).otherwise(F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("nth", said.alias("said"))))
    turns = live.groupBy("conv_id", "turn").agg(
        F.max("role").alias("role"),
        F.array_join(F.transform(parts, lambda x: x["said"]), "").alias("text"),
        F.max((F.col("kind") == "delete").cast("int")).alias("gone"),
    )
    return turns.filter("gone = 0").drop("gone")


def render(turns: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans) of ``turns`` (conv_id, turn, role, text).

    ``loss_spans`` are the [start, end) code points and [from, to) UTF-8 bytes of the learned roles' escaped texts in ``formatted``. Null texts and
    roles are empty; rows with one turn number keep (role, text) order, repeated rows are all rendered; a null conv_id
    is a conversation of its own; extra columns are ignored; an empty table gives an empty result. Offsets are running
    sums over a window, so a long conversation costs no more than its sort; its one formatted text must fit a row.
    """
    role, text = escape(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    lines = turns.select("conv_id", "turn", "role", "text", F.concat(F.lit(TURN), role, F.lit(SAYS)).alias("head"), text.alias("body"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = lines.withColumn("nth", F.row_number().over(order))
    for at, size in (("at", F.length), ("at_byte", F.octet_length)):
        placed = placed.withColumn(at, F.coalesce(F.sum(size("head") + size("body") + len(END)).over(before), F.lit(0)))
    start, first = F.col("at") + F.length("head"), F.col("at_byte") + F.octet_length("head")
    span = F.when(F.col("role").isin(*learned), F.struct(start.alias("start"), (start + F.length("body")).alias("end"), first.alias("from"), (first + F.octet_length("body")).alias("to")))
    return placed.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", F.concat("head", "body", F.lit(END)).alias("line")))), lambda x: x["line"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text of ``formatted`` under the mask ``spans``, unescaped, cut out by bytes: each span costs its own length only."""
    held = F.array(F.struct(formatted.cast("binary").alias("raw"), spans.alias("spans")))  # so that the bytes are made once
    piece = lambda h, s: F.substring(h["raw"], (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")).cast("string")
    return F.element_at(F.transform(held, lambda h: F.array_join(F.transform(h["spans"], lambda s: unescape(piece(h, s))), "")), 1)


def parse(formatted: Column) -> Column:
    """Array of (role, text), unescaped, read back from a formatted conversation."""
    lines = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    cut_end = F.transform(lines, lambda x: x.substr(F.lit(1), F.length(x) - len(END)))
    return F.transform(
        cut_end,
        lambda x: F.struct(
            unescape(F.substring_index(x, SAYS, 1)).alias("role"),
            unescape(F.element_at(F.split(x, r"<\|says\|>", 2), 2)).alias("text"),
        ),
    )


def format_chats(events: DataFrame, learned: tuple[str, ...] = LEARNED) -> DataFrame:
    """Event log to formatted conversations: fold, then render."""
    return render(fold_events(events), learned)
