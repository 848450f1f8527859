"""Repair of conversations: the cheapest edits that make roles alternate, by a Viterbi search that gives edits as soon as they are settled.

Edits are Keep (0), Rerole to user or assistant (1), Delete (2; blank and duplicate rows must go) and Insert an empty
user or assistant row (5); a truncated row that stays costs 5. The roles left must read ``(s?(ua)+)?`` by their initials. An
empty role has no initial. Of equally cheap repairs the one with the least string of edit initials is taken.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagmill.llm.common import bounded_batches
from tagmill.operators.corpus import beside
from tagmill.written import cut

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
SPACES = " \t\n\x0b\x0c\r"
#: Rows of a segment, as a power of two: a conversation of more rows is repaired in segments that meet at their states.
SEGMENT_BITS = 16
#: Rows of a batch that a task gives.
GIVEN = 4096

# States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = 4
_NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
_ENDS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: What it may cost at most to do from the first state what the second one does; a state that costs more than that
#: above another is never part of the cheapest repair.
_INSTEAD = {
    (ASSISTANT, START): DELETE, (ASSISTANT, SYSTEM): 0, (ASSISTANT, USER): INSERT,
    (START, SYSTEM): 0, (START, ASSISTANT): 0, (START, USER): INSERT,
    (SYSTEM, START): DELETE + 2 * INSERT, (SYSTEM, USER): INSERT, (SYSTEM, ASSISTANT): 2 * INSERT,
    (USER, ASSISTANT): INSERT, (USER, SYSTEM): INSERT, (USER, START): DELETE + INSERT,
}


def _moves(state: int, initial: str, truncated: bool, gone: bool) -> Iterator[tuple[int, int, str]]:
    """(next state, cost, edits) of one row. Rows are inserted before a row that stays: before a deleted one they would only come later in order."""
    yield state, DELETE, "D"
    if gone:
        return
    extra = TRUNCATED if truncated else 0
    for inserted in range(3):  # a third one leads back to the state after the first
        role, to = _NEXT[state]
        if not initial:  # an empty role adds no initial
            yield state, INSERT * inserted + extra, "I" * inserted + "K"
        elif initial == role[0]:
            yield to, INSERT * inserted + extra, "I" * inserted + "K"
        elif initial == "s" and state == START:
            yield SYSTEM, INSERT * inserted + extra, "I" * inserted + "K"
        yield to, INSERT * inserted + REROLE + extra, "I" * inserted + "R"
        state = to


class Front:
    """Costs of the states and the order of their survivors' edit strings, from which each row's choice follows.

    Two survivors end in other states, so their strings differ, and neither begins the other, as each ends with the edit
    of the same row. The order carried on from row to row is therefore that of the complete unresolved strings: survivors with
    other parents are ordered as these, those with one parent by their own edits. Differences of costs are bounded, so
    there are few fronts; what follows from each is remembered.
    """

    _known: dict[tuple, Front] = {}

    def __init__(self, costs: tuple, order: tuple):
        self.costs, self.order, self._after = costs, order, {}

    @classmethod
    def of(cls, costs: tuple, order: tuple) -> Front:
        return cls._known.setdefault((costs, order), cls(costs, order))

    @classmethod
    def at(cls, state: int) -> Front:
        return cls.of(tuple(0 if s == state else None for s in range(_STATES)), (state,))

    def after(self, kind: tuple) -> tuple[Front, int, tuple]:
        """(next front, cost added to all, (state, parent state, edits) of each survivor) after a row of ``kind``: (initial, truncated, gone)."""
        found = self._after.get(kind)
        if found is None:
            found = self._after[kind] = self._step(kind)
        return found

    def _step(self, kind: tuple) -> tuple[Front, int, tuple]:
        best: dict[int, tuple] = {}
        for rank, state in enumerate(self.order):
            for to, cost, edits in _moves(state, *kind):
                told = (self.costs[state] + cost, rank, edits, state)
                if to not in best or told < best[to]:
                    best[to] = told
        kept = {s: t for s, t in best.items() if not any(best[q][0] + extra < t[0] for (q, p), extra in _INSTEAD.items() if p == s and q in best)}
        least = min(t[0] for t in kept.values())
        order = tuple(sorted(kept, key=lambda s: kept[s][1:3]))
        costs = tuple(kept[s][0] - least if s in kept else None for s in range(_STATES))
        return Front.of(costs, order), least, tuple((s, kept[s][3], kept[s][2]) for s in order)

    def end(self) -> tuple[int, str]:
        """The state in which the cheapest repair ends and the rows inserted after the last one."""
        return min((self.costs[s] + INSERT * len(_ENDS[s]), rank, s, _ENDS[s]) for rank, s in enumerate(self.order))[2:]


class _Node:
    """A survivor's edits of one row; ``children`` are the nodes that refer to it."""

    __slots__ = ("children", "edits", "parent", "row")

    def __init__(self, parent: _Node | None, edits: str, row: dict | None):
        self.parent, self.edits, self.row, self.children = parent, edits, row, []


class Repair:
    """The search over rows in order, from ``state``; ``give`` gets each row with its edits as soon as no survivor differs in it.

    Survivors are the leaves of a tree. A node to which none refers any more goes, and so on towards the root; while the root
    has one child, all survivors share it, so its edits are settled and it becomes the root. Memory holds the rows since
    the last common ancestor only.
    """

    def __init__(self, state: int, give: Callable[[dict, str], None]):
        self.front, self.give = Front.at(state), give
        self.root = _Node(None, "", None)
        self.tips = {state: self.root}

    def row(self, row: dict, kind: tuple) -> None:
        self.front, _, steps = self.front.after(kind)
        tips = {}
        for state, parent, edits in steps:
            node = tips[state] = _Node(self.tips[parent], edits, row)
            node.parent.children.append(node)
        self._settle(tips)

    def end(self, state: int | None) -> str:
        """Settle all rows: the survivor in ``state``, or the cheapest one; the edits after the last row come back."""
        tail = ""
        if state is None:
            state, tail = self.front.end()
        self._settle({state: self.tips[state]})
        return tail

    def _settle(self, tips: dict[int, _Node]) -> None:
        live = set(map(id, tips.values()))
        for node in self.tips.values():
            while node is not self.root and not node.children and id(node) not in live:
                parent, node.parent = node.parent, None
                parent.children.remove(node)
                node = parent
        self.tips = tips
        while len(self.root.children) == 1:
            child = self.root.children[0]
            self.root.children, child.parent, self.root = [], None, child
            self.give(child.row, child.edits)


# rows


def _faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, truncated, copies): equal rows as one, texts as their digests; nulls are one space."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    ended = F.rtrim(text, F.lit(SPACES))
    said = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), digest_of(text).alias("digest"), (ended == "").alias("blank"), (~F.substring(ended, -1, 1).isin(".", "!", "?")).alias("truncated"))
    return said.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("copies"))


def digest_of(text: Column) -> Column:
    """The first 128 bits of the SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def ordered_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows with faults and ``at``, which rises along a conversation: by turn (nulls first), then role, then digest.

    A (role, text) is a duplicate where it stands at an earlier turn; further copies of one row are duplicates anyway. Rows are
    range-partitioned, so a conversation of any length spreads over tasks; ``segment`` numbers runs of 2^SEGMENT_BITS rows.
    """
    distinct = _faults(rows)
    turn = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = distinct.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("_first"))
    marked = beside(distinct, first, ["conv_id", "role", "digest"]).withColumn("duplicate", (turn > F.col("_first")) & ~F.col("blank")).drop("_first")
    parts = max(4, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv_id", "turn", "role", "digest"]
    placed = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    return cut(placed.withColumn("segment", F.shiftright("at", SEGMENT_BITS)), "ordered")


def _kind(row: dict) -> tuple:
    return row["role"][:1], row["truncated"], row["blank"] or row["duplicate"]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, dict]]:
    """Rows with whether one begins a segment of a conversation."""
    last = None
    for batch in batches:
        for row in batch.to_pylist():
            here = (row["conv_id"], row["segment"])
            yield here != last, row
            last = here


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, segment, costs, ranks) by entry and exit state: what it costs to come from one to the other, and the order of the edits."""
    names = ["conv_id", "segment", "costs", "ranks"]
    open_row, fronts, added = None, [], []

    def told() -> pa.RecordBatch:
        costs, ranks = [], []
        for front, more in zip(fronts, added, strict=True):
            costs += [None if c is None else c + more for c in front.costs]
            ranks += [front.order.index(s) if s in front.order else None for s in range(_STATES)]
        return pa.RecordBatch.from_pydict({"conv_id": pa.array([open_row["conv_id"]], kind), "segment": [open_row["segment"]], "costs": pa.array([costs], pa.list_(pa.int64())), "ranks": pa.array([ranks], pa.list_(pa.int64()))}).select(names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for begins, row in _segments(iter([batch])):
            if begins and (open_row is None or (row["conv_id"], row["segment"]) != (open_row["conv_id"], open_row["segment"])):
                if open_row is not None:
                    yield told()
                fronts, added = [Front.at(s) for s in range(_STATES)], [0] * _STATES
            open_row = row
            for i, front in enumerate(fronts):
                fronts[i], more, _ = front.after(_kind(row))
                added[i] += more
                if row["copies"] > 1:
                    added[i] += DELETE * (row["copies"] - 1)
    if open_row is not None:
        yield told()


def _routes(key: tuple, segments: pa.Table) -> pa.Table:
    """(conv_id, segment, entry, exit) of one conversation's segments: the search once more, with segments for rows; the last one's exit is null."""
    rows = sorted(segments.to_pylist(), key=lambda r: r["segment"])
    costs, order, back = {START: 0}, [START], []
    for row in rows:
        best: dict[int, tuple] = {}
        for rank, state in enumerate(order):
            for to in range(_STATES):
                cost, inner = row["costs"][state * _STATES + to], row["ranks"][state * _STATES + to]
                if cost is not None:
                    told = (costs[state] + cost, rank, inner, state)
                    if to not in best or told < best[to]:
                        best[to] = told
        back.append({s: t[3] for s, t in best.items()})
        costs, order = {s: t[0] for s, t in best.items()}, sorted(best, key=lambda s: best[s][1:3])
    state = min((costs[s] + INSERT * len(_ENDS[s]), rank, s) for rank, s in enumerate(order))[2]
    found, last = [], None
    for row, came in zip(reversed(rows), reversed(back), strict=True):
        entry = came[state]
        found.append((row["segment"], entry, last))
        state = last = entry
    return pa.table({"conv_id": pa.array([key[0].as_py()] * len(found), segments.schema.field("conv_id").type), "segment": [f[0] for f in found], "entry": pa.array([f[1] for f in found], pa.int32()), "exit": pa.array([f[2] for f in found], pa.int32())})


_ARRAY = pa.list_(pa.string())


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with edits, before, new_role and after, a segment at a time."""
    given: list[tuple] = []
    state = START

    def give(row: dict, edits: str) -> None:
        nonlocal state
        before, new_role = [], None
        for letter in edits:
            if letter == "K":
                new_role = row["role"]
                if new_role:
                    state = SYSTEM if new_role[0] == "s" else _NEXT[state][1]
            elif letter != "D":
                role, state = _NEXT[state]
                if letter == "R":
                    new_role = role
                else:
                    before.append(role)
        given.append((row, edits + "D" * (row["copies"] - 1), before, new_role, []))

    def close(search: Repair, exit_state: int | None) -> None:
        nonlocal state
        for _ in search.end(exit_state):
            role, state = _NEXT[state]
            given[-1][4].append(role)
            given[-1] = (given[-1][0], given[-1][1] + "I", *given[-1][2:])

    def told(some: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
        rows = [g[0] for g in some]
        own = [pa.array([r[f.name] for r in rows], f.type) for f in schema if f.name not in ("entry", "exit")]
        more = [pa.array([g[1] for g in some], pa.string()), pa.array([g[2] for g in some], _ARRAY), pa.array([g[3] for g in some], pa.string()), pa.array([g[4] for g in some], _ARRAY)]
        return pa.RecordBatch.from_arrays([*own, *more], [f.name for f in schema if f.name not in ("entry", "exit")] + ["edits", "before", "new_role", "after"])

    search, exit_state, last, schema = None, None, None, None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            here = (row["conv_id"], row["segment"])
            if here != last:
                if search:
                    close(search, exit_state)
                state = START if row["entry"] is None else row["entry"]
                search, exit_state, last = Repair(state, give), row["exit"], here
            search.row(row, _kind(row))
            if len(given) > GIVEN:
                yield told(given[:-1], schema)
                del given[:-1]
    if search:
        close(search, exit_state)
        yield told(given, schema)


def repair(rows: DataFrame) -> DataFrame:
    """Edits of the rows (conv_id, turn, role, text): one row for each distinct one, in the order of ``at`` inside its conversation.

    (conv_id, turn, role, digest, blank, truncated, duplicate, copies, at, segment, edits, before, new_role, after): ``edits`` are
    the initials D, I, K and R in order, ``before`` and ``after`` the roles inserted around the row, ``new_role`` is null for
    a deleted one; ``copies`` equal rows are the row and its duplicates, which are deleted. A null conv_id is a
    conversation, a null role or text one space, null turns come first; rows of one turn follow by role and digest. Extra columns
    are ignored; no row gives no row. A conversation that spans segments is searched twice: first what each segment
    costs from each state to each, then, with its entry and exit known, its edits. Segments of a conversation meet in
    one group, one row of 32 numbers for 2^SEGMENT_BITS rows.
    """
    bounded_batches(rows.sparkSession)
    placed = ordered_rows(rows)
    segments = placed.select("conv_id", "segment").distinct()
    several = segments.groupBy("conv_id").agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n").withColumn("_several", F.lit(True))
    kind = rows.schema["conv_id"].dataType.simpleString()
    parted = beside(placed, several, ["conv_id"]).drop("_several")
    together = lambda f: f.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "at")
    summaries = together(parted).mapInArrow(_summaries, f"conv_id {kind}, segment long, costs array<long>, ranks array<long>")
    routes = summaries.groupBy("conv_id").applyInArrow(_routes, f"conv_id {kind}, segment long, entry int, exit int")
    routed = beside(placed, cut(routes, "routes"), ["conv_id", "segment"], "left")
    own = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    return together(routed).mapInArrow(_edited, f"{own}, edits string, before array<string>, new_role string, after array<string>")


_KEYS = ["conv_id", "turn", "role", "digest"]


def _texts(rows: DataFrame) -> DataFrame:
    """Texts under the keys of their edits."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), digest_of(text).alias("digest"), text.alias("text"))


def with_texts(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """``edits`` with the texts of the rows that stay; each text travels once, whatever its copies."""
    keys = _KEYS
    told = _texts(rows).groupBy(*keys).agg(F.first("text").alias("text")).select(*(F.col(c).alias(f"_{c}") for c in keys), "text")
    same = F.col("new_role").isNotNull()
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return edits.join(told, same, "left").drop(*(f"_{c}" for c in keys))


def repaired_rows(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, at, part, role, text) of the repaired conversations: sorted by at and part, they are in order; inserted texts are empty."""
    full = with_texts(edits, rows)
    empty = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))
    own = F.when(F.col("new_role").isNotNull(), F.array(F.struct(F.col("new_role").alias("role"), "text"))).otherwise(F.array().cast("array<struct<role:string,text:string>>"))
    return full.select("conv_id", "at", F.posexplode(F.concat(F.transform("before", empty), own, F.transform("after", empty))).alias("part", "row")).select("conv_id", "at", "part", "row.role", "row.text")


_REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_LEGAL = {"su", "ua", "au"}


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its edits in order, each followed by its texts; a text is hashed and forgotten."""
    last, told, kind, begun, waiting = None, [], None, False, None

    def say(row: dict, text: str) -> None:
        nonlocal first
        own = [(row["new_role"], text)] if row["new_role"] is not None else []
        for role, said in [*((r, "") for r in row["before"]), *own, *((r, "") for r in row["after"])]:
            hashed.update(f"{'' if first else chr(10)}{role}:{said}".encode("utf-8", "surrogatepass"))
            first = False

    def close() -> None:
        spread = n["high"] - n["low"] + 1 - n["turns"] if n["turns"] else 0
        told.append((last, min(spread, (1 << 63) - 1), n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(audit), hashed.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([t[i] for t in told], types[i]) for i in range(9)], ["conv_id", *_REPORT])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if row["edits"] is None:  # a text: that of the row before, or one more copy, or of a deleted row
                if waiting is not None:
                    say(waiting, row["text"])
                    waiting = None
                continue
            if not begun or row["conv_id"] != last:
                if begun:
                    close()
                last, begun, audit, hashed, first = row["conv_id"], True, [], hashlib.sha256(), True
                n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost", "turns"), 0) | {"low": None, "high": None, "initial": None}
            copies, initial = row["copies"], row["role"][:1]
            n["blank"] += copies if row["blank"] else 0
            n["duplicate"] += 0 if row["blank"] else copies - 1 + row["duplicate"]
            counts = row["truncated"] and not row["blank"] and not row["duplicate"]
            n["truncated"] += counts
            n["illegal"] += copies - 1 + (n["initial"] is not None and n["initial"] + initial not in _LEGAL)
            n["initial"] = initial
            if row["turn"] is not None and row["turn"] != n["high"]:
                n["low"], n["high"], n["turns"] = row["turn"] if n["low"] is None else n["low"], row["turn"], n["turns"] + 1
            edits = row["edits"]
            n["cost"] += DELETE * edits.count("D") + INSERT * edits.count("I") + REROLE * edits.count("R") + (TRUNCATED if counts and row["new_role"] is not None else 0)
            audit.append(edits)
            if row["new_role"] is None:
                say(row, "")
            else:
                waiting = row
        if len(told) > GIVEN:
            yield batch_of()
            told.clear()
    if begun:
        close()
        yield batch_of()


def report(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation with a row.

    A row's first fault counts. ``gaps`` are the turns missing between the least and the largest, as far as a long goes. The hash
    reads ``role:text`` of the repaired rows, joined by newlines, so one task reads a conversation through, row by row; the audit is one value.
    Edits and texts have one order, so they meet by it and not in a join: texts travel once.
    """
    bounded_batches(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    own = ["blank", "truncated", "duplicate", "copies", "edits", "before", "new_role", "after"]
    told = edits.select(*_KEYS, *own, F.lit(None).cast("string").alias("text"))
    none = [F.lit(None).cast(told.schema[c].dataType).alias(c) for c in own]
    both = told.unionByName(_texts(rows).select(*_KEYS, *none, "text"))
    counted = ", ".join(f"{c} long" for c in _REPORT[:6])
    ordered = both.repartition("conv_id").sortWithinPartitions(*_KEYS, F.col("edits").isNull())
    return ordered.drop("digest").mapInArrow(_reported, f"conv_id {kind}, {counted}, audit string, repaired_sha256 string")
