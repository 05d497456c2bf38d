"""Conversation structure repair: a least-cost edit of turns by a DP over the retained subsequence.

The DP runs from the last turn to the first. f[k][r] is the least cost from turn k on if k is retained with role r. Its
next retained turn (or the end) is found in constant time: with P the prefix sums of deletions, the running minimum over
k of P[k] + f[k][r], for each role r, prices every gap, and the pair of roles says how many turns must be
inserted. A walk forward along the cheapest edits takes the ASCII-least letter at each place.

Turns lie in range partitions by conversation and turn, so a conversation of any length is spread over tasks, in
segments of bounded rows and bytes. One that lies in a segment is repaired there. Of the others, each segment gives
the (min, +) matrix that takes the minima behind it to those before it; one small row a segment is folded backward,
then forward, and only then each segment walks. A digest is taken from the segments in order, a segment at a time.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded

INF = 1 << 60
DELETE, INSERT, REROLE, UNFINISHED = 2, 5, 1, 5
WHITE = " \t\n\x0b\x0c\r"
#: What a turn can be retained as, and the end of the conversation.
S, U, A, END, START = range(5)
ROLES = {U: "user", A: "assistant"}
#: How many turns must be inserted between a retained turn (row) and the next one or the end (column s, u, a, end).
INSERTS = {START: (0, 0, 1, 0), S: (None, 0, 1, 2), U: (None, 1, 0, 1), A: (None, 0, 1, 0)}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
ENDED = (INF, INF, INF, 0)


class Segment:
    """Consecutive turns: runs (initial, role, text, how many, first one is good, truncated) in order."""

    def __init__(self, runs: list):
        self.runs = runs
        self.rows = 0
        self.places, self.choices = [], []  # turns that may be retained: row, run
        for i, (_, _, _, n, good, _) in enumerate(runs):
            if good:
                self.places.append(self.rows)
                self.choices.append(i)
            self.rows += n

    def _gap(self, role: int, best) -> int:
        return min(b + INSERT * n for b, n in zip(best, INSERTS[role], strict=True) if n is not None)

    def minima(self, behind) -> list[tuple]:
        """best[c]: for each role the least P + f over the choices from c on and what lies behind; best[-1] is behind itself."""
        best = [tuple(b + DELETE * self.rows if b < INF else INF for b in behind)]
        for place, i in zip(reversed(self.places), reversed(self.choices), strict=True):
            b = best[-1]
            best.append(tuple(min(x, DELETE * place + f) for x, f in zip(b, self._retained(place, i, b), strict=True)))
        return best[::-1]

    def _retained(self, place: int, i: int, best) -> tuple:
        """f of a turn for each role."""
        initial, truncated = self.runs[i][0], self.runs[i][5]
        out = []
        for r, name in ((S, "s"), (U, "u"), (A, "a")):
            edit = 0 if initial == name else REROLE if r != S else INF
            gap = self._gap(r, best)
            out.append(min(INF, edit + UNFINISHED * truncated + gap - DELETE * (place + 1)) if edit < INF and gap < INF else INF)
        return *out, INF

    def matrix(self) -> list[int]:
        """Row t: the minima before the segment if only target t, at no cost, lies behind it."""
        return [x for t in range(4) for x in self.minima([0 if u == t else INF for u in range(4)])[0]]

    def walk(self, state: int, behind, last: bool) -> tuple[str, list[str], int]:
        """The letters of the cheapest edits, the repaired lines, and what was retained last."""
        best, letters, lines, row = self.minima(behind), [], [], 0
        for c, (place, i) in enumerate(zip(self.places, self.choices, strict=True)):
            letters.append("D" * (place - row))
            row = place + 1
            least = self._gap(state, best[c])
            if self._gap(state, best[c + 1]) == least:
                letters.append("D")
                continue
            initial, role, text = self.runs[i][:3]
            f, options = self._retained(place, i, best[c + 1]), []
            for r, name in ((S, "s"), (U, "u"), (A, "a")):
                n = INSERTS[state][r]
                if n is not None and f[r] < INF and DELETE * place + f[r] + INSERT * n == least:
                    options.append(("I" * n + ("K" if initial == name else "R"), r))
            step, r = min(options)
            letters.append(step)
            lines += [f"{ROLES[U if state != U else A]}:" for _ in step[:-1]]
            lines.append(f"{role if step[-1] == 'K' else ROLES[r]}:{text}")
            state = r
        letters.append("D" * (self.rows - row))
        if last:
            letters.append("I" * INSERTS[state][END])
            for _ in range(INSERTS[state][END]):
                state = U if state != U else A
                lines.append(f"{ROLES[state]}:")
        return "".join(letters), lines, state


class Facts:
    """What is counted over a stretch of turns, and joined with the next stretch."""

    FIELDS = ("lo", "hi", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail")

    def __init__(self):
        self.lo = self.hi = self.head = self.tail = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, initial: str, n: int, blank: bool, first: bool, truncated: bool) -> None:
        if turn is not None:
            self.turns += turn != self.hi
            self.lo = turn if self.lo is None else self.lo
            self.hi = turn
        self.illegal += n - 1 + (self.tail is not None and (self.tail, initial) not in LEGAL)
        self.head = initial if self.head is None else self.head
        self.tail = initial
        if blank:
            self.blank += n
        else:
            self.duplicate += n - first
            self.truncated += bool(first and truncated)

    def join(self, other: Facts) -> None:
        if other.head is None:
            return
        if other.lo is not None:
            self.turns += other.turns - (other.lo == self.hi)
            self.lo = other.lo if self.lo is None else self.lo
            self.hi = other.hi
        self.illegal += other.illegal + (self.tail is not None and (self.tail, other.head) not in LEGAL)
        self.head = other.head if self.head is None else self.head
        self.tail = other.tail
        for f in ("blank", "duplicate", "truncated"):
            setattr(self, f, getattr(self, f) + getattr(other, f))

    @property
    def gaps(self) -> int:
        return self.hi - self.lo + 1 - self.turns if self.lo is not None else 0

    def row(self) -> tuple:
        return self.gaps, self.blank, self.duplicate, self.truncated, self.illegal


_SUMMARY = [(n, pa.int64()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
_DONE = pa.schema([("conv_id", pa.int64()), *_SUMMARY])
_OPEN = pa.schema([*_DONE, ("part", pa.int32()), ("segment", pa.int32()), ("facts", pa.binary()), ("matrix", pa.list_(pa.int64())), ("runs", pa.binary())])
_DDL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batches(rows: Iterable[tuple], schema: pa.Schema, size=lambda row: 200) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about 4 MB."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight > 4 << 20:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _repair(rows: int, size: int):
    """Conversations that lie within a segment and inside the partition are done; of others each segment is sent on."""

    def stretches(batches):
        """(conversation, it begins and ends here, runs, facts)."""
        now, begun, runs, facts, weight, any_row = None, True, [], Facts(), 0, False
        for batch in batches:
            for conv, turn, role, text, n, first, blank, truncated in zip(*(batch[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "n", "first", "blank", "truncated")), strict=True):
                if any_row and conv != now:
                    yield now, begun, runs, facts
                    begun, runs, facts, weight = True, [], Facts(), 0
                elif len(runs) >= rows or weight >= size:
                    yield now, False, runs, facts
                    begun, runs, facts, weight = False, [], Facts(), 0
                now, any_row = conv, True
                if n:
                    good = first and not blank
                    runs.append((role[:1], role if good else "", text if good else "", n, good, bool(truncated)))
                    facts.add(turn, role[:1], n, blank, first, truncated)
                    weight += 64 + (4 * (len(role) + len(text)) if good else 0)
        if any_row:
            yield now, begun, runs, facts

    def run(batches):
        part = TaskContext.get().partitionId()

        def out():
            number, held = 0, None
            for found in stretches(batches):
                if held is not None:
                    yield finish(held, number, number > 0)
                    number += 1
                held = found
            if held is not None:
                yield finish(held, number, False)

        def finish(found, number: int, inside: bool):
            conv, whole, runs, facts = found
            segment = Segment(runs)
            if whole and inside:
                audit, lines, _ = segment.walk(START, ENDED, True)
                cost = segment._gap(START, segment.minima(ENDED)[0])
                return conv, *facts.row(), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), None, None, None, None, None
            return conv, *[None] * 8, part, number, pickle.dumps(facts), segment.matrix(), pickle.dumps(runs)

        yield from _batches(out(), _OPEN, lambda row: 200 + len(row[7] or "") + len(row[-1] or b""))

    return run


_BEHIND = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("behind", pa.list_(pa.int64())), ("last", pa.bool_()), *_SUMMARY[:6]])


def _fold_back(table: pa.Table) -> pa.Table:
    """The minima behind each segment of a conversation, and with its first segment the conversation's facts and cost."""
    table = table.sort_by([("part", "ascending"), ("segment", "ascending")])
    facts = Facts()
    for f in table["facts"].to_pylist():
        facts.join(pickle.loads(f))
    behind, out = list(ENDED), []
    for i in reversed(range(len(table))):
        m = table["matrix"][i].as_py()
        out.append((table["part"][i].as_py(), table["segment"][i].as_py(), behind, i == len(table) - 1))
        behind = [min(INF, *(m[4 * t + r] + behind[t] for t in range(4))) for r in range(4)]
    cost = min(b + INSERT * n for b, n in zip(behind, INSERTS[START], strict=True))
    rows = [(*o, *((*facts.row(), cost) if i == len(out) - 1 else [None] * 6)) for i, o in enumerate(out)]
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BEHIND, strict=True)], schema=_BEHIND)


_EXITS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), ("exits", pa.list_(pa.int32()))])


def _exits(batches):
    """What is retained last in a segment, for each that may be retained last before it."""
    states = (START, S, U, A)
    rows = (
        (conv, part, number, [segment.walk(s, behind, False)[2] for s in states])
        for b in batches
        for conv, part, number, runs, behind in zip(*(b[c].to_pylist() for c in ("conv_id", "part", "segment", "runs", "behind")), strict=True)
        for segment in [Segment(pickle.loads(runs))]
    )
    return _batches(rows, _EXITS)


_ENTRIES = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("state", pa.int32())])


def _fold_on(table: pa.Table) -> pa.Table:
    table = table.sort_by([("part", "ascending"), ("segment", "ascending")])
    state, out = START, []
    for exits in table["exits"].to_pylist():
        out.append(state)
        state = exits[(START, S, U, A).index(state)]
    return pa.table([table["part"], table["segment"], pa.array(out, pa.int32())], schema=_ENTRIES)


_PIECES = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("segment", pa.int32()), *_SUMMARY[:7], ("lines", pa.string())])


def _pieces(batches):
    names = ("conv_id", "part", "segment", *(n for n, _ in _SUMMARY[:6]), "runs", "behind", "state", "last")
    rows = (
        (*row, audit, "\n".join(lines))
        for b in batches
        for *row, runs, behind, state, last in zip(*(b[c].to_pylist() for c in names), strict=True)
        for audit, lines, _ in [Segment(pickle.loads(runs)).walk(state, behind, last)]
    )
    return _batches(rows, _PIECES, lambda row: 200 + len(row[-1]) + len(row[-2]))


def _digests(batches):
    """One row a conversation, from its pieces in order."""

    def out():
        now, head, audit, digest, empty = None, None, [], None, True
        for b in batches:
            for conv, segment_facts, letters, lines in zip(
                b["conv_id"].to_pylist(), zip(*(b[n].to_pylist() for n, _ in _SUMMARY[:6]), strict=True), b["audit"].to_pylist(), b["lines"].to_pylist(), strict=True
            ):
                if head is None or conv != now:
                    if head is not None:
                        yield now, *head, "".join(audit), digest.hexdigest()
                    now, head, audit, digest, empty = conv, segment_facts, [], hashlib.sha256(), True
                audit.append(letters)
                if lines:
                    digest.update(b"" if empty else b"\n")
                    digest.update(lines.encode())
                    empty = False
        if head is not None:
            yield now, *head, "".join(audit), digest.hexdigest()

    yield from _batches(out(), _DONE, lambda row: 200 + len(row[7]))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage by crc32 of `conv_id:turn` modulo 20; copies is 0 for a dropped row.

    A null counts as one space wherever it is text: in the key, the role and the text. A null turn stays null.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), fault.alias("fault"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 0, 0).when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair_turns(turns: DataFrame, rows: int = 4096, size: int = 8 << 20) -> DataFrame:
    """One row per conv_id of `turns` (conv_id, turn, role, text, copies): its faults and its cheapest repair.

    gaps, blank, duplicate, truncated, illegal, cost, audit (a letter for each edit: Keep, Rerole, Delete, Insert) and
    repaired_sha256. Turns count in order of turn, nulls first; ties by the first 64 characters of role and text, then
    by role and text. copies says how often a row stands there; a conversation that has only rows of 0 copies is empty.

    Null conv_ids are one conversation. Nulls in role or text count as one space. A role without characters can't be kept. Repeated rows are duplicates. Empty
    tables give no rows; other columns are ignored. A text is one value, so under 2 GB; an audit has a letter for each turn and
    is one value too. rows and size bound a segment: a longer conversation is repaired by several tasks.
    """
    t = turns.select(
        "conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    ).withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "digest": F.unhex(F.sha2(F.encode(F.concat_ws("\n", F.sha2("role", 256), F.sha2("text", 256)), "utf-8"), 256))})
    # where a text is said more than once: the turn of its first time
    said = t.where("copies > 0").groupBy("key", "digest", "turn").agg(F.lit(1).alias("one"))
    said = said.groupBy("key", "digest").agg(F.min(F.struct("turn")).alias("least"), F.count(F.lit(1)).alias("times")).where("times > 1").select("key", "digest", F.col("least.turn").alias("said"))
    runs = t.groupBy("key", "conv_id", "turn", "digest").agg(F.sum("copies").alias("n"), F.max("role").alias("role"), F.max("text").alias("text"))
    runs = runs.join(said.withColumn("again", F.lit(True)), ["key", "digest"], "left")
    stripped = F.rtrim(F.col("text"), F.lit(WHITE))
    runs = runs.select(
        "conv_id", "turn", "role", "text", "n",
        (F.col("again").isNull() | F.col("turn").eqNullSafe(F.col("said"))).alias("first"),
        (stripped == "").alias("blank"),
        (~F.substring(stripped, -1, 1).isin(".", "!", "?")).alias("truncated"),
        F.substring("role", 1, 64).alias("role_head"), F.substring("text", 1, 64).alias("text_head"),
    )
    heads = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role_head", "text_head")]
    runs = runs.repartitionByRange(*heads).sortWithinPartitions(*heads, "role", "text").drop("role_head", "text_head")
    found = Written(bounded(runs).mapInArrow(_repair(rows, size), f"{_DDL}, part int, segment int, facts binary, matrix array<long>, runs binary"), "turns").read()
    whole, parts = found.where("part is null").select(*_DONE.names), found.where("part is not null")
    place = ["part", "segment"]
    behind = parts.select("conv_id", *place, "facts", "matrix").groupBy("conv_id").applyInArrow(_fold_back, "part int, segment int, behind array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long")
    behind = Written(behind, "behind").read()
    exits = parts.select("conv_id", *place, "runs").join(behind, place).mapInArrow(_exits, "conv_id long, part int, segment int, exits array<int>")
    entries = exits.groupBy("conv_id").applyInArrow(_fold_on, "part int, segment int, state int")
    pieces = parts.select("conv_id", *place, "runs").join(behind, place).join(entries, place).mapInArrow(_pieces, "conv_id long, part int, segment int, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines string")
    pieces = pieces.repartition("conv_id").sortWithinPartitions("conv_id", *place)
    return whole.unionByName(pieces.mapInArrow(_digests, _DDL))
