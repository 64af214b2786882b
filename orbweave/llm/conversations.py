"""Repair of conversation structure: the cheapest edits that make a conversation's roles follow ``(s?(ua)+)?``.

Faults of a row, the first that holds: blank (no character but ASCII white space), duplicate (role and text of an earlier
row), truncated (its last other character is none of ``.!?``). Edits: keep (K, 0), change the role to user or assistant (R, 3),
delete (D, 4; blank and duplicate rows must go), insert a turn without text (I, 3); a truncated row that stays costs 3 more.
The cheapest edits are found by Dijkstra's search over nodes (row, state of the grammar) that are made as they are reached,
in order of (cost, edits), so of equally cheap ones those with the least string of initials win. With equal cost neither of
two strings at one node begins the other, so the order at a node stays the order at the end.

A conversation may hold a third of all rows. Identical rows of a turn are counted, not listed, and the first of equal texts
is found by sums, so only one slim row (digest, no text) for each different turn is sorted, by range over (conversation,
turn, role, digest): a long conversation lies in many tasks. Each task searches its stretches, of at most ``STRETCH`` rows, from
every state of the grammar in which the stretch may be entered, or from the start and to the first accepting end where a
stretch is a whole conversation. Stretches are then joined state by state, in order. The digest of a repaired conversation
chains over all of its text: one task passes over those rows in sorted batches, holding the edits but no texts.

Rows are taken by turn (nulls first), rows of one turn by role and by the SHA-256 of the text. Nulls: a null role or text counts as
one space, so such a text is blank and such a role no role; null turns count in no gap; a null conversation id is an id like
any other. Long texts are hashed whole. Rows that repeat are duplicates. A conversation of which all rows are gone has
zeros, no edits and the digest of the empty string; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Costs of edits; initials; what ends a sentence.
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED_COST = 3
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
LEGAL = ("su", "ua", "au")
NAMES = {"u": "user", "a": "assistant"}
#: States of the grammar: nothing yet, after system, after user, after assistant; what each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ACCEPTING = (START, ASSISTANT)
#: Rows searched together.
STRETCH = 1024


def cheapest_edits(rows: list[tuple[str, int]], entry: int = START, to_end: bool = True) -> dict[int, tuple[int, str]]:
    """Cost and edits by the state reached after ``rows`` (role initial, fault), entered in state ``entry``.

    With ``to_end`` the rows end a conversation: the search stops at the first accepting end node, the only one returned.
    """
    heap, settled, ends = [(0, "", 0, entry)], set(), {}
    while heap:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in settled:
            continue
        settled.add((at, state))
        if at == len(rows):
            if to_end and state in ACCEPTING:
                return {state: (cost, audit)}
            ends[state] = (cost, audit)
            if not to_end and len(ends) == len(STEPS):
                return ends
        for initial, after in STEPS[state].items():
            if initial in NAMES:
                heapq.heappush(heap, (cost + COST["I"], audit + "I", at, after))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + COST["D"], audit + "D", at + 1, state))
            if fault not in (BLANK, DUPLICATE):
                more = TRUNCATED_COST if fault == TRUNCATED else 0
                for to, after in STEPS[state].items():
                    if to == initial:
                        heapq.heappush(heap, (cost + COST["K"] + more, audit + "K", at + 1, after))
                    if to in NAMES:
                        heapq.heappush(heap, (cost + COST["R"] + more, audit + "R", at + 1, after))
    return ends


class Joined:
    """Stretches of a conversation, joined in order: the cheapest edits to each state so far, beginnings that they share kept once."""

    def __init__(self) -> None:
        self.shared, self.live, self.illegal, self.last = [], {START: (0, "")}, 0, None

    def add(self, ways: dict[tuple[int, int], tuple[int, str]], illegal: int, first: str, last: str) -> None:
        found: dict[int, tuple[int, str]] = {}
        for (entry, after), (cost, audit) in ways.items():
            if entry in self.live:
                before = self.live[entry]
                way = (before[0] + cost, before[1] + audit)
                found[after] = min(found.get(after, way), way)
        begin = os.path.commonprefix([audit for _, audit in found.values()])
        self.shared.append(begin)
        self.live = {state: (cost, audit[len(begin) :]) for state, (cost, audit) in found.items()}
        self.illegal += illegal + (self.last is not None and self.last + first not in LEGAL)
        self.last = last

    def best(self) -> tuple[int, str]:
        cost, audit = min(way for state, way in self.live.items() if state in ACCEPTING)
        return cost, "".join(self.shared) + audit


_WAY = pa.struct([("entry", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])


def _search(batches: Iterator[pa.RecordBatch], stretch: int) -> Iterator[pa.RecordBatch]:
    """Sorted slim rows (conv, at, initial, fault, again, times) to stretches with the cheapest edits between states.

    ``again`` is the fault of the repeats of a row that comes ``times`` times.
    """
    names = ("conv", "at", "nth", "first", "last", "illegal", "ways")
    kinds, found, nth = None, [], 0

    def close(conv, at: int, rows: list, opens: bool, closes: bool) -> None:
        ways = [{"entry": entry, "after": after, "cost": cost, "audit": audit} for entry in ((START,) if opens else range(len(STEPS))) for after, (cost, audit) in cheapest_edits(rows, entry, opens and closes).items()]
        found.append((conv, at, nth, rows[0][0], rows[-1][0], sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:])), ways))

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
        found.clear()
        return out

    now, begin, rows, opens, begun = None, 0, [], False, False
    for batch in batches:
        kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(_WAY)]
        for conv, at, initial, fault, again, times in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and conv != now:
                if rows:
                    close(now, begin, rows, opens, True)
                    nth += 1
                rows, opens = [], True  # where a task begins, the conversation may have begun in another
            now, begun = conv, True
            for k in range(times):
                begin = begin if rows else at
                rows.append((initial, again if k else fault))
                if len(rows) == stretch:
                    close(now, begin, rows, opens, False)
                    nth, rows, opens = nth + 1, [], False
                    if len(found) >= 256:
                        yield batch_of()
        if found:
            yield batch_of()
    if rows:
        close(now, begin, rows, opens, False)
        yield batch_of()


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From records of conversations (a summary, the stretches, the rows, in this order): each summary with its joined stretches, the
    turns that stay or are put in (role, text, edit), and None where the conversation ends."""
    summary, joined, audit, k = None, None, "", 0

    def edits(until: int) -> Iterator[tuple]:
        """Turns put in before the next row, or at the end."""
        nonlocal k, state
        while k < until and audit[k] == "I":
            initial = "a" if state == USER else "u"
            state, k = STEPS[state][initial], k + 1
            yield NAMES[initial], "", "I"

    state = START
    for batch in batches:
        for conv, kind, *values, first, last, illegal, ways, role, text in zip(*(c.to_pylist() for c in batch.columns)):
            if kind == 0:
                if summary is not None:
                    if audit is None:
                        audit = joined.best()[1]
                        yield "summary", summary, joined
                    yield from (("turn", summary, t) for t in edits(len(audit)))
                    yield "end", summary, None
                summary, joined, audit, k, state = (conv, *values), Joined(), None, 0, START
            elif kind == 1:
                joined.add({(w["entry"], w["after"]): (w["cost"], w["audit"]) for w in ways}, illegal, first, last)
            else:
                if audit is None:
                    audit = joined.best()[1]
                    yield "summary", summary, joined
                yield from (("turn", summary, t) for t in edits(len(audit)))
                edit, k = audit[k], k + 1
                if edit != "D":
                    initial = role[:1] if edit == "K" else "a" if state == USER else "u"
                    state = STEPS[state][initial]
                    yield "turn", summary, (role if edit == "K" else NAMES[initial], text, edit)
    if summary is not None:
        if audit is None:
            audit = joined.best()[1]
            yield "summary", summary, joined
        yield from (("turn", summary, t) for t in edits(len(audit)))
        yield "end", summary, None


_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _batched(rows: Iterator[tuple], kinds: list, names: list[str], most: int = 512, most_chars: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _typed(batches: Iterator[pa.RecordBatch]) -> tuple[pa.DataType, Iterator[pa.RecordBatch]]:
    first = next(batches, None)
    return (pa.int64(), iter(())) if first is None else (first.schema.field(0).type, (b for part in ((first,), batches) for b in part))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, batches = _typed(batches)

    def rows() -> Iterator[tuple]:
        digest, begun, row = hashlib.sha256(), False, ()
        for what, summary, value in _turns(batches):
            if what == "summary":
                cost, audit = value.best()
                row, digest, begun = (*summary, value.illegal, cost, audit), hashlib.sha256(), False
            elif what == "turn":
                digest.update(("\n" * begun + value[0] + ":" + value[1]).encode())
                begun = True
            else:
                yield *row, digest.hexdigest()

    yield from _batched(rows(), [kind, *[pa.int64()] * 6, pa.string(), pa.string()], ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"])


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind, batches = _typed(batches)

    def rows() -> Iterator[tuple]:
        at = 0
        for what, summary, value in _turns(batches):
            at = 0 if what == "summary" else at
            if what == "turn":
                yield summary[0], at, *value
                at += 1

    yield from _batched(rows(), [kind, pa.int64(), *[pa.string()] * 3], ["conv", "at", "role", "text", "edit"])


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with faults planted by a checksum of conversation and turn: of 20 rows one goes, one loses its
    text, one its full stops, one comes twice, one gets the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space(conv_col), F.lit(":"), space(turn_col))) % 20
    text = F.when(draw == 1, "").when(draw == 2, F.regexp_replace(space(text_col), "[.!?]", "")).otherwise(space(text_col))
    rows = conversations.where(draw != 0).select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.when(draw == 4, "user").otherwise(space(role_col)).alias("role"), text.alias("text"), F.explode(F.when(draw == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return rows.drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, times, fault, again): a row per different row of ``rows`` (conv, turn, role, text), its fault and that of its repeats."""
    text = F.translate("text", "\t\n\x0b\x0c\r", "     ")
    own = F.when(F.trim(text) == "", BLANK).when(~F.substring(F.rtrim(text), -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0)
    slim = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), own.alias("own"))
    slim = slim.groupBy("conv", "turn", "role", "digest", "own").agg(F.count("*").alias("times"))
    # min() passes over nulls, which come first: the least turn of equal rows is a pair
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = slim.where(F.col("own") != BLANK).groupBy("conv", "role", "digest").agg(F.min(place).alias("place"), F.count("*").alias("n")).where("n > 1")
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "place")
    met = slim.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(place > F.col("place"), F.lit(False))
    fault = F.when(F.col("own") == BLANK, BLANK).when(later, DUPLICATE).otherwise(F.col("own"))
    return met.select("conv", "turn", "role", "digest", "times", fault.alias("fault"), F.when(F.col("own") == BLANK, BLANK).otherwise(DUPLICATE).alias("again"))


def _records(rows: DataFrame, ids: DataFrame, stretch: int) -> DataFrame:
    """Summaries, stretches and rows of conversations, each conversation in one partition, in order."""
    slim = faults(rows)
    first, more = F.col("fault"), F.col("times") - 1
    counted = lambda kind: F.sum(F.when(first == kind, 1).otherwise(0) + F.when(F.col("again") == kind, more).otherwise(0))
    counts = slim.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), counted(BLANK).alias("blank"), counted(DUPLICATE).alias("duplicate"), counted(TRUNCATED).alias("truncated")
    )
    all_ids = ids.select(F.col("conv").alias("id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    summaries = all_ids.join(counts, F.col("id").eqNullSafe(F.col("conv")), "left").select(F.col("id").alias("conv"), F.lit(0).alias("kind"), *map(zero, ("gaps", "blank", "duplicate", "truncated")))
    order = [F.asc_nulls_first(c) for c in ("conv", "turn", "role", "digest")]
    placed = slim.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    conv = rows.schema["conv"].dataType.simpleString()
    found = placed.select("conv", "at", F.substring("role", 1, 1).alias("initial"), "fault", "again", "times").mapInArrow(lambda batches: _search(batches, stretch), f"conv {conv}, at long, nth long, first string, last string, illegal long, ways array<struct<entry: int, after: int, cost: bigint, audit: string>>")
    texts = rows.select("conv", F.lit(2).alias("kind"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    both = summaries.unionByName(found.withColumn("kind", F.lit(1)), True).unionByName(texts, True)
    both = both.repartition("conv").sortWithinPartitions(*map(F.asc_nulls_first, ("conv", "kind", "at", "nth", "turn", "role", "digest")))
    return both.select("conv", "kind", "gaps", "blank", "duplicate", "truncated", "first", "last", "illegal", "ways", "role", "text")


def _named(convs: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return convs.select(F.col(conv_col), F.col(turn_col), space(role_col), space(text_col)).toDF("conv", "turn", "role", "text")


def repair_report(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", ids: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """A row per conversation: faults, cost and initials of the cheapest edits, digest of the repaired conversation.

    ``ids`` (column ``conv``): all conversations to report, those without rows too; without it those that have rows.
    """
    rows = _named(conversations, conv_col, turn_col, role_col, text_col)
    conv = rows.schema["conv"].dataType.simpleString()
    return _records(rows, rows if ids is None else ids, stretch).mapInArrow(_report, f"conv {conv}, {_REPORT}").withColumnRenamed("conv", conv_col)


def repaired_turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", stretch: int = STRETCH) -> DataFrame:
    """The repaired conversations: (conversation, at, role, text, edit), a row per turn that stays (K, R) or was put in (I), numbered from 0."""
    rows = _named(conversations, conv_col, turn_col, role_col, text_col)
    conv = rows.schema["conv"].dataType.simpleString()
    return _records(rows, rows, stretch).mapInArrow(_repaired, f"conv {conv}, at long, role string, text string, edit string").withColumnRenamed("conv", conv_col)
