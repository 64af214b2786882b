"""Near-duplicate texts: wide SimHash fingerprints, Golay keys, and verification by word shingles.

Two texts are near duplicates if the sets of their word shingles (``words`` = 5, A-Z lower-cased) have a Jaccard
similarity of at least ``similarity`` = 0.8. A fingerprint has 105 bits in five segments; each segment is decoded to the
indices of all nearby Golay codewords, and texts that share an index in two segments are candidates if their
fingerprints differ in at most ``NEAR`` bits (3.3 standard deviations beyond what a similarity of 0.8 gives). Of texts
at exactly 0.8 about 95 % become candidates, of those at 0.9 over 99 %.

Candidates are verified on the shingles themselves, and verified links make the groups, of which the row of the smallest
id stays: a row is never dropped for fingerprints alone. Equal word sequences are collapsed first. What is shuffled is a
row for each index of the first segment of a pair; a task finds the indices of the second again. Every bucket gives a
forest of its candidates, never all pairs; a very full one is cut into blocks whose pairs are dealt to different tasks.
Of the forests' links, those of each row to the nearest and to the least other row are verified first, then those of what
they connect, as long as that connects much: never more than two a row and round. A tree whose rows are then connected
needs no more. The rows of all other trees are compared by their rarest shingles: of two sets that are similar enough each
must hold one of the other's rarest fifth, at a place that leaves room for the overlap, and few of the bits that its
shingles set may be missing in the other's. That loses none of a tree's links, however full its bucket is, and leaves few
pairs where texts share much (a site's frame, say) but not enough. Only pairs that are not connected yet are compared, so
a large group of true copies costs what its forest costs.

Nulls count as empty texts; texts without words are equal to one another; a text of fewer words than a shingle has is one
shingle. Very long texts are hashed whole. Rows may repeat; columns of any name pass through; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import forget
from .common import BATCH_ROWS, fresh, join_hot, stage, unstage
from .components import components
from .golay import Golay
from .simhash import words_of

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Segments and their width, the bits that a candidate may differ in.
SEGMENTS, SEGMENT_BITS, NEAR = 5, 21, 28
#: Rows of a bucket that are compared by columns of pairs, and that one task compares with one another at most.
PAIRED, BUCKET_ROWS = 128, 4096
#: Rows whose keys a task makes at once, and rows of one half key that it holds at most.
WIDENED_ROWS, PART_ROWS = 1 << 15, 1 << 19
#: Rounds of links to the nearest and the least, and the part of a round's links that must hold for another round.
ROUNDS, ROUND_YIELD = 6, 1 / 8
#: Bits of a set's sketch, in words of 64.
SKETCH_WORDS = 16
#: Shingles of a set that may be broadcast to the many pairs of its row.
HOT_SHINGLES = 16_384
#: Counters that tell rare shingles from frequent ones; two that share one cost time, not links.
COUNTERS = 1 << 20
#: Bits of the filter that tells most rows without looking that they are not in a list, in words of 64.
FILTER_BITS = 1 << 24
_MASK = np.uint64((1 << SEGMENT_BITS) - 1)
_PAIRS = [(i, j) for i in range(SEGMENTS) for j in range(i + 1, SEGMENTS)]


def shingle_hashes(text: str, size: int = WORDS) -> np.ndarray:
    """128-bit hashes of all shingles of a text, as rows of 16 bytes; none for a text without words."""
    words = words_of(text)
    if not words:
        return np.zeros((0, 16), np.uint8)
    data, digest = b" ".join(words), xxhash.xxh3_128_digest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.frombuffer(b"".join([digest(data[i : j - 1], SEED) for i, j in zip(starts, starts[size:])]) or digest(data, SEED), np.uint8).reshape(-1, 16)


def wide_fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    """Two words of 63 and 42 bits: three and two segments. A bit is set if it is in over half the hashes."""
    sums = np.zeros(128, np.int64)
    for i in range(0, len(hashes), 255):  # so many bits fit into a byte
        sums += np.add.reduce(np.unpackbits(hashes[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    bits = int.from_bytes(np.packbits(2 * sums > len(hashes)).tobytes(), "big")
    return bits & ((1 << 63) - 1), bits >> 63 & ((1 << 42) - 1)


def _distinct(hashes: np.ndarray) -> np.ndarray:
    """The sorted different shingles; 32 bits tell those of two texts apart."""
    return np.unique(hashes[:, :4].copy().view(np.int32).reshape(-1))


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


def _prints(texts: DataFrame, words: int) -> DataFrame:
    """(row, a, b, n, same, also): the fingerprint of every row of (row, text), how many different shingles it has, and a digest of its word sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()  # workers are reused, and may still hold the caches of an encoder
        for batch in _bounded(batches):
            a, b, n, same = [], [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingle_hashes(text or "", words)
                one, two = wide_fingerprint(hashes)
                a.append(one)
                b.append(two)
                n.append(len(_distinct(hashes)))
                same.append(xxhash.xxh3_128_digest(b" ".join(words_of(text or "")), SEED))
            halves = np.frombuffer(b"".join(same), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int32()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], names=["row", "a", "b", "n", "same", "also"])

    return texts.mapInArrow(run, "row long, a long, b long, n int, same long, also long")


def _keys(prints: DataFrame) -> DataFrame:
    """(key, row, a, b, n): a row per fuzzy key of each row's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                row, a, b, n = (batch.column(i).slice(at, 1024).to_numpy() for i in range(4))
                near = [code.keys(_segment(a, b, s)) for s in range(SEGMENTS)]
                for pair, (i, j) in enumerate(_PAIRS):
                    keys = np.where((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0), pair << 24 | near[i][:, :, None] << 12 | near[j][:, None, :], -1).reshape(len(row), -1)
                    who, column = np.nonzero(keys >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[who, column].astype(np.int32)), *(pa.array(x[who]) for x in (row, a, b, n))], names=["key", "row", "a", "b", "n"])

    return prints.select("row", "a", "b", "n").mapInArrow(run, "key int, row long, a long, b long, n int")


def _segment(a: np.ndarray, b: np.ndarray, at: int) -> np.ndarray:
    bits, place = (a, at) if at < 3 else (b, at - 3)
    return (bits.view(np.uint64) >> np.uint64(place * SEGMENT_BITS) & _MASK).astype(np.int64)


def _half_keys(prints: DataFrame) -> DataFrame:
    """(part, row, a, b, n): a row per pair of segments and index of the first, the upper half of some five keys of ``_keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                row, a, b, n = (batch.column(i).slice(at, 1024).to_numpy() for i in range(4))
                near = [code.keys(_segment(a, b, s)) for s in range(SEGMENTS)]
                for pair, (i, _) in enumerate(_PAIRS):
                    who, column = np.nonzero(near[i] >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array((pair << 12 | near[i][who, column]).astype(np.int32)), *(pa.array(x[who]) for x in (row, a, b, n))], names=["part", "row", "a", "b", "n"])

    return prints.select("row", "a", "b", "n").mapInArrow(run, "part int, row long, a long, b long, n int")


def _widened(batches: Iterator[pa.RecordBatch], wide: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (key, row, a, b, n) sorted by key, of rows of half keys sorted by part; keys of one row only are left out.

    Parts of more rows than PART_ROWS are put into ``wide`` instead.
    """
    code, names = Golay(), ["key", "row", "a", "b", "n"]

    def keyed(part: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(part, append=-1)) + 1
        many = np.repeat(np.diff(ends, prepend=0) > 1, np.diff(ends, prepend=0))
        part, row, a, b, n = (x[many] for x in (part, row, a, b, n))
        second = np.searchsorted(part >> 12, np.arange(len(_PAIRS) + 1))
        keys, rows = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for (_, j), s, e in zip(_PAIRS, second, second[1:]):
            if e > s:
                near = code.keys(_segment(a[s:e], b[s:e], j))
                who, column = np.nonzero(near >= 0)
                keys.append((part[s:e][who].astype(np.int64) << 12 | near[who, column]).astype(np.int32))
                rows.append(who + s)
        key, who = np.concatenate(keys), np.concatenate(rows)
        order = np.argsort(key, kind="stable")  # rows of a key stay in their order
        key = key[order]
        same = np.diff(key, prepend=-1) == 0
        same[:-1] |= same[1:]
        who = who[order[same]]
        yield pa.RecordBatch.from_arrays([pa.array(key[same]), *(pa.array(x[who]) for x in (row, a, b, n))], names=names)

    held: list[list[np.ndarray]] = []
    count, passed = 0, -1
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        gone = int(np.searchsorted(columns[0], passed, side="right"))  # the rest of a wide part
        held.append([c[gone:] for c in columns])
        count += batch.num_rows - gone
        if count >= WIDENED_ROWS and held[-1][0].size and (held[0][0][0] != held[-1][0][-1] or count > PART_ROWS):
            columns = [np.concatenate(c) for c in zip(*held)]
            whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last part may go on
            if whole:
                yield from keyed(*(c[:whole] for c in columns))
            held, count = [[c[whole:] for c in columns]], count - whole
            if count > PART_ROWS:
                passed = int(columns[0][-1])
                wide.append(passed)
                held, count = [], 0
    if count:
        yield from keyed(*(np.concatenate(c) for c in zip(*held)))


def _apart(a: np.ndarray, b: np.ndarray, c: np.ndarray | np.int64, d: np.ndarray | np.int64) -> np.ndarray:
    return np.bitwise_count(a ^ c) + np.bitwise_count(b ^ d)


def _sized(n: np.ndarray, other: np.ndarray | np.int64, similarity: float) -> np.ndarray:
    """Whether sets of so many shingles can be similar enough: the smaller must hold that share of the larger."""
    return np.minimum(n, other) >= similarity * np.maximum(n, other) - 1e-9


def _forest(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A spanning forest of the links among some rows, with each link's root and bits apart: a row reached looks once at those not reached yet."""
    left, right, roots, bits, open_, queue, root = [], [], [], [], np.arange(len(row)), [], 0
    while len(open_):
        if not queue:
            queue, root, open_ = [int(open_[0])], int(open_[0]), open_[1:]
        i = queue.pop()
        apart = _apart(a[open_], b[open_], a[i], b[i])
        hit = (apart <= NEAR) & _sized(n[open_], n[i], similarity)
        if hit.any():
            found = open_[hit]
            left.append(np.full(len(found), row[i]))
            right.append(row[found])
            roots.append(np.full(len(found), row[root]))
            bits.append(apart[hit].astype(np.int32))
            queue += found.tolist()
            open_ = open_[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right), np.concatenate(roots), np.concatenate(bits)) if left else (none, none, none, none.astype(np.int32))


def spanning(row: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray | None = None, similarity: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among some rows.

    With the sizes ``n`` of the rows' sets, rows whose sizes rule a similarity out are not linked.
    """
    return _forest(row, a, b, np.zeros(len(row), np.int64) if n is None else n, similarity)[:2]


def _least_linked(count: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(partner, place, root) for every place but the first of each tree, of links from lower to higher places."""
    root, before = np.arange(count), None
    while before is None or (root != before).any():
        before = root.copy()
        np.minimum.at(root, two, root[one])
        np.minimum.at(root, one, root[two])
        root = root[root]
    below, above = np.full(count, count), np.full(count, count)
    np.minimum.at(below, two, one)
    np.minimum.at(above, one, two)
    place = np.flatnonzero(root != np.arange(count))
    return np.where(below[place] < count, below[place], above[place]), place, root[place]


_LINK_NAMES = ["a", "b", "root", "key", "apart", "full"]


def _fulls(keys: np.ndarray) -> pa.RecordBatch:
    none, short = pa.nulls(len(keys), pa.int64()), pa.nulls(len(keys), pa.int32())
    return pa.RecordBatch.from_arrays([none, none, none, short, short, pa.array(keys, pa.int32())], names=_LINK_NAMES)


def _links(bucket_rows: int, similarity: float = 0.0):
    """Links (a, b) of trees (key, root) inside buckets, of rows (key, row, a, b and, if known, n) that come sorted by key; of a fuller bucket only its key, as ``full``."""

    def links(one: np.ndarray, two: np.ndarray, root: np.ndarray, key: np.ndarray, apart: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(root), pa.array(key.astype(np.int32)), pa.array(apart.astype(np.int32)), pa.nulls(len(one), pa.int32())], names=_LINK_NAMES)

    fulls = _fulls

    def inside(key: np.ndarray, row: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(key, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        sizes = ends - starts
        if (sizes > bucket_rows).any():
            yield fulls(key[starts[sizes > bucket_rows]])
        small = np.repeat((sizes > 1) & (sizes <= PAIRED), sizes)
        k, r, x, y, z = key[small], row[small], a[small], b[small], n[small]
        hits, step, live = [], 1, np.arange(len(k))
        while len(live):  # each row with the next one, the one after it, and so on, in its bucket
            live = live[live + step < len(k)]
            live = live[k[live] == k[live + step]]
            hit = live[(_apart(x[live], y[live], x[live + step], y[live + step]) <= NEAR) & _sized(z[live], z[live + step], similarity)]
            hits.append(np.stack([hit, hit + step]))
            step += 1
        if hits:
            partner, place, root = _least_linked(len(k), *np.concatenate(hits, axis=1))
            yield links(r[partner], r[place], r[root], k[place], _apart(x[partner], y[partner], x[place], y[place]))
        middle = (sizes > PAIRED) & (sizes <= bucket_rows)
        for s, e in zip(starts[middle], ends[middle]):
            one, two, root, apart = _forest(row[s:e], a[s:e], b[s:e], n[s:e], similarity)
            yield links(one, two, root, np.full(len(one), key[s]), apart)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, passed = 0, -1
        for batch in batches:
            columns = [c.to_numpy() for c in batch.columns]
            columns += [np.zeros(batch.num_rows, np.int32)] * (5 - len(columns))
            gone = int(np.searchsorted(columns[0], passed, side="right"))  # the rest of a full bucket
            held.append([c[gone:] for c in columns])
            count += batch.num_rows - gone
            if count >= 1 << 19:
                columns = [np.concatenate(c) for c in zip(*held)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last bucket may go on
                if whole:
                    yield from inside(*(c[:whole] for c in columns))
                held, count = [[c[whole:] for c in columns]], count - whole
                if count > bucket_rows:
                    passed = int(columns[0][-1])
                    yield fulls(np.array([passed]))
                    held, count = [], 0
        if count:
            yield from inside(*(np.concatenate(c) for c in zip(*held)))

    return run


def _full(keyed: DataFrame, full: DataFrame, similarity: float) -> DataFrame:
    """Links inside buckets of more than BUCKET_ROWS rows: each pair of a bucket's blocks is a group of its own."""
    rows = keyed.join(full, "key").withColumn("blocks", F.ceil(F.col("count") / BUCKET_ROWS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "row", "a", "b", "n")

    def pair(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        one, two, root, apart = _forest(*(table.column(c).to_numpy() for c in ("row", "a", "b", "n")), similarity)
        key = np.full(len(one), table.column("key")[0].as_py() if len(one) else 0, np.int32)
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64()), "root": pa.array(root, pa.int64()), "key": pa.array(key), "apart": pa.array(apart, pa.int32())})

    return rows.groupBy("key", "low", "high").applyInArrow(pair, "a long, b long, root long, key int, apart int")


def candidate_links(prints: DataFrame, similarity: float = 0.0) -> DataFrame:
    """(a, b, root, key, apart): links between rows of (row, a, b, n) by trees, whose rows are all that candidates of a bucket connect.

    A tree's rows are its root and the ``b`` of its links; ``apart`` is how many bits of its ends differ.

    Rows whose numbers of shingles ``n`` rule ``similarity`` out are no candidates; without ``n`` none are ruled out.

    Half keys go through one shuffle and are not written; keys are made in the tasks that get them. Where a half key has more
    rows than a task holds, its keys go through a shuffle; where a bucket is full, keys are made again, for those buckets.
    """
    prints = prints if "n" in prints.columns else prints.withColumn("n", F.lit(0))
    keyed, inside_bucket, kind = _keys(prints), _links(BUCKET_ROWS, similarity), "a long, b long, root long, key int, apart int, full int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide: list[int] = []
        yield from inside_bucket(_widened(batches, wide))
        if wide:
            yield _fulls(-1 - np.array(wide))

    found = stage(_half_keys(prints).repartition("part").sortWithinPartitions("part", "row").mapInArrow(run, kind), "near_links")
    wide = found.where("full < 0").select((-1 - F.col("full")).alias("part"))
    if wide.limit(1).count():
        again = keyed.withColumn("part", F.shiftright("key", 12)).join(wide, "part", "left_semi").drop("part")
        found = found.unionByName(stage(again.repartition("key").sortWithinPartitions("key", "row").mapInArrow(inside_bucket, kind), "near_links"))
    full = found.where("full >= 0").select(F.col("full").alias("key")).distinct()
    links = found.where("full is null").drop("full")
    if full.limit(1).count():
        inside = stage(keyed.join(full, "key", "left_semi"), "near_full")
        links = links.unionByName(stage(_full(inside, inside.groupBy("key").count(), similarity), "near_links"))
        unstage(inside)
    return links


def _shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(row, shingles): the sorted distinct hashes of every row of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            sets = [_distinct(shingle_hashes(t or "", words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], names=["row", "shingles"])

    return texts.mapInArrow(run, "row long, shingles array<int>")


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, other: str, name: str) -> DataFrame:
    """Pairs with the shingles of the row on one side; rows of very many pairs get theirs by broadcast, if they are short."""
    counts = pairs.groupBy(side).agg(F.count("*").alias("n"))
    known = counts.join(sets, counts[side] == sets["row"]).select(side, F.when(F.size("shingles") <= HOT_SHINGLES, F.col("n")).otherwise(0).alias(f"{name}_n"), F.col("shingles").alias(name))
    return join_hot(pairs, stage(known, "sided"), side, f"{name}_n", other).drop(f"{name}_n")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles are similar enough."""
    both = _with_set(_with_set(pairs, sets, "a", "b", "one"), sets, "b", "a", "two")
    shared = F.size(F.array_intersect("one", "two"))
    union = F.size("one") + F.size("two") - shared
    return both.where(F.when(union > 0, shared >= similarity * union - 1e-9).otherwise(True)).select("a", "b")


def _unsettled(links: DataFrame, linked: DataFrame) -> DataFrame:
    """(row, component): the rows of the trees that verified links do not connect."""
    rows = links.select("key", "root", F.col("b").alias("row")).unionByName(links.select("key", "root", F.col("root").alias("row")).distinct())
    rows = rows.join(linked, F.col("row") == F.col("node"), "left").select("key", "root", "row", F.coalesce("component", "row").alias("component"))
    open_ = rows.groupBy("key", "root").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    return rows.join(open_.select("key", "root"), ["key", "root"], "left_semi").select("row", "component").distinct()


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each counter: COUNTERS numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy() & (COUNTERS - 1), minlength=COUNTERS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["counter", "n"])

    sums = sets.select("shingles").mapInArrow(run, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[sums.column("counter").to_numpy()] = sums.column("n").to_numpy()
    return out


def _rarest(shingles: np.ndarray, frequencies: np.ndarray, similarity: float) -> np.ndarray:
    """As many of a set's rarest shingles, rarest first, as must hold one of any set that is similar enough."""
    ordered = shingles[np.lexsort((shingles, frequencies[shingles & (COUNTERS - 1)]))]
    return ordered[: len(ordered) - int(np.ceil(similarity * len(ordered) - 1e-9)) + 1]


def _rare_rows(sets: DataFrame, similarity: float) -> DataFrame:
    """(shingle, place, row, component, n, sketch): the rarest shingles of every row of (row, component, shingles), with their places."""
    frequencies = sets.sparkSession.sparkContext.broadcast(_frequencies(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches):
            flat, size = batch.column(2).flatten().to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            ends = np.cumsum(size)
            rare = [_rarest(flat[e - n : e], frequencies.value, similarity) for e, n in zip(ends, size)]
            counts = np.array([len(x) for x in rare], np.int64)
            out = [np.concatenate([np.zeros(0, np.int32), *rare]), np.concatenate([np.zeros(0, np.int32), *(np.arange(c, dtype=np.int32) for c in counts)])]
            out += [np.repeat(batch.column(i).to_numpy(), counts) for i in (0, 1)] + [np.repeat(size.astype(np.int32), counts)]
            bits = [x.tobytes() for x in _sketches(flat, size)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in out), pa.array(bits, pa.binary()).take(pa.array(np.repeat(np.arange(len(size)), counts)))], names=["shingle", "place", "row", "component", "n", "sketch"])

    return sets.select("row", "component", "shingles").mapInArrow(run, "shingle int, place int, row long, component long, n int, sketch binary")


def _sketches(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of SKETCH_WORDS words for each set: the bits that its shingles set."""
    bits = np.zeros((len(size), SKETCH_WORDS * 64), bool)
    spread = flat.view(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(7)  # other bits than the counters look at
    bits[np.repeat(np.arange(len(size)), size), spread % np.uint32(SKETCH_WORDS * 64)] = True
    return np.packbits(bits, axis=1).view(np.uint64)


def _most_shared(n: np.ndarray, bits: np.ndarray, other: np.ndarray) -> np.ndarray:
    """What sets of ``n`` shingles can share with others at most: a bit that the other lacks is a shingle that it lacks."""
    return n - np.bitwise_count(bits & ~other).sum(1, dtype=np.int64)


def _near_and_least(one: np.ndarray, two: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs that lead from each row to its nearest and to its least other row."""
    node, other, place = np.concatenate([one, two]), np.concatenate([two, one]), np.tile(np.arange(len(one)), 2)
    orders = np.lexsort((other, np.tile(apart, 2), node)), np.lexsort((other, node))
    return np.unique(np.concatenate([place[o[np.diff(node[o], prepend=-1) != 0]] for o in orders]))


def _rare_pairs(similarity: float, nearest: bool = False):
    """Pairs (a, b) that may be similar enough and the bits that their sketches differ in, of rows (shingle, low, high, place, row, component, n, sketch) sorted by the first three."""

    def may(rows: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
        place, _, component, n, bits = rows
        room = np.minimum(n[i] - place[i], n[j] - place[j])  # this shingle and all after it
        needed = np.ceil(similarity / (1 + similarity) * (n[i].astype(np.int64) + n[j]) - 1e-9)
        out = (component[i] != component[j]) & _sized(n[i], n[j], similarity) & (room >= needed)
        live = np.flatnonzero(out)
        i, j = i[live], j[live]
        out[live] = np.minimum(_most_shared(n[i], bits[i], bits[j]), _most_shared(n[j], bits[j], bits[i])) >= needed[live]
        return out

    def unlike(bits: np.ndarray, i: np.ndarray | int, j: np.ndarray) -> np.ndarray:
        return np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64)

    def inside(group: np.ndarray, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(starts, append=len(group))
        live, step, found = np.flatnonzero(np.repeat(sizes <= PAIRED, sizes)), 1, []
        while len(live):
            live = live[live + step < len(group)]
            live = live[group[live] == group[live + step]]
            hit = live[may(rows, live, live + step)]
            found.append((rows[1][hit], rows[1][hit + step], unlike(rows[4], hit, hit + step)))
            step += 1
        for s, size in zip(starts[sizes > PAIRED], sizes[sizes > PAIRED]):
            for i in range(s, s + size - 1):
                rest = np.arange(i + 1, s + size)
                hit = rest[may(rows, np.full(len(rest), i), rest)]
                found.append((np.full(len(hit), rows[1][i]), rows[1][hit], unlike(rows[4], i, hit)))
        one, two, apart = (np.concatenate([np.zeros(0, np.int64), *(f[i] for f in found)]) for i in range(3))
        if nearest:
            best = _near_and_least(one, two, apart)
            one, two, apart = one[best], two[best], apart[best]
        both = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two), apart], 1), axis=0)
        yield pa.RecordBatch.from_arrays([*(pa.array(both[:, i]) for i in (0, 1)), pa.array(both[:, 2].astype(np.int32))], names=["a", "b", "apart"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            held.append([*(c.to_numpy() for c in batch.columns[:-1]), np.frombuffer(b"".join(batch.columns[-1].to_pylist()), np.uint64).reshape(-1, SKETCH_WORDS)])
            if sum(len(h[0]) for h in held) >= 1 << 18:
                *whole, rest = _cut([np.concatenate(c) for c in zip(*held)])
                if len(whole[0]):
                    yield from inside(whole[0], whole[1])
                held = [rest]
        if held:
            columns = [np.concatenate(c) for c in zip(*held)]
            yield from inside(_groups(columns), columns[3:])

    return run


def _groups(columns: list[np.ndarray]) -> np.ndarray:
    """A number for each run of rows that agree in the first three columns."""
    return np.cumsum(np.logical_or.reduce([np.diff(c, prepend=c[:1]) != 0 for c in columns[:3]]))


def _cut(columns: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The groups but for the last one, their rows, and the last group's rows with all columns."""
    group = _groups(columns)
    whole = int(np.searchsorted(group, group[-1]))
    return group[:whole], [c[:whole] for c in columns[3:]], [c[whole:] for c in columns]


def rare_links(sets: DataFrame, similarity: float, nearest: bool = False) -> DataFrame:
    """(a, b, apart): of rows (row, component, shingles), all pairs of different components that may be similar enough.

    Two similar sets meet at the first shingle they share in the order of frequency: both hold it among their rarest, and
    what follows it in either set must suffice for their overlap, as must what their sketches have in common. Shingles of one component only are left out before any
    pair is made; the rows of a frequent one are cut into blocks, whose pairs are groups of their own. With ``nearest``, each
    task returns of each row only the pair with the nearest other row it meets there and that with the least.
    """
    rare = stage(_rare_rows(sets, similarity), "rare")
    met = rare.groupBy("shingle").agg(F.count("*").alias("count"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    met = stage(met.select("shingle", F.ceil(F.col("count") / BUCKET_ROWS).cast("int").alias("blocks")), "met")
    rows = _perhaps(rare, "shingle", met.select(F.col("shingle").alias("row")), "perhaps").where("perhaps").drop("perhaps")
    rows = rows.join(met, "shingle")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("shingle", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "place", "row", "component", "n", "sketch")
    pairs = rows.repartition("shingle", "low", "high").sortWithinPartitions("shingle", "low", "high").mapInArrow(_rare_pairs(similarity, nearest), "a long, b long, apart int")
    out = stage(pairs.distinct(), "rare_pairs")
    unstage(rare)
    unstage(met)
    return out


def _nearest(pairs: DataFrame) -> DataFrame:
    """(a, b): of pairs (a, b, ca, cb, apart), for each component the pair that leads to the nearest other one, and that to the least."""
    pair = F.struct("a", "b").alias("pair")
    ends = pairs.select(F.col("ca").alias("node"), F.col("cb").alias("other"), "apart", pair).unionByName(pairs.select(F.col("cb").alias("node"), F.col("ca").alias("other"), "apart", pair))
    best = ends.groupBy("node").agg(F.min(F.struct("apart", "other", "pair"))["pair"].alias("near"), F.min(F.struct("other", "apart", "pair"))["pair"].alias("least"))
    return best.select(F.explode(F.array("near", "least")).alias("pair")).select("pair.a", "pair.b").distinct()


def _between(pairs: DataFrame, linked: DataFrame | None) -> DataFrame:
    """(a, b, ca, cb, apart): the pairs (a, b, apart) of different components, with these."""
    if linked is None:
        return pairs.select("a", "b", F.col("a").alias("ca"), F.col("b").alias("cb"), "apart")
    for end in ("a", "b"):
        pairs = pairs.join(linked.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.where("ca <> cb").select("a", "b", "ca", "cb", "apart")


def _joined(linked: DataFrame | None, found: DataFrame) -> DataFrame:
    """Components of rows, of those before and the links found since."""
    if linked is not None:
        found = found.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = stage(components(found), "linked")
    if linked is not None:
        unstage(linked)
    return out


def _settled(pairs: DataFrame, linked: DataFrame | None, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Components after rounds of verifying, and the pairs not verified whose rows these do not connect.

    Each round verifies at most two pairs of each component, and the next leaves out those of rows that are connected by
    then. It goes on as long as a good part of a round's pairs hold and many pairs are left.
    """
    left = stage(_between(pairs, linked), "pairs")
    for _ in range(ROUNDS):
        chosen = stage(_nearest(left), "chosen")
        found = stage(verified(chosen, sets, similarity), "verified")
        tried, hold = chosen.count(), found.count()
        if hold or linked is None:
            linked = _joined(linked, found)
        after = stage(_between(left.join(chosen, ["a", "b"], "left_anti").select("a", "b", "apart"), linked), "pairs")
        for done in (left, chosen, found):
            unstage(done)
        left = after
        if hold <= ROUND_YIELD * tried or left.count() <= 2 * tried:
            break
    return linked, left


def near_components(links: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(node, component): rows that links connect whose similarity is verified, of the trees of ``links`` and the sets of their rows."""
    linked, left = _settled(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "apart").distinct(), None, sets, similarity)
    unstage(left)
    open_ = stage(_unsettled(links, linked), "unsettled")
    if open_.limit(1).count():
        for nearest in (True, False):  # most of what is similar is connected before all pairs are made of the rest
            now = open_.join(linked.withColumnRenamed("component", "found"), F.col("row") == F.col("node"), "left").select("row", F.coalesce("found", "row").alias("component"))
            more = rare_links(sets.join(now, "row").select("row", "component", "shingles"), similarity, nearest)
            linked, left = _settled(more, linked, sets, similarity)
            if not nearest and left.limit(1).count():
                linked = _joined(linked, verified(left.select("a", "b"), sets, similarity))
            unstage(more)
            unstage(left)
    unstage(open_)
    return linked


def _perhaps(table: DataFrame, row: str, listed: DataFrame, mark: str) -> DataFrame:
    """``table`` with the boolean ``mark``: false where the number in ``row`` is certainly not in ``listed`` (row).

    What is broadcast are the filter's words, FILTER_BITS / 64 rows at most; texts of unmarked rows need no shuffle.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    word = lambda c: F.shiftright(bit(c), 6)
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), (bit(c) % 64).cast("int"))
    words = listed.select(word("row").alias(f"{mark}_word"), one("row").alias("bit")).groupBy(f"{mark}_word").agg(F.bit_or("bit").alias(f"{mark}_bits"))
    met = table.join(F.broadcast(words), word(row) == F.col(f"{mark}_word"), "left")
    return met.withColumn(mark, F.coalesce(F.col(f"{mark}_bits").bitwiseAND(one(row)) != 0, F.lit(False))).drop(f"{mark}_word", f"{mark}_bits")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each group that verified links connect, that of the smallest id."""
    mark = fresh(docs, "row")
    numbered = stage(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(mark).alias("row"), F.col(text_col).alias("text"))
    ids = numbered.select(F.col(mark).alias("row"), F.col(id_col).alias("id"))
    prints = stage(_prints(texts, words), "near_prints")
    order = F.min(F.struct(F.col("id").isNull(), "id", "row", "a", "b", "n")).alias("x")
    leaders = stage(prints.join(ids, "row").groupBy("same", "also").agg(order).select("x.row", "x.id", "x.a", "x.b", "x.n"), "leaders")
    links = candidate_links(leaders, similarity)
    ends = links.select(F.col("b").alias("row")).unionByName(links.select(F.col("root").alias("row"))).distinct()
    ends = stage(ends, "ends")
    near = _perhaps(texts, "row", ends, "perhaps").where("perhaps").drop("perhaps")
    sets = stage(_shingle_sets(near.join(ends, "row", "left_semi"), words), "shingles")
    linked = near_components(links, sets, similarity)
    members = leaders.join(linked, leaders["row"] == linked["node"]).select("row", "id", "component")
    first = members.groupBy("component").agg(F.min(F.struct(F.col("id").isNull(), "id", "row"))["row"].alias("first"))
    inner = linked.join(first.select(F.col("first").alias("node")), "node", "left_anti").select(F.col("node").alias("row"))
    kept = leaders.select("row").join(inner, "row", "left_anti")
    gone = stage(prints.select("row").join(kept, "row", "left_anti"), "gone")
    for done in (prints, leaders, ends, sets, linked):
        unstage(done)
    seen = _perhaps(numbered, mark, gone, f"{mark}_perhaps")
    looked = seen.where(f"`{mark}_perhaps`").join(gone.withColumnRenamed("row", f"{mark}_gone"), F.col(mark) == F.col(f"{mark}_gone"), "left_anti")
    return seen.where(f"not `{mark}_perhaps`").unionByName(looked).drop(mark, f"{mark}_perhaps")
