"""Near-duplicate detection by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint has 64 bits: a bit is set if it is set in over half the hashes of the text's word shingles (repeats count).
Fingerprints at most 4 bits apart are linked. It is cut into three segments, and 4 differing bits leave two segments with
at most 2 each. A segment is decoded to the indices of all nearby Golay codewords, and two segments at most 2 bits apart
share an index; so linked fingerprints share a key made of the indices of some two segments. Rows with equal keys are
compared bit by bit, and components are the rows that links connect.

Copies are collapsed to distinct fingerprints first, a bucket is sorted into the stream of its partition and compared in
blocks of numpy rows, and it gives back a spanning forest of its links, never all pairs. Very full buckets are cut into
blocks whose pairs are dealt to different tasks. Nulls count as empty texts; texts without words have fingerprint zero,
linked like any other. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stage
from .components import components
from .golay import Golay

WORDS, BITS, SEED = 4, 4, 42
#: Where the three segments start, and their widths.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of a bucket that one task compares with one another; of a fuller bucket, pairs of blocks of so many rows.
BUCKET_ROWS = 4096
#: Full buckets whose list is broadcast, at most; longer lists are joined by a shuffle.
FEW_BUCKETS = 100_000


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, with only A-Z lower-cased, in UTF-8."""
    return text.encode().lower().split()


def fingerprint(text: str, size: int = WORDS) -> int:
    words = words_of(text)
    if not words:
        return 0
    data, digest = b" ".join(words), xxhash.xxh64_digest
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    hashes = np.frombuffer(b"".join([digest(data[i : j - 1], SEED) for i, j in zip(starts, starts[size:])]) or digest(data, SEED), np.uint8).reshape(-1, 8)
    sums, count = np.zeros(64, np.int64), len(hashes)
    for i in range(0, count, 255):  # so many bits fit into a byte
        sums += np.add.reduce(np.unpackbits(hashes[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * sums > count).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) of every row; the fingerprint as a signed bigint with the same bits."""
    short_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t or "") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], names=["id", "fingerprint"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, fingerprint long")


def _fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(key, fingerprint): the keys of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Golay()
        for batch in batches:
            value = batch.column(0).to_numpy()
            bits = value.view(np.uint64)
            near = [code.keys((bits >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
            for pair, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
                keys = np.where((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0), pair << 24 | near[i][:, :, None] << 12 | near[j][:, None, :], -1).reshape(len(bits), -1)
                row, column = np.nonzero(keys >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(keys[row, column].astype(np.int32)), pa.array(value[row])], names=["key", "fingerprint"])

    return prints.mapInArrow(run, "key int, fingerprint long")


def forest(values: np.ndarray, others: np.ndarray | None = None, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints, or between two blocks of them."""
    same = others is None
    others = values if same else others
    left, right = values.view(np.uint64), others.view(np.uint64)
    parent = list(range(len(left) + (0 if same else len(right))))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out, step = [], max(1, (1 << 20) // max(1, len(right)))
    for at in range(0, len(left), step):
        hit = np.bitwise_count(left[at : at + step, None] ^ right[None, :]) <= bits
        for i, j in zip(*np.nonzero(hit)):
            i = int(i) + at
            a, b = root(i), root(int(j) + (0 if same else len(left)))
            if a != b:
                parent[a] = b
                out.append((int(values[i]), int(others[j])))
    return out


def _small_buckets(keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links within many small buckets at once: each row with the next one, the one after it, and so on, in its bucket."""
    out, step, live = [], 1, np.arange(len(keys))
    bits = values.view(np.uint64)
    while len(live):
        live = live[live + step < len(keys)]
        live = live[keys[live] == keys[live + step]]
        hit = live[np.bitwise_count(bits[live] ^ bits[live + step]) <= BITS]
        out.append((values[hit], values[hit + step]))
        step += 1
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside buckets; rows come sorted by key."""

    def links(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.flatnonzero(np.diff(keys, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        sizes = ends - starts
        small = np.repeat((sizes > 1) & (sizes <= 48), sizes)
        pairs = _small_buckets(keys[small], values[small])
        for s, e in zip(starts[sizes > 48], ends[sizes > 48]):
            found = forest(values[s:e])
            pairs.append((np.array([a for a, _ in found], np.int64), np.array([b for _, b in found], np.int64)))
        a, b = (np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64) for i in (0, 1))
        if len(a):
            # each pair once: the same two fingerprints meet in many buckets
            both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    held: list[tuple[np.ndarray, np.ndarray]] = []
    count = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        count += batch.num_rows
        if count < 1 << 19:
            continue
        keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        whole = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on
        if whole:
            yield from links(keys[:whole], values[:whole])
        held, count = [(keys[whole:], values[whole:])], len(keys) - whole
    if held:
        keys, values = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        if len(keys):
            yield from links(keys, values)


def _full_buckets(keyed: DataFrame, full: DataFrame) -> DataFrame:
    """Links inside buckets of more than BUCKET_ROWS rows: each pair of a bucket's blocks is a group of its own."""
    rows = keyed.join(full, "key").withColumn("blocks", F.ceil(F.col("count") / BUCKET_ROWS).cast("int"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fingerprint"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "fingerprint")

    def pair(table: pa.Table) -> pa.Table:
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        block, value = table.column("block").to_numpy(), table.column("fingerprint").to_numpy()
        found = forest(value) if low == high else forest(value[block == low], value[block == high])
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return rows.groupBy("key", "low", "high").applyInArrow(pair, "a long, b long")


def link_fingerprints(prints: DataFrame) -> DataFrame:
    """(a, b): links that connect all distinct ``fingerprint`` values at most BITS apart into their components."""
    spark = prints.sparkSession
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    keyed = stage(_fuzzy_keys(prints.select("fingerprint").distinct()), "fuzzy_keys")
    full = stage(keyed.groupBy("key").count().where(F.col("count") > BUCKET_ROWS), "full_buckets")  # at most 3 x 2^24 keys exist
    few = full.count()
    small = F.broadcast if few <= FEW_BUCKETS else lambda df: df
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    usual = keyed.join(small(full.select("key")), "key", "left_anti") if few else keyed
    links = usual.repartition("key").sortWithinPartitions("key").mapInArrow(_compare, "a long, b long")
    if few:
        links = links.unionByName(_full_buckets(keyed, small(full)))
    links = stage(links, "links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint in hex, component_id): the smallest id of the rows that links connect to the row, itself included."""
    rows = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    prints = stage(rows.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count("*").alias("n")), "prints")
    linked = components(link_fingerprints(prints))
    classes = stage(prints.join(linked, F.col("fingerprint") == F.col("node"), "left").select("fingerprint", "least", "n", F.coalesce("component", "fingerprint").alias("component")), "classes")
    ids = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = classes.join(ids, "component").select(F.col("fingerprint").alias("print"), "component_id", "n")
    return _back(rows, ids, id_col)


def _back(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Class ids to all rows; the fingerprints that most rows share by broadcast (256 of them at most)."""
    hot = ids.orderBy(F.desc("n"), "print").limit(256).select(F.col("print").alias("_hot"), F.col("component_id").alias("_hot_id"))
    cold = ids.select(F.col("print").alias("_cold"), F.col("component_id").alias("_cold_id"))
    met = rows.join(F.broadcast(hot), F.col("fingerprint") == F.col("_hot"), "left")
    # rows already met get keys of their own, which no fingerprint of the other side equals in both columns
    met = met.withColumn("_done", F.col("_hot").isNotNull()).withColumn("_key", F.when(F.col("_done"), F.monotonically_increasing_id()).otherwise(F.col("fingerprint")))
    met = met.join(cold.withColumn("_open", F.lit(False)), (F.col("_key") == F.col("_cold")) & (F.col("_done") == F.col("_open")), "left")
    return met.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.coalesce("_hot_id", "_cold_id").alias("component_id"))
