"""Near-duplicate vectors by a forest of random-projection trees.

A tree splits recursively at the median of a random projection. Vectors near the split go to both sides (spill), as near
as half the way that two linked vectors usually lie apart in one projection. Vectors that share a leaf of some tree are
compared in double precision; a pair that shares several leaves counts in the first of them. A node whose vectors would
nearly all spill is a tight group and stays a leaf. Leaves larger than a block are compared as pairs of blocks in
separate tasks, so a leaf of any size is compared in full.

The trees are fitted on a sample of at most ``SAMPLE`` distinct vectors (by a hash of their rows), and all vectors are
indexed. Equal vectors are collapsed first and count as linked. A leaf gives back counts by vector and a spanning forest,
never all pairs. Vectors that are null, zero, hold a null or non-finite component, or have another length than most,
link with nothing and are components of their own. Rows may repeat; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

#: Vectors the trees are fitted on, trees, vectors a leaf aims at, and vectors of a block.
SAMPLE, TREES, LEAF, BLOCK = 32_768, 8, 256, 2048
#: A node is split only with so many sampled vectors, and only if at most this share of them spills.
SAMPLED, SPILLED = 16, 0.5
#: Rows of an Arrow batch of vectors.
ROWS = 8192


class Tree:
    """Splits by node: the root is 1, the children of n are 2n and 2n + 1; a node without a split is a leaf."""

    def __init__(self, number: int, margin: float):
        self.number, self.margin = number, margin
        self.cuts: dict[int, float] = {}

    def direction(self, node: int, width: int) -> np.ndarray:
        # From the tree's and the node's number, so that only cuts travel to the executors.
        x = np.random.default_rng([7, self.number, node]).standard_normal(width)
        return x / np.linalg.norm(x)

    def fit(self, unit: np.ndarray, rows: float) -> Tree:
        """``rows``: how many vectors there are in all for each one of ``unit``."""
        stack = [(1, np.arange(len(unit)))]
        while stack:
            node, at = stack.pop()
            if len(at) * rows <= LEAF or len(at) < SAMPLED or node >= 1 << 30:
                continue
            p = unit[at] @ self.direction(node, unit.shape[1])
            cut = float(np.median(p))
            left, right = at[p <= cut + self.margin], at[p > cut - self.margin]
            if len(left) + len(right) - len(at) > SPILLED * len(at):
                continue
            self.cuts[node] = cut
            stack += [(2 * node, left), (2 * node + 1, right)]
        return self

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, leaf) for every leaf that each vector reaches."""
        who, leaf, stack = [], [], [(1, np.arange(len(unit)))]
        while stack:
            node, at = stack.pop()
            if node not in self.cuts:
                who.append(at)
                leaf.append(np.full(len(at), node, np.int64))
            elif len(at):
                p, cut = unit[at] @ self.direction(node, unit.shape[1]), self.cuts[node]
                stack += [(2 * node, at[p <= cut + self.margin]), (2 * node + 1, at[p > cut - self.margin])]
        return np.concatenate(who), np.concatenate(leaf)


def unit_rows(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return unit_rows(values.reshape(len(flat), -1)) if len(flat) else np.zeros((0, 1))


def _star(hit: np.ndarray) -> np.ndarray:
    """The least index reachable from each by links in a square matrix."""
    label = np.arange(len(hit))
    hit = hit | np.eye(len(hit), dtype=bool)
    while True:
        new = np.where(hit, label[None, :], len(hit)).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        leaf, low, high = (group.column(c)[0].as_py() for c in ("leaf", "low", "high"))
        unit, node, n, block = _matrix(group.column("vector")), group.column("node").to_numpy(), group.column("n").to_numpy(), group.column("block").to_numpy()
        hit = unit @ unit.T >= threshold
        np.fill_diagonal(hit, False)
        if low != high:
            hit &= block[:, None] != block[None, :]
        some = np.flatnonzero(hit.any(1))
        a, b, count = [], [], []
        if len(some):
            hit, node, n = hit[np.ix_(some, some)], node[some], n[some]
            label = _star(hit)
            # a pair that shares a leaf of a smaller number was counted there
            codes = group.column("codes").combine_chunks().take(pa.array(some))
            row, code = np.repeat(np.arange(len(some)), codes.value_lengths().to_numpy()), codes.flatten().to_numpy()
            row, code = row[code < leaf], code[code < leaf]
            names, inverse, times = np.unique(code, return_inverse=True, return_counts=True)
            inverse, row = inverse[times[inverse] > 1], row[times[inverse] > 1]
            columns, inverse = np.unique(inverse, return_inverse=True)
            if len(columns):
                has = np.zeros((len(some), len(columns)), np.float32)
                has[row, inverse] = 1
                first = hit & (has @ has.T == 0)
            else:
                first = hit
            a, b, count = node, node[label], first @ n
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(count, pa.int64())})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, trees: int = TREES) -> DataFrame:
    """(id, n_links, component_id, kept) of every row: other rows linked directly, and the least id in reach."""
    spark = vectors.sparkSession
    rows_before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS))
    rows = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(vector_col).cast("array<double>").alias("vector"))
    whole = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce((F.size("vector") > 0) & F.forall("vector", whole) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = stage(rows.withColumn("good", good), "vectors")
    usual = rows.where("good").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    width = usual["width"] if usual else 0
    rows = rows.withColumn("good", F.col("good") & (F.size("vector") == width))
    distinct = stage(rows.where("good").groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("n"), F.min("id").alias("least")), "distinct")
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("vector").toArrow().column(0)
    unit = _matrix(sample)
    # Two linked vectors at the threshold lie apart by this on average in one of the projections; half of it spills.
    margin = float(np.sqrt(max(0.0, 2 - 2 * threshold) / max(1, width))) / 2
    forest = [Tree(i, margin).fit(unit, total / max(1, len(unit))) for i in range(trees)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(2))
            found = [t.leaves(own) for t in forest]
            who = np.concatenate([w for w, _ in found])
            code = np.concatenate([leaf | t.number << 32 for t, (_, leaf) in zip(forest, found)])
            order = np.argsort(who, kind="stable")
            codes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(who, minlength=len(own)))]).astype(np.int32)), pa.array(code[order]))
            for at in range(0, len(who), ROWS):
                take = pa.array(who[at : at + ROWS])
                yield pa.RecordBatch.from_arrays([pa.array(code[at : at + ROWS]), *(batch.column(i).take(take) for i in (0, 1)), batch.column(2).take(take), codes.take(take)], names=["leaf", "node", "n", "vector", "codes"])

    kind = dict(vectors.dtypes)[vector_col]
    kind = kind if kind == "array<float>" else "array<double>"
    keyed = distinct.select("node", "n", F.col("vector").cast(kind).alias("vector"))
    keyed = stage(keyed.mapInArrow(index, f"leaf long, node long, n long, vector {kind}, codes array<long>"), "leaves")
    # As many leaves as the trees have, which the sample bounds.
    sizes = F.broadcast(keyed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    pairs = keyed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = pairs.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("leaf", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "n", "vector", "codes")
    links = stage(pairs.groupBy("leaf", "low", "high").applyInArrow(_compare(threshold), "a long, b long, n long"), "links")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_before)
    counts = links.groupBy("a").agg(F.sum("n").alias("others"))
    linked = components(links.select("a", "b"))
    classes = distinct.join(linked, distinct["node"] == linked["node"], "left").join(counts, distinct["node"] == counts["a"], "left")
    classes = stage(classes.select("vector", distinct["node"].alias("node"), "n", "least", F.coalesce("component", distinct["node"]).alias("component"), F.coalesce("others", F.lit(0)).alias("others")), "classes")
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = classes.join(names, "component").select(F.col("vector").alias("_vector"), (F.col("others") + F.col("n") - 1).alias("n_links"), "component_id")
    alone = rows.where(~F.col("good")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.where("good").join(classes, F.col("vector") == F.col("_vector")).select("id", "n_links", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
