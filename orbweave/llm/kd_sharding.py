"""Sharding by a k-d tree over document metadata.

The rows are split recursively at a weighted median of size along the widest metadata dimension, until leaves reach the
target. A median is found on the executors by radix selection: each pass sums sizes by node and digit of the sort key
(the dimension's value, then a hash that breaks ties), and only those sums (nodes x 4096) reach the driver.

Rows with equal texts form one group that stays in one shard. A small group goes where its first row goes. Large groups
(over ``GROUP_SHARE`` of a shard, so at most that many for each shard) are placed first, the largest where there is most
room, and the tree then divides the other rows so that they fill what is left of each shard. A group is dealt out row by
row only where it cannot be kept: where it is over half a shard, or no shard has room for it.

The law is ``bytes``: sizes near equal. Nulls: a null text has size 1, null metadata sort first. String dimensions count
by the six bytes after the beginning that all values share. Rows may repeat; extra columns are ignored; very long texts
are rows like others, which no split can divide; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage, unstage

#: A group of equal texts is placed by itself from this share of a shard's size, and dealt out from that one.
GROUP_SHARE, DEALT_SHARE = 1 / 256, 1 / 2
#: Digits of the sort key: bits a pass decides, and passes.
DIGIT_BITS, KEY_BITS = 12, 60


def _ordered(column: Column, kind: str, shared: int = 0) -> Column:
    """A dimension as a double that sorts as the values do; strings by the six bytes after those that all share."""
    if kind == "string":
        return F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    return F.coalesce(column.cast("double"), F.lit(-1.0))


def _split(rows: DataFrame, nodes: dict[int, tuple], share: dict[int, float], dims: int) -> dict[int, tuple]:
    """For each node to split: (dimension, low, high, cut) so that keys below ``cut`` hold about its share of the size."""
    plan = {}
    stats = rows.where(F.col("node").isin(list(nodes))).groupBy("node").agg(F.sum("size").alias("size"), *[f(f"d{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("low", F.min), ("high", F.max))]).collect()
    for r in stats:
        whole = nodes[r["node"]]
        width = [(r[f"high{i}"] - r[f"low{i}"]) / whole[i] if whole[i] else 0 for i in range(dims)]
        best = max(range(dims), key=lambda i: (width[i], -i))
        plan[r["node"]] = {"dim": best, "low": r[f"low{best}"], "span": r[f"high{best}"] - r[f"low{best}"], "goal": r["size"] * share[r["node"]], "prefix": 0, "below": 0.0}
    for done in range(0, KEY_BITS, DIGIT_BITS):
        held = rows.where(F.col("node").isin(list(plan))).withColumn("key", _key(plan))
        shift = KEY_BITS - done - DIGIT_BITS
        same = F.shiftright("key", shift + DIGIT_BITS) == _of_node({k: p["prefix"] for k, p in plan.items()}, "long")
        digit = F.shiftright("key", shift).bitwiseAND((1 << DIGIT_BITS) - 1)
        sums: dict[int, list] = {}
        for r in held.where(same).groupBy("node", digit.alias("digit")).agg(F.sum("size").alias("size")).collect():
            sums.setdefault(r["node"], []).append((r["digit"], r["size"]))
        for node, found in sums.items():
            p = plan[node]
            for digit_, size in sorted(found):
                chosen = digit_
                if p["below"] + size > p["goal"]:
                    break
                p["below"] += size
            p["prefix"] = (p["prefix"] << DIGIT_BITS) | chosen
    return plan


def _key(plan: dict[int, dict]) -> Column:
    """The 60-bit sort key of a row in its node: 36 bits of the node's dimension, 24 of the tie-breaking hash."""
    dims = F.array(*[F.col(f"d{i}") for i in range(max(p["dim"] for p in plan.values()) + 1)])
    value = F.element_at(dims, _of_node({k: p["dim"] + 1 for k, p in plan.items()}, "int")) - _of_node({k: p["low"] for k, p in plan.items()}, "double")
    scaled = F.floor(value * _of_node({k: ((1 << 36) - 1) / p["span"] if p["span"] else 0.0 for k, p in plan.items()}, "double")).cast("long")
    return F.shiftleft(F.least(scaled, F.lit((1 << 36) - 1)), 24).bitwiseOR(F.col("tie"))


def _of_node(values: dict[int, float], kind: str) -> Column:
    """A value that depends on the row's node."""
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v).cast(kind))]), F.col("node"))


def assign_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", dims: tuple[str, ...] = ("doc_id", "n_chars", "lang", "source")) -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row. Give the number of shards, or the bytes that a leaf aims at.

    ``dims`` are the metadata dimensions (numbers or strings); those that the table lacks are left out.
    """
    kinds = dict(docs.dtypes)
    dims = tuple(d for d in dims if d in kinds) or (id_col,)
    strings = [d for d in dims if kinds[d] == "string"]
    ends = docs.agg(F.lit(0), *[f(d).alias(f"{f.__name__}_{i}") for i, d in enumerate(strings) for f in (F.min, F.max)]).first()
    shared = {d: len(os.path.commonprefix([(ends[f"{f}_{i}"] or "").encode() for f in ("min", "max")])) for i, d in enumerate(strings)}  # of the first and the last, so of all
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("crc"),
        F.xxhash64(text).alias("group"), *[_ordered(F.col(d), kinds[d], shared.get(d, 0)).alias(f"d{i}") for i, d in enumerate(dims)],
    )
    rows = stage(rows, "metadata")
    total = rows.agg(F.sum("size")).first()[0] or 0
    if shards is None:
        shards = max(1, round(total / target_bytes))
    # A group is placed as its first row is.
    first = F.min(F.struct("id", "row", *[f"d{i}" for i in range(len(dims))])).alias("first")
    groups = stage(rows.groupBy("group").agg(F.count("*").alias("n"), F.sum("size").alias("group_size"), first).where("n > 1"), "groups")
    whole_shard = total / shards
    large = groups.where(F.col("group_size") > whole_shard * GROUP_SHARE).select("group", "group_size").collect()  # at most shards / GROUP_SHARE
    fixed, dealt, room = _place_groups({r["group"]: r["group_size"] for r in large}, shards, whole_shard)
    leaders = groups.where(F.col("group_size") <= whole_shard * GROUP_SHARE)
    leaders = leaders.select(F.col("group").alias("_group"), "n", F.struct(F.col("first.row").alias("leader"), *[F.col(f"first.d{i}").alias(f"g{i}") for i in range(len(dims))]).alias("of"))
    rows = rows.withColumn("leaf", _of_group(fixed))
    if dealt:
        rows = rows.withColumn("group", F.when(F.col("group").isin(dealt), F.xxhash64("row")).otherwise(F.col("group")))
    free = rows.where("leaf is null")
    free = free.join(leaders, F.col("group") == F.col("_group"), "left").withColumn("leader", F.coalesce("of.leader", "row"))
    free = free.select("id", "row", "size", "crc", F.xxhash64("leader").bitwiseAND((1 << 24) - 1).alias("tie"), *[F.coalesce(f"of.g{i}", f"d{i}").alias(f"d{i}") for i in range(len(dims))])
    free = stage(free.withColumn("node", F.lit(1).cast("long")), "points")
    spans = free.agg(*[(F.max(f"d{i}") - F.min(f"d{i}")).alias(f"s{i}") for i in range(len(dims))]).first()
    whole = tuple(spans[f"s{i}"] or 0 for i in range(len(dims)))
    leaves = {1: list(range(shards))}  # node -> shards below it
    if not free.limit(1).count():  # nothing to split
        leaves = {1: [0]}
    while any(len(n) > 1 for n in leaves.values()):
        split = {k: n for k, n in leaves.items() if len(n) > 1}
        share = {k: sum(room[i] for i in n[: len(n) // 2]) / max(1e-9, sum(room[i] for i in n)) for k, n in split.items()}
        plan = _split(free, {k: whole for k in split}, share, len(dims))
        if plan:
            side = F.when(_key(plan) < _of_node({k: p["prefix"] for k, p in plan.items()}, "long"), 0).otherwise(1)
            before, free = free, stage(free.withColumn("node", F.when(F.col("node").isin(list(plan)), F.col("node") * 2 + side).otherwise(F.col("node"))), "points")
            unstage(before)
        leaves = {k: n for k, n in leaves.items() if len(n) == 1} | {c: m for k, n in split.items() for c, m in ((2 * k, n[: len(n) // 2]), (2 * k + 1, n[len(n) // 2 :]))}
    placed = free.select("id", "row", "size", "crc", _of_node({k: n[0] for k, n in leaves.items()}, "int").alias("shard"))
    placed = placed.unionByName(rows.where("leaf is not null").select("id", "row", "size", "crc", F.col("leaf").alias("shard")))
    return _slots(placed).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def _place_groups(sizes: dict[int, int], shards: int, whole: float) -> tuple[dict[int, int], list[int], list[float]]:
    """(group -> shard, groups to deal out, what is left of each shard): the largest first, where there is most room."""
    room, fixed, dealt = [(-whole, i) for i in range(shards)], {}, []
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        left, i = room[0]
        if size > whole * DEALT_SHARE or size > -left:
            dealt.append(group)
            continue
        heapq.heapreplace(room, (left + size, i))
        fixed[group] = i
    return fixed, dealt, [-left for left, _ in sorted(room, key=lambda x: x[1])]


def _of_group(values: dict[int, int]) -> Column:
    """The shard of a group that has one."""
    if not values:
        return F.lit(None).cast("int")
    return F.element_at(F.create_map(*[x for k, v in values.items() for x in (F.lit(k).cast("long"), F.lit(v).cast("int"))]), F.col("group"))


def _slots(rows: DataFrame, per_bucket: int = 20_000) -> DataFrame:
    """Number the rows of a shard from 0 without gaps: buckets of bounded size are numbered inside and then shifted."""
    from pyspark.sql import Window

    n = rows.count()
    buckets = max(1, math.ceil(n / per_bucket))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("long"))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id", "row")) - 1
    return rows.withColumn("inside", inside).join(shifts, ["shard", "bucket"]).withColumn("slot", (F.col("inside") + F.col("shift")).cast("long"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", **options) -> None:
    """Write ``docs`` as one folder per shard. Needs ids that differ from row to row."""
    mark, shard = fresh(docs, "id"), fresh(docs, "shard")
    placed = assign_shards(docs, id_col=id_col, **options).select(F.col(id_col).alias(mark), F.col("shard").alias(shard))
    docs.join(placed, F.col(id_col) == F.col(mark)).drop(mark).write.partitionBy(shard).parquet(path)
