"""Exact deduplication by deterministic block naming.

A normalised text (ASCII white space deleted) is cut into blocks of fixed size. The distinct blocks are sorted (by a
hash, and blocks of one hash by themselves) and a block's name is its rank; then adjacent names are paired, the distinct
pairs sorted and named the same way, again and again, until each document has a single name. Two documents have the same
name after the same number of rounds exactly if they have equal texts: blocks of one hash are told apart as strings, so
no hash can collide. Names depend on the texts alone, not on how the table is divided.

DataFrame functions only. Blocks that very many rows share are numbered by broadcast (their number is fixed), the others
in a window over the block's hash, so texts are shuffled once. Nulls count as empty texts, which are equal to one another
and to texts of white space. Very long texts are many blocks. Rows may repeat (each is a row of its own; one stays);
columns of any name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_hot, stage, unstage

#: Code points in a block.
BLOCK = 2048
#: Blocks named by broadcast: the most frequent ones.
HOT_BLOCKS = 256
# The characters that normalising deletes.
WHITE_SPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, "")


def _blocks(docs: DataFrame, id_col: str, text_col: str, row_col: str | None) -> DataFrame:
    """(row, at, blocks, block, h, head): a row per block with its hash; a text's first block carries what is known of the row."""
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))
    base = base.select("id", "row", F.length("text").alias("chars"), normalised(F.col("text")).alias("norm"))
    base = base.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.length("norm") / BLOCK)).cast("int"))
    head = F.struct("id", "chars", F.sha2("norm", 256).alias("sha"))
    cut = F.when(F.col("blocks") == 1, F.array("norm")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring("norm", i * BLOCK + 1, F.lit(BLOCK))))
    out = base.select("row", "blocks", head.alias("head"), F.posexplode(cut).alias("at", "block"))
    return out.select("row", "at", "blocks", "block", F.xxhash64("block").alias("h"), F.when(F.col("at") == 0, F.col("head")).alias("head"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``block`` replaced by ``k``: its number among the blocks of its hash, nearly always 1."""
    hot = [r["h"] for r in rows.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(HOT_BLOCKS).collect()]
    keep = ["row", "at", "blocks", "head", "h", "k"]
    number = F.dense_rank().over(Window.partitionBy("h").orderBy("block"))
    if not hot:
        return rows.withColumn("k", number).select(*keep)
    near = rows.where(F.col("h").isin(hot))
    kinds = near.select("h", "block").distinct().withColumn("k", number)
    near = near.join(F.broadcast(kinds), ["h", "block"]).select(*keep)
    return near.unionByName(rows.where(~F.col("h").isin(hot)).withColumn("k", number).select(*keep))


def _ranked(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """(by, name, n): the distinct values of some integer columns, how many rows have each, and their rank, gapless from 0."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n")).orderBy(*by)
    found = stage(found.select(*by, "n", F.monotonically_increasing_id().alias("place")), label)
    part = F.shiftright("place", 33)  # the number of the partition, which are in order
    parts = found.groupBy(part.alias("part")).agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    shifts = F.broadcast(parts.select("part", before.alias("shift")))
    return found.join(shifts, part == F.col("part")).select(*by, "n", (F.col("shift") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("name"))


def _named(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows with their ``name``; names that many rows have reach them by broadcast."""
    names = stage(_ranked(rows, by, label).withColumn("pair", F.xxhash64(*by)), f"{label}_names")
    hot = F.broadcast(names.orderBy(F.desc("n"), "name").limit(HOT_BLOCKS).select(*by, F.col("name").alias("hot")))
    met = rows.join(hot, by, "left")
    cold = names.select(*by, "name")
    open_ = met.where("hot is null").drop("hot").join(cold, by)
    return met.where("hot is not null").withColumnRenamed("hot", "name").unionByName(open_.select(*rows.columns, "name"), allowMissingColumns=True)


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(row, id, chars, sha, identity): a bigint that is equal for two rows exactly if their normalised texts are.

    ``row_col`` numbers the rows, where there is such a column; else they are numbered here.
    """
    blocks = stage(_blocks(docs, id_col, text_col, row_col), "blocks")
    numbered = stage(_numbered(blocks), "numbered")
    unstage(blocks)
    named = stage(_named(numbered, ["h", "k"], "ranks").select("row", "at", "blocks", "head", "name"), "names")
    unstage(numbered)
    done = named.where("blocks = 1").select("row", "head.*", (F.col("name") * 64).alias("identity"))
    level, left = 1, named.where("blocks > 1")
    while left.limit(1).count():
        pairs = left.groupBy("row", F.floor(F.col("at") / 2).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
            F.max("head").alias("head"),
            F.max(F.ceil(F.col("blocks") / 2)).alias("blocks"),
        )
        pairs = stage(pairs, "pairs")
        left = stage(_named(pairs, ["a", "b"], "ranks").select("row", "at", "blocks", "head", "name"), "names")
        unstage(pairs)
        done = done.unionByName(left.where("blocks = 1").select("row", "head.*", (F.col("name") * 64 + level).alias("identity")))
        left, level = left.where("blocks > 1"), level + 1
    return done


def _kept(rows: DataFrame) -> DataFrame:
    """(identity, group_size, keep_id, keep_row): of each identity the row with most code points, then the smallest id."""
    order = F.struct(-F.col("chars").cast("long"), F.col("id").isNull(), F.col("id"), F.col("row"))
    groups = rows.groupBy("identity").agg(F.count("*").alias("group_size"), F.min_by(F.struct("id", "row"), order).alias("best"))
    return stage(groups.select("identity", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "groups")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the row that stays for its text, the group's size, whether it stays itself.

    Of equal texts the one with most code points before normalising stays, then the one with the smallest id.
    """
    rows = identities(docs, id_col, text_col)
    out = join_hot(rows, _kept(rows), "identity", "group_size", "row")
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, all columns; ids may repeat or be null."""
    mark = fresh(docs, "row")
    numbered = stage(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    kept = _kept(identities(numbered, id_col, text_col, mark)).select(F.col("keep_row").alias(f"{mark}_kept"))
    return numbered.join(kept, F.col(mark) == F.col(f"{mark}_kept"), "left_semi").drop(mark)
