"""Mixing sources to target weights by capped water-filling.

Sources share the size of the whole table by weight. A source whose share is above ``epochs`` times its own size is clamped
there and what it cannot take is shared among the others, again by weight, until no share is above its cap. All shares that
are not clamped stand at one level (words for each unit of weight), so a round needs two sums over the table of sources
and the driver holds one number.

A source's target is met by whole repetitions of all its documents and one fractional repetition: documents in a seeded
random order, as many as are needed, of the last one only its first words. The order is by a hash of seed and id, so it does
not depend on how the table is divided, and reruns agree. Where in that order the fractional repetition ends is found by
radix selection: sizes are summed by source and leading digits of the hash, the digit that holds the end is opened, and so
on until few documents are left; no source is ever sorted or gathered as a whole.

Nulls: a null text has size 0; a null source is a source of its own, after all others; null ids are hashed as the word
null. Texts without words take nothing, nor does a source without words. Rows that repeat in full stand beside each other
in the order and are taken as rows of their own. Very long texts count in full; a document can be cut once, as said. An
empty table gives an empty result. Columns of any other name are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stage, unstage

# What parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: Hex digits opened at a time, hence at most 4096 sums a source.
DIGITS = 3
#: Documents left around the end of a fractional repetition that are sorted together.
FEW = 4096
#: A table of one row a source reaches all rows by broadcast up to so many sources and bytes of names.
FEW_SOURCES, FEW_BYTES = 50_000, 8 << 20


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _placed(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``place``: the rank of each row, gapless from 0, counted by range partitions and their offsets."""
    found = stage(df.orderBy(*order).withColumn("at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("at", 33)  # the number of the partition, which are in order
    parts = found.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    shifts = F.broadcast(parts.select("part", before.alias("shift")))
    return found.join(shifts, part == F.col("part")).withColumn("place", F.col("shift") + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at", "part", "shift")


def water_level(sources: DataFrame, epochs: int = 3) -> float:
    """The level at which shares of ``sources`` (size, weight) use up the sum of their sizes, none above ``epochs`` sizes.

    Each round clamps the sources that are above their caps at the level so far, which only rises; it ends when a round
    clamps no further source.
    """
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, clamped = total / weight, -1
    while True:
        over = F.lit(level) * F.col("weight") > F.lit(epochs) * F.col("size")
        n, capped, open_weight = sources.agg(F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, F.lit(epochs) * F.col("size"))), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == clamped or not open_weight:
            return level
        level, clamped = (total - capped) / open_weight, n


def source_targets(rows: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3) -> DataFrame:
    """(nameless, source, source_size, target): a row per source of ``rows`` (nameless, source, size), with its words in the mix.

    Weights go to the sources in order of code points, the nameless one last, over and over.
    """
    found = rows.groupBy("nameless", "source").agg(F.sum("size").alias("size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    sources = stage(_placed(found, "nameless", "source").select("nameless", "source", "size", weight.cast("long").alias("weight")), "sources")
    share, cap = F.lit(water_level(sources, epochs)) * F.col("weight"), F.lit(epochs) * F.col("size")
    return sources.select("nameless", "source", F.col("size").alias("source_size"), F.when(share > cap, cap.cast("double")).otherwise(share).alias("target"))


def _by_source(rows: DataFrame, table: DataFrame, few: bool, *more: str, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if few else table, ["nameless", "source", *more], how)


def _open_ends(rows: DataFrame, ends: DataFrame, few: bool) -> DataFrame:
    """(nameless, source, prefix, need): of each source the shortest digits in steps of DIGITS that single out few documents around the end.

    ``ends`` (nameless, source, need): the words that the fractional repetition takes. ``need`` of the result: those that it
    takes from documents whose hash begins with ``prefix``; documents of smaller digits are taken whole, those of larger
    ones not at all.
    """
    done, open_, at = None, ends.withColumn("prefix", F.lit("")), 0
    while True:
        at += DIGITS
        inside = _by_source(rows, open_, few).where(F.substring("u", 1, at - DIGITS) == F.col("prefix")) if at > DIGITS else _by_source(rows, open_, few)
        sums = inside.groupBy("nameless", "source", "need", F.substring("u", 1, at).alias("next")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        before = F.sum("words").over(Window.partitionBy("nameless", "source").orderBy("next")) - F.col("words")  # 16^DIGITS rows at most
        sums = sums.withColumn("before", before).where("before < need and need <= before + words")
        level = stage(sums.select("nameless", "source", F.col("next").alias("prefix"), (F.col("need") - F.col("before")).alias("need"), "docs"), "ends")
        ready = level if at + DIGITS > 32 else level.where(F.col("docs") <= FEW)
        done = ready if done is None else done.unionByName(ready)
        open_ = level.where(F.col("docs") > FEW).drop("docs")
        if at + DIGITS > 32 or not open_.limit(1).count():
            return done.drop("docs")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """A row per row of ``docs``: (id, size, source_size, target, taken), the words of the row, of its source, those that its source
    gives to the mix, and those that the row gives, repetitions counted. Taken words of a source come to its target, rounded down.
    """
    u = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    source = F.col(source_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), source.isNull().alias("nameless"), F.coalesce(source, F.lit("")).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"), u.alias("u"))
    rows = stage(rows, "mixed")  # counted once
    targets = stage(source_targets(rows, weights, epochs), "targets")
    held = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source")), F.lit(0))).first()
    few = held[0] <= FEW_SOURCES and held[1] <= FEW_BYTES
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("need", F.greatest(F.floor("target").cast("long") - F.col("whole") * F.col("source_size"), F.lit(0)))
    ends = _open_ends(rows.where("size > 0"), targets.where("need > 0").select("nameless", "source", "need"), few)
    targets = targets.drop("need").join(ends, ["nameless", "source"], "left")
    met = _by_source(rows, targets, few)
    lead = F.substring(F.col("u"), F.lit(1), F.length("prefix"))
    near = F.coalesce((lead == F.col("prefix")) & (F.col("size") > 0), F.lit(False))
    far = met.where(~near).withColumn("extra", F.when(lead < F.col("prefix"), F.col("size")).otherwise(F.lit(0)))
    before = F.sum("size").over(Window.partitionBy("nameless", "source").orderBy("u", "id", "size").rowsBetween(Window.unboundedPreceding, -1))
    edge = met.where(near).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), F.col("need") - F.coalesce(before, F.lit(0)))))
    out = far.unionByName(edge)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), epochs: int = 3, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` once for each repetition, all columns, the text of a cut one its first words, joined by spaces.

    Ids are to be unique here: a row that repeats would be repeated for each.
    """
    plan = mix(docs, weights, epochs, seed, id_col, text_col, source_col)
    key, taken, size, times = (fresh(docs, n) for n in ("key", "taken", "size", "times"))
    plan = plan.where("taken > 0").select(F.col(id_col).alias(key), F.col("taken").alias(taken), F.col("size").alias(size))
    met = docs.join(plan, F.col(id_col).eqNullSafe(F.col(key))).withColumn(times, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    left = (F.col(taken) - (F.col(times) - 1) * F.col(size)).cast("int")
    cut = F.when(left >= F.col(size), F.col(text_col)).otherwise(F.array_join(F.slice(words(F.col(text_col)), F.lit(1), left), " "))
    return met.withColumn(text_col, cut).select(*docs.columns)
