"""Filter interaction audit: what each filter of a chain removes in every order of the chain, by a subset-zeta transform.

Each row is given a mask of the filters that it fails. Masks are counted by part (a value of one column), so a part comes
down to 2^k counts for k filters; the zeta transform adds to each set of filters the counts of all its subsets. A row
survives the filters S if its mask holds none of S, so the survivors of S are the transformed count of the complement, and
a step of an order is the difference between two neighbouring sets. Nothing is counted once more for any of the k! orders.

One filter may look at the whole table: a row fails it if a row with a smaller id has the same text. Equal texts share all
other verdicts, so rows of a text are summed by part and marks first and compared afterwards: a text that a third of the
rows share is a few counts by then. Only ids, digests and masks are shuffled, never texts.

Nulls: a null text is empty; a null part is the empty string; a null id neither repeats a row nor is repeated; a label that
is null or missing counts as not given; of an id labelled twice, any label that is given counts. Rows that repeat in full
have one id, so neither is the smaller: they do not fail as repeats of one another. Very long texts are measured whole. An
empty table has no part, hence no rows. Columns of any other name are not looked at.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What parts words.
SPACE = r"[\x20\x09-\x0D]+"
#: More filters than this would give more orders than a report is for.
MOST_FILTERS = 7


def quality_filters(text: str = "text") -> dict[str, str]:
    """Failure conditions by letter, as SQL over ``text``: few words, repeated words, capitals, signs of markup."""
    words = f"array_remove(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"
    return {
        "A": f"size({words}) < 200",
        "B": f"100 * size(array_distinct({words})) < 50 * size({words})",
        "C": f"100 * length(regexp_replace({text}, '[^A-Z]+', '')) > 3 * length({text})",
        "D": f"{text} rlike '[#$%&*|]'",
    }


def failure_masks(docs: DataFrame, filters: dict[str, str], id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(id, part, digest, mask): bit i of the mask is set if the row fails the i-th filter. The filters see a column ``text``."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(filters.values())]
    return base.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits[1:], bits[0]).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, repeat_bit: int, id_col: str = "doc_id", good: str = "quality", bad: str = "toxic") -> DataFrame:
    """(part, mask, n, good, toxic): rows by mask, with ``repeat_bit`` set in those that repeat the text of a smaller id."""
    marks = labels.groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.max(F.col(good) == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col(bad) == 1), F.lit(False)).alias("toxic"))
    met = masks.join(marks, "id", "left").select("id", "part", "digest", "mask", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))
    kind = ["digest", "part", "mask", "good", "toxic"]
    by_id = met.groupBy("id", *kind).agg(F.count("*").alias("n"))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "n"))
    by_text = by_id.groupBy(*kind).agg(F.sum("n").alias("n"), F.min(named).alias("first"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"))
    least = F.min("first.id").over(Window.partitionBy("digest"))  # a text has one row here for each part and pair of marks
    fails = F.col("n") - F.col("nameless") - F.when(F.col("first.id") == least, F.col("first.n")).otherwise(0)
    split = by_text.withColumn("fails", fails).withColumn(
        "each", F.array(F.struct(F.col("mask").alias("m"), (F.col("n") - F.col("fails")).alias("k")), F.struct(F.col("mask").bitwiseOR(repeat_bit).alias("m"), F.col("fails").alias("k")))
    )
    each = split.select("part", "good", "toxic", F.explode("each").alias("e")).select("part", F.col("e.m").alias("mask"), F.col("e.k").alias("n"), "good", "toxic")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return each.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def zeta(counts: Column, bits: int) -> Column:
    """Subset-zeta transform of an array over 2^bits masks: entry m becomes the sum of the entries at all subsets of m."""

    def add_bit(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.get(sums, m - bit)).otherwise(F.lit(0)))

    return F.aggregate(F.array(*(F.lit(1 << b) for b in range(bits))), counts, add_bit)


def interactions(counts: DataFrame, names: str) -> DataFrame:
    """A row per part, order of the filters and step, from counts by mask.

    ``kept``, ``removed``: rows after the step and those that it takes. ``redundant``: failing its filter but gone before.
    ``unique_fails``: failing its filter alone. ``good_lost``, ``toxic_lost``: of those removed. ``shapley``: what its filter
    removes, summed over all orders.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS or len(set(names)) != k:
        raise ValueError(f"1 to {MOST_FILTERS} filters of different letters, not {names!r}")
    full = (1 << k) - 1
    kinds = ("n", "good", "toxic")
    held = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*kinds)))).alias("by"))  # 2^k entries at most
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(full)), lambda m: F.coalesce(F.element_at(F.col("by"), m)[c], F.lit(0)).cast("long"))
    sums = held.select("part", *(zeta(dense(c), k).alias(c) for c in kinds))
    orders = F.split(F.lit(",".join(map("".join, permutations(names)))), ",")
    rows = sums.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    bit = lambda at: F.element_at(F.array(*(F.lit(1 << b) for b in range(k))), F.instr(F.lit(names), F.substring("filter_order", at, F.lit(1))))
    before = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0), lambda acc, at: acc + F.when(at < F.col("step"), bit(at)).otherwise(F.lit(0)))
    rows = rows.withColumn("bit", bit(F.col("step"))).withColumn("open", F.lit(full) - before)
    at = lambda c, m: F.get(F.col(c), m)
    taken = lambda c, left: at(c, left) - at(c, left - F.col("bit"))
    # a set S of filters stands before a given one in |S|! (k-1-|S|)! of the orders
    times = F.array(*(F.lit(factorial(b) * factorial(max(0, k - 1 - b))).cast("long") for b in range(k + 1)))
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(full)), F.lit(0).cast("long"),
        lambda acc, s: acc + F.when(s.bitwiseAND(F.col("bit")) == 0, F.get(times, F.bit_count(s)) * taken("n", F.lit(full) - s)).otherwise(F.lit(0)),
    )
    removed = taken("n", F.col("open"))
    return rows.select(
        "part", "filter_order", "step", at("n", F.col("open") - F.col("bit")).alias("kept"), removed.alias("removed"), (taken("n", F.lit(full)) - removed).alias("redundant"),
        (at("n", F.col("bit")) - at("n", F.lit(0))).alias("unique_fails"), taken("good", F.col("open")).alias("good_lost"), taken("toxic", F.col("open")).alias("toxic_lost"), shapley.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, repeats: str = "E", id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The interactions of ``filters`` (failure conditions by letter) and of ``repeats``, the letter of the table-wide filter."""
    filters = quality_filters() if filters is None else filters
    counts = mask_counts(failure_masks(docs, filters, id_col, text_col, part_col), labels, 1 << len(filters), id_col)
    return interactions(counts, "".join(filters) + repeats)
