"""Personal data: candidate spans, boosted trees and calibrated thresholds, in DataFrame functions only.

Strict rules (format and checksum) give the base spans, which always stay. Generators of high recall propose further,
overlapping spans: any run with an @, any long run of digits and separators. Each is described by bits for its format
and its context (neighbouring characters, words before it). Boosted trees learn from all candidates of the input which
of them look like those that the strict rules accept; the bits do not hold the rules' own checks, so what nearly passes
in the same surroundings scores high too. A threshold for each kind of candidate is calibrated on the same counts, and
candidates above it that touch no base span are added.

The trees are fitted on counts by (kind, bits, label), at most 2 x 2^14 x 2 rows however long the input; everything else
stays on the executors. Nulls count as empty texts. Rows may repeat; extra columns are ignored; an empty table is fine.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, stage

# The base kinds in order. Written so that no attempt backtracks over a long run; they match what the
# plain patterns (see the tests) match. A local part may start right after the match before it, hence \G.
BASE = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    ("card", r"[0-9](?:[\x20-]?[0-9]){13,}+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
CANDIDATES = (
    ("contact", r"[^\s@]{1,80}+@[^\s@]{1,80}+", "@"),
    ("number", r"[+(]?[0-9](?:[\x20().-]{0,2}+[0-9]){6,}+", r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"),
)
ROUNDS, RATE, PRECISION, LEAST_PROBABILITY = 24, 0.3, 0.9, 0.5
FEATURES = 14
#: Matches of a text whose lengths are summed as one run.
RUN = 128


def _pieces(text: Column, pattern: str, guard: str) -> tuple[Column, Column]:
    """Matches, and the text between them; nothing where the cheap guard finds nothing."""
    has = F.instr(text, guard) > 0 if guard == "@" else text.rlike(guard)
    empty = F.array().cast("array<string>")
    return F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(empty), F.when(has, F.split(text, pattern, -1)).otherwise(empty)


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _count_up(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, b: a + b)


def _placed(matches: Column, gaps: Column) -> Column:
    """array<struct<start, end, found>> in code points.

    Where a match starts is the sum of the lengths before it: of whole runs of ``RUN`` matches and of those in its own
    run, so that the work stays near linear in the matches of a text.
    """
    def place(both: Column) -> Column:
        def with_runs(sums: Column) -> Column:
            return _bound(F.transform(_count_up(F.size(sums)), lambda r: _sum(F.slice(sums, 1, r))), with_starts)

        def with_starts(before: Column) -> Column:
            def one(i: Column) -> Column:
                run = F.floor(i / RUN).cast("int")
                start = F.get(before, run) + _sum(F.slice(both["lengths"], run * RUN + 1, i - run * RUN)) + F.length(F.get(gaps, i))
                return F.struct(start.alias("start"), (start + F.length(F.get(matches, i))).alias("end"), F.get(matches, i).alias("found"))

            return F.transform(_count_up(F.size(matches)), one)

        runs = F.ceil(F.size(matches) / RUN).cast("int")
        return _bound(F.transform(_count_up(runs), lambda r: _sum(F.slice(both["lengths"], r * RUN + 1, F.lit(RUN)))), with_runs)

    lengths = F.transform(_count_up(F.size(matches)), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(matches, i)))
    none = F.array().cast("array<struct<start:int,end:int,found:string>>")
    return F.when(F.size(matches) > 0, _bound(F.struct(lengths.alias("lengths")), place)).otherwise(none)


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid check digit."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def _passes(kind: str, found: Column) -> Column:
    if kind == "ip":  # without leading zeros a part has at most three digits, and is at most 255
        parts = F.transform(F.split(found, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | (F.length(p) == 3) & (p <= "255"))
    n = F.length(_digits(found))
    if kind == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(found))).otherwise(F.lit(False))
    if kind == "phone":
        return (n >= 10) & (n <= 15)
    return F.lit(True)


def _bits(text: Column, x: Column) -> Column:
    """The feature bits of a candidate."""
    found, n = x["found"], F.length(_digits(x["found"]))
    start = F.greatest(x["start"] - 23, F.lit(1))
    before = F.lower(F.substring(text, start, x["start"] - start + 1))
    left = F.when(x["start"] > 0, F.substring(text, x["start"], F.lit(1))).otherwise(F.lit(""))
    right = F.substring(text, x["end"] + 1, F.lit(1))
    tests = (
        F.instr(found, "-") > 0, found.rlike(r"[0-9][^0-9]+[0-9]"), n >= 10, n >= 14, n > 19,
        left.rlike(r"[\p{L}\p{N}]"), right.rlike(r"[\p{L}\p{N}]"),
        before.rlike(r"\b(?:card|visa|amex|iban|account|konto|carte|tarjeta)"), before.rlike(r"\b(?:phone|tel|call|mobile|fax|handy)"), before.rlike(r"\b(?:ssn|social|passport|born|dob|mail|contact)"),
        F.instr(found, "(") > 0, found.rlike(r"@[^@]*\."), found.rlike(r"[0-9]"), before.rlike(r"[=:\"']\s*$"),
    )
    return reduce(lambda a, b: a + b, [F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)])


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, proposed) of every row: base spans by kind, and proposed spans with their bits and whether base has them."""
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    pieces = {k: _pieces(text, p, g) for k, p, g in (*BASE, *CANDIDATES)}
    out = out.select("id", "text", *[c.alias(f"{k}_{n}") for k, pair in pieces.items() for n, c in zip(("found", "gaps"), pair)])
    out = out.select("id", "text", *[_placed(F.col(f"{k}_found"), F.col(f"{k}_gaps")).alias(k) for k in pieces])
    spans = lambda k, o: F.transform(F.filter(F.col(k), lambda x: _passes(k, x["found"])), lambda x: F.struct(x["start"].alias("start"), F.lit(o).alias("place"), x["end"].alias("end"), F.lit(k).alias("kind")))
    out = out.select("id", "text", F.concat(*[spans(k, o) for o, (k, _, _) in enumerate(BASE)]).alias("base"), *[k for k, _, _ in CANDIDATES])

    def proposed(kind: str, place: int) -> Column:
        def row(x: Column) -> Column:
            same = F.exists("base", lambda b: (b["start"] == x["start"]) & (b["end"] == x["end"]))
            touch = F.exists("base", lambda b: (b["start"] < x["end"]) & (b["end"] > x["start"]))
            return F.struct(x["start"].alias("start"), F.lit(place).alias("place"), x["end"].alias("end"), F.lit(kind).alias("kind"), _bits(text, x).alias("bits"), same.alias("same"), touch.alias("touch"))

        return F.transform(F.col(kind), row)

    return out.select("id", "base", F.concat(*[proposed(k, len(BASE) + i) for i, (k, _, _) in enumerate(CANDIDATES)]).alias("proposed"))


def boost(counts: dict[tuple[int, bool], int], rounds: int = ROUNDS, rate: float = RATE) -> tuple[float, list[tuple[int, int, tuple]]]:
    """Gradient boosting for the logistic loss over counts by (bits, label): trees of depth two on single bits.

    Gives the start value and trees (bit, bit, values of the four leaves by 2 * first + second).
    """
    masks = sorted({b for b, _ in counts})
    yes = {b: counts.get((b, True), 0) for b in masks}
    total = {b: yes[b] + counts.get((b, False), 0) for b in masks}
    p = (sum(yes.values()) + 0.5) / (sum(total.values()) + 1)
    first, trees = math.log(p / (1 - p)), []
    score = dict.fromkeys(masks, first)
    for _ in range(rounds):
        best = None
        prob = {b: 1 / (1 + math.exp(-score[b])) for b in masks}
        for i in range(FEATURES):
            for j in range(i + 1, FEATURES):
                g, h = [0.0] * 4, [1.0] * 4
                for b in masks:
                    leaf = 2 * (b >> i & 1) + (b >> j & 1)
                    g[leaf] += yes[b] - total[b] * prob[b]
                    h[leaf] += total[b] * prob[b] * (1 - prob[b])
                gain = sum(x * x / y for x, y in zip(g, h))
                if best is None or gain > best[0] + 1e-12:
                    best = gain, i, j, tuple(rate * x / y for x, y in zip(g, h))
        if best is None:
            break
        trees.append(best[1:])
        for b in masks:
            score[b] += best[3][2 * (b >> best[1] & 1) + (b >> best[2] & 1)]
    return first, trees


def calibrate(counts: dict[tuple[int, bool], int], model: tuple[float, list], precision: float = PRECISION) -> float:
    """The lowest score at and above which candidates are base spans with at least that precision; infinite if none is."""
    scores: dict[float, list[int]] = {}
    for (bits, label), n in counts.items():
        s = scores.setdefault(round(model[0] + sum(t[2][2 * (bits >> t[0] & 1) + (bits >> t[1] & 1)] for t in model[1]), 9), [0, 0])
        s[0] += n * label
        s[1] += n
    yes = total = 0
    out = math.inf
    for score in sorted(scores, reverse=True):
        yes, total = yes + scores[score][0], total + scores[score][1]
        if score >= math.log(LEAST_PROBABILITY / (1 - LEAST_PROBABILITY)) and yes >= precision * total:
            out = score
    return out


def _score(model: tuple[float, list], bits: Column) -> Column:
    bit = lambda i: F.shiftright(bits, i).bitwiseAND(1)
    return reduce(lambda a, b: a + b, [F.element_at(F.array(*[F.lit(v) for v in leaves]), 2 * bit(i) + bit(j) + 1) for i, j, leaves in model[1]], F.lit(model[0]))


def _chosen(kind: str, model: tuple[float, list], least: float) -> Column:
    return F.filter("proposed", lambda x: (x["kind"] == kind) & ~x["touch"] & (F.round(_score(model, x["bits"]), 9) >= least))


def _count(kind: str) -> Column:
    return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, added) of every row: arrays of struct<start, place, end, kind>, code points, end exclusive."""
    found = stage(candidates(docs, id_col, text_col), "candidates")
    rows = found.select(F.explode("proposed").alias("x")).groupBy("x.kind", "x.bits", "x.same").count().collect()
    added = []
    for kind, _, _ in CANDIDATES:
        counts = {(r["bits"], r["same"]): r["count"] for r in rows if r["kind"] == kind}
        if counts:
            model = boost(counts)
            least = calibrate(counts, model)
            if least < math.inf:
                added.append(_chosen(kind, model, least))
    none = F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")
    plain = lambda a: F.transform(a, lambda x: F.struct(x["start"].alias("start"), x["place"].alias("place"), x["end"].alias("end"), x["kind"].alias("kind")))
    return found.select("id", "base", (plain(F.concat(*added)) if added else none).alias("added"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """``docs`` with personal data in the text replaced by its kind. Needs ids that differ from row to row."""
    own, held = fresh(docs, "id"), fresh(docs, "spans")
    spans = find_personal_data(docs, id_col, text_col).select(F.col("id").alias(own), F.array_sort(F.concat("base", "added")).alias(held))
    text = F.coalesce(F.col(text_col), F.lit(""))
    head, tail = mark.split("{}")

    def add(state: Column, x: Column) -> Column:
        new = F.concat(state["out"], F.substring(text, state["at"] + 1, x["start"] - state["at"]), F.lit(head), x["kind"], F.lit(tail))
        return F.when(x["start"] < state["at"], state).otherwise(F.struct(x["end"].alias("at"), new.alias("out")))

    done = F.aggregate(held, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return docs.join(spans, F.col(id_col).eqNullSafe(F.col(own))).withColumn(text_col, done).drop(own, held)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base spans and the list of all spans."""
    listed = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [_count(k) for k, _, _ in BASE]
    return found.select(F.col("id").alias(id_col), *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
