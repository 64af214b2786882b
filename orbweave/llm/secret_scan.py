"""Secret scanning with an incremental ledger of blobs.

A text is a blob, named by its SHA-256. The ledger is a table with one row per (blob, rule version) that was ever
scanned, findings or not. A scan hashes all rows, drops blobs the ledger has under the current rules, scans each of the
others once, appends them to the ledger, and joins findings back to every row (path or historical version) with the
blob. Unchanged texts are never scanned again; a change of the rules changes their version and so scans all anew.

Nulls count as empty texts. Rows may repeat; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, shared_dir, short_batches

# The kinds, in order, with pattern, the group whose length counts, and its least length.
RULES = (
    ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,40}PRIVATE KEY-----)?", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("repo", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("cloud", r"AIza[A-Za-z0-9_-]{35}", 0, 39),
    ("url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,200}:[^\s:/@]{1,200}@", 0, 8),
)
BASE = ("assign", "access", "hex")
#: A text without any of these holds no match of the kind.
_NEEDS = {"assign": ":=", "access": ("AKIA",), "pem": ("PRIVATE KEY-----",), "jwt": ("eyJ",), "repo": ("gh",), "chat": ("xox",), "cloud": ("AIza",), "url": ("://",)}


def rule_version(rules=RULES) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def find_secrets(text: str, rules=RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by the order of kinds; leftmost and not overlapping within a kind."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(rules):
        needs = _NEEDS.get(kind)
        if needs and not any(x in text for x in needs):
            continue
        found += [(m.start(), order, kind, m.end()) for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]
    return [(kind, start, end) for start, _, kind, end in sorted(found)]


_FINDINGS = "rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    version = rule_version()
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            spans = find_secrets(text)
            listed = [f"{k}:{s}:{e}" for k, s, e in spans]
            base = ",".join(x for x, (k, _, _) in zip(listed, spans) if k in BASE)
            rows.append((version, *(sum(k == b for k, _, _ in spans) for b in BASE), hashlib.sha256(base.encode()).hexdigest(), ",".join(listed)))
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = list(zip(*rows)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["blob", "rule_version", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def read_ledger(docs: DataFrame, ledger: str) -> DataFrame:
    """The ledger's rows under the current rules; none if it was not begun."""
    spark = docs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
    schema = f"blob string, {_FINDINGS}"
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version()).dropDuplicates(["blob"])


def scan_documents(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Findings of every row: counts and digest of the base kinds, and all spans (code points, end exclusive).

    ``ledger`` is the folder of the ledger, kept from scan to scan; without it a fresh one is begun in the shared folder.
    A blob with a third of all rows is collapsed before the shuffle, and its findings reach its rows by broadcast.
    """
    spark = docs.sparkSession
    short_batches(spark)
    begun = ledger is not None
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    paths = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("blob", F.sha2("_text", 256))
    blobs = paths.select("blob", "_text").dropDuplicates(["blob"])
    if begun:
        blobs = blobs.join(read_ledger(docs, ledger).select("blob"), "blob", "left_anti")
    blobs.mapInArrow(_scan, f"blob string, {_FINDINGS}").write.mode("append").parquet(ledger)
    findings = read_ledger(docs, ledger) if begun else spark.read.schema(f"blob string, {_FINDINGS}").parquet(ledger)
    slim = paths.select("_id", "blob")
    hot = slim.groupBy("blob").count().orderBy(F.desc("count"), "blob").limit(256).select("blob")
    far = findings.join(F.broadcast(hot), "blob", "left_semi").select(F.col("blob").alias("_hot"), F.struct("n_assign", "n_access", "n_hex", "base_sha256", "spans").alias("_h"))
    near = findings.select(F.col("blob").alias("_cold"), F.struct("n_assign", "n_access", "n_hex", "base_sha256", "spans").alias("_c"))
    met = slim.join(F.broadcast(far), F.col("blob") == F.col("_hot"), "left")
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("blob")).otherwise(F.monotonically_increasing_id().cast("string")))
    met = met.join(near, F.col("_key") == F.col("_cold"), "left")
    value = lambda c: F.coalesce(F.col(f"_h.{c}"), F.col(f"_c.{c}")).alias(c)
    return met.select(F.col("_id").alias(id_col), *(value(c) for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")), "blob")


def redact_documents(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with every finding in the text replaced by its kind in brackets; all rows and columns stay.

    Of overlapping findings the union is replaced, under the kind that begins it. ``length_col``, where there is one,
    follows the text. Texts are joined with findings by blob, and only blobs with findings take part.
    """
    short_batches(docs.sparkSession)
    blob, held = fresh(docs, "blob"), fresh(docs, "spans")
    found = scan_documents(docs, ledger, id_col, text_col).where("spans <> ''").select(F.col("blob").alias(blob), F.col("spans").alias(held)).dropDuplicates([blob])
    met = docs.join(found, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == F.col(blob), "left").drop(blob)
    at = docs.columns.index(text_col)
    long_at = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, texts = batch.columns[:-1], batch.column(at).to_pylist()
            lengths = batch.column(long_at).to_pylist() if long_at is not None else []
            for i, spans in enumerate(batch.column(len(columns)).to_pylist()):
                if spans:
                    texts[i] = replace_spans(texts[i], spans)
                    if lengths:
                        lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if lengths:
                columns[long_at] = pa.array(lengths, columns[long_at].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return met.mapInArrow(run, docs.schema)


def replace_spans(text: str, spans: str) -> str:
    """The text with listed spans (kind:start:end, by start) replaced by [kind]."""
    out, at = [], 0
    for kind, start, end in (x.split(":") for x in spans.split(",")):
        if int(start) >= at:
            out += [text[at : int(start)], f"[{kind}]"]
        at = max(at, int(end))
    return "".join(out) + text[at:]
