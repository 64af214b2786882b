"""Queries over the corpus tables, by name. Each applies its operator to the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attention_lm, block_naming, bpe, conversations, filter_audit, kd_sharding, mixing, oracles, packing, pii, rp_forest, secret_scan, simhash, toxicity
from .common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(table(spark, sf_dir, "documents")).drop("blob")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = kd_sharding.assign_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), VOCABULARY, ids=False)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, grammar)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), VOCABULARY, ids=False)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rp_forest.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.score_documents(table(spark, sf_dir, "documents"), VOCABULARY)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), epochs=3)


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    hurt = conversations.damaged(rows).withColumnRenamed("conv", "conv_id")
    return conversations.repair_report(hurt, ids=rows.select(F.col("conv_id").alias("conv")))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_exact_dedup, op3_sharding, op4_bpe, op5_pii, op6_toxicity, op7_packing, op8_simhash, op9_embeddings, op10_lm_scores, op11_filter_audit, op12_mixing, op13_conversations)}

def _secrets_sql() -> str:
    """Spans by cutting each text at its matches: a match starts after the pieces and matches before it."""
    any_case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join([*map(any_case, ("password", "passwd", "secret", "token")), any_case("api") + "_?" + any_case("key")])
    parts = []
    for order, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        pattern = pattern.replace("(?ai:(password|passwd|secret|token|api_?key))", f"({words})").replace("'", "''")
        size = f"length(regexp_extract(m, '{pattern}', {group}))" if group else "length(m)"
        parts.append(
            f"SELECT doc_id, {order} AS o, '{kind}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, unnest(ms) AS m, "
            f"unnest(list_transform(range(1, len(ms) + 1), lambda i: coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS s "
            f"FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM d)) WHERE {size} >= {least}"
        )
    count = lambda k: f"count(*) FILTER (kind = '{k}') AS n_{k}"
    listed = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({' UNION ALL '.join(parts)}) SELECT d.doc_id, {', '.join(map(count, secret_scan.BASE))}, "
        f"sha256(coalesce({listed} FILTER (o < 3), '')) AS base_sha256, coalesce({listed}, '') AS spans FROM d LEFT JOIN f ON d.doc_id = f.doc_id GROUP BY d.doc_id"
    )


ORACLE_SQL: dict[str, str] = {
    "op1_secrets": _secrets_sql(),
    "op2_exact_dedup": r"""WITH h AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k""",
    "op9_embeddings": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS r FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (a.r * b.r) >= 0.95),
w AS (SELECT * FROM (WITH RECURSIVE q AS (SELECT vec_id AS node, vec_id AS seen FROM v UNION SELECT q.node, l.b FROM q JOIN l ON l.a = q.seen) SELECT node, min(seen) AS component_id FROM q GROUP BY 1)),
c AS (SELECT a, count(*) AS k FROM l GROUP BY 1) SELECT w.node AS vec_id, coalesce(k, 0) AS n_links, component_id, node = component_id AS kept FROM w LEFT JOIN c ON c.a = w.node""",
    "op11_filter_audit": oracles.FILTER_AUDIT,
    "op12_mixing": oracles.MIXING,
    "op13_conversations": oracles.CONVERSATIONS,
}
