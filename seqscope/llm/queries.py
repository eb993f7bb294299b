"""The queries of the subpackage's operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embeddings, fuzzy, html_text, mixing, packing, quality, secrets, simhash, tokens, warc
from .common import table


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all embeddings. Vectors that can't be compared (null, zero, not finite) or have no label link with nothing; copies link; an empty table gives no row."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents. A null text counts as empty; equal rows give equal rows; an empty table gives no row."""
    return secrets.report(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents. A null text counts as empty; equal rows give equal rows; an empty table gives no row."""
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents. A null or empty text is one piece, the end's id; equal rows are pieces of their own; an empty table gives no row."""
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents. A null or empty text has the prior's score; equal rows give equal rows; an empty table gives no row."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    rows = docs.select("doc_id", "text", quality.held_out().alias("held_out"))
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages. A null html counts as empty and gives an empty text; equal rows give equal rows; an empty table gives no row."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written and read. A null html counts as empty; rows equal in all are all responses; an empty table gives no row."""
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents. Texts without words have fingerprint zero; equal rows give equal rows; an empty table gives no row."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents. Null or empty texts have size 0 and are taken 0 times; equal rows are documents of their own; an empty table gives no row."""
    per_doc, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return per_doc.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken")


def op10_fuzzy_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. A null text counts as empty; ties of doc_id go by the text's hash; an empty table gives no row."""
    return fuzzy.fingerprints(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup,
        op2_secret_scan,
        op3_token_counts,
        op4_best_fit_packing,
        op5_quality,
        op6_html_extraction,
        op7_warc,
        op8_simhash,
        op9_mixing,
        op10_fuzzy_fingerprints,
    )
}

SQL: dict[str, str] = {
    "op1_embedding_near_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        ), usable AS (
            SELECT * FROM v
            WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(e, lambda x: x <> 0)) > 0
        ), links AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
        ), reach AS (
            SELECT a AS node, b AS other FROM links
            UNION
            SELECT r.node, l.b FROM reach r JOIN links l ON r.other = l.a
        ), least AS (
            SELECT node, min(other) AS m FROM reach GROUP BY node
        ), counts AS (
            SELECT a, count(*) AS n FROM links GROUP BY a
        )
        SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(l.m, v.vec_id)) AS component_id,
               v.vec_id = least(v.vec_id, coalesce(l.m, v.vec_id)) AS kept
        FROM v LEFT JOIN counts c ON v.vec_id = c.a LEFT JOIN least l ON v.vec_id = l.node
    """,
    "op7_warc": """
        WITH p AS (
            SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
        ), d AS (
            SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM p
        ), e AS (
            SELECT page_id, payload_bytes,
                   array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
                     + 16 * CAST(substr(bits, CAST(5 * i + 1 AS BIGINT), 1) AS INT) + 8 * CAST(substr(bits, CAST(5 * i + 2 AS BIGINT), 1) AS INT) + 4 * CAST(substr(bits, CAST(5 * i + 3 AS BIGINT), 1) AS INT)
                     + 2 * CAST(substr(bits, CAST(5 * i + 4 AS BIGINT), 1) AS INT) + CAST(substr(bits, CAST(5 * i + 5 AS BIGINT), 1) AS INT) AS BIGINT), 1)), '') AS payload_digest
            FROM d
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS response FROM e
        )
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> response THEN response END AS refers_to
        FROM f
    """,
}
