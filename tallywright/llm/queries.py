"""The queries opN_<name>: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallywright.llm import embed_index, fingerprint, mainhtml, minhash, mixing, packing, pii, quality, urlfilter, warc
from tallywright.llm.common import table


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all embeddings at cosine 0.95, by a pivot-permutation index."""
    return embed_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_pii_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and revealing words in all documents."""
    return pii.sanitised(table(spark, sf_dir, "documents")).drop("clean_text")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by a sparse rule ensemble."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived with revisits, and the archives read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages by consensus host paths."""
    return mainhtml.extracted(table(spark, sf_dir, "pages"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of all documents at similarity 0.75 of five-word shingles."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' shares in the mix of sources by weight."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls by Bloom filter cascades."""
    return urlfilter.judged(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_embedding_dedup, op2_pii_sanitise, op3_fingerprints, op4_best_fit_packing, op5_quality_rules, op6_warc_revisits,
        op7_html_consensus, op8_minhash_dedup, op9_mix_sources, op10_url_cascade,
    )
}

ORACLES: dict[str, str] = {
    "op6_warc_revisits": """
        WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
        d AS (SELECT page_id, url, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
        f AS (SELECT payload_digest AS g, min(page_id) AS o FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > o THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > o THEN o END AS refers_to, url
        FROM d LEFT JOIN f ON payload_digest = g""",
    "op9_mix_sources": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, CAST(CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS w FROM d GROUP BY source),
        -- Rounds of sharing: sources above their cap are clamped, the rest is shared again.
        fill AS (
            SELECT 0 AS round, list(struct_pack(source := source, n := n, w := w, capped := false)) AS state FROM s
            UNION ALL
            SELECT round + 1, list_transform(state, lambda x: struct_pack(source := x.source, n := x.n, w := x.w, capped := x.capped OR
                (CAST(list_sum(list_transform(state, lambda y: y.n)) - 3 * list_sum(list_transform(state, lambda y: CASE WHEN y.capped THEN y.n ELSE 0 END)) AS DOUBLE) * x.w > 3.0 * x.n * list_sum(list_transform(state, lambda y: CASE WHEN y.capped THEN 0 ELSE y.w END)))))
            FROM fill WHERE round < 30),
        last AS (SELECT unnest(state) AS x, CAST(list_sum(list_transform(state, lambda y: y.n)) - 3 * list_sum(list_transform(state, lambda y: CASE WHEN y.capped THEN y.n ELSE 0 END)) AS DOUBLE) AS rest,
            list_sum(list_transform(state, lambda y: CASE WHEN y.capped THEN 0 ELSE y.w END)) AS w_open FROM fill WHERE round = 30),
        t AS (SELECT x.source AS source, x.n AS source_size, CASE WHEN x.capped THEN CAST(3 * x.n AS DOUBLE) ELSE rest * x.w / w_open END AS target FROM last),
        g AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
        r AS (SELECT doc_id, size, source_size, target, whole, target - CAST(whole * source_size AS DOUBLE) AS rest,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN ahead + size / 2.0 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r""",
    "op10_url_cascade": r"""
        WITH u AS (SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
        r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        m AS (SELECT page_id, host, path, max(struct_pack(n := length(h || p), rule := h || p, verdict := verdict)) AS best
            FROM (SELECT p.page_id, p.host, p.path, r.h, r.p, r.verdict FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)) GROUP BY 1, 2, 3)
        SELECT p.page_id, p.host, p.path, m.best.rule AS rule, coalesce(m.best.verdict, 'allow') AS verdict
        FROM p LEFT JOIN (SELECT DISTINCT * FROM m) m ON p.page_id IS NOT DISTINCT FROM m.page_id AND p.host = m.host AND p.path = m.path""",
}
