"""The registered queries of this subpackage, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readloom.llm.common import load
from readloom.llm.decontaminate import contained_items
from readloom.llm.exact_dedup import exact_groups
from readloom.llm.html_text import extract_text
from readloom.llm.lm_score import lm_scores
from readloom.llm.mixing import mixed
from readloom.llm.quality import quality_scores
from readloom.llm.simhash import hex_fingerprint, near_duplicates
from readloom.llm.tokens import token_round_trip
from readloom.llm.url_filter import judge_urls
from readloom.llm.warc import archive_round_trip

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary lies: READLOOM_TOKENIZERS, else the installed package of vocabulary files."""
    if folder := os.environ.get("READLOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint("fp").alias("fingerprint"), "component_id")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_round_trip(load(spark, sf_dir, "documents"), tokenizer_path(), END_ID)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(load(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(load(spark, sf_dir, "pages"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixed(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(load(spark, sf_dir, "pages"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(load(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(load(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_tokens, op3_exact_dedup, op4_url_filter, op5_quality, op6_mixing, op7_html_text, op8_lm_score,
        op9_decontaminate, op10_warc, pipeline,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        g AS (
            SELECT doc_id, norm,
                first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY norm) AS group_size
            FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g""",
    "op6_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS draw
            FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::DOUBLE AS weight,
                sum(source_size) OVER ()::DOUBLE AS total
            FROM s),
        -- with the sources of a ratio up to x full, the others reach this level
        l AS (
            SELECT a.source_size * 3.0 / a.weight AS ratio,
                (any_value(a.total) - sum(CASE WHEN b.source_size * 3.0 / b.weight <= a.source_size * 3.0 / a.weight THEN b.source_size * 3.0 ELSE 0 END))
                / nullif(sum(CASE WHEN b.source_size * 3.0 / b.weight > a.source_size * 3.0 / a.weight THEN b.weight ELSE 0 END), 0) AS level,
                min(CASE WHEN b.source_size * 3.0 / b.weight > a.source_size * 3.0 / a.weight THEN b.source_size * 3.0 / b.weight END) AS next_ratio
            FROM w a, w b GROUP BY a.source, a.source_size, a.weight),
        v AS (
            SELECT CASE WHEN (SELECT any_value(total) / sum(weight) FROM w) <= (SELECT min(ratio) FROM l)
                THEN (SELECT any_value(total) / sum(weight) FROM w)
                ELSE (SELECT min(level) FROM l WHERE level >= ratio AND level <= next_ratio) END AS level),
        p AS (SELECT source, source_size, least(source_size * 3.0, coalesce(v.level * weight, source_size * 3.0))::DOUBLE AS target FROM w, v),
        r AS (
            SELECT d.*, p.source_size, p.target, floor(CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END)::BIGINT AS whole,
                sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
            FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
            (size * (whole + CASE WHEN upto - size / 2 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM r""",
    "op9_decontaminate": r"""
        WITH words AS (
            SELECT 'd' AS kind, doc_id AS id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
            UNION ALL
            SELECT 'i', item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\x{80}-\x{10FFFF}]+', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark),
        shingles AS (
            SELECT DISTINCT kind, id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
            FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
        n AS (SELECT id, count(*) AS n_shingles FROM shingles WHERE kind = 'i' GROUP BY id)
        SELECT d.id AS doc_id, i.id AS item_id, count(*)::DOUBLE / any_value(n_shingles) AS containment, any_value(n_shingles)::BIGINT AS n_shingles
        FROM shingles i JOIN shingles d ON d.s = i.s AND d.kind = 'd' JOIN n ON n.id = i.id
        WHERE i.kind = 'i' GROUP BY d.id, i.id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9""",
}
