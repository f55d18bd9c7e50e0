"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A public vocabulary file, as all executors and the driver have it; a parameter of the operators.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op1_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(common.documents(spark, sf_dir))


def op2_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    path = common.new_folder(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payloads=False).drop("url")


def op3_passage_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(common.documents(spark, sf_dir))


def op4_license_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_scan

    return license_scan(common.documents(spark, sf_dir))


def op5_benchmark_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("match")


def op6_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .maxent import maxent_scores

    return maxent_scores(common.documents(spark, sf_dir))


def op7_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", "held_out", "score", "predicted", "matched_clauses")


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cws import fingerprint_neighbours

    return fingerprint_neighbours(common.documents(spark, sf_dir))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lines import line_dedup

    kept = line_dedup(common.documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op10_sentencepiece_lattice(spark: SparkSession, sf_dir: str, model_path: str = VOCABULARY) -> DataFrame:
    from ..sources.model import load
    from .lattice import lattice_encode

    done = lattice_encode(common.documents(spark, sf_dir), load(model_path))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_pigeonring": op1_simhash_pigeonring,
    "op2_warc_dictionary": op2_warc_dictionary,
    "op3_passage_bands": op3_passage_bands,
    "op4_license_compression": op4_license_compression,
    "op5_benchmark_edits": op5_benchmark_edits,
    "op6_maxent_scores": op6_maxent_scores,
    "op7_toxicity_grammar": op7_toxicity_grammar,
    "op8_weighted_sampling": op8_weighted_sampling,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece_lattice": op10_sentencepiece_lattice,
}

#: A-Z lower-cased, and the white space that the operators strip or split at, in DuckDB's SQL.
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
STRIP = r"regexp_replace({}, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

LINE_DEDUP_SQL = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM {{docs}}),
line AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM split),
keyed AS (SELECT *, {LOWER.format(STRIP.format('line'))} AS key FROM line),
repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id"""

ORACLE_SQL: dict[str, str] = {
    "op2_warc_dictionary": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= 100 GROUP BY html)
SELECT page_id, CAST(strlen(p.html) AS BIGINT) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html""",
    "op9_line_dedup": f"SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ({LINE_DEDUP_SQL.format(docs='documents')})",
}
