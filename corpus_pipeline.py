"""From raw documents to training tokens: five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from piecewright.llm import common
from piecewright.llm.decontaminate import contamination
from piecewright.llm.lattice import lattice_encode
from piecewright.llm.lines import line_dedup
from piecewright.llm.queries import VOCABULARY
from piecewright.llm.simhash import simhash_components
from piecewright.llm.toxicity import train, without_toxic
from piecewright.sources.model import load


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar's score rejects go. The labels of sf_dir train it; null and empty texts stay, rows that
    repeat an id are each judged by their own text, and other columns stay, whatever their names."""
    common.prepare(spark)
    return without_toxic(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for the largest id's; n_chars is counted anew where docs has it. A document may be left
    empty, and stays. Rows that repeat an id are one document, rows with a null id lose every repeated line; other
    columns stay, whatever their names."""
    out = line_dedup(docs, counts=None)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by fingerprints, the smallest id stays. Rows that repeat an id stay or go together; rows
    with a null id stay, and other columns, whatever their names."""
    groups = simhash_components(docs)
    gone = groups.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone"))
    return common.without_ids(docs, gone)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go in which an item of sf_dir's benchmark occurs; rows with a null id stay. Rows that repeat an id go if
    one of them has an item."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return common.without_ids(docs, found.select(F.col("doc_id").alias("gone")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): each document's piece ids, and the text that they decode to; null and empty texts
    have no ids. A row for each row, also of repeated and null ids; other columns aren't kept."""
    done = lattice_encode(docs, load(VOCABULARY))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text"))


STAGES = [("toxicity", toxicity), ("line dedup", dedup_lines), ("SimHash near-dedup", dedup_documents), ("benchmark decontamination", decontaminate), ("SentencePiece encoding", encode)]

#: SQL can express neither the learned grammar nor XXH64 fingerprints; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is a table in the shared folder, which the next one reads and which
    goes when that one's result is written."""
    docs, before = common.documents(spark, sf_dir), None
    for _, stage in STAGES[:-1]:
        docs, path = common.written(stage(spark, docs, sf_dir), "stage")
        if before:
            common.drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
