"""Looking up pieces and ids, and inspecting vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.model import Model

# How piece types are shown.
TYPE_NAMES = {1: "NORMAL", 2: "UNKNOWN", 3: "CONTROL", 4: "USER", 5: "UNUSED", 6: "BYTE"}


def type_name(kind: Column) -> Column:
    out = F.concat(F.lit("TYPE("), kind.cast("string"), F.lit(")"))
    for k, name in TYPE_NAMES.items():
        out = F.when(kind == k, F.lit(name)).otherwise(out)
    return out


def id_to_piece(df: DataFrame, model: Model, id_col: str = "id") -> DataFrame:
    """df with piece, '' for ids outside the vocabulary."""
    vocab = F.broadcast(model.vocab(df.sparkSession).select(F.col("id").alias("_id"), "piece"))
    return df.join(vocab, df[id_col] == F.col("_id"), "left").drop("_id").withColumn("piece", F.coalesce("piece", F.lit("")))


def get_piece(df: DataFrame, model: Model, id_col: str = "id") -> DataFrame:
    """df with piece, score and type; ids outside the vocabulary get '', 0 and 0."""
    vocab = F.broadcast(model.vocab(df.sparkSession).select(F.col("id").alias("_id"), "piece", "score", "type"))
    out = df.join(vocab, df[id_col] == F.col("_id"), "left").drop("_id")
    return out.withColumns({"piece": F.coalesce("piece", F.lit("")), "score": F.coalesce("score", F.lit(0.0).cast("float")), "type": F.coalesce("type", F.lit(0))})


def piece_to_id(df: DataFrame, model: Model, piece_col: str = "piece", into: str = "id") -> DataFrame:
    """df with the piece's id, the last of equal pieces, the unknown id for others."""
    vocab = model.vocab(df.sparkSession).groupBy(F.col("piece").alias("_piece")).agg(F.max("id").alias("_id"))
    return df.join(F.broadcast(vocab), df[piece_col] == F.col("_piece"), "left").withColumn(into, F.coalesce("_id", F.lit(model.unk_id))).drop("_piece", "_id")


def type_counts(spark: SparkSession, model: Model) -> DataFrame:
    return model.vocab(spark).groupBy(type_name(F.col("type")).alias("type_name")).agg(F.count(F.lit(1)).alias("pieces"))


def head_tail(spark: SparkSession, model: Model, n: int = 10) -> DataFrame:
    size = len(model.pieces)
    return model.vocab(spark).where((F.col("id") < n) | (F.col("id") >= size - n)).select("id", "piece", "score", type_name(F.col("type")).alias("type_name"))


def search(spark: SparkSession, model: Model, part: str, limit: int = 20) -> DataFrame:
    """The first pieces by id that contain a string."""
    return model.vocab(spark).where(F.contains(F.col("piece"), F.lit(part))).orderBy("id").limit(limit).select("id", "piece", "score", type_name(F.col("type")).alias("type_name"))
