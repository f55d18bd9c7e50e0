"""Encoding of streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.analytics import line_stats, totals
from ..sources.model import Model
from ..sources.text import without_return


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(line) of text files as they arrive, cut as read_lines cuts them."""
    reader = spark.readStream.format("text").option("lineSep", "\n")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select(without_return(F.col("value")).alias("line"))


def stream_stats(lines: DataFrame, model: Model) -> DataFrame:
    """Each line's token count and preview; stateless, for append mode."""
    return line_stats(lines, model)


def stream_totals(lines: DataFrame, model: Model) -> DataFrame:
    """Lines, tokens and their ratio so far, for complete or update mode; the state is one row."""
    return totals(line_stats(lines, model))
