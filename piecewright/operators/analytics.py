"""Corpus statistics over encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoder import encoder_function
from ..sources.model import Model


def preview(line: Column, size: int = 50) -> Column:
    """A line's first bytes, with dots if it has more; a character cut in two shows as U+FFFD."""
    raw = line.cast("binary")
    return F.when(F.octet_length(line) > size, F.concat(F.make_valid_utf8(F.substring(raw, 1, size).cast("string")), F.lit("..."))).otherwise(line)


def line_stats(lines: DataFrame, model: Model, text_col: str = "line", cut: bool = False) -> DataFrame:
    """lines with n_tokens and preview."""
    encode = encoder_function(lines.sparkSession, model, cut, pieces=False)
    return lines.withColumn("n_tokens", F.size(encode(F.col(text_col))["ids"]).cast("long")).withColumn("preview", preview(F.col(text_col)))


def running_totals(stats: DataFrame, group: str, *order: str) -> DataFrame:
    """line_stats with the lines and tokens so far within each group."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return stats.withColumn("lines_so_far", F.count(F.lit(1)).over(upto)).withColumn("tokens_so_far", F.sum("n_tokens").over(upto))


def totals(stats: DataFrame, *by: str) -> DataFrame:
    """Lines, tokens and tokens per line, in all or by columns."""
    return stats.groupBy(*by).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.avg("n_tokens"), F.lit(0.0)).alias("tokens_per_line"))


def jaccard(a: Column, b: Column) -> dict[str, Column]:
    """Shared and joint numbers of distinct ids of two arrays, and their ratio, NaN for two empty ones."""
    shared, joint = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    ratio = F.when(joint == 0, F.lit(float("nan"))).otherwise(shared / F.greatest(joint, F.lit(1)))
    return {"shared_ids": shared.cast("long"), "union_ids": joint.cast("long"), "jaccard": ratio}


def compare(df: DataFrame, first: Model, second: Model, text_col: str = "text") -> DataFrame:
    """df with the number of tokens by either model and which uses fewer."""
    spark = df.sparkSession
    a, b = (encoder_function(spark, m, pieces=False) for m in (first, second))
    out = df.withColumn("tokens_first", F.size(a(F.col(text_col))["ids"]).cast("long")).withColumn("tokens_second", F.size(b(F.col(text_col))["ids"]).cast("long"))
    diff = F.col("tokens_first") - F.col("tokens_second")
    return out.withColumn("difference", diff).withColumn("fewer", F.when(diff > 0, "second").when(diff < 0, "first").otherwise("same"))
