"""Texts in and results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What one line of golden cases looks like.
GOLDEN = T.StructType([T.StructField("input", T.StringType()), T.StructField("pieces", T.ArrayType(T.StringType())), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType()), T.StructField("description", T.StringType())])


def without_return(line: Column) -> Column:
    """A line without one carriage return at its end."""
    return F.when(F.endswith(line, F.lit("\r")), F.substr(line, F.lit(1), F.length(line) - 1)).otherwise(line)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of text files. Lines end at line feeds alone; one carriage return before one doesn't count."""
    return spark.read.option("lineSep", "\n").text(path).select(without_return(F.col("value")).alias("line"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLDEN).json(path)


def explode_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df's other columns with (line_no, line), a row for each line of each text, as reading them line by line gives
    them: the line end and one carriage return before it don't count, and a last line end begins no line."""
    rest = [c for c in df.columns if c != text_col]
    lines = F.split(F.col(text_col), "\n")
    lines = F.when(F.endswith(F.col(text_col), F.lit("\n")), F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    lines = F.transform(lines, without_return)
    return df.where(F.col(text_col) != "").select(*rest, F.posexplode(lines).alias("line_no", "line"))


def write_tokens(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """Encodings as Parquet, partitioned if asked."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
