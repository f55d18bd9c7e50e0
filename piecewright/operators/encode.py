"""Encoding as DataFrame operators."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoder import batch_function, encoder_function
from ..functions.normalize import Normalizer, normalize
from ..functions.pretokenize import added_segments_column, metaspace_column, whitespace_metaspace_column
from ..sources.model import METASPACE, SPLIT_METASPACE, Model


def encode(df: DataFrame, model: Model, text_col: str = "text", into: str = "encoded", cut: bool = False, pieces: bool = True) -> DataFrame:
    """df with a column of struct<ids, pieces>. Nothing is shuffled: each worker segments a word once and remembers it.
    pieces=False leaves the pieces null and sends the ids alone back from Python.

    Null text gives null; empty text, and white space that normalizes away, give empty arrays.
    """
    return df.withColumn(into, encoder_function(df.sparkSession, model, cut, pieces)(F.col(text_col)))


def tokens(df: DataFrame, model: Model, text_col: str = "text", cut: bool = False) -> DataFrame:
    """df's other columns with (pos, id, piece), a row for each token of each text, pos from 0."""
    rest = [c for c in df.columns if c != text_col]
    made = encode(df, model, text_col, "_encoded", cut)
    return made.select(*rest, F.posexplode(F.arrays_zip("_encoded.ids", "_encoded.pieces")).alias("pos", "t")).select(*rest, "pos", F.col("t.ids").alias("id"), F.col("t.pieces").alias("piece"))


def encode_batches(df: DataFrame, model: Model, texts_col: str, into: str = "encoded", cut: bool = False) -> DataFrame:
    """df with array<array<int>> for a column of text arrays, in order. Null texts have null ids."""
    return df.withColumn(into, batch_function(df.sparkSession, model, cut)(F.col(texts_col)))


def normalized(df: DataFrame, model: Model, text_col: str = "text", into: str = "normalized") -> DataFrame:
    """df with the normalized text: as an expression, or by a kernel if the model has a character map."""
    if not model.charsmap:
        return df.withColumn(into, normalize(F.col(text_col), model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces))
    sent = df.sparkSession.sparkContext.broadcast(model)
    return df.withColumn(into, charsmap_function(sent)(F.col(text_col)))


def charsmap_function(sent):
    """A model's normalization of a text column."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        one = Normalizer(sent.value)
        return pa.array([None if t is None else one(t) for t in texts.to_pylist()], pa.string())

    return run


def charsmap_array_function(sent):
    """A model's normalization of an array of texts."""

    @F.arrow_udf("array<string>")
    def run(rows: pa.Array) -> pa.Array:
        one = Normalizer(sent.value)
        return pa.array([None if r is None else [None if t is None else one(t) for t in r] for r in rows.to_pylist()], pa.list_(pa.string()))

    return run


def segments(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """df's other columns with (seg_pos, segment, added_id): added tokens found in the raw text, and what the
    pre-tokenizer makes of the texts between them, numbered from 0 within each row."""
    rest = [c for c in df.columns if c != text_col]
    if model.charsmap:
        parts = df.select(*rest, added_segments_column(F.col(text_col), model).alias("_parts"))
        sent = df.sparkSession.sparkContext.broadcast(model)
        parts = parts.withColumn("_own", charsmap_array_function(sent)(F.col("_parts.segment")))
        flat = F.flatten(F.zip_with("_parts", "_own", lambda part, own: _pieces(part, own, model)))
    else:
        parts, flat = df, segments_column(F.col(text_col), model)
    return parts.select(*rest, F.posexplode(flat).alias("seg_pos", "s")).select(*rest, "seg_pos", "s.segment", "s.added_id")


def segments_column(text: Column, model: Model) -> Column:
    """array<struct<segment, added_id>> of a text, as an expression: what segments() has a row for each of. For models
    without a character map."""
    if model.charsmap:
        raise ValueError("a character map is not an expression; use segments()")
    own = lambda p: normalize(p["segment"], model.add_dummy_prefix, model.remove_extra_whitespaces, model.escape_whitespaces)
    return F.flatten(F.transform(added_segments_column(text, model), lambda p: _pieces(p, own(p), model)))


def _pieces(part: Column, own: Column, model: Model) -> Column:
    """The segments of a part of a text, given the part's normalized text."""
    cut = {METASPACE: metaspace_column, SPLIT_METASPACE: whitespace_metaspace_column}.get(model.pre_tokenizer, F.array)
    none = F.lit(None).cast("int")
    regular = F.transform(cut(own), lambda s: F.struct(s.alias("segment"), none.alias("added_id")))
    return F.when(part["added_id"].isNotNull(), F.array(part)).otherwise(F.filter(regular, lambda s: s["segment"] != ""))


def merge_unknown(token_rows: DataFrame, unk_id: int, *keys: str) -> DataFrame:
    """Token rows (keys, pos, id, piece) with runs of the unknown id as one row, their pieces joined, pos from 0."""
    order = Window.partitionBy(*keys).orderBy("pos")
    marked = token_rows.withColumn("_new", F.when((F.col("id") == unk_id) & (F.lag("id").over(order) == unk_id), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda x: x["piece"]), "")
    return runs.groupBy(*keys, "_run").agg(F.first("id").alias("id"), joined.alias("piece")).select(*keys, (F.col("_run") - 1).cast("int").alias("pos"), "id", "piece")
