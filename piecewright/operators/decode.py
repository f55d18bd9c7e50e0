"""Decoding: native expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.model import Model


def decode_tokens(token_rows: DataFrame, model: Model, *keys: str) -> DataFrame:
    """(keys, text, bytes) of token rows (keys, pos, id): each id's bytes in order, one leading space off if the model
    says so. Ids that the vocabulary lacks add nothing. Bytes that aren't UTF-8 become U+FFFD in text. The tokens of a key
    come together in one row, so a key should be a text."""
    vocab = F.broadcast(model.vocab(token_rows.sparkSession).select("id", "piece_bytes"))
    met = token_rows.join(vocab, "id", "left")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("piece_bytes", F.lit(b"")).alias("b")))), lambda x: x["b"])
    return _text(met.groupBy(*keys).agg(ordered.alias("_parts")), model, keys)


def decode(df: DataFrame, model: Model, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the text of an id array, each id looked up by its place, so that nothing is exploded or shuffled. Null
    ids give null."""
    return df.withColumn(into, decode_column(F.col(ids_col), model))


def decode_column(ids: Column, model: Model) -> Column:
    """The text of an id array, as one expression over the hexadecimal bytes of the whole vocabulary."""
    hexes = F.split(F.lit(",".join(model.bytes_of(i).hex() for i in range(len(model.pieces)))), ",")
    parts = F.transform(ids, lambda i: F.when((i >= 0) & (i < len(model.pieces)), F.get(hexes, i)).otherwise(""))
    raw = F.unhex(F.array_join(parts, ""))
    if model.strip_leading_space:
        raw = F.when(F.substring(raw, 1, 1) == F.lit(b" "), F.substring(raw, 2, 1 << 30)).otherwise(raw)
    return F.when(ids.isNotNull(), F.make_valid_utf8(raw.cast("string")))


def _text(df: DataFrame, model: Model, keys: tuple[str, ...]) -> DataFrame:
    raw = F.expr("aggregate(_parts, cast('' as binary), (a, b) -> concat(a, b))")
    out = df.select(*keys, raw.alias("bytes"))
    if model.strip_leading_space:
        out = out.withColumn("bytes", F.when(F.substring("bytes", 1, 1) == F.lit(b" "), F.substring("bytes", 2, 1 << 30)).otherwise(F.col("bytes")))
    return out.select(*keys, F.make_valid_utf8(F.col("bytes").cast("string")).alias("text"), "bytes")
