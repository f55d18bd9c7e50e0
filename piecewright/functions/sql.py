"""The operators as SQL functions of a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..sources.model import Model
from .encoder import Encoder, encoder_function


def register(spark: SparkSession, model: Model, name: str = "sp") -> None:
    """Registers <name>_encode(text) -> struct<ids, pieces> and the table function <name>_tokenize(text) -> (pos, id,
    piece), for LATERAL, and the views <name>_vocab and <name>_config."""
    spark.udf.register(f"{name}_encode", encoder_function(spark, model))
    sent = spark.sparkContext.broadcast(model)

    @udtf(returnType="pos int, id int, piece string", useArrow=True)
    class Tokenize:
        def __init__(self):
            self.encoder = Encoder(sent.value)

        def eval(self, text: str) -> Iterator[tuple[int, int, str]]:
            for pos, (i, piece) in enumerate(self.encoder(text) if text is not None else ()):
                yield pos, i, piece

    spark.udtf.register(f"{name}_tokenize", Tokenize)
    model.vocab(spark).createOrReplaceTempView(f"{name}_vocab")
    model.config(spark).createOrReplaceTempView(f"{name}_config")
