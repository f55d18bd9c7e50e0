"""Connected components of a table of links, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, file_rows: int | None = None) -> DataFrame:
    """(node, component): for each node of a link, the smallest node that can be reached, itself included.

    Rounds of large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and Beyond) until the
    links no longer change; each step is a min per node and an equi-join, so a hub is pre-aggregated before the
    shuffle and split by AQE in the join. Each round's links go to the checkpoint folder. Links with a null end, and
    links from a node to itself, count as absent. No links: no rows.

    file_rows: links are counted, and a step's result is written by no more tasks than it takes at so many rows each, so
    that a round over few links doesn't leave a file for each shuffle partition; None: by all of them.
    """

    def gathered(df: DataFrame, most: int) -> DataFrame:
        return common.gathered(df, most, file_rows) if file_rows else df

    pairs = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    pairs = gathered(pairs, links.count() if file_rows else 0).checkpoint()
    state = _state(pairs)
    for _ in range(max_rounds):
        if not state[0]:
            break
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        pairs = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        pairs = pairs.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        pairs = gathered(pairs.where("u != v").distinct(), 2 * state[0]).checkpoint()
        before, state = state, _state(pairs)
        if state == before:
            break
    else:
        raise RuntimeError(f"the components did not settle within {max_rounds} rounds")
    return gathered(pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select("v", "v").distinct()), 2 * state[0])
