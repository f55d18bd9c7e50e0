"""What the training-data operators share: reading, the shared folder, size-checked broadcasts, Arrow streaming."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch between the JVM and Python. Texts may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 512, 8 << 20
#: A table is broadcast only if it has been counted and takes at most so many bytes.
BROADCAST_BYTES = 32 << 20


def prepare(spark: SparkSession) -> None:
    """Settings that the operators rely on; called by each of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    shared_dir(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; only a local session may lack it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not (sc.master.startswith("local[") or sc.master == "local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "/tmp/checkpoints/piecewright"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished steps, which it else does only at the driver's next
    collection of garbage."""
    gc.collect()
    spark._jvm.System.gc()


def written(df: DataFrame, kind: str = "table") -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, which outlives lost executors, and its place."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def gathered(df: DataFrame, most: int, file_rows: int) -> DataFrame:
    """df, which has at most `most` rows, in no more partitions than these take at file_rows each. Where AQE doesn't
    merge small partitions, a table of a few rows else gets a file for each."""
    return df.coalesce(max(1, -(-most // file_rows)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(column: str):
    """A text column as bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b"").cast("binary"))


def map_arrow(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """Applies a function to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def free_names(columns: list[str], n: int) -> list[str]:
    """n column names that differ from the columns', also but for case."""
    used = {c.lower() for c in columns}
    return [c for c in (f"_own{k}" for k in range(n + len(used))) if c not in used][:n]


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in gone (one column, named gone). The ids are counted: few are broadcast, for
    many both sides are shuffled. Rows with a null id stay."""
    gone = gone.distinct().checkpoint()
    if gone.count() * 16 <= BROADCAST_BYTES:
        gone = F.broadcast(gone)
    return docs.join(gone, docs[id_col] == gone["gone"], "left_anti")
