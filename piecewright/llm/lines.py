"""Line dedup: documents probe a sharded minimal perfect hash over the hashes of lines, whose counts decide."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .perfect_hash import LineShard

BLANK = b" \t\n\r\x0b\x0c"
#: Keys in a shard of the table, about.
SHARD_KEYS = 1 << 16
#: Bytes that a key takes in a shard: fingerprint, count, largest document and the perfect hash's bits.
KEY_BYTES = 25
#: Routed lines that meet one shard, about.
SHARD_LINES = 1 << 19
#: Lines in at least this part of all lines count as heavy; there are at most so many.
HEAVY = 1 << 16


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """A line's key, or None if it has under min_chars code points."""
    key = line.strip(BLANK).lower()
    if len(key) >= 4 * min_chars or len(key) >= min_chars and sum(b & 0xC0 != 0x80 for b in key) >= min_chars:
        return key
    return None


def line_hashes(lines: list[bytes], min_chars: int) -> tuple[list[int], np.ndarray]:
    """Which lines have keys, and the keys' hashes as rows of two 64-bit halves."""
    at, found = [], []
    for i, line in enumerate(lines):
        if (key := line_key(line, min_chars)) is not None:
            at.append(i)
            found.append(xxhash.xxh3_128_digest(key))
    return at, np.frombuffer(b"".join(found), "<u8").reshape(-1, 2)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


def _bytes_of(column: pa.Array) -> list[bytes]:
    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]


def _strings(values: list[bytes]) -> pa.Array:
    """Bytes as a string column, without a second check of their UTF-8."""
    raw = pa.array(values, pa.binary())
    return pa.StringArray.from_buffers(len(raw), raw.buffers()[1], raw.buffers()[2])


def _key_rows(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, id): each document's distinct line keys."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, ids = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), _bytes_of(batch.column(1))):
            _, found = line_hashes(text.split(b"\n"), min_chars)
            if len(found):
                hashes.append(found := np.unique(found, axis=0))
                ids += [doc_id] * len(found)
        both = np.concatenate(hashes) if hashes else np.zeros((0, 2), "<u8")
        return pa.RecordBatch.from_arrays([_longs(both[:, 0]), _longs(both[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "id"])

    return common.map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t")), each, "h1 long, h2 long, id long")


def _tables(keys: DataFrame, shards: int) -> DataFrame:
    """(shard, table): one row for each shard of the line table."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        made = LineShard.build(*(pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2")), pdf["n"].to_numpy(), pdf["last"].to_numpy())
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "table": [made.to_bytes()]})

    return keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, table binary")


class _Probe:
    """The table's shards in a Python worker."""

    def __init__(self, tables: dict[int, bytes], shards: int):
        self.shards, self.tables = shards, {k: LineShard.from_bytes(v) for k, v in tables.items()}

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each line, 0 if it isn't in the table, and the largest of them."""
        count, last = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        shard = hashes[:, 0].view(np.int64) % self.shards if len(hashes) else np.zeros(0, np.int64)
        for k in np.unique(shard).tolist():
            if k in self.tables:
                own = np.flatnonzero(shard == k)
                _, count[own], last[own] = self.tables[k].probe(hashes[own, 0].copy(), hashes[own, 1].copy())
        return count, last


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 2) -> DataFrame:
    """(h1, h2, n, last): hashes of the line keys that at least min_docs documents hold, how many, and the largest id."""
    common.prepare(docs.sparkSession)
    rows = _key_rows(docs, id_col, text_col, min_chars)
    return rows.groupBy("h1", "h2").agg(F.count_distinct("id").alias("n"), F.max("id").alias("last")).where(F.col("n") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, table_bytes: int = common.BROADCAST_BYTES, counts: tuple[str, str] | None = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with the lines taken out of text_col whose keys at least min_docs documents hold, except in the document
    with the largest id that holds the key; the numbers of lines (before) and of dropped lines are added as `counts`.

    Lines end at 0x0A; a key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased, if it has
    at least min_chars code points. Lines are known by 128-bit hashes: one half goes to the minimal perfect hash, the
    other is the stored fingerprint. The distinct hashes, but for those of one document alone, whose absence says as
    much, are counted and dealt over shards; each becomes a perfect hash with fingerprint, count and largest-id arrays.
    Up to table_bytes all shards are broadcast, and documents probe them where they are read; the count found decides.
    Beyond, only keys that take at least 1/65536 of all lines are (which are 65536 at most); the other lines' hashes go
    to their shards, probe there, and the hits return to the documents by id and a hash of the text. No line is sent to
    a task that a frequent key could fill, and no list is longer than a text's own lines.

    Null text: one empty line. Rows that repeat an id are one document. A row with a null id is never the one that keeps
    its lines, and doesn't count as a document. Empty tables give none. Very long texts are split in memory, at about
    ten times their size. Extra columns stay, whatever their names, but for columns named as `counts`, which are
    replaced; counts=None adds and replaces none.
    """
    spark = docs.sparkSession
    keys, place = common.written(repeated_lines(docs, id_col, text_col, min_chars, min(2, min_docs)), "line-keys")
    docs = docs.select(*[c for c in docs.columns if c not in (counts or ())])
    shards, found = max(1, -(-keys.count() // SHARD_KEYS)), None
    near = keys
    if (total := keys.count() * KEY_BYTES) > table_bytes:
        lines = _key_rows(docs, id_col, text_col, min_chars).count()
        heavy = F.col("n") * HEAVY >= lines
        near, far = keys.where(heavy), keys.where(~heavy)
        shards = max(shards, -(-lines // SHARD_LINES))
    token = uuid.uuid4().hex
    tables = spark.sparkContext.broadcast({r["shard"]: bytes(r["table"]) for r in _tables(near, shards).toLocalIterator()})
    if total > table_bytes:
        found = _routed(docs, tables, _tables(far, shards), shards, token, id_col, text_col, min_chars, min_docs)
    else:
        common.drop_folder(spark, place)
    return _without(docs, tables, shards, token, found, id_col, text_col, min_chars, min_docs, counts)


_PROBES: dict[str, _Probe] = {}


def _probe_of(tables, shards: int, token: str) -> _Probe:
    """The worker's one probe, kept from task to task."""
    if token not in _PROBES:
        _PROBES.clear()
        _PROBES[token] = _Probe(tables.value, shards)
    return _PROBES[token]


def _row_key(text: Column, doc_id: Column) -> Column:
    """Tells rows of one id, or of none, apart by their texts."""
    return F.xxhash64(text, doc_id.isNull())


def _routed(docs: DataFrame, tables, far: DataFrame, shards: int, token: str, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """(id, row, drop): hashes of the lines that a row loses by the shards that aren't broadcast."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        probe = _probe_of(tables, shards, token)
        hashes, ids, rows = [], [], []
        for doc_id, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes_of(batch.column(2))):
            _, found = line_hashes(text.split(b"\n"), min_chars)
            if len(found):
                hashes.append(found := np.unique(found, axis=0))
                ids += [doc_id] * len(found)
                rows += [row] * len(found)
        h = np.concatenate(hashes) if hashes else np.zeros((0, 2), "<u8")
        open_ = pa.array(probe(h)[0] == 0)
        columns = [pa.array((h[:, 0].view(np.int64) % shards).astype(np.int32)), _longs(h[:, 0]), _longs(h[:, 1]), pa.array(ids, pa.int64()), pa.array(rows, pa.int64())]
        return pa.RecordBatch.from_arrays([c.filter(open_) for c in columns], ["shard", "h1", "h2", "id", "row"])

    def meet(lines: pa.Table, table: pa.Table) -> pa.Table:
        lines = lines.select(["id", "row", "h1", "h2"])
        if not lines.num_rows or not table.num_rows:
            return lines.slice(0, 0)
        _, count, last = LineShard.from_bytes(table["table"][0].as_py()).probe(*(lines[c].to_numpy().view(np.uint64) for c in ("h1", "h2")))
        other = pc.fill_null(pc.not_equal(lines["id"], pa.chunked_array([last])), True)
        return lines.filter(pc.and_(pa.chunked_array([count >= min_docs]), other))

    own = docs.select(F.col(id_col).cast("long").alias("id"), _row_key(F.col(text_col), F.col(id_col)).alias("row"), F.col(text_col).alias("t"))
    sent = common.map_arrow(own, each, "shard int, h1 long, h2 long, id long, row long")
    hits = sent.groupBy("shard").cogroup(far.groupBy("shard")).applyInArrow(meet, "id long, row long, h1 long, h2 long")
    return hits.distinct().groupBy("id", "row").agg(F.collect_list(F.struct("h1", "h2")).alias("drop"))


def _without(docs: DataFrame, tables, shards: int, token: str, found: DataFrame | None, id_col: str, text_col: str, min_chars: int, min_docs: int, counts: tuple[str, str] | None) -> DataFrame:
    at, by = docs.columns.index(text_col), docs.columns.index(id_col)
    fields = [T.StructField(f.name, T.StringType()) if f.name == text_col else f for f in docs.schema.fields]
    schema = T.StructType([*fields, *(T.StructField(name, T.LongType()) for name in counts or ())])
    width, with_routed = len(fields), found is not None
    rows = docs
    if found is not None:
        a, b, c = common.free_names(docs.columns, 3)
        own = found.select(F.col("id").alias(a), F.col("row").alias(b), F.col("drop").alias(c))
        rows = docs.join(own, docs[id_col].cast("long").eqNullSafe(own[a]) & (_row_key(docs[text_col], docs[id_col]) == own[b]), "left").drop(a, b)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        probe = _probe_of(tables, shards, token)
        split = [t.split(b"\n") for t in _bytes_of(batch.column(at))]
        each_doc = [line_hashes(lines, min_chars) for lines in split]
        held, last = probe(np.concatenate([h for _, h in each_doc]))
        routed = batch.column(width).to_pylist() if with_routed else None
        texts, dropped, k = [], [], 0
        for row, (doc_id, lines, (where, hashes)) in enumerate(zip(batch.column(by).to_pylist(), split, each_doc)):
            own = slice(k, k := k + len(where))
            gone = held[own] >= min_docs
            if doc_id is not None:
                gone &= last[own] != doc_id
            if routed is not None and routed[row]:
                more = {(d["h1"] & (1 << 64) - 1, d["h2"] & (1 << 64) - 1) for d in routed[row]}
                gone = gone | np.array([tuple(h) in more for h in hashes.tolist()], bool)
            out = {where[i] for i in np.flatnonzero(gone).tolist()}
            texts.append(b"\n".join([x for i, x in enumerate(lines) if i not in out]) if out else b"\n".join(lines))
            dropped.append(len(out))
        columns = [_strings(texts) if i == at else batch.column(i) for i in range(width)]
        numbers = [pa.array([len(x) for x in split], pa.int64()), pa.array(dropped, pa.int64())] if counts else []
        return pa.RecordBatch.from_arrays([*columns, *numbers], schema.names)

    return rows.mapInArrow(lambda batches: (each(b) for b in batches if b.num_rows), schema)
