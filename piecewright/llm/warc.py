"""WARC archives of pages, records compressed one by one with a Zstandard dictionary that each archive carries."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Fixed values of the formats: the magic of the skippable frame that holds a dictionary, and of an empty one.
DICTIONARY_MAGIC, EMPTY_MAGIC = 0x184D2A5D, 0x184D2A50
ZSTD_MAGIC = 0xFD2FB528
#: What Spark's text writer puts between records: an empty skippable frame, which readers of Zstandard pass over.
GAP = struct.pack("<II", EMPTY_MAGIC, 0)
#: Bytes of a dictionary, and of the records, drawn from all by a hash, that it is built from.
DICTIONARY_BYTES, SAMPLE_BYTES = 1 << 16, 4 << 20
#: Bytes of frames that are written at a time, and how often in an archive: about 64 MB, or a few records more.
BLOCK_BYTES, BLOCKS = 1 << 20, 64
#: Equal payloads of at least so many bytes are archived once.
LEAST_REVISIT = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None) -> str:
    """A version 8 UUID that holds the page's id."""
    bits = (page_id or 0) & (1 << 64) - 1
    return f"urn:uuid:{uuid.UUID(int=(bits >> 62) << 80 | 8 << 76 | (page_id is None) << 64 | 2 << 62 | bits & (1 << 62) - 1)}"


def page_of(urn: str) -> int | None:
    n = uuid.UUID(urn).int
    bits = (n >> 80 & 3) << 62 | n & (1 << 62) - 1
    return None if n >> 64 & 1 else bits - (1 << 64) if bits >> 63 else bits


def _safe(value: str) -> str:
    return "".join(f"%{b:02X}" if b <= 32 or b == 127 else chr(b) if b < 127 else f"%{b:02X}" for b in value.encode("utf-8", "surrogatepass"))


def warc_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit record if another page's record has the same payload."""
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id)}>",
        f"WARC-Target-URI: {_safe(url) if url else record_id(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: {digest}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _dictionary(records: list[bytes]) -> bytes:
    """Built from records; too few to train on: their own bytes serve as the dictionary."""
    if not records:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r[i : i + 8192] for r in records for i in range(0, len(r), 8192)], level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(records)[-DICTIONARY_BYTES:]


def archive_blocks(records: Iterator[bytes], dictionary: bytes, block_bytes: int = BLOCK_BYTES, each: int = BLOCKS, level: int = 6) -> Iterator[bytes]:
    """The frames of archives, some together: `each` blocks begin with the dictionary in a skippable frame, and each
    record is compressed on its own. No records: nothing."""
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True, write_content_size=True)
    head = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
    held, size, blocks = [], 0, 0
    for record in records:
        if not held and blocks % each == 0:
            held.append(head)
        held.append(packer.compress(record))
        size += len(held[-1])
        if size >= block_bytes:
            yield b"".join(held)
            held, size, blocks = [], 0, blocks + 1
    if held:
        yield b"".join(held)


def _sample(rows: DataFrame) -> list[bytes]:
    """About SAMPLE_BYTES of response records, drawn from all rows by a hash of id and url."""
    whole = rows.agg(F.sum(F.octet_length("payload")).alias("n")).first()["n"] or 0
    share = min(1.0, SAMPLE_BYTES / max(whole, 1))
    drawn = rows.where(F.pmod(F.xxhash64("id", "url"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    out, size = [], 0
    for r in drawn.select("id", "url", F.substring("payload", 1, SAMPLE_BYTES).alias("payload")).toLocalIterator():
        out.append(warc_record(r["id"], r["url"], bytes(r["payload"]), None))
        size += len(out[-1])
        if size >= 2 * SAMPLE_BYTES:  # chance, or a few long records
            break
    return out


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT, block_bytes: int = BLOCK_BYTES, blocks: int = BLOCKS) -> None:
    """Writes a record for each page to archives (*.warc.zst) under path, of about 64 MB at most each, unless a single
    record is longer. All carry one dictionary, built from a sample of all records.

    The payload is the html in UTF-8, null as empty. Of equal payloads of at least `least` bytes, the page with the
    smallest id gives a response record and the others revisit records that refer to it; rows that repeat that id are
    responses, and rows with a null id revisits. All others are responses. Only digests are compared over all pages;
    those that occur twice are counted, and broadcast only if they are few. Spark's own text writer puts the bytes into
    any store and commits each archive once, whatever executors are lost; between two blocks of frames it writes an empty
    skippable frame. Ids of equal rows are ties that need no order. Very long texts are one record each. Other columns are
    not read. No pages: no archives.
    """
    spark = pages.sparkSession
    common.prepare(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), common.utf8(html_col).alias("payload"))
    raw = _dictionary(_sample(rows))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    twice, place = common.written(rows.where(F.octet_length("payload") >= least).groupBy(F.col("digest").alias("d")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first"), "payloads")
    few = twice.count() * 80 <= common.BROADCAST_BYTES
    rows = rows.join(F.broadcast(twice) if few else twice, (rows["digest"] == twice["d"]) & (F.octet_length("payload") >= least), "left")
    rows = rows.select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers"))


    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records():
            for batch in batches:
                for row in zip(*(batch.column(i) for i in range(4))):
                    yield warc_record(*(x.as_py() for x in row))

        for block in archive_blocks(records(), raw, block_bytes, blocks):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.binary())], ["frame"])

    made = rows.select("id", "url", "payload", "refers").mapInArrow(frames, "frame binary").select(F.col("frame").cast("string").alias("value"))
    made.write.option("lineSep", GAP.decode("ascii")).option("compression", "none").option("maxRecordsPerFile", blocks).text(path)
    _name(spark, path)
    common.drop_folder(spark, place)


def _name(spark: SparkSession, path: str) -> None:
    """Gives the archives their usual ending; empty files go."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark._jsc.hadoopConfiguration())
    for n, f in enumerate(sorted((f for f in store.listStatus(where) if f.getPath().getName().startswith("part-")), key=lambda f: f.getPath().getName())):
        if f.getLen():
            store.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(path, f"archive-{n:05d}.warc.zst"))
        else:
            store.delete(f.getPath(), False)


def archive_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, decompressed as a stream."""
    raw, view = b"", memoryview(data)
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        raw, view = bytes(view[8 : 8 + size]), view[8 + size :]
    unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    stream = io.BufferedReader(unpacker.stream_reader(io.BytesIO(view), read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record's block ends early")
        yield headers, block


def _row(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {headers['warc-record-id']} does not fit its digest")
    refers = headers.get("warc-refers-to")
    return page_of(headers["warc-record-id"].strip("<>")), headers["warc-target-uri"], int(said["content-length"]), digest, kind, page_of(refers.strip("<>")) if refers else None, payload if kind == "response" else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of each record under path.

    Each response's payload is held against its digest. payload_bytes and payload_digest are the full payload's, also
    for revisits, whose own payload is null.
    """
    common.prepare(spark)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payloads else 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names)

        for batch in batches:
            for i in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in archive_records(batch.column(0)[i].as_py()):
                    row = _row(headers, block)
                    rows.append(row if payloads else row[:6])
                    size += len(block) if payloads else 200
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    store = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not any(f.getPath().getName().endswith(".warc.zst") for f in store.listStatus(spark._jvm.org.apache.hadoop.fs.Path(path))):
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("content").mapInArrow(run, schema)
