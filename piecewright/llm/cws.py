"""Document fingerprints by consistent weighted sampling of words."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Samples of a fingerprint; each is kept as 16 bits.
SAMPLES = 128
#: Characters of the texts whose words share one table of gamma draws.
GROUP_CHARS = 1_500_000
#: Words whose draws are made at a time, and words of a group whose draws are kept; with more, each text's are made anew.
BLOCK, MANY = 2048, 300_000
#: Ranges of ids that rows are dealt into, at most; a range is sorted, with spilling, and read in groups.
RANGES = 1 << 15
EMPTY = "0" * (4 * SAMPLES)

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: -ln(u) for u at the middles of 65536 equal steps.
_LOG = -np.log((np.arange(1 << 16) + 0.5) / (1 << 16))


def _mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer, in place."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def draws(hashes: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and beta for each word hash and sample: r and c are gamma(2, 1) draws, beta is uniform. They depend on
    the hash and the sample's number alone."""
    with np.errstate(over="ignore"):
        x = hashes[:, None] + (np.arange(1, samples + 1, dtype=np.uint64) * _STEP)[None, :]
    x = _mix(x)
    part = x.view(np.uint16).reshape(*x.shape, 4)
    r = _LOG[part[..., 0]] + _LOG[part[..., 1]]
    c = np.log(_LOG[part[..., 2]] + _LOG[part[..., 3]])
    beta = (_mix(x ^ _STEP) >> np.uint64(40)).astype(np.float64) / (1 << 24)
    return r.astype(np.float32), c.astype(np.float32), beta.astype(np.float32)


class Words:
    """The words of a group of texts: their numbers and their draws."""

    def __init__(self, samples: int = SAMPLES):
        self.samples, self.number = samples, defaultdict()
        self.number.default_factory = self.number.__len__

    def count(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's words, and how often each occurs."""
        words = text.encode("utf-8", "surrogatepass").lower().split()
        return np.unique(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), return_counts=True)

    def draw(self, often: np.ndarray) -> None:
        """Makes the draws: for weight 1 what sampling comes to, for the words in `often` also the draws themselves."""
        hashes = self.hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.number), np.uint64, len(self.number))
        if len(hashes) > MANY:
            return
        self.once = np.empty((len(hashes), self.samples), np.float32)
        for at in range(0, len(hashes), BLOCK):
            r, c, beta = draws(hashes[at : at + BLOCK], self.samples)
            self.once[at : at + BLOCK] = c - r * (np.float32(1) - beta)
        self.place = np.zeros(len(hashes), np.int64)
        self.place[often] = np.arange(len(often))
        self.own = draws(hashes[often], self.samples)

    def fingerprint(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray | None:
        """SAMPLES 16-bit codes. Each sample takes the word of the least ln a = ln c - r (t - beta + 1) with
        t = floor(ln weight / r + beta); that value, which word, t and sample fix, is the sample's identity."""
        if not len(numbers):
            return None
        if len(self.hashes) > MANY:
            return _codes(self._low(numbers, counts))
        one = counts == 1
        low = self.once[numbers[one]].min(0) if one.any() else np.full(self.samples, np.inf, np.float32)
        if not one.all():
            at = self.place[numbers[~one]]
            r, c, beta = (x[at] for x in self.own)
            t = np.floor(np.log(counts[~one]).astype(np.float32)[:, None] / r + beta)
            # Where t is 0, the value must be the same number as the one for weight 1.
            low = np.minimum(low, np.where(t == 0, self.once[numbers[~one]], c - r * (t - beta + np.float32(1))).min(0))
        return _codes(low)

    def _low(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The same least values, from draws that are made for BLOCK words at a time and not kept."""
        low = np.full(self.samples, np.inf, np.float32)
        for at in range(0, len(numbers), BLOCK):
            r, c, beta = draws(self.hashes[numbers[at : at + BLOCK]], self.samples)
            t = np.floor(np.log(counts[at : at + BLOCK]).astype(np.float32)[:, None] / r + beta)
            low = np.minimum(low, np.where(t == 0, c - r * (np.float32(1) - beta), c - r * (t - beta + np.float32(1))).min(0))
        return low


def _codes(low: np.ndarray) -> np.ndarray:
    return (_mix(low.view(np.uint32).astype(np.uint64)) & np.uint64(0xFFFF)).astype(">u2")


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """The share of equal samples, an estimate of the generalised Jaccard similarity; two empty texts are alike."""
    if a is None or b is None:
        return float(a is None and b is None)
    return float((a == b).mean())


def _hex(codes: np.ndarray | None) -> str:
    return EMPTY if codes is None else codes.tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(texts: list[str]) -> Iterator[tuple]:
    """For each text but the last: n_chars, edited_sha256, both fingerprints, both likenesses."""
    made = [edited(a, b) for a, b in zip(texts, texts[1:])]
    words = Words()
    counted = [words.count(t) for t in texts]
    changed = [words.count(t) for t in made]
    often = [n[c > 1] for n, c in counted + changed]
    words.draw(np.unique(np.concatenate(often)))
    prints = [words.fingerprint(*x) for x in counted]
    for i, t in enumerate(made):
        own = words.fingerprint(*changed[i])
        yield len(texts[i]), hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), _hex(prints[i]), _hex(own), likeness(prints[i], own), likeness(prints[i], prints[i + 1])


def fingerprint_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_part: int = 4096) -> DataFrame:
    """(id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row: its
    fingerprint, that of its edited text, and how like its fingerprint is to this and to the next row's.

    Words are runs of bytes other than space and 0x09-0x0D with A-Z lower-cased; their weight is their count. Rows are
    in descending order of id, nulls last, equal ids by their texts; after the last comes the first. Null text counts
    as empty: no words, a fingerprint of zeros, like only other empty ones. A single row follows itself. No rows: none.

    Ranges of about per_part ids, RANGES at most, from quantiles of the ids alone, are each sorted in one task; into
    each also goes the first row of the range after it, so that texts are shuffled once and no task or driver sees all
    rows. Rows are compared GROUP_CHARS characters at a time; a very long text is a group, whose draws are made in
    blocks. Other columns are not read.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    schema = f"`{id_col}` long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not n:
        return spark.createDataFrame([], schema)
    parts = min(RANGES, -(-n // per_part))
    bounds = sorted(set(rows.approxQuantile("id", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []))
    bounds = [int(b) for b in bounds]
    found = rows.select("id", _range_of(bounds).alias("part")).groupBy("part").agg(F.max("id").alias("first")).orderBy(F.desc("part")).collect()
    order, first = [r["part"] for r in found], [r["first"] for r in found]
    guests = spark.createDataFrame([(order[i], first[(i + 1) % len(order)]) for i in range(len(order))], "into int, guest long")
    own = rows.select("id", "text", _range_of(bounds).alias("part"), F.lit(0).alias("late"))
    visiting = own.join(F.broadcast(guests), F.col("id").eqNullSafe(F.col("guest"))).select("id", "text", F.col("into").alias("part"), F.lit(1).alias("late"))
    dealt = own.union(visiting).repartitionByRange(len(order), "part").sortWithinPartitions("part", "late", F.desc_nulls_last("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, part = [], [], 0, None

        def out(upto: int) -> pa.RecordBatch:
            made = list(_compare(texts[: upto + 1]))
            columns = list(zip(*made))
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([pa.array(ids[:upto], pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds))], [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        ended = False
        for batch in batches:
            for doc_id, text, p, late in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    ids, texts, size, part, ended = [], [], 0, p, False
                if ended:
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if late:
                    yield out(len(texts) - 1)
                    ended = True
                elif size >= GROUP_CHARS and len(texts) > 1:
                    yield out(len(texts) - 1)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    return dealt.mapInArrow(run, schema)


def _range_of(bounds: list[int]) -> Column:
    """Which of the ranges between bounds an id falls into; nulls fall into the lowest."""
    if not bounds:
        return F.lit(0)
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy(np.int64), "right").astype(np.int32))

    return place(F.coalesce(F.col("id"), F.lit(-(1 << 63))))
