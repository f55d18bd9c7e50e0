"""Substring dedup: paragraphs joined by MinHash bands, and exact repeats inside them by seeds, clustered and cut out once."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .graph import connected_components

#: Words of a shingle, and the least similarity of near paragraphs.
SHINGLE, SIMILARITY = 5, 0.8
#: Paragraphs of fewer words aren't compared, and repeated runs of fewer words aren't reported.
LEAST_WORDS, LEAST_RUN = 10, 20
#: Lines of more words are also taken in parts, which begin where the hash of two words is the least among so many
#: places to either side.
LONG_LINE, REACH = 100, 24
#: Distinct paragraphs of a bucket that a task compares at once; larger buckets are dealt over pairs of such blocks.
BUCKET = 256
#: Bits of a filter, bytes of a filter that are merged in one place, and bytes that the driver fetches at a time.
FILTER_BITS, SEGMENT, FETCH_BYTES = 1 << 28, 1 << 16, 1 << 22
#: Rows a file of small intermediate tables, of pairs of hashes and of first places.
PAIR_ROWS, PLACE_ROWS = 1 << 10, 1 << 14
#: Bytes of texts that are worked on at a time; a longer text is one group.
GROUP_BYTES = 1 << 21
#: Bytes of a text whose words are hashed at a time.
WORD_BYTES = 1 << 22

_ODD = np.random.default_rng(20).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWER, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def tuned_bands(similarity: float = SIMILARITY, recall: float = 0.99, apart: float = 0.2, noise: float = 0.2) -> tuple[int, int]:
    """(bands, rows) with the fewest bands that find a pair of the given similarity with probability `recall`, while
    pairs of similarity `apart` meet with probability `noise` at most; if none does, the least noisy."""
    found = []
    for rows in range(1, 9):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))
        found.append((1 - (1 - apart**rows) ** bands > noise, bands, rows))
    return min(found)[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


_BYTES = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE, _IS_SPACE = re.compile(rb"[\t-\r ]"), np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of _POWER and of its inverse, kept for the next call."""
    if len(_POWERS[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_POWER, _INVERSE)):
                _POWERS[k] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, base)]), dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def _words(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some bytes that end with a word or white space: where they begin, in which line, and their hashes."""
    space = np.concatenate([_IS_SPACE[buffer], [True]])
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
    with np.errstate(over="ignore"):
        powers, inverse = _powers(len(buffer) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[buffer] * powers[: len(buffer)], dtype=np.uint64)])
        hashes = _mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return starts, np.searchsorted(np.flatnonzero(buffer == 10), starts), hashes


class Texts:
    """The words of a batch of texts in a row, as hashes, and their paragraphs (lines) and parts.

    Hashes of stretches are differences of prefix sums of byte or word values times powers, moved to a common place by
    the inverse power and mixed; no word is made a Python object.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts).lower()
        found, lines_before, at = [], 0, 0
        while at < len(joined):
            cut = _SPACE.search(joined, at + WORD_BYTES)
            to = cut.end() if cut else len(joined)
            starts, line, words = _words(np.frombuffer(joined, np.uint8, to - at, at))
            found.append((starts + at, line + lines_before, words))
            lines_before += joined.count(b"\n", at, to)
            at = to
        starts, line, self.words = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        ends_of = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        begins = np.concatenate(([0], ends_of[:-1] + 1)) if len(texts) else np.zeros(0, np.int64)
        self.docs = np.stack([np.searchsorted(starts, begins), np.searchsorted(starts, ends_of)], axis=1) if len(texts) else np.zeros((0, 2), np.int64)
        n = len(starts)
        self.line_starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1]))) if n else np.zeros(0, np.int64)
        self.line_ends = np.append(self.line_starts[1:], n)
        with np.errstate(over="ignore"):
            powers, self.inverse = _powers(n + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(self.words) * powers[:n], dtype=np.uint64)])
            shingles = np.zeros(max(n - SHINGLE + 1, 0), np.uint64)
            for k in range(SHINGLE):
                shingles += self.words[k : k + len(shingles)] * _ODD[k]
        self.shingles = _mix(shingles)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the words of each stretch, wherever it lies."""
        with np.errstate(over="ignore"):
            return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def doc_of(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs[:, 1], starts, "right")

    def paragraphs(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines of LEAST_WORDS words and more; of lines of over LONG_LINE words also the parts, cut where the words
        themselves say so, so that a passage is cut alike whatever surrounds it."""
        size = self.line_ends - self.line_starts
        starts, ends = self.line_starts[size >= LEAST_WORDS], self.line_ends[size >= LEAST_WORDS]
        n = len(self.words)
        if not (size > LONG_LINE).any():
            return starts, ends
        with np.errstate(over="ignore"):
            pair = _mix(self.words[:-1] * _ODD[10] + self.words[1:] * _ODD[11])
        low = np.ones(n, bool)
        low[-1] = False
        for k in range(1, min(REACH, n - 2) + 1):
            low[k:-1] &= pair[k:] < pair[:-k]
            low[: -k - 1] &= pair[:-k] <= pair[k:]
        line = np.repeat(np.arange(len(size)), size)
        low &= size[line] > LONG_LINE
        low[self.line_starts] |= size > LONG_LINE
        cuts = np.flatnonzero(low)
        to = np.minimum(np.append(cuts[1:], n), self.line_ends[line[cuts]])
        part = (to - cuts >= LEAST_WORDS) & (to - cuts < size[line[cuts]])
        return np.concatenate([starts, cuts[part]]), np.concatenate([ends, to[part]])

    def seeds(self, least_run: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of seeds, stretches of seed_words(least_run) words: of each run of least_run words within a
        text the one of the least hash, the first of equals."""
        size = seed_words(least_run)
        at = np.arange(max(len(self.words) - size + 1, 0))
        own, want = self.hashes(at, at + size), least_run - size + 1
        low, width = own, 1
        while width < want and len(low):
            step = min(width, want - width)
            low = np.minimum(low[: max(len(low) - step, 0)], low[step:])
            width += step
        starts = np.arange(len(low))
        inside = starts + least_run <= self.docs[:, 1][self.doc_of(starts)] if len(starts) else np.zeros(0, bool)
        least = np.zeros(len(own), bool)
        for k in range(want):
            hit = inside & (own[k : k + len(low)] == low)
            least[np.flatnonzero(hit) + k] = True
            inside &= ~hit
        chosen = np.flatnonzero(least)
        return chosen, own[chosen]

    def around(self, starts: np.ndarray, size: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """16 bits, not 0, of each of the `reach` words before stretches (the nearest first) and after them; 0 beyond
        the text."""
        short = ((self.words >> np.uint64(48)) | np.uint64(1)).astype("<u2")
        lo, hi = self.docs[self.doc_of(starts)].T
        before = starts[:, None] - 1 - np.arange(reach)
        after = starts[:, None] + size + np.arange(reach)
        n = max(len(short) - 1, 0)
        return np.where(before >= lo[:, None], short[np.maximum(before, 0)], 0).astype("<u2"), np.where(after < hi[:, None], short[np.minimum(after, n)], 0).astype("<u2")

    def minima(self, starts: np.ndarray, ends: np.ndarray, count: int) -> np.ndarray:
        """MinHash values of paragraphs' shingles, one row for each paragraph: the least of a range is the least of two
        ranges of the next lower power of 2."""
        out = np.empty((len(starts), count), np.uint64)
        if not len(starts):
            return out
        size = ends - starts - SHINGLE + 1
        level = np.frexp(size.astype(float))[1] - 1
        groups = [(k, np.flatnonzero(level == k)) for k in range(int(level.max()) + 1)]
        for j in range(count):
            with np.errstate(over="ignore"):
                low = self.shingles * _ODD[20 + j]
            for k, own in groups:
                if k:
                    low = np.minimum(low[: -(1 << k - 1)], low[1 << k - 1 :])
                if len(own):
                    out[own, j] = np.minimum(low[starts[own]], low[starts[own] + size[own] - (1 << k)])
        return out


def seed_words(least_run: int) -> int:
    """With at least half a run's words, each word inside a repeat lies in a seed."""
    return (least_run + 2) // 2


def _map(df: DataFrame, each, schema: str) -> DataFrame:
    """map_arrow with a batch's texts (its last column) cut into groups of GROUP_BYTES, which bounds memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upto = np.cumsum([len(t) for t in batch.column(batch.num_columns - 1).to_pylist()])
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + GROUP_BYTES, "right")))
                if (out := each(batch.slice(at, to - at))) is not None:
                    yield out
                at = to

    return df.mapInArrow(run, schema)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _seeds(docs: DataFrame, least_run: int) -> DataFrame:
    """(seed, doc): the seeds of all texts."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy()
        t = Texts(batch.column(1).to_pylist())
        starts, found = t.seeds(least_run)
        return pa.RecordBatch.from_arrays([_longs(found), pa.array(ids[t.doc_of(starts)])], ["seed", "doc"])

    return _map(docs, each, "seed long, doc long")


def _places(docs: DataFrame, seeds: np.ndarray, nodes: np.ndarray, least_run: int) -> DataFrame:
    """(kind, h, doc, start, n, again, before, after): with kind 1, each place of a seed that passes the first filter,
    whether its text has it earlier too, and the words around it, as far as the nearest next seed of a repeat could be;
    with kind 0, each paragraph, by the hash of its words, that passes the second filter."""
    sc, size = docs.sparkSession.sparkContext, seed_words(least_run)
    sent = sc.broadcast((seeds, nodes))
    names, kinds = ["kind", "h", "doc", "start", "n", "again", "before", "after"], [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column(0).to_numpy()
        t = Texts(batch.column(1).to_pylist())
        starts, found = t.seeds(least_run)
        hit = _passed(found, sent.value[0])
        starts, found = starts[hit], found[hit]
        where = t.doc_of(starts)
        order = np.lexsort((starts, found, where))
        again = np.zeros(len(starts), bool)
        again[order[1:]] = (found[order[1:]] == found[order[:-1]]) & (where[order[1:]] == where[order[:-1]])
        begins, ends = t.paragraphs()
        uh = t.hashes(begins, ends)
        hit = _passed(uh, sent.value[1])
        begins, ends, uh = begins[hit], ends[hit], uh[hit]
        n, m = len(starts), len(begins)
        if not n + m:
            return None
        every, docs_of = np.concatenate([starts, begins]), np.concatenate([where, t.doc_of(begins)])
        around = [[x.tobytes() for x in side] + [None] * m for side in t.around(starts, size, least_run - size)] if n else [[None] * m] * 2
        columns = [np.repeat([1, 0], [n, m]), np.concatenate([found, uh]).view(np.int64), ids[docs_of], every - t.docs[docs_of, 0], np.concatenate([np.full(n, size), ends - begins]), np.concatenate([again, np.zeros(m, bool)]), *around]
        return pa.RecordBatch.from_arrays([pa.array(c).cast(k) if isinstance(c, np.ndarray) else pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return _map(docs, each, "kind int, h long, doc long, start int, n int, again boolean, before binary, after binary")


def _bands(t: Texts, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different paragraphs of some texts: their hashes, starts, ends, and a row of band keys for each."""
    starts, ends = t.paragraphs()
    uh, at = np.unique(t.hashes(starts, ends), return_index=True)
    low = t.minima(starts[at], ends[at], bands * rows)
    keys = np.empty((len(uh), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(uh), b, np.uint64)
        for r in range(rows):
            with np.errstate(over="ignore"):
                key = _mix(key * _POWER + low[:, b * rows + r])
        keys[:, b] = key
    return uh, starts[at], ends[at], keys


def _band_rows(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, uh): each paragraph's bands."""

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        uh, _, _, keys = _bands(Texts(batch.column(1).to_pylist()), bands, rows)
        return pa.RecordBatch.from_arrays([_longs(keys.T.ravel()), _longs(np.tile(uh, bands))], ["key", "uh"])

    return _map(docs, each, "key long, uh long")


def _probes(uh: np.ndarray, bits: int) -> list[np.ndarray]:
    return [(_mix(uh ^ _ODD[50 + k]) % np.uint64(bits)).astype(np.int64) for k in range(3)]


def _passed(uh: np.ndarray, bits: np.ndarray) -> np.ndarray:
    hit = np.ones(len(uh), bool)
    for p in _probes(uh, len(bits) * 8):
        hit &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return hit


def _filter(found: DataFrame) -> np.ndarray:
    """A bit filter of the hashes in found's one column, which is counted; its size is bounded, and false hits only cost
    time. Tasks make bits in packed form, and these are merged on the executors, a SEGMENT in one place; the driver
    fetches FETCH_BYTES with a job, however many partitions there are."""
    bits = min(FILTER_BITS, max(SEGMENT * 8, 1 << (16 * found.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for at in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                np.bitwise_or.at(own, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
        for k in range(0, len(own), SEGMENT):
            if own[k : k + SEGMENT].any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own[k : k + SEGMENT].tobytes()], pa.binary())], ["at", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held[k] = held.get(k, 0) | np.frombuffer(part, np.uint8)
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["at", "bits"])

    out = np.zeros(bits // 8, np.uint8)
    merged = found.mapInArrow(run, "at int, bits binary").repartition("at").mapInArrow(merge, "at int, bits binary")
    for row in merged.repartition(-(-len(out) // FETCH_BYTES)).toLocalIterator():
        out[row["at"] : row["at"] + SEGMENT] = np.frombuffer(row["bits"], np.uint8)
    return out


def _candidates(docs: DataFrame, bits: np.ndarray, bands: int, rows: int) -> DataFrame:
    """(uh, keys, shingles): different paragraphs with those of their bands that pass the filter, and 32 bits of the
    hashes of their distinct shingles."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        t = Texts(batch.column(1).to_pylist())
        uh, starts, ends, keys = _bands(t, bands, rows)
        hit = _passed(keys.ravel(), sent.value).reshape(keys.shape)
        own = np.flatnonzero(hit.any(1))
        if not len(own):
            return None
        short = (t.shingles >> np.uint64(32)).astype("<u4")
        sets = [np.unique(short[a : b - SHINGLE + 1]).tobytes() for a, b in zip(starts[own].tolist(), ends[own].tolist())]
        cuts = np.concatenate(([0], np.cumsum(hit[own].sum(1)))).astype(np.int32)
        return pa.RecordBatch.from_arrays([_longs(uh[own]), pa.ListArray.from_arrays(pa.array(cuts), _longs(keys[own][hit[own]])), pa.array(sets, pa.binary())], ["uh", "keys", "shingles"])

    found = _map(docs, each, "uh long, keys array<long>, shingles binary")
    return found.groupBy("uh").agg(F.first("keys").alias("keys"), F.first("shingles").alias("shingles"))


def links_within(ids: list[int], sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A forest that joins what pairs of at least the similarity join: each member is compared with those not yet
    reached, over the shingles they share, so that no more than len(ids) - 1 links come out."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets])
    if n == 2:  # as most buckets are
        met = len(np.intersect1d(*sets, assume_unique=True))
        return [(ids[0], ids[1])] if met >= similarity * (sizes[0] + sizes[1] - met) - 1e-9 else []
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    owner_by, bounds = owner[order], np.searchsorted(flat[order], np.arange(flat.max() + 2))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    open_, out = np.ones(n, bool), []
    for seed in range(n):
        stack = [seed] if open_[seed] else []
        open_[seed] = False
        while stack and open_.any():
            at = stack.pop()
            own = flat[offsets[at] : offsets[at + 1]]
            met = np.bincount(np.concatenate([owner_by[bounds[x] : bounds[x + 1]] for x in own]), minlength=n)
            near = np.flatnonzero(open_ & (met >= similarity * (sizes[at] + sizes - met) - 1e-9))
            open_[near] = False
            out += [(ids[at], ids[k]) for k in near.tolist()]
            stack += near.tolist()
    return out


def _verified(met: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links within the buckets of met(key, uh, shingles), which has all rows of a key in one partition, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets, out = None, [], [], []

        def close() -> None:
            if len(ids) > 1:
                out.extend(links_within(ids, sets, similarity))

        for batch in batches:
            for k, uh, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    close()
                    key, ids, sets = k, [], []
                if not ids or ids[-1] != uh:
                    ids.append(uh)
                    sets.append(np.frombuffer(s, "<u4"))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def paragraph_links(docs: DataFrame, similarity: float = SIMILARITY, recall: float = 0.99) -> DataFrame:
    """(a, b): hashes of different paragraphs whose shingles' Jaccard similarity is at least `similarity`.

    Paragraphs that share a band meet; the bands that two different paragraphs have go into a filter of bounded size,
    through which the texts are read again for these paragraphs' shingles, and the exact Jaccard similarity (over 32-bit
    hashes of shingles) decides. A bucket of over BUCKET paragraphs is cut into blocks by a hash, and each pair of blocks
    is a task's share, so that any two members meet and no task holds more than two blocks. What comes out joins a
    share's members without listing all pairs.
    """
    return _linked(docs, similarity, recall)[0]


def _linked(docs: DataFrame, similarity: float, recall: float = 0.99) -> tuple[DataFrame, str]:
    """paragraph_links as a table, and its place."""
    spark = docs.sparkSession
    bands, rows = tuned_bands(similarity, recall)
    shared = _band_rows(docs, bands, rows).groupBy("key").agg(F.min("uh").alias("lo"), F.max("uh").alias("hi")).where("lo <> hi").select("key").persist(StorageLevel.DISK_ONLY)
    bits = _filter(shared)
    shared.unpersist()
    del shared
    common.release(spark)
    found, path = common.written(_candidates(docs, bits, bands, rows), "paragraphs")
    common.release(spark)
    met = found.select("uh", "shingles", F.explode("keys").alias("key"))
    large = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BUCKET).select(F.col("key").alias("large"), F.ceil(F.col("n") / BUCKET).cast("int").alias("blocks"))
    counted, used = large.persist(StorageLevel.DISK_ONLY), [path]
    if counted.count() * 32 <= common.BROADCAST_BYTES:
        large = F.broadcast(counted)
    else:  # as a table, both sides of the join are shuffled, and AQE can split a large bucket
        large, place = common.written(counted, "large")
        used.append(place)
    own = F.pmod(F.xxhash64("uh"), F.col("blocks")).cast("int")
    shares = F.when(F.col("blocks").isNull(), F.array("key")).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o))))
    met = met.join(large, F.col("key") == F.col("large"), "left").select("uh", F.explode(shares).alias("key"), "shingles")
    out, links = common.written(_verified(met.select("key", "uh", "shingles").repartition("key").sortWithinPartitions("key", "uh"), similarity), "links")
    counted.unpersist()
    for place in used:
        common.drop_folder(spark, place)
    common.release(spark)
    return out, links


def _extended(met: DataFrame, size: int) -> DataFrame:
    """(doc, start, end, class_id, n_docs, kept): each place of a seed as far as it agrees with the first place, and
    the first place as far as any of a batch agrees with it, which is kept."""
    names, kinds = ["doc", "start", "end", "class_id", "n_docs", "kept"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def reach(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, y = (np.frombuffer(b"".join(v.to_pylist()), "<u2").reshape(len(v), -1) for v in (a, b))
        return np.cumprod((x == y) & (x > 0), axis=1).sum(1) if x.shape[1] else np.zeros(len(x), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, start, first_doc, first_start, n = (batch.column(i).to_numpy() for i in range(5))
            left, right = (reach(batch.column(5 + k), batch.column(7 + k)) for k in (0, 1))
            other = (doc != first_doc) | (start != first_start)
            doc, start, first_doc, first_start, n, left, right = (x[other] for x in (doc, start, first_doc, first_start, n, left, right))
            order = np.lexsort((first_start, first_doc))
            fd, fs = first_doc[order], first_start[order]
            cuts = np.flatnonzero(np.concatenate(([True], (fd[1:] != fd[:-1]) | (fs[1:] != fs[:-1]))))[: len(fd)]
            if not len(cuts):
                continue
            most = [np.maximum.reduceat(x[order], cuts) for x in (left, right)]
            columns = [(doc, fd[cuts]), (start - left, fs[cuts] - most[0]), (start + size + right, fs[cuts] + size + most[1]), (first_doc, fd[cuts]), (n, n[order][cuts]), (np.zeros(len(doc), bool), np.ones(len(cuts), bool))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)).cast(k) for c, k in zip(columns, kinds)], names)

    return met.mapInArrow(run, "doc long, start int, end int, class_id long, n_docs long, kept boolean")


def _united(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that units, sorted by start, cover together, and the first unit of each."""
    reach = np.maximum.accumulate(ends)
    first = np.flatnonzero(np.concatenate(([True], starts[1:] > reach[:-1])))[: len(starts)]
    return starts[first], reach[np.append(first[1:], len(starts)) - 1] if len(first) else ends[:0], first


def stretches(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray, class_ids: np.ndarray, n_docs: np.ndarray, kept: np.ndarray, least_run: int) -> tuple[np.ndarray, ...]:
    """(document, first word, words, class_id, n_docs, kept) of units sorted by document and start. Words of a kept unit
    are kept; the others' words that no kept unit has can be removed. Units that adjoin or overlap are a run, which must
    have least_run words. A stretch has the first class, and the most documents, of the units of its kind that it is cut
    from. All documents are laid out in one row, with a gap between them."""
    new = np.concatenate(([True], docs[1:] != docs[:-1]))[: len(docs)]
    begin = np.flatnonzero(new)
    widest = np.maximum.reduceat(ends, begin) + 2 if len(begin) else np.zeros(0, np.int64)
    shift = np.cumsum(widest) - widest
    of = np.cumsum(new) - 1
    a, b = starts + shift[of], ends + shift[of]
    runs, runs_to, _ = _united(a, b)
    long = runs_to - runs >= least_run
    out = []
    held, held_to, _ = _united(a[kept], b[kept])
    for flag in (True, False):
        own = np.flatnonzero(kept == flag)
        if not len(own):
            continue
        side, _, first = _united(a[own], b[own])
        if flag:
            lo, hi = held, held_to
        else:  # what lies between a run's beginning, its kept stretches and its end
            lo, hi = np.sort(np.concatenate([runs, held_to])), np.sort(np.concatenate([held, runs_to]))
            lo, hi = lo[hi > lo], hi[hi > lo]
        in_long = long[np.searchsorted(runs, lo, "right") - 1]
        lo, hi = lo[in_long], hi[in_long]
        k = np.searchsorted(side, lo, "right") - 1
        d = np.searchsorted(shift, lo, "right") - 1
        out.append((docs[begin][d], lo - shift[d], hi - lo, class_ids[own][first][k], np.maximum.reduceat(n_docs[own], first)[k], np.full(len(lo), flag)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5 + (np.zeros(0, bool),)


def _swept(units: DataFrame, least_run: int, id_col: str) -> DataFrame:
    """The stretches of all documents; a task reads its documents' units in order, some whole documents at a time."""
    names, kinds = [id_col, "first_word", "n_words", "class_id", "n_docs", "kept"], [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, size = [], 0

        def out(whole: list[np.ndarray]) -> pa.RecordBatch:
            made = stretches(*(x.astype(np.int64) for x in whole[:5]), whole[5], least_run)
            return pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(made, kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            open_.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(6)])
            size += batch.num_rows
            if size >= 50_000:
                whole = [np.concatenate(c) for c in zip(*open_)]
                cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last document may go on
                if cut:
                    yield out([c[:cut] for c in whole])
                    whole = [c[cut:] for c in whole]
                open_, size = [whole], 0 if cut else -len(whole[0])
        if open_:
            yield out([np.concatenate(c) for c in zip(*open_)])

    dealt = units.select("doc", "start", "end", "class_id", "n_docs", "kept").repartition("doc").sortWithinPartitions("doc", "start", "end", "class_id", "kept")
    return dealt.mapInArrow(run, f"`{id_col}` long, first_word int, n_words int, class_id long, n_docs long, kept boolean")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, least_run: int = LEAST_RUN) -> DataFrame:
    """(id_col, first_word, n_words, class_id, n_docs, kept): the stretches of each document that other documents
    repeat, exactly or nearly.

    Near repeats: paragraphs are lines of at least LEAST_WORDS words, and parts of long lines; those of different words
    whose five-word shingles have at least the similarity are joined by MinHash bands, an exact Jaccard similarity and
    components, which are classes. Exact repeats, wherever they begin and end: every run of least_run words has a seed,
    the stretch of over half as many words with the least hash, so that equal runs have equal seeds; a seed that
    different documents have is a class, and each of its places is extended word by word as far as it agrees with the
    class's first place. So all words of a repeat of least_run words are found, but for up to least_run / 2 words at
    its ends where an earlier document has the seed there and goes on otherwise.

    A class's first place, by id and place, is kept. Words that only other places of classes cover can be removed
    (kept = false); what any first place covers is kept, so that every class still stands somewhere when all the others
    are gone. (Near an edit a text may have a seed that an unedited one, which has the words too, does not; then the
    edited text counts as the first, and a little more is kept than need be.) Places that adjoin or overlap are a run; runs of fewer than least_run words are left out, the others are
    cut where kept changes. class_id is the smallest id that has the first class of a stretch, n_docs the most rows
    that have one of its classes, counted exactly. Words are counted from 0 over the whole text; A-Z are lower-cased
    and white space evened out before words are compared.

    Null and empty texts and rows with a null id have no stretches. Rows that repeat an id are laid over one another,
    and a class needs two different ids. Very long texts take memory in proportion to their own words, about 100 bytes
    a word. Other columns are not read. Documents that share nothing aren't in the result, which is empty for an empty
    table.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), common.utf8(text_col).alias("t"))
    links, place = _linked(texts, similarity)
    nodes, _ = common.written(connected_components(links, file_rows=PAIR_ROWS), "nodes")
    common.drop_folder(spark, place)
    seeds = _seeds(texts, least_run).groupBy("seed").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("seed").persist(StorageLevel.DISK_ONLY)
    n_seeds, bits = seeds.count(), _filter(seeds)
    seeds.unpersist()
    del seeds
    common.release(spark)
    found, _ = common.written(_places(texts, bits, _filter(nodes.select("node")), least_run), "places")

    near = found.where("kind = 0").join(nodes, F.col("h") == F.col("node")).select(F.col("component").alias("class"), "doc", "start", "n")
    each = near.groupBy("class", "doc").agg(F.min("start").alias("start"))
    first = F.min(F.struct("doc", "start")).alias("first")
    classes = each.groupBy("class").agg(first, F.max("doc").alias("last"), F.count(F.lit(1)).alias("n_docs")).where("first.doc <> last").select("class", "first", "n_docs")
    classes, _ = common.written(common.gathered(classes, nodes.count(), PAIR_ROWS), "classes")
    near = near.join(classes, "class").select("doc", "start", (F.col("start") + F.col("n")).alias("end"), F.col("first.doc").alias("class_id"), "n_docs", F.struct("doc", "start").eqNullSafe(F.col("first")).alias("kept"))

    found = found.where("kind = 1")
    first = F.min(F.struct("doc", "start", "before", "after")).alias("f")
    firsts = found.groupBy("h").agg(first, F.max("doc").alias("last"), F.sum((~F.col("again")).cast("long")).alias("n_docs")).where("f.doc <> last").select(F.col("h").alias("own"), F.col("f.doc").alias("first_doc"), F.col("f.start").alias("first_start"), "n_docs", F.col("f.before").alias("first_before"), F.col("f.after").alias("first_after"))
    firsts, _ = common.written(common.gathered(firsts, n_seeds, PLACE_ROWS), "firsts")
    common.release(spark)
    met = found.join(firsts.hint("merge"), F.col("h") == F.col("own")).select("doc", "start", "first_doc", "first_start", "n_docs", "before", "after", "first_before", "first_after")
    return _swept(near.unionByName(_extended(met, seed_words(least_run))), least_run, id_col)
