"""Language-model scores of a hashed maximum-entropy model with a class-factored softmax."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .chunks import SHAPES, Piece, chunked, give_back

#: Classes, and units in a class: a power of 2 that grows with the fourth root of the number of different words.
LEAST_SIDE, MOST_SIDE = 16, 128
#: Weights: a power of 2 that grows with the training tokens, by 2^-WEIGHTS_BITS of them, up to a broadcast's size.
WEIGHTS_BITS, LEAST_WEIGHTS, MOST_WEIGHTS = 5, 21, 23
#: Shares of the documents; in each round of training the gradient updates of one share are made and merged.
ROUNDS = 4
#: Tokens of a gradient update, the size of steps, and what their decay begins from.
TOKENS, STEP, CALM = 2048, 0.7, 1.0
#: A word that fewer training tokens have stands in contexts by its shape.
LEAST_CONTEXT = 3
#: Parts (of about 1 MB of text) that a task learns from in a round, at most.
SHARE_PARTS = 64
#: Words of a task that may be among the most frequent of all.
FREQUENT = MOST_SIDE * MOST_SIDE
#: Rows of weights that are summed over the tasks in one place.
ROWS_MERGED = 1 << 10

_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def held(doc_id: int | None, mod: int = 7, rest: int = 2) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % mod == rest


def side_for(types: int) -> int:
    return min(MOST_SIDE, max(LEAST_SIDE, 1 << int(np.log2(types + 1) / 4 + 0.5)))


def weights_for(tokens: int) -> int:
    return 1 << min(MOST_WEIGHTS, max(LEAST_WEIGHTS, max(tokens, 1).bit_length() - WEIGHTS_BITS))


@dataclass(frozen=True)
class Units:
    """What the softmax tells apart: the end, the most frequent words, and shapes for all other words.

    Unit u is member u % side of class u // side. top: h1, h2 and count of the frequent words, by h1, and their units;
    inside: for each unit its training tokens, types, and the discount that its unknown words get.
    """

    side: int
    top: np.ndarray
    top_units: np.ndarray
    inside: np.ndarray

    @property
    def shapes_from(self) -> int:
        return self.side * self.side * 7 // 8

    @classmethod
    def made(cls, side: int, top: list[tuple[int, int, int]], shapes: np.ndarray, ends: int) -> Units:
        """top: (h1, h2, count) of the most frequent words in order; shapes: tokens, types, words that occur once and
        twice of each shape, the frequent words among them; ends: training documents."""
        n, first = side * side, side * side * 7 // 8
        words = np.array(top[: first - 1], np.int64).reshape(-1, 3)
        rest = shapes.astype(np.int64).copy()
        np.subtract.at(rest, words[:, 1] & (SHAPES - 1), np.stack([words[:, 2], np.ones(len(words), np.int64), words[:, 2] == 1, words[:, 2] == 2], axis=1))
        own = rest.reshape(-1, n - first, 4).sum(0)  # shape s belongs to unit first + s % (n - first)
        inside = np.zeros((n, 3))
        inside[0, :2] = ends, min(ends, 1)
        inside[1 : 1 + len(words), :2] = np.stack([words[:, 2], np.ones(len(words))], axis=1)
        inside[first:, :2] = own[:, :2]
        inside[first:, 2] = np.where(own[:, 2] > 0, np.clip(own[:, 2] / np.maximum(own[:, 2] + 2 * own[:, 3], 1), 0.05, 0.95), np.where(own[:, 0] > 0, 0.05, 0.5))
        order = np.argsort(words[:, 0], kind="stable")
        return cls(side, words[order], (1 + np.arange(len(words)))[order], inside)

    def of(self, h1: np.ndarray, shapes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Units of words, by the first half of the hash, shape and training count."""
        n = self.side * self.side
        units = self.shapes_from + shapes % (n - self.shapes_from)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top[:, 0], h1), len(self.top) - 1)
            same = (self.top[at, 0] == h1) & (self.top[at, 1] & (SHAPES - 1) == shapes) & (self.top[at, 2] == counts)
            units = np.where(same, self.top_units[at], units)
        return units

    def within(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 P(word | unit): the training share less a discount, which goes to the unit's unknown words."""
        total, types, discount = self.inside[units].T
        share = np.where(counts > 0, (counts - discount) / np.maximum(total, 1), np.where(total > 0, discount * types / np.maximum(total, 1), 1.0))
        return np.log10(np.maximum(np.where(units < self.shapes_from, 1.0, share), 1e-300))

    def bias(self) -> tuple[np.ndarray, np.ndarray]:
        """log P(class) and log P(member | class) without a context."""
        of = (self.inside[:, 0] + 0.1).reshape(self.side, self.side)
        return np.log(of.sum(1) / of.sum()).astype(np.float32), np.log(of / of.sum(1, keepdims=True)).astype(np.float32)


@dataclass(frozen=True)
class Part:
    """Documents as training and scoring need them: their tokens as numbers into lists of units and of the hashes by
    which words stand in contexts, and what doesn't depend on contexts."""

    ids: list[int | None]
    marks: np.ndarray
    lengths: np.ndarray
    known: np.ndarray
    base: np.ndarray
    within: np.ndarray
    units: np.ndarray
    contexts: np.ndarray
    numbers: np.ndarray

    def to_bytes(self) -> bytes:
        there = np.array([i is not None for i in self.ids], "<i8")
        whole = [np.array([len(self.ids), len(self.units)], "<i8"), np.array([i or 0 for i in self.ids], "<i8"), there, *(x.astype("<i8") for x in (self.marks, self.lengths, self.known)), self.base.astype("<f8"), self.within.astype("<f8")]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in [*whole, self.contexts.astype("<u4"), self.units.astype("<u2"), self.numbers.astype("<i4")]))

    @classmethod
    def from_bytes(cls, blob: bytes) -> Part:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, m = np.frombuffer(raw, "<i8", 2).tolist()
        ids, there, marks, lengths, known = (np.frombuffer(raw, "<i8", n, 16 + 8 * n * k) for k in range(5))
        base, within = (np.frombuffer(raw, "<f8", n, 16 + 8 * n * k) for k in (5, 6))
        at = 16 + 56 * n
        contexts, units, numbers = np.frombuffer(raw, "<u4", m, at), np.frombuffer(raw, "<u2", m, at + 4 * m), np.frombuffer(raw, "<i4", -1, at + 6 * m)
        return cls([i if t else None for i, t in zip(ids.tolist(), there.tolist())], marks, lengths, known, base, within, units, contexts, numbers)

    def tokens(self, learned: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(place, units, hashes one before, hashes two before) of TOKENS tokens at a time; 0 stands before a text.
        learned: only tokens of training documents."""
        starts = np.cumsum(self.lengths) - self.lengths
        for at in range(0, len(self.numbers), TOKENS):
            to = min(at + TOKENS, len(self.numbers))
            lo = max(at - 2, 0)
            before = np.concatenate([np.zeros(2 - (at - lo), np.uint64), self.contexts[self.numbers[lo:to]].astype(np.uint64) + np.uint64(1)])
            one, two = before[1:-1].copy(), before[:-2].copy()
            here = starts[np.searchsorted(starts, at - 1) : np.searchsorted(starts, to)] - at
            one[here[here >= 0]] = 0
            two[here[here >= 0]] = 0
            two[(here + 1)[here + 1 < to - at]] = 0
            units = self.units[self.numbers[at:to]].astype(np.int64)
            if learned:
                own = self.marks[np.searchsorted(starts, np.arange(at, to), "right") - 1] == 0
                units, one, two = units[own], one[own], two[own]
            yield at, units, one, two


def part_of(piece: Piece, h32: np.ndarray, shapes: np.ndarray, counts: np.ndarray, units: np.ndarray, within: np.ndarray, base: np.ndarray) -> Part:
    """A piece's documents; the arrays have an entry for each number of the chunk, 0 being the end."""
    starts = np.cumsum(piece.lengths) - piece.lengths
    used, numbers = np.unique(piece.numbers, return_inverse=True)
    own, kinds = counts[used], units[used]
    contexts = np.where(own >= LEAST_CONTEXT, h32[used], shapes[used] + 1)
    contexts[used == 0] = 0
    sums = (np.add.reduceat(x[used][numbers], starts) for x in ((counts > 0).astype(np.int64), base, within))
    return Part(piece.ids, piece.marks, piece.lengths, *sums, kinds, contexts, numbers)


class Model:
    """Rows of `side` weights. A feature of a context is the word before, the word skipped to, or both; it has a row,
    found by hashing, for the softmax over classes, and the first two have one for that over each class's members."""

    def __init__(self, side: int, bias: tuple[np.ndarray, np.ndarray], weights: np.ndarray, calm: np.ndarray):
        self.side, self.bias, self.weights, self.calm = side, bias, weights, calm

    @classmethod
    def new(cls, units: Units, size: int) -> Model:
        rows = size // units.side
        return cls(units.side, units.bias(), np.zeros((rows, units.side), np.float32), np.full(rows, CALM, np.float32))

    def rows(self, one: np.ndarray, two: np.ndarray, node: np.ndarray | int) -> list[np.ndarray]:
        """The rows of each context's features in the softmax of a node: 0 for classes, 1 + class for its members, an array."""
        out, shift = [], np.uint64(64 - (len(self.weights).bit_length() - 1))
        with np.errstate(over="ignore"):
            both = ((one * _TURN) ^ (two + np.uint64(7)),) if isinstance(node, int) else ()
            for feature, x in enumerate((one, two, *both)):
                x = (x * np.uint64(4) + np.uint64(feature)) * _MIX + np.asarray(node, np.uint64) * _TURN
                x = (x ^ (x >> np.uint64(31))) * _TURN
                out.append((((x ^ (x >> np.uint64(29))) * _MIX) >> shift).astype(np.int64))
        return out

    def probabilities(self, rows: list[np.ndarray], bias: np.ndarray) -> np.ndarray:
        x = np.take(self.weights, rows[0], axis=0)
        for r in rows[1:]:
            x += np.take(self.weights, r, axis=0)
        x += bias
        np.minimum(x, np.float32(60), out=x)
        np.exp(x, out=x)
        x /= x.sum(1, keepdims=True)
        return x

    def log10(self, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """log10 P(unit | context) of each token."""
        own, member = np.divmod(units, self.side)
        at = np.arange(len(units))
        p = self.probabilities(self.rows(one, two, 0), self.bias[0])[at, own].astype(np.float64)
        p *= self.probabilities(self.rows(one, two, own + 1), self.bias[1][own])[at, member]
        return np.log10(np.maximum(p, 1e-300))

    def update(self, units: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        """One gradient step over some tokens; a row's steps shorten as its gradients add up."""
        own, member = np.divmod(units, self.side)
        at = np.arange(len(units))
        for rows, bias, hit in ((self.rows(one, two, 0), self.bias[0], own), (self.rows(one, two, own + 1), self.bias[1][own], member)):
            gradient = self.probabilities(rows, bias)
            gradient[at, hit] -= 1
            for r in rows:
                which, sums = summed(r, gradient)
                calm = self.calm[which] + np.einsum("ij,ij->i", sums, sums)
                self.calm[which] = calm
                sums *= (STEP / np.sqrt(calm))[:, None]
                self.weights[which] = np.take(self.weights, which, axis=0) - sums


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, and the sums of their values; rows that occur once are only copied."""
    order = np.argsort(rows)
    found = rows[order]
    first = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
    times = np.diff(np.append(first, len(found)))
    sums, many = np.take(values, order[first], axis=0), np.flatnonzero(times > 1)
    if len(many):
        sums[many] = np.add.reduceat(np.take(values, order[np.repeat(times > 1, times)], axis=0), np.cumsum(times[many]) - times[many])
    return found[first], sums


def corpus_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, kind, a, b, c, d, blob), one shuffle after the texts: kind 0 are words' training counts, returned to
    their chunks in blobs; 1 are pieces (a: number); 2 are sums over different words of a shape (chunk: shape; a, b, c,
    d: tokens, types, and types that occur once and twice); 3 are a task's most frequent words (a, b: hash, c: count).
    A word's rows, one for each chunk that has it, are summed over a sorted window that may spill."""
    rows = chunked(docs, id_col, text_col, lambda i: int(held(i)))
    counted = rows.withColumn("c", F.sum("n").over(Window.partitionBy("h1", "h2"))).select("chunk", "h1", "h2", "idx", "c", "blob")
    names, kinds = ["chunk", "kind", "a", "b", "c", "d", "blob"], [pa.int64(), pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def rows_of(**columns) -> pa.RecordBatch:
        n = len(columns["chunk"])
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, size, last = [], 0, (None, None)
        stats, top = np.zeros((SHAPES, 4), np.int64), []

        def back() -> pa.RecordBatch:
            chunk, idx, c, low, shape = (np.concatenate(x) for x in zip(*open_))
            order = np.lexsort((idx, chunk))
            chunk, idx, c, low, shape = (x[order] for x in (chunk, idx, c, low, shape))
            cuts = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
            blobs = []
            for a, b in zip(cuts, [*cuts[1:], len(chunk)]):
                raw = b"".join(x.tobytes() for x in (np.diff(idx[a:b], prepend=0).astype("<i4"), c[a:b].astype("<i8"), low[a:b].astype("<i8"), shape[a:b].astype("<u2")))
                blobs.append(zstandard.ZstdCompressor(level=1).compress(raw))
            return rows_of(chunk=chunk[cuts], kind=np.zeros(len(cuts), np.int32), blob=blobs)

        for batch in batches:
            chunk, h1, h2, idx, c = (batch.column(i).to_numpy() for i in range(5))
            pieces = np.flatnonzero(idx < 0)
            if len(pieces):
                yield rows_of(chunk=chunk[pieces], kind=np.ones(len(pieces), np.int32), a=(-1 - idx[pieces]).astype(np.int64), blob=batch.column(5).take(pa.array(pieces)))
                chunk, h1, h2, idx, c = (np.delete(x, pieces) for x in (chunk, h1, h2, idx, c))
            if not len(chunk):
                continue
            shape = h2 & (SHAPES - 1)
            open_.append((chunk, idx, c, h1, shape))
            new = np.concatenate(([(int(h1[0]), int(h2[0])) != last], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))) & (c > 0)
            last, size = (int(h1[-1]), int(h2[-1])), size + len(chunk)
            np.add.at(stats, shape[new], np.stack([c[new], np.ones(int(new.sum()), np.int64), c[new] == 1, c[new] == 2], axis=1))
            often = new & (c > (top[0][0] if len(top) == FREQUENT else 1))
            for row in zip(c[often].tolist(), h1[often].tolist(), h2[often].tolist()):
                (heapq.heappush if len(top) < FREQUENT else heapq.heappushpop)(top, row)
            if size >= 1 << 20:
                yield back()
                open_, size = [], 0
        if open_:
            yield back()
        used = np.flatnonzero(stats[:, 1])
        yield rows_of(chunk=used, kind=np.full(len(used), 2, np.int32), a=stats[used, 0], b=stats[used, 1], c=stats[used, 2], d=stats[used, 3])
        if top:
            count, a, b = (np.array(x, np.int64) for x in zip(*top))
            yield rows_of(chunk=np.zeros(len(top), np.int64), kind=np.full(len(top), 3, np.int32), a=a, b=b, c=count)
        open_, top = [], []
        give_back()

    return counted.mapInArrow(run, "chunk long, kind int, a long, b long, c long, d long, blob binary")


def prepared_parts(returned: DataFrame, units: Units, tokens: int, types: int, ends: int) -> DataFrame:
    """(slot, part): the Parts of all pieces. A chunk's counts come before its pieces in one task, which holds one
    chunk's arrays and one piece."""
    sent = returned.sparkSession.sparkContext.broadcast(units)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk, found, arrays = sent.value, None, [], None

        def whole() -> tuple[np.ndarray, ...]:
            made = []
            for raw in map(zstandard.ZstdDecompressor().decompress, found):
                n = len(raw) // 22
                made.append((np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64), np.frombuffer(raw, "<i8", n, 4 * n), np.frombuffer(raw, "<i8", n, 12 * n), np.frombuffer(raw, "<u2", n, 20 * n).astype(np.int64)))
            size = 1 + sum(len(x[0]) for x in made)
            counts, h1, shapes = (np.zeros(size, np.int64) for _ in range(3))
            there = np.zeros(size, bool)
            there[0], counts[0] = True, ends
            for idx, c, low, shape in made:
                counts[idx], h1[idx], shapes[idx], there[idx] = c, low, shape, True
            if not there.all():
                raise ValueError("a chunk lacks words")
            kinds = own.of(h1, shapes, counts)
            kinds[0] = 0
            return (h1.view(np.uint64) >> np.uint64(32)).astype(np.int64), shapes, counts, kinds, own.within(kinds, counts), np.log10((counts + 1.0) / (tokens + types + 1.0))

        for batch in batches:
            for c, kind, a, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if c != chunk:
                    chunk, found, arrays = c, [], None
                if kind == 0:
                    found.append(blob.as_py())
                    continue
                if arrays is None:
                    arrays, found = whole(), []
                part = part_of(Piece.from_bytes(blob.as_py()), *arrays)
                slot = zlib.crc32(b"%d %d" % (c, a)) % ROUNDS
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([part.to_bytes()], pa.binary())], ["slot", "part"])
        arrays = None
        give_back()

    dealt = returned.where("kind < 2").select("chunk", "kind", "a", "blob").repartition("chunk").sortWithinPartitions("chunk", "kind", "a")
    return dealt.mapInArrow(run, "slot int, part binary")


def learned(parts: DataFrame, n_parts: int, model: Model) -> list:
    """What the tasks' updates over n_parts parts come to: (row, weights' change, steps' decay, tasks) of each row of
    weights that was changed. Each task goes over its share of parts from the broadcast weights; changes are summed on
    the executors, ROWS_MERGED rows of weights in one place. There are as many tasks as the cluster has cores, or more
    where a task would have more than SHARE_PARTS parts."""
    sc = parts.sparkSession.sparkContext
    sent, side = sc.broadcast(model), model.side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = sent.value
        own = Model(side, start.bias, start.weights.copy(), start.calm.copy())
        for batch in batches:
            for blob in batch.column(0):
                for _, units, one, two in Part.from_bytes(blob.as_py()).tokens(True):
                    if len(units):
                        own.update(units, one, two)
        for at in range(0, len(own.weights), ROWS_MERGED):
            changed = at + np.flatnonzero(own.calm[at : at + ROWS_MERGED] != start.calm[at : at + ROWS_MERGED])
            if len(changed):
                raw = changed.astype("<i4").tobytes() + (own.calm - start.calm)[changed].astype("<f4").tobytes() + (own.weights[changed] - start.weights[changed]).astype("<f2").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(raw)], pa.binary())], ["at", "changes"])
        give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
                n = len(raw) // (8 + 2 * side)
                rows = np.frombuffer(raw, "<i4", n) - at
                if at not in sums:
                    sums[at] = np.zeros((ROWS_MERGED, side + 2), np.float32)
                sums[at][rows, 0] += 1
                sums[at][rows, 1] += np.frombuffer(raw, "<f4", n, 4 * n)
                sums[at][rows, 2:] += np.frombuffer(raw, "<f2", -1, 8 * n).reshape(n, side)
        for at, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([s.tobytes()], pa.binary())], ["at", "changes"])

    schema = "at int, changes binary"
    tasks = parts.coalesce(max(1, sc.defaultParallelism, -(-n_parts // SHARE_PARTS))).mapInArrow(run, schema)
    out = [(r["at"], np.frombuffer(r["changes"], np.float32).reshape(-1, side + 2)) for r in tasks.repartition("at").mapInArrow(merge, schema).toLocalIterator()]
    sent.destroy()
    return out


def train(parts: DataFrame, n_parts: int, units: Units, size: int, rounds: int = ROUNDS) -> Model:
    """The model after one pass over all training tokens, in `rounds` shares of the parts. After each, the tasks'
    changes of a row are averaged over the tasks that changed it, as in iterative parameter mixing."""
    model = Model.new(units, size)
    for slot in range(rounds):
        for at, s in learned(parts.where(F.col("slot") == slot).select("part"), -(-n_parts // ROUNDS), model):
            tasks = np.maximum(s[:, :1], 1)
            n = min(ROWS_MERGED, len(model.weights) - at)
            model.weights[at : at + n] += (s[:, 2:] / tasks)[:n]
            model.calm[at : at + n] += (s[:, 1] / tasks[:, 0])[:n]
    return model


def maxent_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row, over its whole text.

    Tokens are the words and an end. P(token | the two words before) = P(class | them) P(member | class, them)
    P(word | unit): members are the end, the most frequent words, each a unit, and units of words alike in ending and
    length. Both softmaxes are maximum-entropy models over the word before, the word skipped to and the pair, which are
    hashed as they are if LEAST_CONTEXT training tokens have the word, else by shape; P(word | unit) is the training
    share less a discount for unknown words. All is learned from rows whose crc32(id as text) mod 7 isn't 2.
    base_score is the add-one unigram score. Scores are log10 of probabilities of the text.

    Words are counted over all training texts by a shuffle that has each word, by 116 bits of a hash, once per chunk of
    documents (chunks.chunked), for any number of words; counts return to the chunks in blobs. Classes, units and
    weights grow with the corpus; bounded are the units, by MOST_SIDE squared, and the weights, by 2^MOST_WEIGHTS
    (32 MB), as every task holds them. Every training token takes part in training once. rounds=0: unigrams of units.

    Null text is empty: one token. Null ids count as training rows. Rows that repeat an id each give a row. Words of
    equal counts are ranked by hash. Very long texts are cut into words by blocks and scored TOKENS tokens at a time.
    Other columns are not read. No rows: none; no training rows: every token is unknown.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    returned, place = common.written(corpus_words(docs, id_col, text_col), "words")
    shapes = np.zeros((SHAPES, 4), np.int64)
    for r in returned.where("kind = 2").groupBy("chunk").agg(*(F.sum(c).alias(c) for c in "abcd")).collect():  # SHAPES rows at most
        shapes[r["chunk"]] = r["a"], r["b"], r["c"], r["d"]
    ends = docs.where(~F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 7 == 2, F.lit(False))).count()
    tokens, types = int(shapes[:, 0].sum()) + ends, int(shapes[:, 1].sum()) + bool(ends)
    side = side_for(types)
    top = returned.where("kind = 3").orderBy(F.desc("c"), "a", "b").limit(side * side * 7 // 8 - 1).select("a", "b", "c").collect()
    units, pieces = Units.made(side, [tuple(r) for r in top], shapes, ends), returned.where("kind = 1").count()
    path = common.new_folder(spark, "parts")
    prepared_parts(returned, units, tokens, types, ends).write.partitionBy("slot").parquet(path)
    common.drop_folder(spark, place)
    parts = spark.read.schema("part binary, slot int").parquet(path)
    model = train(parts, pieces, units, weights_for(tokens), rounds if ends else 0)
    sent = spark.sparkContext.broadcast(model)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                p = Part.from_bytes(blob.as_py())
                each = np.empty(len(p.numbers))
                for at, units, one, two in p.tokens(False):
                    each[at : at + len(units)] = sent.value.log10(units, one, two)
                scores = p.within + np.add.reduceat(each, np.cumsum(p.lengths) - p.lengths)
                arrays = [pa.array(p.ids, pa.int64()), pa.array(p.marks == 1), pa.array(p.lengths), pa.array(p.known), pa.array(np.full(len(p.ids), tokens, np.int64)), pa.array(p.base), pa.array(scores)]
                yield pa.RecordBatch.from_arrays(arrays, [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return parts.select("part").mapInArrow(finish, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
