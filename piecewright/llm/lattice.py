"""SentencePiece encoding and decoding by a relational lattice of word pieces."""

from __future__ import annotations

import re
import uuid
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.normalize import Normalizer
from ..functions.unigram import UnigramBatch
from ..sources.model import BPE, META, NORMAL, USER_DEFINED, Model, byte_piece
from . import common

#: What an uncovered character costs below the least likely piece.
UNKNOWN_PENALTY = 10.0
#: Characters of a word whose substrings are cut at a time, so that very long words take linear time.
BLOCK = 256
#: Words of a partition whose edges an aggregation holds in memory, at about 0.5 KB a word; beyond, it sorts and spills.
IN_MEMORY = 1 << 18
#: Words that a Python worker remembers, and their characters, as a word may be a whole text.
REMEMBERED, REMEMBERED_CHARS = 400_000, 16 << 20
#: Longer words are folded one by one, place by place, rather than all at once.
LONG_WORD = 512


def piece_scores(model: Model) -> dict[int, float]:
    """id -> log probability of the pieces a lattice may use.

    Unigram models carry them. BPE models carry only the order of their merges; there the pieces get Zipf's law by that
    order, 1 / (rank + 2), normalised.
    """
    ids = [i for i, p in enumerate(model.pieces) if p and model.types[i] in (NORMAL, USER_DEFINED) and model.index[p] == i]
    if model.kind != BPE:
        top = model.score_bounds[1]
        return {i: float(model.scores[i]) if model.types[i] == NORMAL else len(model.pieces[i].encode()) * top - 0.1 for i in ids}
    ranked = sorted(ids, key=lambda i: (-float(model.scores[i]), i))
    total = float(np.log((1 / (np.arange(len(ranked)) + 2)).sum()))
    return {i: -float(np.log(rank + 2)) - total for rank, i in enumerate(ranked)}


def word_splitter(model: Model) -> Callable[[str], list[str]]:
    """Normalizes a text and cuts it where no piece can cross: before a run of ▁, and before line ends.

    Words come as keys, from which whole_word makes the word: most are words without their ▁, as these can be had by
    cutting a text at its spaces.
    """
    known, normalizer = [p for p in model.matchable if len(p) > 1], Normalizer(model)
    if any(META in p.lstrip(META) for p in known):
        return lambda text: [JOINED + x] if (x := normalizer(text)) else []
    if any("\n" in p for p in known):
        find = re.compile(f"{META}*[^{META}]+|{META}+").findall
        return lambda text: [JOINED + w for w in find(normalizer(text))]
    find = re.compile(f"(?:{META}+|\n|^)[^{META}\n]*").findall
    simple = model.add_dummy_prefix and model.escape_whitespaces and not (model.remove_extra_whitespaces or model.charsmap)

    def key(word: str) -> str:
        if word[0] == "\n":
            return word
        return word[1:] if word[0] == META and word[1:2] not in (META, JOINED) else JOINED + word

    def cut(text: str) -> list[str]:
        if simple and text and "  " not in text and text[0] != " " and META not in text and JOINED not in text:
            return text.replace("\n", " \n").split(" ")
        return [key(w) for w in find(normalizer(text)) if w]

    return cut


#: Begins the keys of words that are to be taken as they are; keys without it that don't begin with a line end lack ▁.
JOINED = "\x00"


def whole_word(word: Column) -> Column:
    """The word of a key."""
    return F.when(F.startswith(word, F.lit(JOINED)), F.expr("substring(word, 2)")).when(F.startswith(word, F.lit("\n")), word).otherwise(F.concat(F.lit(META), word))


def pieces_table(spark: SparkSession, model: Model) -> DataFrame:
    """pieces(piece, id, score)."""
    return spark.createDataFrame([(model.pieces[i], i, s) for i, s in piece_scores(model).items()], "piece string, id int, score double")


# An edge is one long, so that lists of edges are small and sort by end and then by start: its end, 255 less its
# length, and a code, which is the piece's id or, from UNCOVERED on, a character's code point.
UNCOVERED = 1 << 21
_EDGE = f"shiftleft(cast(s + n as long), 30) + shiftleft(cast(255 - n as long), 22) + coalesce(id, {UNCOVERED} + ascii(piece))"

# The fold over a word's edges. State: p the position reached, c the best way to it (x score, s where its last edge
# starts, i that edge's code), b the best ways to all positions before. The first of equal ways stays, which is the one
# whose last piece is longest.
_OPEN = """transform(edges, e -> named_struct('p', cast(shiftright(e, 30) as int),
  's', cast(shiftright(e, 30) - 255 + (shiftright(e, 22) & 255) as int), 'i', cast(e & 4194303 as int)))"""
_FOLD = """aggregate(open,
  named_struct('p', 0, 'c', named_struct('x', 0D, 's', -1, 'i', 0), 'b', cast(array() as array<struct<x:double,s:int,i:int>>)),
  (a, e) -> CASE WHEN e.p > a.p THEN named_struct('p', e.p, 'c', named_struct('x', IF(e.s = a.p, a.c.x, a.b[e.s].x) + coalesce(get(scores, e.i), {unknown}D), 's', e.s, 'i', e.i), 'b', concat(a.b, array(a.c)))
                 WHEN a.b[e.s].x + coalesce(get(scores, e.i), {unknown}D) > a.c.x THEN named_struct('p', a.p, 'c', named_struct('x', a.b[e.s].x + coalesce(get(scores, e.i), {unknown}D), 's', e.s, 'i', e.i), 'b', a.b)
                 ELSE a END,
  a -> concat(a.b, array(a.c)))"""

# Back from the last position: w is the position wanted next.
_BACK = """aggregate(sequence(size(best) - 1, 1, -1), named_struct('w', size(best) - 1, 'o', cast(array() as array<int>)),
  (a, k) -> IF(k = a.w, named_struct('w', best[k].s, 'o', concat(array(best[k].i), a.o)), a),
  a -> a.o)"""


def encode_words(words: DataFrame, model: Model, text: Column | None = None) -> DataFrame:
    """(word, ids): the best segmentation of each distinct, non-empty word; -1 - codepoint is an uncovered character.

    Relational lattice: substrings of at most the longest piece's length are exploded and equi-joined to the piece
    table (a vocabulary file, broadcast as its size is that of the file); the matches are the lattice's edges, grouped
    by word, and a higher-order aggregate folds Viterbi over them. Words already partitioned by `word` aren't shuffled.
    text: an expression of what to segment, if `word` only names it.
    """
    spark, longest = words.sparkSession, max(model.longest, 1)
    if longest > 255 or len(model.pieces) > UNCOVERED:
        raise ValueError("pieces of over 255 characters, or over 2^21 pieces")
    scores = piece_scores(model)
    unknown = (min(scores.values()) if scores else 0.0) - UNKNOWN_PENALTY
    # Words of a partition whose edges are gathered in memory before the aggregation goes over to sorting.
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(IN_MEMORY))
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.length("w") - 1) / BLOCK).cast("int")))
    whole = words.select("word", (F.col("word") if text is None else text).alias("w"))
    cut = whole.select("word", "w", blocks.alias("k")).select("word", "k", F.expr(f"substring(w, k * {BLOCK} + 1, {BLOCK + longest - 1})").alias("part"))
    starts = cut.select("word", "k", "part", F.explode(F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("part")))).alias("s"))
    spans = starts.select("word", "k", "part", "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("part") - F.col("s") + 1))).alias("n"))
    subs = spans.select("word", (F.col("k") * BLOCK + F.col("s") - 1).alias("s"), "n", F.expr("substring(part, s, n)").alias("piece"))
    met = subs.join(F.broadcast(pieces_table(spark, model)), "piece", "left").where("id is not null or n = 1").select("word", F.expr(_EDGE).alias("e"))
    grouped = met.groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("edges"))
    table = F.from_json(F.lit("[" + ",".join(repr(scores[i]) if i in scores else "null" for i in range(len(model.pieces))) + "]"), "array<double>")
    best = grouped.select("word", F.expr(_OPEN).alias("open")).select("word", "open", table.alias("scores")).select("word", F.expr(_FOLD.replace("{unknown}", repr(unknown))).alias("best"))
    return best.select("word", F.expr(_BACK).alias("codes")).select("word", F.transform("codes", lambda c: F.when(c >= UNCOVERED, UNCOVERED - 1 - c).otherwise(c)).alias("ids"))


def unknown_ids(model: Model, code: int) -> list[int]:
    """What stands for an uncovered character: its UTF-8 bytes' pieces under byte fallback, else the unknown piece."""
    if not model.byte_fallback:
        return [model.unk_id]
    return [model.piece_to_id(byte_piece(b)) for b in chr(code).encode("utf-8", "surrogatepass")]


def _spread(flat: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices numbered `at` in a row, and their lengths."""
    lengths = offsets[at + 1] - offsets[at]
    ends = np.cumsum(lengths)
    return flat[np.repeat(offsets[at] - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], lengths


class LatticeBatch(UnigramBatch):
    """The lattice of many words at once in numpy: their substrings up to the longest piece, by place and length, are
    joined to the piece table by sorted hashes; the matches are the edges, and Viterbi is folded over their ends. The
    same edges, double scores and order as encode_words, so the same result. Words of over LONG_WORD characters are
    folded one by one in the same order."""

    FLOAT = np.float64

    def __init__(self, model: Model):
        self.model, scores = model, piece_scores(model)
        self.unknown = (min(scores.values()) if scores else 0.0) - UNKNOWN_PENALTY
        self.fallback: dict[int, tuple[float, list[int]]] = {}
        self.known = {model.pieces[i]: (i, x) for i, x in scores.items()}
        self._tables(self.known)

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        long = [k for k, w in enumerate(segments) if len(w) > LONG_WORD]
        if not long:
            return super().__call__(segments)
        short = list(segments)
        for k in long:
            short[k] = ""
        ids, offsets = super().__call__(short)
        parts = np.split(ids, offsets[1:-1])
        for k in long:
            parts[k] = self._alone(segments[k])
        return np.concatenate(parts).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in parts])))

    def _alone(self, text: str) -> np.ndarray:
        n, known, longest = len(text), self.known, self.longest
        best, came, ids = array("d", bytes(8 * (n + 1))), array("q", [-1]) * (n + 1), array("q", bytes(8 * (n + 1)))
        for start in range(n):
            here, alone = best[start], False
            for end in range(start + 1, min(n, start + longest) + 1):
                hit = known.get(text[start:end])
                if hit is not None:
                    alone = alone or end == start + 1
                    if came[end] < 0 or here + hit[1] > best[end]:
                        best[end], came[end], ids[end] = here + hit[1], start, hit[0]
            if not alone and (came[start + 1] < 0 or here + self.unknown > best[start + 1]):
                best[start + 1], came[start + 1], ids[start + 1] = here + self.unknown, start, -1 - ord(text[start])
        out, at = [], n
        while at:
            out.append([ids[at]] if ids[at] >= 0 else self._uncovered(-1 - ids[at])[1])
            at = came[at]
        return np.array([i for own in reversed(out) for i in own], np.int32)

    def _uncovered(self, code: int) -> tuple[float, list[int]]:
        if code not in self.fallback:
            self.fallback[code] = self.unknown, unknown_ids(self.model, code)
        return self.fallback[code]


class _Memory:
    """The words that a Python worker has segmented, by number: their ids, and the bytes that these decode to."""

    def __init__(self, model: Model):
        self.many, self.split = LatticeBatch(model), word_splitter(model)
        self.bytes_of = [bytes(model.bytes_of(i)) for i in range(len(model.pieces))]
        self.forget()

    def forget(self) -> None:
        self.number: defaultdict[str, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.chars = 0
        self.flat, self.offsets, self.back = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.number) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        found = [self.split(t) for t in texts]
        out = [np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)) for w in found]
        new = [k[1:] if k[:1] == JOINED else k if k[:1] == "\n" else META + k for k in islice(self.number, len(self.back), None)]
        if new:
            self.chars += sum(map(len, new))
            ids, offsets = self.many(new)
            self.flat, self.offsets = np.concatenate([self.flat, ids]), np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
            spelled = [self.bytes_of[i] if 0 <= i < len(self.bytes_of) else b"" for i in ids.tolist()]
            self.back += [b"".join(spelled[a:b]) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        return out


_MEMORIES: dict[str, _Memory] = {}


def lattice_encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) for each row: the piece ids of its whole text, and the text that these decode to.

    Texts are normalized as the model says and cut into words where no piece can cross; the lattice of the words that
    are new to a worker is built and folded for a batch at once (LatticeBatch), and ids are gathered by the words'
    numbers, so nothing is shuffled. What a worker remembers is bounded; the model's size is that of its file.
    Uncovered characters become byte pieces, or the unknown piece (runs of which are one id); decoding turns ▁ into
    spaces and drops the one that the dummy prefix added, so that texts without ▁ of their own come back unchanged
    under byte fallback. Of equal paths the one whose last piece is longest stays. Null and empty texts: no ids, empty
    text. Null ids stay null, rows that repeat an id each give a row, an empty table gives none; other columns are not
    read. Very long texts take memory in proportion to their length, words without an end too.
    """
    spark = docs.sparkSession
    common.prepare(spark)
    sent, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        if token not in _MEMORIES:
            _MEMORIES.clear()
            _MEMORIES[token] = _Memory(m)
        memory = _MEMORIES[token]
        for batch in batches:
            words = memory.numbers([t or "" for t in batch.column(1).to_pylist()])
            tokens, each = _spread(memory.flat, memory.offsets, np.concatenate([*words, np.zeros(0, np.int64)]))
            cuts = np.concatenate(([0], np.cumsum(each)))[np.concatenate(([0], np.cumsum([len(w) for w in words])))]
            texts = [b"".join([memory.back[w] for w in own.tolist()]) for own in words]
            if not m.byte_fallback:
                tokens, cuts, texts = merge_unknown(tokens, cuts, m.unk_id, memory.bytes_of)
            texts = [t[1:] if m.strip_leading_space and t.startswith(b" ") else t for t in texts]
            ids = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(tokens.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], [id_col, "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, ids array<int>, decoded string")


def merge_unknown(tokens: np.ndarray, cuts: np.ndarray, unk: int, table: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Runs of the unknown piece within a document as one id, and the documents' texts."""
    first = np.zeros(len(tokens) + 1, bool)
    first[cuts] = True
    again = (tokens == unk) & np.concatenate(([False], tokens[:-1] == unk)) & ~first[:-1]
    upto = np.concatenate(([0], np.cumsum(~again)))
    tokens, cuts = tokens[~again], upto[cuts]
    return tokens, cuts, [b"".join([table[i] for i in tokens[a:b].tolist()]) for a, b in zip(cuts, cuts[1:])]
