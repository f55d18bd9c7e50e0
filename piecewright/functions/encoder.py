"""Encoding whole texts: the kernel, and the Column function that runs it on Arrow batches."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..sources.model import BPE, META, METASPACE, SPLIT_METASPACE, UNUSED, USER_DEFINED, Model
from .bpe import Bpe
from .normalize import Normalizer
from .pretokenize import AddedTokens, pre_tokenizer, split_words
from .unigram import Unigram, UnigramBatch

TYPE = "struct<ids: array<int>, pieces: array<string>>"


def cuts_are_exact(model: Model) -> bool:
    """Whether encoding the stretches between ▁ one by one gives what encoding the whole text does (for Unigram, but for
    float32 near-ties): no piece has ▁ after its first character, and no BPE piece is unused."""
    if model.kind == BPE and any(t == UNUSED for t in model.types):
        return False
    reach = model.index if model.kind == BPE else model.matchable
    return not any(META in p[1:] for p in reach)


def run_cuts_are_exact(model: Model) -> bool:
    """The same for stretches that begin with a run of ▁: no piece has ▁ after another character."""
    if model.kind == BPE and any(t in (UNUSED, USER_DEFINED) for t in model.types):
        return False
    reach = model.index if model.kind == BPE else model.matchable
    return not any(META in p.lstrip(META) for p in reach)


#: Begins what is remembered as it is.
WHOLE = "\x00"
#: Texts and bytes that are encoded together. An Arrow batch may be 10,000 long texts, of which Python's strings and the
#: arrays between take many times the room.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def _segment_of(key: str) -> str:
    return key[1:] if key[0] == WHOLE else META + key


class Encoder:
    """A model's encoding of texts. Segments that were seen before are looked up; what is remembered is bounded, by
    number and by characters, as a segment may be a whole text."""

    REMEMBERED, REMEMBERED_CHARS, LONGEST = 200_000, 16 << 20, 64

    def __init__(self, model: Model, cut: bool = False):
        self.model, self.normalize, self.added = model, Normalizer(model), AddedTokens(model)
        self.segment = Bpe(model) if model.kind == BPE else Unigram(model)
        self.pre = pre_tokenizer(model)
        if cut and self.pre is None:
            if not run_cuts_are_exact(model):
                raise ValueError("pieces of this model cross word borders; texts can't be cut into words")
            self.pre = re.compile(f"{META}*[^{META}]+|{META}+", re.S).findall
        self.keys = self._keys()
        self.seen: dict[str, list[tuple[int, str]]] = {}
        self.seen_pieces = 0
        self.many = UnigramBatch(model) if self.pre is not None and model.kind != BPE else None
        self.names = pa.array(model.pieces, pa.string())
        self.lengths = np.array([len(p) for p in model.pieces], np.int64)
        # Whether added tokens are the vocabulary's pieces, so that ids tell their texts.
        self.added_plain = all(0 <= i < len(model.pieces) and model.pieces[i] == c and i != model.unk_id for c, i in self.added.ids.items())
        self._forget()

    def _keys(self) -> Callable[[str], list[str]]:
        """Cuts a raw text into what its segments are remembered by: a word that stands for itself after ▁, or WHOLE and
        a segment. Words are had by cutting at white space, without a string made for each."""
        pre, normalize, m = self.pre, self.normalize, self.model
        plain = not (m.add_dummy_prefix or m.remove_extra_whitespaces or m.escape_whitespaces or m.charsmap)
        if m.pre_tokenizer == SPLIT_METASPACE and plain:
            return lambda text: split_words(text) if WHOLE not in text else [WHOLE + META + w for w in split_words(text)]
        if pre is None:
            return lambda text: [WHOLE + normalize(text)]
        spaced = m.pre_tokenizer not in (METASPACE, SPLIT_METASPACE) and m.add_dummy_prefix and m.escape_whitespaces and not (m.remove_extra_whitespaces or m.charsmap)

        def cut(text: str) -> list[str]:
            if spaced and "  " not in text and text[0] != " " and text[-1] != " " and META not in text and WHOLE not in text:
                return text.split(" ")
            return [WHOLE + s for s in pre(normalize(text))]

        return cut

    def _forget(self) -> None:
        # Numbers come from a counter: a factory that knows the dictionary would keep it, until garbage is next collected.
        self.number: defaultdict[str | int, int] = defaultdict(count().__next__)
        self.chars = 0
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Segments what has got a number since the last time."""
        keys = list(islice(self.number, len(self.offsets) - 1, None))
        if not keys:
            return
        new = [_segment_of(k) if isinstance(k, str) else "" for k in keys]
        self.chars += sum(map(len, new))
        if self.many is not None:
            short = [w if len(w) <= self.LONGEST else "" for w in new]
            ids, offsets = self.many(short)
            long = [k for k, w in enumerate(new) if len(w) > self.LONGEST or isinstance(keys[k], int)]
        else:
            ids, offsets, long = np.zeros(0, np.int32), np.zeros(len(new) + 1, np.int64), range(len(new))
        if long:
            parts = np.split(ids, offsets[1:-1])
            for k in long:
                parts[k] = np.array([keys[k]] if isinstance(keys[k], int) else [i for i, _ in self.segment(new[k])], np.int32)
            ids, offsets = np.concatenate(parts).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        self.flat, self.offsets = np.concatenate([self.flat, ids]), np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])

    def _words(self, text: str) -> list[str | int]:
        """A raw text's keys; those of added tokens are their ids."""
        if not self.added.found(text):
            return self.keys(text)
        return [k for part, i in self.added.split(text) for k in (self.keys(part) if i is None else (i,))]

    def spelled(self, text: str, ids: np.ndarray) -> list[str] | None:
        """The texts of the runs of unknown ids among a text's ids, as batch() gives them; None if an unknown piece has
        more than a character."""
        whole = "".join([_segment_of(k) if isinstance(k, str) else self.model.pieces[k] for k in self._words(text)])
        unknown = ids == self.model.unk_id
        ends = np.cumsum(np.where(unknown, 1, self.lengths[ids]))
        if ends[-1] != len(whole):
            return None
        edges = np.flatnonzero(np.diff(unknown.astype(np.int8), prepend=0, append=0))
        first, last = edges[::2], edges[1::2] - 1
        return [whole[a:b] for a, b in zip((ends[first] - 1).tolist(), ends[last].tolist())]

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each begins and the last ends), with a row of unknown ids as that many: for
        models with a pre-tokenizer, whose words are numbers into what is remembered."""
        if len(self.number) > self.REMEMBERED or self.chars > self.REMEMBERED_CHARS:
            self._forget()
        words = [self._words(t) if t else () for t in texts]
        numbers = [np.fromiter(map(self.number.__getitem__, w), np.int64, len(w)) for w in words]
        self._learn()
        every = np.concatenate([*numbers, np.zeros(0, np.int64)])
        sizes = self.offsets[every + 1] - self.offsets[every]
        upto = np.concatenate(([0], np.cumsum(sizes)))
        ids = self.flat[np.repeat(self.offsets[every] - upto[:-1], sizes) + np.arange(upto[-1])]
        return ids, upto[np.concatenate(([0], np.cumsum([len(w) for w in words], dtype=np.int64)))]

    def _known(self, segment: str) -> list[tuple[int, str]]:
        if len(segment) > self.LONGEST:
            return self.segment(segment)
        if (found := self.seen.get(segment)) is None:
            if self.seen_pieces > self.REMEMBERED:
                self.seen.clear()
                self.seen_pieces = 0
            found = self.seen[segment] = self.segment(segment)
            self.seen_pieces += len(found) + 1
        return found

    def _regular(self, text: str) -> Iterator[tuple[int, str]]:
        text = self.normalize(text)
        if self.pre is None:
            yield from self.segment(text)
        else:
            for s in self.pre(text):
                yield from self._known(s)

    def __call__(self, text: str) -> list[tuple[int, str]]:
        """(id, piece) in order. Runs of unknown pieces are one, unless the model falls back to bytes."""
        out: list[tuple[int, str]] = []
        for part, added in self.added.split(text):
            if added is None:
                out.extend(self._regular(part))
            else:
                out.append((added, part))
        return out if self.model.byte_fallback else merge_unknown(out, self.model.unk_id)


def merge_unknown(pieces: list[tuple[int, str]], unk_id: int) -> list[tuple[int, str]]:
    out: list[tuple[int, str]] = []
    run: list[str] = []
    for i, p in pieces:
        if i == unk_id:
            run.append(p)
            continue
        if run:
            out.append((unk_id, "".join(run)))
            run = []
        out.append((i, p))
    if run:
        out.append((unk_id, "".join(run)))
    return out


_ENCODERS: dict[str, Encoder] = {}


def slices(rows: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """An Arrow array of texts, or of lists of them, in stretches of few rows and bytes, one row at least. A copy is
    never made."""
    at, texts = np.arange(len(rows) + 1), rows
    while pa.types.is_list(texts.type) or pa.types.is_large_list(texts.type):
        at, texts = _offsets(texts)[at], texts.values
    upto = _offsets(texts)[at]
    begin = 0
    if not len(rows):
        yield rows
    while begin < len(rows):
        end = int(np.searchsorted(upto, upto[begin] + size, "right")) - 1
        end = min(max(end, begin + 1), begin + SLICE_ROWS, len(rows))
        yield rows.slice(begin, end - begin)
        begin = end


def _offsets(rows: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(rows.type) or pa.types.is_large_list(rows.type) else np.int32
    if not len(rows):
        return np.zeros(1, np.int64)
    return np.frombuffer(rows.buffers()[1], kind)[rows.offset : rows.offset + len(rows) + 1].astype(np.int64)


def encode_arrow(encoder: Encoder, texts: pa.Array, pieces: bool = True) -> pa.StructArray:
    """Texts as struct<ids, pieces>; null stays null.

    Texts of models with a pre-tokenizer go through Encoder.batch, where ids are gathered by number and their pieces
    are the vocabulary's, or for unknown ones parts of the text; what words in order don't spell is encoded one by one.
    """
    rows, m = texts.to_pylist(), encoder.model
    slow = range(len(rows))
    made: dict[int, tuple[np.ndarray, list[str]]] = {}
    ids, cuts = np.zeros(0, np.int32), np.zeros(len(rows) + 1, np.int64)
    names, spelled = np.zeros(0, np.int64), []
    if encoder.pre is not None:
        slow = [] if encoder.added_plain else [k for k, t in enumerate(rows) if t and encoder.added.found(t)]
        odd = set(slow)
        ids, cuts = encoder.batch([None if k in odd else t for k, t in enumerate(rows)])
        unknown = ids == m.unk_id
        found = np.unique(np.searchsorted(cuts, np.flatnonzero(unknown), "right") - 1).tolist() if pieces or not m.byte_fallback else []
        names = np.full(len(ids), -1, np.int64)
        if found and not m.byte_fallback:
            # Of a run of unknown ids in a text the first stays.
            again = np.zeros(len(ids), bool)
            again[1:] = unknown[1:] & unknown[:-1]
            again[cuts[:-1][cuts[:-1] < len(ids)]] = False
            if pieces:
                for k in found:
                    own = encoder.spelled(rows[k], ids[cuts[k] : cuts[k + 1]])
                    if own is None:
                        odd.add(k)
                        own = [""] * int(np.count_nonzero((unknown & ~again)[cuts[k] : cuts[k + 1]]))
                    spelled += own
                slow = sorted(odd)
                names[unknown & ~again] = np.arange(len(spelled))
            ids, names = ids[~again], names[~again]
            cuts = cuts - np.concatenate(([0], np.cumsum(again)))[cuts]
        elif found:
            slow = sorted(odd.union(found))
    for k in slow:
        if rows[k]:
            own = encoder(rows[k])
            made[k] = np.array([i for i, _ in own], np.int32), [p for _, p in own] if pieces else []
    if made:
        parts, lengths, names_of, last = [], [], [], 0
        for k, (own_ids, own_pieces) in sorted(made.items()):
            keep = slice(cuts[last], cuts[k])
            parts += [ids[keep], own_ids]
            names_of += [names[keep], len(spelled) + np.arange(len(own_ids))]
            lengths.append((k, len(own_ids)))
            spelled += own_pieces
            last = k + 1
        parts.append(ids[cuts[last] :])
        names_of.append(names[cuts[last] :])
        sizes = np.diff(cuts)
        for k, size in lengths:
            sizes[k] = size
        ids, names, cuts = np.concatenate(parts), np.concatenate(names_of), np.concatenate(([0], np.cumsum(sizes)))
    offsets = pa.array(cuts.astype(np.int32))
    columns = [pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))]
    if pieces:
        own = names >= 0
        texts_of = pa.concat_arrays([encoder.names, pa.array(spelled, pa.string())])
        columns.append(pa.ListArray.from_arrays(offsets, texts_of.take(pa.array(np.where(own, len(m.pieces) + names, ids)))))
    else:
        columns.append(pa.nulls(len(rows), pa.list_(pa.string())))
    return pa.StructArray.from_arrays(columns, ["ids", "pieces"], mask=pa.array(np.array([t is None for t in rows], bool)))


def _encoder(token: str, sent, cut: bool) -> Encoder:
    if token not in _ENCODERS:
        if len(_ENCODERS) >= 4:
            _ENCODERS.clear()
        _ENCODERS[token] = Encoder(sent.value, cut)
    return _ENCODERS[token]


def encoder_function(spark: SparkSession, model: Model, cut: bool = False, pieces: bool = True):
    """A function from a text column to struct<ids, pieces>. One call gives both, so that no text is encoded twice.

    The model is broadcast once; each Python worker builds its encoder once, also for several queries, and keeps what it
    has segmented. cut: texts
    of models without a pre-tokenizer are encoded stretch by stretch (see run_cuts_are_exact). pieces=False leaves the
    pieces null, which halves what returns from Python.
    """
    sent, token = spark.sparkContext.broadcast(model), f"{model.key} {cut}"

    @F.arrow_udf(TYPE)
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(token, sent, cut)
        for texts in (part for batch in batches for part in slices(batch)):
            yield encode_arrow(encoder, texts, pieces)

    return encode


def batch_function(spark: SparkSession, model: Model, cut: bool = False):
    """The same for arrays of texts: array<array<int>>."""
    sent, token = spark.sparkContext.broadcast(model), f"{model.key} {cut}"

    @F.arrow_udf("array<array<int>>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(token, sent, cut)
        for rows in (part for batch in batches for part in slices(batch)):
            made = encode_arrow(encoder, rows.flatten(), pieces=False)
            inner = made.field(0)
            inner = pa.ListArray.from_arrays(inner.offsets, inner.values, mask=made.is_null())
            sizes = np.array([0 if r is None else len(r) for r in rows.to_pylist()], np.int32)
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), inner, mask=rows.is_null())

    return encode
