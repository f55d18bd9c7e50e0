"""Tokenizer models: loading from protobuf and JSON files, and the tables they give."""

from __future__ import annotations

import base64
import binascii
import hashlib
import importlib.resources
import json
from dataclasses import dataclass, field, replace
from dataclasses import fields as fields_of
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..errors import InvalidModelError, UnsupportedModelError
from ..plans.template import Part, Template
from .wire import fields, signed

META = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = range(1, 7)
#: What an unknown piece is written as by decoding.
UNKNOWN_TEXT = " ⁇ "
PLAIN, METASPACE, SPLIT_METASPACE = "none", "metaspace", "whitespace_split_metaspace"
_FLOAT_MAX = float(np.finfo(np.float32).max)


def is_byte_piece(piece: str) -> bool:
    return len(piece.encode("utf-8", "surrogatepass")) == 6 and piece.startswith("<0x") and piece.endswith(">")


def byte_value(piece: str) -> int | None:
    """The byte of a <0xHH> piece, either case; None if it isn't one."""
    if not is_byte_piece(piece):
        return None
    try:
        return int(piece[3:5], 16) if all(ch in "0123456789abcdefABCDEF" for ch in piece[3:5]) else None
    except ValueError:
        return None


def byte_piece(value: int) -> str:
    return f"<0x{value:02X}>"


@dataclass(frozen=True)
class AddedToken:
    id: int
    content: str
    special: bool


@dataclass(frozen=True, eq=False)
class Model:
    """A vocabulary and its settings. Immutable; everything derived from it is computed once."""

    kind: int
    pieces: tuple[str, ...]
    scores: np.ndarray
    types: np.ndarray
    unk_id: int = 0
    bos_id: int = 0
    eos_id: int = 0
    pad_id: int = 0
    byte_fallback: bool = False
    add_dummy_prefix: bool = False
    remove_extra_whitespaces: bool = False
    escape_whitespaces: bool = False
    charsmap: bytes = b""
    pre_tokenizer: str = PLAIN
    added_tokens: tuple[AddedToken, ...] = ()
    template: Template | None = None
    from_json: bool = False
    skip_zero_scores: bool = False
    name: str = field(default="model")

    @cached_property
    def key(self) -> str:
        """Names all that encoding and decoding depend on, so that workers know a model they have met before."""
        known = [getattr(self, f.name) for f in fields_of(self) if f.name not in ("name", "scores", "types")]
        return hashlib.sha256(repr(known).encode("utf-8", "surrogatepass") + self.scores.tobytes() + self.types.tobytes()).hexdigest()

    @cached_property
    def index(self) -> dict[str, int]:
        """piece -> id; of equal pieces the last. Ids that a JSON vocabulary leaves out have no piece to find."""
        return {p: i for i, p in enumerate(self.pieces) if self.types[i] or p}

    @cached_property
    def matchable(self) -> dict[str, int]:
        """piece -> id of what Unigram segmentation may match: normal and user-defined pieces."""
        return {p: i for i, p in enumerate(self.pieces) if p and self.types[i] in (NORMAL, USER_DEFINED)}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.matchable), default=0)

    @cached_property
    def score_bounds(self) -> tuple[float, float]:
        """Least and greatest score of normal pieces; JSON models pass over scores of 0."""
        of = self.scores[(self.types == NORMAL) & ((self.scores != 0) if self.skip_zero_scores else True)]
        return (float(of.min()), float(of.max())) if len(of) else (_FLOAT_MAX, -_FLOAT_MAX)

    @cached_property
    def user_defined(self) -> dict[str, int]:
        return {p: i for p, i in self.matchable.items() if self.types[i] == USER_DEFINED}

    @property
    def strip_leading_space(self) -> bool:
        """Whether decoding takes one leading space off: protobuf models with a dummy prefix."""
        return self.add_dummy_prefix and not (self.from_json and self.pre_tokenizer != PLAIN)

    @property
    def matched_added_tokens(self) -> tuple[AddedToken, ...]:
        """Added tokens that are sought in raw text: neither special nor byte pieces."""
        return tuple(t for t in self.added_tokens if not t.special and not is_byte_piece(t.content) and t.content)

    def piece_to_id(self, piece: str) -> int:
        return self.index.get(piece, self.unk_id)

    def id_to_piece(self, i: int) -> str:
        return self.pieces[i] if 0 <= i < len(self.pieces) else ""

    def bytes_of(self, i: int) -> bytes:
        """What an id adds to decoded text."""
        if not 0 <= i < len(self.pieces):
            return b""
        piece, kind = self.pieces[i], self.types[i]
        if kind == CONTROL:
            return b""
        if kind == UNKNOWN:
            return UNKNOWN_TEXT.encode()
        if kind == BYTE and (b := byte_value(piece)) is not None:
            return bytes([b])
        return piece.replace(META, " ").encode("utf-8", "surrogatepass")

    # Tables

    def vocab(self, spark: SparkSession) -> DataFrame:
        """vocab(id, piece, score, type, piece_bytes)."""
        rows = [(i, p, float(self.scores[i]), int(self.types[i]), bytearray(self.bytes_of(i))) for i, p in enumerate(self.pieces)]
        return spark.createDataFrame(rows, "id int, piece string, score float, type int, piece_bytes binary")

    def config(self, spark: SparkSession) -> DataFrame:
        """One row of the model's settings."""
        low, high = self.score_bounds
        row = (self.name, self.kind, len(self.pieces), self.unk_id, self.bos_id, self.eos_id, self.pad_id, self.byte_fallback, self.add_dummy_prefix, self.remove_extra_whitespaces, self.escape_whitespaces, self.pre_tokenizer, self.strip_leading_space, low, high)
        return spark.createDataFrame([row], "model_id string, model_type int, vocab_size int, unk_id int, bos_id int, eos_id int, pad_id int, byte_fallback boolean, add_dummy_prefix boolean, remove_extra_whitespaces boolean, escape_whitespaces boolean, pre_tokenizer string, strip_leading_space boolean, min_score float, max_score float")

    def added(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(t.id, t.content, t.special) for t in self.added_tokens], "id int, content string, special boolean")


# Protobuf


def from_protobuf(data: bytes) -> Model:
    """A model of the protobuf format. Defaults within a message hold only where the message is present."""
    pieces, scores, types = [], [], []
    trainer = normalizer = None
    for number, value in fields(data):
        if number == 1:
            own = dict(fields(value))
            try:
                pieces.append(bytes(own.get(1, b"")).decode("utf-8"))
            except UnicodeDecodeError as e:
                raise InvalidModelError("a piece isn't UTF-8") from e
            scores.append(own.get(2, 0.0))
            types.append(own.get(3, NORMAL))
        elif number == 2:
            trainer = (trainer or {}) | dict(fields(value))
        elif number == 3:
            normalizer = (normalizer or {}) | dict(fields(value))
    kind, settings = UNIGRAM, {}
    if trainer is not None:
        kind = trainer.get(3, UNIGRAM)
        if kind not in (UNIGRAM, BPE):
            raise UnsupportedModelError(f"model type {kind}")
        settings = {k: signed(trainer.get(n, d)) for k, n, d in (("unk_id", 40, 0), ("bos_id", 41, 1), ("eos_id", 42, 2), ("pad_id", 43, -1))}
        settings["byte_fallback"] = bool(trainer.get(35, 0))
    if normalizer is not None:
        settings |= {"charsmap": bytes(normalizer.get(2, b"")), "add_dummy_prefix": bool(normalizer.get(3, 1)), "remove_extra_whitespaces": bool(normalizer.get(4, 1)), "escape_whitespaces": bool(normalizer.get(5, 1))}
    return Model(kind, tuple(pieces), np.array(scores, np.float32), np.array(types, np.int32), **settings)


# JSON


def _pre_tokenizer(spec) -> str:
    if not isinstance(spec, dict):
        return PLAIN
    if spec.get("type") == "Metaspace":
        return METASPACE
    if spec.get("type") == "Sequence":
        inner = [s.get("type") for s in spec.get("pretokenizers") or [] if isinstance(s, dict)]
        if inner[:2] == ["WhitespaceSplit", "Metaspace"]:
            return SPLIT_METASPACE
    return PLAIN


def _charsmap(spec) -> bytes:
    if not isinstance(spec, dict) or spec.get("type") != "Precompiled" or not spec.get("precompiled_charsmap"):
        return b""
    try:
        return base64.b64decode(spec["precompiled_charsmap"], validate=True)
    except (binascii.Error, ValueError, TypeError):
        return b""


def _template(spec) -> Template | None:
    if not isinstance(spec, dict) or spec.get("type") != "TemplateProcessing":
        return None
    known = spec.get("special_tokens") or {}

    def parts(entries) -> tuple[Part, ...]:
        out = []
        for e in entries or []:
            if e.get("SpecialToken") is not None:
                token = e["SpecialToken"]
                ids = (known.get(token.get("id")) or {}).get("ids") or [0]
                out.append(Part(token=token.get("id", ""), id=ids[0], type_id=token.get("type_id", 0)))
            elif e.get("Sequence") is not None:
                out.append(Part(sequence="B" if e["Sequence"].get("id") == "B" else "A", type_id=e["Sequence"].get("type_id", 0)))
            else:
                out.append(Part())
        return tuple(out)

    return Template(parts(spec.get("single")), parts(spec.get("pair")))


def merge_scores(merges: list) -> dict[str, float]:
    """What each merged string scores: the number of merges less its place; of several places the last holds."""
    out = {}
    for rank, merge in enumerate(merges):
        pair = merge.split(" ", 1) if isinstance(merge, str) else merge
        if len(pair) >= 2:
            out[pair[0] + pair[1]] = float(len(merges) - rank)
    return out


def from_json(data: bytes | str) -> Model:
    """A model of the JSON format, of type Unigram or BPE."""
    try:
        spec = json.loads(data)
    except ValueError as e:
        raise InvalidModelError(str(e)) from e
    if not isinstance(spec, dict) or not isinstance(spec.get("model"), dict):
        raise UnsupportedModelError("no model in the file")
    inner = spec["model"]
    kind = {"Unigram": UNIGRAM, "BPE": BPE}.get(inner.get("type"))
    if kind is None:
        raise UnsupportedModelError(str(inner.get("type")))
    added = tuple(AddedToken(t["id"], t.get("content", ""), bool(t.get("special", False))) for t in spec.get("added_tokens") or [])
    vocab = inner.get("vocab")
    if kind == BPE:
        if not isinstance(vocab, dict):
            raise ValueError("the vocabulary of a BPE model is a map")
        size = max(vocab.values(), default=-1) + 1
        pieces, scores, types = [""] * size, np.zeros(size, np.float32), np.zeros(size, np.int32)
        for piece, i in vocab.items():
            pieces[i], types[i] = piece, NORMAL
        for piece, score in merge_scores(inner.get("merges") or []).items():
            if piece in vocab:
                scores[vocab[piece]] = score
    else:
        if not isinstance(vocab, list) or not all(isinstance(v, list) and len(v) >= 2 for v in vocab):
            raise ValueError("the vocabulary of a Unigram model is a list of pieces and scores")
        pieces, scores = [v[0] for v in vocab], np.array([v[1] for v in vocab], np.float32)
        types = np.full(len(pieces), NORMAL, np.int32)
    by_id = {t.id: t for t in added}
    for i, piece in enumerate(pieces):
        if (token := by_id.get(i)) is not None:
            types[i] = UNKNOWN if token.content == "<unk>" else CONTROL if token.special else UNUSED if token.content.startswith("<unused") else USER_DEFINED
        elif is_byte_piece(piece):
            types[i] = BYTE
    index = {p: i for i, p in enumerate(pieces)}

    def special(content: str) -> int:
        """An added token's id, else the piece's."""
        return next((t.id for t in added if t.content == content), index.get(content, -1))

    if inner.get("unk_id") is not None:
        unk = inner["unk_id"]
    else:
        unk = index.get(inner.get("unk_token"), 0) if inner.get("unk_token") else 0
    return Model(
        kind,
        tuple(pieces),
        scores,
        types,
        unk_id=unk,
        bos_id=special("<bos>"),
        eos_id=special("<eos>"),
        pad_id=special("<pad>"),
        byte_fallback=bool(inner.get("byte_fallback", False)),
        charsmap=_charsmap(spec.get("normalizer")),
        pre_tokenizer=_pre_tokenizer(spec.get("pre_tokenizer")),
        added_tokens=added,
        template=_template(spec.get("post_processor")),
        from_json=True,
        skip_zero_scores=True,
    )


# Any


def looks_like_json(data: bytes) -> bool:
    """Whether the first byte other than space, tab, LF and CR is a brace."""
    return data.lstrip(b" \t\n\r")[:1] == b"{"


def load_bytes(data: bytes, name: str = "model") -> Model:
    made = from_json(data) if looks_like_json(data) else from_protobuf(data)
    return replace(made, name=name)


def load_resource(package: str, name: str) -> Model:
    """A model that an installed package carries as a resource, so that it travels with the code."""
    return load_bytes(importlib.resources.files(package).joinpath(name).read_bytes(), name)


def load(path: str, spark: SparkSession | None = None) -> Model:
    """A model from a file: a local one, or one that Spark can read if a session is given."""
    if spark is not None:
        rows = spark.read.format("binaryFile").load(path).select("content").take(1)
        if not rows:
            raise FileNotFoundError(path)
        return load_bytes(bytes(rows[0]["content"]), path)
    with open(path, "rb") as f:
        return load_bytes(f.read(), path)
