"""Small models for examples, queries and tests, made by rule from short lists."""

from __future__ import annotations

import json
import string
import struct

from .model import META, Model, byte_piece, from_json

# Letters beyond ASCII and frequent strings of the sample corpus' four languages.
ACCENTED = "äöüßéèêçñíóáúàâîôûÉÈÊÇÑÍÓÁÚÄÖÜ"
FREQUENT = (
    "th the ▁the and ▁and ing ion tion ▁of ▁to ▁in ▁is er re on an en ou ha he in ed nd st or es it at ly wh ble ▁th ▁a that ▁that "
    "ver ▁der ▁die und ▁und ein ch sch ich lich ung heit keit ge be zu ▁en eau aux ment ▁de ▁la ▁le ▁les ▁que qu eux ▁un ▁une "
    "ción ▁y ▁el ▁los os ar ra do mente ci ie ll rr ue as"
).split()
SPECIAL = ("<unk>", "<bos>", "<eos>", "<pad>", "[CLS]", "[SEP]")
SPLIT = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "Metaspace"}]}
META_ONLY = {"type": "Metaspace"}


def _letters(accented: bool) -> list[str]:
    return [META, *string.ascii_letters, *(ACCENTED if accented else ""), *string.digits, *".,;:!?'\"-()/&%$#*@<>=|_+"]


def _added(extra: dict[str, int] | None = None) -> list[dict]:
    return [{"id": i, "content": c, "special": True} for i, c in enumerate(SPECIAL)] + [{"id": i, "content": c, "special": False} for c, i in (extra or {}).items()]


def unigram_spec(pre_tokenizer: dict | None = None, accented: bool = True, byte_fallback: bool = False, added: tuple[str, ...] = ()) -> dict:
    """A Unigram model in the JSON format: special tokens, letters, frequent strings, and bytes if asked. Scores fall
    by 1/64 from piece to piece, frequent strings from -2 and letters from -3, so that they are exact in float32."""
    vocab = [[t, 0.0] for t in SPECIAL]
    vocab += [[p, -2 - k / 64] for k, p in enumerate(FREQUENT)]
    vocab += [[p, -3 - k / 64] for k, p in enumerate(_letters(accented))]
    if byte_fallback:
        vocab += [[byte_piece(b), -4.0] for b in range(256)]
    extra = {t: len(vocab) + k for k, t in enumerate(added)}
    vocab += [[t, -1.0] for t in added]
    return {"added_tokens": _added(extra), "pre_tokenizer": pre_tokenizer or SPLIT, "model": {"type": "Unigram", "unk_id": 0, "byte_fallback": byte_fallback, "vocab": vocab}}


def bpe_spec(pre_tokenizer: dict | None = None) -> dict:
    """A BPE model: letters, and each frequent string by merging its letters from the left."""
    merges, pieces = [], [*SPECIAL, *_letters(True)]
    for text in FREQUENT:
        for k in range(1, len(text)):
            if [text[:k], text[k]] not in merges:
                merges.append([text[:k], text[k]])
                if text[: k + 1] not in pieces:
                    pieces.append(text[: k + 1])
    return {"added_tokens": _added(), "pre_tokenizer": pre_tokenizer or SPLIT, "model": {"type": "BPE", "unk_token": "<unk>", "vocab": {p: i for i, p in enumerate(pieces)}, "merges": merges}}


def unigram(**options) -> Model:
    return from_json(json.dumps(unigram_spec(**options)))


def bpe(**options) -> Model:
    return from_json(json.dumps(bpe_spec(**options)))


def charsmap(entries: dict[str, str]) -> bytes:
    """A precompiled character map: a double array in which each node has a block of 256 places of its own."""
    texts, offsets = b"", {}
    for source, to in entries.items():
        offsets[source.encode()] = len(texts)
        texts += to.encode() + b"\0"
    nodes = {b""} | {s[:k] for s in offsets for k in range(1, len(s) + 1)}
    ordered = sorted(nodes, key=lambda n: (len(n), n))
    block = {n: 256 * (k + 1) for k, n in enumerate(ordered)}
    units = [0x80000055] * (256 * (len(ordered) + 2))  # a label that no byte has
    for n in ordered:
        at = block[n[:-1]] ^ n[-1] if n else 0
        jump = at ^ block[n]
        units[at] = (jump << 10 if jump < 1 << 21 else (jump >> 8) << 10 | 0x200) | (n[-1] if n else 0) | (256 if n in offsets else 0)
        if n in offsets:
            units[block[n]] = offsets[n] | 1 << 31
    data = struct.pack(f"<{len(units)}I", *units)
    return struct.pack("<I", len(data)) + data + texts
