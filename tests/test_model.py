import base64
import json
import struct

import pytest

from piecewright.errors import InvalidModelError, UnsupportedModelError
from piecewright.sources import samples
from piecewright.sources.model import BPE, BYTE, CONTROL, META, NORMAL, UNIGRAM, UNKNOWN, UNUSED, USER_DEFINED, byte_piece, byte_value, from_json, from_protobuf, is_byte_piece, load, load_bytes, looks_like_json, merge_scores


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def proto(pieces, trainer=None, normalizer=None):
    out = b"".join(field(1, field(1, p) + field(2, s) + (field(3, t) if t is not None else b"")) for p, s, t in pieces)
    for number, message in ((2, trainer), (3, normalizer)):
        if message is not None:
            out += field(number, b"".join(field(n, v) for n, v in message))
    return out


PIECES = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("a", -1.0, None), (META, -2.5, 1)]


def test_protobuf_defaults_hold_only_in_present_messages():
    bare = from_protobuf(proto(PIECES))
    assert (bare.kind, bare.unk_id, bare.bos_id, bare.eos_id, bare.pad_id, bare.add_dummy_prefix) == (UNIGRAM, 0, 0, 0, 0, False)
    full = from_protobuf(proto(PIECES, [], []))
    assert (full.unk_id, full.bos_id, full.eos_id, full.pad_id) == (0, 1, 2, -1)
    assert full.add_dummy_prefix and full.remove_extra_whitespaces and full.escape_whitespaces and full.strip_leading_space
    assert full.types.tolist() == [UNKNOWN, CONTROL, NORMAL, NORMAL]
    assert full.score_bounds == (-2.5, -1.0)


def test_protobuf_settings():
    m = from_protobuf(proto(PIECES, [(3, 2), (35, 1), (40, 3), (43, -1)], [(3, 0), (4, 0), (2, b"xyz")]))
    assert (m.kind, m.byte_fallback, m.unk_id, m.pad_id, m.charsmap) == (BPE, True, 3, -1, b"xyz")
    assert not m.add_dummy_prefix and not m.remove_extra_whitespaces and m.escape_whitespaces


def test_protobuf_errors():
    with pytest.raises(UnsupportedModelError):
        from_protobuf(proto(PIECES, [(3, 3)]))
    with pytest.raises(InvalidModelError):
        from_protobuf(b"\x0a\xff\x01abc")


def test_json_sniffing():
    assert looks_like_json(b' \t\r\n{"a":1}') and not looks_like_json(b"") and not looks_like_json(b"\x0a\x05") and not looks_like_json(b"[1]")
    assert load_bytes(json.dumps(samples.bpe_spec()).encode()).kind == BPE


@pytest.mark.parametrize("data,error", [("{", InvalidModelError), ("{}", UnsupportedModelError), ('{"model":{"type":"WordPiece"}}', UnsupportedModelError), ('{"model":{"type":"BPE","vocab":[1]}}', ValueError), ('{"model":{"type":"Unigram","vocab":{"a":1}}}', ValueError)])
def test_json_errors(data, error):
    with pytest.raises(error):
        from_json(data)


def test_merge_scores_take_the_last_place():
    assert merge_scores([["a", "b"], ["ab", "c"], ["a", "bc"]]) == {"ab": 3.0, "abc": 1.0}
    assert merge_scores(["a b", "b c"]) == {"ab": 2.0, "bc": 1.0}


def test_classification_is_by_id():
    added = [(0, "<unk>", True), (1, "[X]", True), (2, "<unused7>", False), (3, "zz", False)]
    m = from_json(json.dumps({"model": {"type": "Unigram", "vocab": [["u", 0], ["b", -1], ["c", -1], ["d", -1], ["<0x41>", 0], ["e", -2]]}, "added_tokens": [{"id": i, "content": c, "special": s} for i, c, s in added]}))
    assert m.types.tolist() == [UNKNOWN, CONTROL, UNUSED, USER_DEFINED, BYTE, NORMAL]
    assert m.piece_to_id("zz") == 0 and m.bos_id == -1 and [t.content for t in m.matched_added_tokens] == ["<unused7>", "zz"]


def test_holes_and_duplicates():
    m = from_json(json.dumps({"model": {"type": "BPE", "vocab": {"a": 0, "b": 3}}}))
    assert m.pieces == ("a", "", "", "b") and m.types.tolist() == [1, 0, 0, 1] and "" not in m.index
    two = from_json(json.dumps({"model": {"type": "Unigram", "vocab": [["a", -1], ["a", -2]]}}))
    assert two.index["a"] == 1 and two.id_to_piece(9) == "" and two.piece_to_id("q") == 0


def test_json_parts():
    spec = samples.unigram_spec()
    spec["normalizer"] = {"type": "Precompiled", "precompiled_charsmap": base64.b64encode(b"abcd").decode()}
    spec["post_processor"] = {"type": "TemplateProcessing", "single": [{"SpecialToken": {"id": "[CLS]", "type_id": 0}}, {"Sequence": {"id": "A", "type_id": 1}}, {"SpecialToken": {"id": "?", "type_id": 0}}], "special_tokens": {"[CLS]": {"ids": [4]}}}
    m = from_json(json.dumps(spec))
    assert m.charsmap == b"abcd" and [(p.id, p.sequence, p.type_id) for p in m.template.single] == [(4, None, 0), (0, "A", 1), (0, None, 0)]
    spec["normalizer"] = {"type": "Sequence"}
    assert from_json(json.dumps(spec)).charsmap == b""


def test_bytes():
    assert [byte_piece(b) for b in (0, 10, 255)] == ["<0x00>", "<0x0A>", "<0xFF>"]
    assert all(byte_value(byte_piece(b)) == b for b in range(256))
    assert byte_value("<0xab>") == 171 and byte_value("<0xG1>") is None and is_byte_piece("<0xG1>") and not is_byte_piece("<0x1>")


def test_public_vocabulary_file():
    path = "/opt/tokenizers/piece_bpe_32k.model"
    sentencepiece = pytest.importorskip("sentencepiece")
    try:
        m = load(path)
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    from piecewright.functions.encoder import Encoder

    other = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = ["", " ", "Hello world", "  a  b\tc\n\nd ", "naïve façade 你好 🚀🚀", "x" * 500, "<s> </s> <0x41>"]
    for cut in (False, True):
        encode = Encoder(m, cut)
        assert [[i for i, _ in encode(t)] for t in texts] == [other.encode(t) for t in texts]
