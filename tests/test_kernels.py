import json
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from piecewright.functions.encoder import Encoder, cuts_are_exact, merge_unknown
from piecewright.functions.normalize import Normalizer, read_charsmap
from piecewright.functions.pretokenize import AddedTokens, metaspace, split_keeping, whitespace_metaspace
from piecewright.functions.unigram import Unigram
from piecewright.sources import samples
from piecewright.sources.model import META, Model, from_json

UNK = ((0, "<unk>", True),)
SPLIT, SPACES = samples.SPLIT, samples.META_ONLY
U1 = [["<unk>", 0.0], ["a", -1], ["b", -1.5], ["ab", -0.5], [META, -2]]


def model(vocab, kind="Unigram", pre=None, added=UNK, **more):
    return from_json(json.dumps({"model": {"type": kind, "vocab": vocab, **more}, "pre_tokenizer": pre, "added_tokens": [{"id": i, "content": c, "special": s} for i, c, s in added]}))


MODELS = {
    "U1": model(U1, unk_id=0),
    "U1-meta": model(U1, unk_id=0, pre=SPACES),
    "U1-ws": model(U1, unk_id=0, pre=SPLIT),
    "U0-ws": model([["<unk>", 0], ["a", -1]], unk_id=0, pre=SPLIT),
    "U2": model([["<unk>", 0], ["<0x78>", 0], ["<0x79>", 0], ["a", -1], ["xy", -3]], unk_id=0, byte_fallback=True),
    "B1": model({"<unk>": 0, "<pad>": 1, "a": 2, "b": 3, "ab": 4}, "BPE", merges=[["a", "b"]], added=UNK + ((1, "<pad>", True),)),
    "B2": model({"<unk>": 0, "a": 1, "b": 2, "c": 3, "ab": 4, "bc": 5}, "BPE", merges=[["a", "b"]]),
    "B3": model({"<unk>": 0, "a": 1, "aa": 2}, "BPE", merges=["a a"]),
    "B4": model({"<unk>": 0, "a": 1, "b": 2, "ab": 3}, "BPE", merges=["a b"], added=UNK + ((3, "<unused0>", False),)),
}


@pytest.mark.parametrize(
    "name,text,ids",
    [("U1", "", []), ("U1", "ab", [3]), ("U1", "aab", [1, 3]), ("U1", "ba", [2, 1]), ("U1", "a b", [1, 0, 2]), ("U1", "xya", [0, 1]), ("U1-meta", "ab a", [4, 3, 4, 1]), ("U1-meta", " ", [4]), ("U1-ws", "  ab\ta ", [4, 3, 4, 1]), ("U1-ws", " \n", []), ("U0-ws", "x y", [0])]
    + [("U2", "xy", [1, 2]), ("U2", "axy", [3, 1, 2]), ("U2", "zz", [0, 0]), ("B1", "aab", [2, 4]), ("B1", "abab", [4, 4]), ("B1", "acdb", [2, 0, 3]), ("B2", "bc", [5]), ("B2", "abc", [4, 3]), ("B3", "aaa", [2, 1]), ("B4", "ab", [1, 2]), ("B4", "a<unused0>b", [1, 3, 2])],
)
def test_encodings(name, text, ids):
    assert [i for i, _ in Encoder(MODELS[name])(text)] == ids


def test_unknown_runs_join_across_segments():
    assert Encoder(MODELS["U0-ws"])("x y") == [(0, "▁x▁y")]
    assert merge_unknown([(0, "a"), (0, "b"), (1, "c"), (0, "d")], 0) == [(0, "ab"), (1, "c"), (0, "d")]


def test_unused_results_are_taken_apart_again():
    m = model({"<unk>": 0, "a": 1, "b": 2, "c": 3, "ab": 4, "abc": 5}, "BPE", merges=["a b", "ab c"], added=UNK + ((4, "<unused1>", False), (5, "<unused2>", False)))
    assert [i for i, _ in Encoder(m)("abcab")] == [1, 2, 3, 1, 2]
    assert not cuts_are_exact(m)


def test_user_defined_pieces_stay_whole_in_bpe_and_are_favoured_in_unigram():
    b = model({"<unk>": 0, "a": 1, "b": 2, "ab": 3, "ba": 4}, "BPE", merges=["a b", "b a"], added=UNK + ((4, "ba", False),))
    symbols, frozen = Encoder(b).segment._symbols("aba")
    assert symbols == ["a", "ba"] and frozen == [False, True]
    u = model([["<unk>", 0], ["a", -1], ["b", -3], ["ab", -0.25]], added=UNK + ((3, "ab", False),))
    assert Unigram(u).pieces["ab"][1] == pytest.approx(-2.1)


def test_float32_is_kept():
    third = -1 / 3
    m = model([["<unk>", 0], ["a", third], ["b", -2.0]])
    total = np.float32(0)
    for _ in range(1000):
        total = np.float32(total + np.float32(third))
    best = Unigram(m)
    assert best("a" * 1000) == [(1, "a")] * 1000 and best.pieces["a"][1] == float(np.float32(third))


def brute(m: Model, text: str) -> float:
    table = {p: float(m.scores[i]) for p, i in m.matchable.items()}
    best = [0.0] + [None] * len(text)
    for end in range(1, len(text) + 1):
        found = [best[s] + table[text[s:end]] for s in range(end) if text[s:end] in table]
        found += [best[end - 1] + m.score_bounds[0] - 10] if text[end - 1] not in table else []
        best[end] = max(found)
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="thenadiorü▁x", max_size=12))
def test_viterbi_against_all_segmentations(text):
    m = samples.unigram(accented=False)
    pieces = Unigram(m)(text)
    score = sum(float(m.scores[i]) if i else m.score_bounds[0] - 10 for i, _ in pieces)
    assert "".join(p for _, p in pieces) == text and (not text or score == pytest.approx(brute(m, text)))


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_properties_of_any_text(text):
    text = text.encode("utf-8", "ignore").decode()
    for m in (samples.unigram(), samples.bpe(), samples.unigram(byte_fallback=True, accented=False, pre_tokenizer=SPACES)):
        made = Encoder(m)(text)
        assert all(0 <= i < len(m.pieces) for i, _ in made)
        once = b"".join(m.bytes_of(i) for i, _ in made).decode("utf-8", "replace")
        again = b"".join(m.bytes_of(i) for i, _ in Encoder(m)(once)).decode("utf-8", "replace")
        third = b"".join(m.bytes_of(i) for i, _ in Encoder(m)(again)).decode("utf-8", "replace")
        if m.byte_fallback:
            assert again.strip() == third.strip()
            assert once.replace(" ", "") == text.replace(" ", "").replace(META, "")


BATCHES = [samples.unigram(accented=False), samples.unigram(accented=False, byte_fallback=True), samples.unigram(added=("the", "[X]")), samples.bpe(), MODELS["U2"], MODELS["U1-ws"], MODELS["U0-ws"], samples.unigram(pre_tokenizer=SPACES)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="thenad ▁\n[X]éü日🚀xyz", max_size=30)), max_size=8), st.sampled_from(range(len(BATCHES))))
def test_batches_against_single_texts(texts, which):
    import pyarrow as pa

    from piecewright.functions.encoder import encode_arrow

    m = BATCHES[which]
    one, many = Encoder(m), Encoder(m)
    for _ in range(2):
        got = encode_arrow(many, pa.array(texts, pa.string())).to_pylist()
        assert got == [None if t is None else {"ids": [i for i, _ in one(t)], "pieces": [p for _, p in one(t)]} for t in texts]
        ids = encode_arrow(many, pa.array(texts, pa.string()), pieces=False).to_pylist()
        assert [r and r["ids"] for r in ids] == [r and r["ids"] for r in got]


def test_batches_of_long_segments():
    import pyarrow as pa

    from piecewright.functions.encoder import encode_arrow

    m = samples.unigram()
    texts = ["th" * 400 + " the", "x " + "and" * 50, ""]
    one, many = Encoder(m), Encoder(m)
    assert [r["ids"] for r in encode_arrow(many, pa.array(texts)).to_pylist()] == [[i for i, _ in one(t)] for t in texts]


def flags(dummy, lean, escape, charsmap=b""):
    return Model(1, ("<unk>",), np.zeros(1, np.float32), np.array([2], np.int32), add_dummy_prefix=dummy, remove_extra_whitespaces=lean, escape_whitespaces=escape, charsmap=charsmap)


NORMALIZED = [((1, 1, 1), "hello", "▁hello"), ((1, 1, 1), "  a  b ", "▁a▁b"), ((1, 1, 1), "   ", ""), ((1, 1, 1), "a\tb", "▁a\tb"), ((1, 1, 1), "▁", ""), ((1, 0, 1), " a ", "▁▁a▁"), ((1, 1, 0), "a b", " a b"), ((0, 0, 0), "a b", "a b"), ((1, 1, 1), "", "")]


@pytest.mark.parametrize("setting,text,want", NORMALIZED)
def test_normalization(setting, text, want):
    assert Normalizer(flags(*map(bool, setting)))(text) == want


def test_normalization_as_expression(spark):
    from pyspark.sql import functions as F

    from piecewright.functions.normalize import normalize

    for setting, text, want in NORMALIZED:
        row = spark.createDataFrame([(text,)], "t string").select(normalize(F.col("t"), *map(bool, setting))).first()
        assert row[0] == want


def test_charsmap():
    entries = {"ﬁ": "fi", "Ａ": "A", "é": "éx", "\t": " ", "ab": "Q", "abc": "", "​": " "}
    data = samples.charsmap(entries)
    assert {k.decode(): v for k, v in read_charsmap(data).items()} == entries
    assert Normalizer(flags(False, False, False, data))("ﬁ Ａabcabz\tx") == "fi AQz x"
    assert Normalizer(flags(True, True, True, data))("\t​ a\t\tb ​") == "▁a▁b"
    assert Normalizer(flags(True, True, True, data))("\t ") == ""
    assert read_charsmap(b"ab") == {} and read_charsmap(struct.pack("<II", 100, 0)) == {}


@pytest.mark.parametrize("text,want", [("Hello world", ["▁Hello", "▁world"]), (" ", ["▁"]), ("  ", ["▁", "▁"]), ("", []), ("a", ["▁a"]), (" hello ", ["▁hello", "▁"])])
def test_metaspace(spark, text, want):
    from pyspark.sql import functions as F

    from piecewright.functions.pretokenize import metaspace_column

    assert metaspace(text) == want
    assert spark.createDataFrame([(text,)], "t string").select(metaspace_column(F.col("t"))).first()[0] == want


def test_other_cuts():
    assert split_keeping("a▁b▁▁c") == ["a", "▁b", "▁", "▁c"] and split_keeping("") == []
    assert whitespace_metaspace(" a　b\x1cc d\n") == ["▁a", "▁b\x1cc", "▁d"]
    tokens = AddedTokens(model([["<unk>", 0], ["a", -1], ["b", -1]], added=UNK + ((7, "ab", False), (8, "abc", False), (9, "<0x41>", False), (1, "<s>", True))))
    assert list(tokens.split("xabcab<s>")) == [("x", None), ("abc", 8), ("ab", 7), ("<s>", None)]


def test_cutting_at_words_changes_nothing():
    random.seed(4)
    letters = list("thenadio▁ ")
    m = model([["<unk>", 0]] + [[p, -2 - k / 64] for k, p in enumerate(samples.FREQUENT)] + [[c, -4.0] for c in "thenadior▁"])
    whole, cut = Encoder(m), Encoder(m, cut=True)
    for _ in range(200):
        text = "".join(random.choice(letters) for _ in range(30))
        assert whole(text) == cut(text)
