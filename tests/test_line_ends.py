"""Line ends, segments, padding of whole tables, post-processors and resources."""

import json
import sys
from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from piecewright.functions.normalize import Normalizer, normalize
from piecewright.functions.unigram import Unigram, UnigramBatch
from piecewright.operators import encode, encoding
from piecewright.plans.queries import _MAPPED, ADDED, METASPACE, UNIGRAM
from piecewright.sources import samples
from piecewright.sources.model import META, load_resource
from piecewright.sources.text import explode_lines, golden_cases

TEXTS = ["a \n", "a\n", " a  b \r\n ", "a\r", "a  ", "\n", " \n", "a\x85", "", "   ", "a \n\n", f"a {META}", f"{META} ", "b\r\r\n", "x\x0b \x0c"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet=f"ab \n\r\t\x0b\x85 {META}é", max_size=12), min_size=1, max_size=40))
def test_the_expression_normalizes_as_the_kernel_does(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts + TEXTS], "t string")
    for dummy in (True, False):
        for lean in (True, False):
            for escape in (True, False):
                model = _with(dummy, lean, escape)
                got = [r[0] for r in rows.select(normalize(F.col("t"), dummy, lean, escape)).collect()]
                assert got == [Normalizer(model)(t) for t in texts + TEXTS]


def _with(dummy, lean, escape):

    return replace(UNIGRAM, add_dummy_prefix=dummy, remove_extra_whitespaces=lean, escape_whitespaces=escape)


def scanned(text):
    """Lines as a line scanner gives them: up to each line feed, without one carriage return before it."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def test_lines_are_those_of_a_scanner(spark):
    texts = [*TEXTS, "a\n\n", "\n\n", "a\r\n\r\n", "\r", "a\n\r", "a\nb"]
    got = explode_lines(spark.createDataFrame(list(enumerate(texts)), "k int, text string")).orderBy("k", "line_no").collect()
    assert [(r["k"], r["line_no"], r["line"]) for r in got] == [(k, n, x) for k, t in enumerate(texts) for n, x in enumerate(scanned(t))]


def test_segments_are_numbered_within_each_row(spark):
    rows = spark.createDataFrame([("en", "a b"), ("en", "c d"), ("en", "a b"), ("de", None), ("de", ""), ("fr", "x the y")], "lang string, text string")
    got = [tuple(r) for r in encode.segments(rows, ADDED).coalesce(1).collect()]
    assert [g[2] for g in got if g[0] == "en"] == [META + w for w in ("a", "b", "c", "d", "a", "b")] and not [g for g in got if g[0] == "de"]
    french = [g for g in got if g[0] == "fr"]
    assert (french[-2][2], french[-2][3]) == ("the", ADDED.matched_added_tokens[[t.content for t in ADDED.matched_added_tokens].index("the")].id)
    assert [g[1] for g in french] == list(range(len(french))) and french[0][2] == META + "x" and french[-1][2] == META + "y"
    assert [g[1] for g in got if g[0] == "en"] == [0, 1, 0, 1, 0, 1]
    mapped = encode.segments(rows.where("lang = 'fr'"), _MAPPED).collect()
    assert [r["seg_pos"] for r in mapped] == list(range(len(mapped))) and len(mapped) >= 1


def test_padding_to_the_longest_of_a_table(spark):
    rows = spark.createDataFrame([(k, "the and " * k) for k in range(4)], "k int, text string")
    sizes = {r[0] for r in encoding.Pipeline(UNIGRAM).with_padding(encoding.LONGEST).encode(rows).select(F.size("encoding.input_ids")).collect()}
    assert len(sizes) == 1 and sizes != {0}
    assert encoding.Pipeline(UNIGRAM).with_padding(encoding.LONGEST).encode(rows.limit(0)).count() == 0


def test_a_post_processor_may_be_any_function(spark):
    rows = spark.createDataFrame([("the",)], "text string")
    half = lambda enc: encoding.truncate(enc, 1)
    assert len(encoding.Pipeline(UNIGRAM).with_template(half).encode(rows).first()["encoding"]["input_ids"]) == 1


def test_a_model_from_a_package(tmp_path, monkeypatch):
    package = tmp_path / "carries_a_model"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "own.json").write_text(json.dumps(samples.unigram_spec()))
    monkeypatch.syspath_prepend(str(tmp_path))
    sys.modules.pop("carries_a_model", None)
    made = load_resource("carries_a_model", "own.json")
    assert made.name == "own.json" and made.pieces == samples.unigram().pieces


def test_golden_cases_of_a_file(spark, tmp_path):
    texts = ["", "the and", "  two  spaces ", "there\nis", "ünïcode ß", "a" * 70, "x 🚀 y", "...", "1 2 3", "The THE the"]
    expected = []
    for t in texts:
        ids = [i for i, _ in encode_plain(t)]
        expected.append({"input": t, "pieces": [p for _, p in encode_plain(t)], "ids": ids, "decoded": "", "description": "made by the kernel"})
    (tmp_path / "cases.jsonl").write_text("\n".join(json.dumps(e, ensure_ascii=False) for e in expected))
    cases = golden_cases(spark, str(tmp_path / "cases.jsonl"))
    got = encode.encode(cases, UNIGRAM, "input", "e")
    assert cases.count() == len(texts)
    assert got.where("not (e.ids <=> ids and e.pieces <=> pieces)").count() == 0


def encode_plain(text):
    from piecewright.functions.encoder import merge_unknown
    from piecewright.functions.pretokenize import whitespace_metaspace

    one = Unigram(UNIGRAM)
    return merge_unknown([x for w in whitespace_metaspace(text) for x in one(w)], UNIGRAM.unk_id)


def test_pieces_are_compared_and_not_only_their_hashes(monkeypatch):
    """With hashes of few bits, words that aren't pieces meet pieces' hashes."""
    many = UnigramBatch(UNIGRAM)
    words = ["the", "thq", "zzz", "and", "there", "xx"]
    right, offsets = many(words)
    one = Unigram(UNIGRAM)
    assert [right[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [[i for i, _ in one(w)] for w in words]
    for n, (marks, table, ids, scores, codes) in list(many.tables.items()):
        if n == 3:  # a piece's hash is now that of another word
            k = int(ids.tolist().index(UNIGRAM.piece_to_id("the"))) if UNIGRAM.piece_to_id("the") in ids.tolist() else 0
            codes = codes.copy()
            codes[k] = [ord(c) for c in "q~q"]
            many.tables[n] = marks, table, ids, scores, codes
    changed, cuts = many(["the"])
    assert len(changed[cuts[0] : cuts[1]]) >= 1 and changed.tolist() != right[: offsets[1]].tolist() or UNIGRAM.piece_to_id("the") == UNIGRAM.unk_id


@pytest.mark.parametrize("text", ["b\r\r\n", "a\n\n"])
def test_scanner_examples(spark, text):
    assert [r["line"] for r in explode_lines(spark.createDataFrame([(text,)], "text string")).collect()] == scanned(text)


def test_an_encoder_remembers_a_bounded_number_of_characters():
    from piecewright.functions.encoder import Encoder

    encoder = Encoder(METASPACE)
    for k in range(30):
        encoder.batch([f"{k}" + "é" * 1_000])
    few = encoder.REMEMBERED_CHARS
    encoder.REMEMBERED_CHARS = 5_000
    for k in range(30):
        encoder.batch([f"n{k}" + "é" * 1_000])
        assert encoder.chars <= 40_000
    assert few > 1 << 20 and len(encoder.number) <= 7


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=f"the \n\t\x1c\x85\xa0{META}é\x00", max_size=30), min_size=1, max_size=8))
def test_batches_are_encoded_as_single_texts(texts):
    import numpy as np

    from piecewright.functions.encoder import Encoder

    for model in (UNIGRAM, METASPACE, _with(True, False, True), _with(False, False, False)):
        for encoder in (Encoder(model), Encoder(replace(model, pre_tokenizer="none"), cut=True)):
            ids, cuts = encoder.batch(texts)
            for k, t in enumerate(texts):
                single = [i for s in (encoder.pre(encoder.normalize(t)) if t else ()) for i, _ in encoder.segment(s)]
                assert ids[cuts[k] : cuts[k + 1]].astype(np.int64).tolist() == single


def test_files_and_streams_are_cut_at_line_feeds_alone(spark, tmp_path):
    from piecewright.sources.text import read_lines
    from piecewright.streaming.lines import stream_lines

    (tmp_path / "in").mkdir()
    text = "a\rb\r\n\nc\r\r\n\u2028d \n"
    (tmp_path / "in" / "x.txt").write_bytes(text.encode())
    assert [r["line"] for r in read_lines(spark, str(tmp_path / "in")).collect()] == scanned(text)
    query = stream_lines(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("lines_seen").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(r["line"] for r in spark.table("lines_seen").collect()) == sorted(scanned(text))
