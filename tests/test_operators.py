import json

import pytest
from pyspark.sql import functions as F

from piecewright.functions.sql import register
from piecewright.operators import analytics, decode, encode, encoding, vocabulary
from piecewright.plans.queries import model_input_pipeline
from piecewright.plans.template import Part, Template, bert
from piecewright.sources import samples
from piecewright.sources.model import load
from piecewright.sources.text import explode_lines, golden_cases, read_lines, write_tokens
from piecewright.streaming.lines import stream_lines, stream_stats, stream_totals

M, SPACES, BYTES = samples.unigram(), samples.unigram(pre_tokenizer=samples.META_ONLY), samples.unigram(accented=False, byte_fallback=True)
ROWS = [(1, "the thing and the ones"), (2, ""), (3, None), (4, " \n "), (5, "日本 the 日"), (5, "dup id")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "id int, text string")


def test_encode_keeps_rows_and_nulls(docs):
    got = {(r["id"], r["text"]): r["encoded"] for r in encode.encode(docs, M).collect()}
    assert len(got) == len(ROWS) and got[3, None] is None and got[2, ""]["ids"] == [] and got[4, " \n "]["pieces"] == []
    assert "".join(got[1, ROWS[0][1]]["pieces"]) == "▁the▁thing▁and▁the▁ones"
    assert [i for i, _ in zip(got[5, "日本 the 日"]["ids"], "xxxx")].count(0) == 1


def test_encoding_shuffles_nothing(docs):
    plan = encode.encode(docs, M)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tokens_and_merge(docs, spark):
    rows = encode.tokens(docs.where("id = 5"), M).orderBy("text", "pos").collect()
    assert [r["pos"] for r in rows if r["text" if "text" in r else "id"]] or rows
    raw = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, 7, "c"), (1, 3, 0, "d"), (2, 0, 0, "x")], "k int, pos int, id int, piece string")
    merged = sorted(tuple(r) for r in encode.merge_unknown(raw, 0, "k").collect())
    assert merged == [(1, 0, 0, "ab"), (1, 1, 7, "c"), (1, 2, 0, "d"), (2, 0, 0, "x")]


def test_batches(spark):
    df = spark.createDataFrame([(1, ["the", None, ""]), (2, []), (3, None)], "id int, texts array<string>")
    got = {r["id"]: r["encoded"] for r in encode.encode_batches(df, M, "texts").collect()}
    assert got[1][1] is None and got[1][2] == [] and len(got[1][0]) == 1 and got[2] == [] and got[3] is None


def test_segments(spark):
    m = samples.unigram(added=("the", "[X]"), pre_tokenizer=samples.META_ONLY)
    df = spark.createDataFrame([(1, "a b[X]c"), (2, ""), (3, None)], "id int, text string")
    got = [(r["id"], r["seg_pos"], r["segment"], r["added_id"]) for r in encode.segments(df, m).orderBy("id", "seg_pos").collect()]
    assert [g[:3] for g in got] == [(1, 0, "▁a"), (1, 1, "▁b"), (1, 2, "[X]"), (1, 3, "▁c")]
    assert [g[3] is not None for g in got] == [False, False, True, False]


def test_decode_both_ways(spark):
    df = spark.createDataFrame([(1, [4, -1, 999]), (2, []), (3, None)], "k int, ids array<int>")
    got = {r["k"]: r["decoded"] for r in decode.decode(df, M).collect()}
    assert got == {1: "", 2: "", 3: None}
    unk = spark.createDataFrame([(1, [M.piece_to_id("a"), 0, M.piece_to_id("b")])], "k int, ids array<int>")
    assert decode.decode(unk, M).first()["decoded"] == "a ⁇ b"
    text = "naïve 日本 🚀 ok"
    made = encode.encode(spark.createDataFrame([(1, text)], "k int, text string"), BYTES)
    assert decode.decode(made.withColumn("ids", F.col("encoded.ids")), BYTES).first()["decoded"] == " " + text
    rows = encode.tokens(spark.createDataFrame([(1, text)], "k int, text string"), BYTES)
    joined = decode.decode_tokens(rows, BYTES, "k").first()
    assert joined["text"] == " " + text and bytes(joined["bytes"]).decode() == " " + text


def test_decoding_partial_bytes_and_the_leading_space(spark):
    import numpy as np

    from piecewright.sources.model import Model

    m = Model(1, ("<unk>", "<0xE6>", "▁a"), np.zeros(3, np.float32), np.array([2, 6, 1], np.int32), add_dummy_prefix=True)
    df = spark.createDataFrame([([2, 1],), ([0],)], "ids array<int>")
    assert [r["decoded"] for r in decode.decode(df, m).collect()] == ["a�", "⁇ "]


def one(spark, ids, toks):
    df = spark.createDataFrame([(ids, toks)], "ids array<int>, toks array<string>")
    return df.select(encoding.new_encoding(F.col("ids"), F.col("toks")).alias("e"))


def test_template_truncation_padding(spark):
    e = one(spark, [10, 20, 30], ["a", "b", "c"])
    t = e.select(encoding.apply_template(F.col("e"), bert(101, 102)).alias("e"))
    row = t.first()["e"]
    assert row["input_ids"] == [101, 10, 20, 30, 102] and row["special_tokens_mask"] == [1, 0, 0, 0, 1] and row["tokens"][0] == "[CLS]"
    assert t.select(encoding.truncate(F.col("e"), 3)["input_ids"]).first()[0] == [101, 10, 20]
    right, left = (e.select(encoding.pad(F.col("e"), 5, 0, "<p>", side)).first()[0] for side in (encoding.RIGHT, encoding.LEFT))
    assert right["input_ids"] == [10, 20, 30, 0, 0] and right["attention_mask"] == [1, 1, 1, 0, 0] and right["special_tokens_mask"] == [0] * 5
    assert left["input_ids"] == [0, 0, 10, 20, 30] and left["tokens"][:2] == ["<p>", "<p>"]
    assert e.select(encoding.pad(F.col("e"), 2, 0)["input_ids"]).first()[0] == [10, 20, 30]
    twice = Template((Part(sequence="A"), Part(token="s", id=9), Part(sequence="B", type_id=1)))
    row = e.select(encoding.apply_template(F.col("e"), twice)).first()[0]
    assert row["input_ids"] == [10, 20, 30, 9, 10, 20, 30] and row["token_type_ids"] == [0, 0, 0, 0, 1, 1, 1]
    empty = one(spark, [], []).select(encoding.apply_template(F.col("e"), bert(101, 102))["input_ids"]).first()[0]
    assert empty == [101, 102]


def test_pipelines(docs, spark):
    p = model_input_pipeline(M, 6)
    rows = {r["text"]: r["encoding"] for r in p.encode(docs.where("text is not null")).collect()}
    assert all(len(r["input_ids"]) == 6 for r in rows.values()) and rows[""]["input_ids"] == [1, 2, 3, 3, 3, 3]
    batched = encoding.Pipeline(M).with_padding(encoding.LONGEST, pad_id=3).encode(docs.where("id in (1, 2)").withColumn("b", F.lit(1)), batch="b").collect()
    assert len({len(r["encoding"]["input_ids"]) for r in batched}) == 1
    alone = encoding.Pipeline(M).with_padding(encoding.LONGEST, pad_id=3).encode(docs.where("id = 2")).first()
    assert alone["encoding"]["input_ids"] == []
    assert encoding.Pipeline(M, template=bert(4, 5)).encode(docs.where("id = 2"), add_special_tokens=False).first()["encoding"]["input_ids"] == []


def test_vocabulary(spark):
    ids = spark.createDataFrame([(0,), (7,), (-1,), (10**6,), (None,)], "id int")
    got = [r["piece"] for r in vocabulary.id_to_piece(ids, M).collect()]
    assert sorted(got) == sorted(["<unk>", M.pieces[7], "", "", ""])
    back = {r["piece"]: r["id"] for r in vocabulary.piece_to_id(spark.createDataFrame([("the",), ("nope",)], "piece string"), M).collect()}
    assert back == {"the": M.index["the"], "nope": 0}
    assert {r["type_name"] for r in vocabulary.type_counts(spark, BYTES).collect()} == {"NORMAL", "UNKNOWN", "CONTROL", "BYTE"}
    assert vocabulary.search(spark, M, "e", 3).count() == 3 and vocabulary.head_tail(spark, M).count() == 20


def test_statistics(spark):
    df = spark.createDataFrame([(1, "the the\nthe\n"), (2, ""), (3, "x\r\n\ny")], "id int, text string")
    lines = explode_lines(df)
    assert [(r["id"], r["line_no"], r["line"]) for r in lines.orderBy("id", "line_no").collect()] == [(1, 0, "the the"), (1, 1, "the"), (3, 0, "x"), (3, 1, ""), (3, 2, "y")]
    stats = analytics.line_stats(lines, M)
    total = analytics.totals(stats).first()
    assert total["lines"] == 5 and total["tokens"] == 6 and analytics.totals(stats.where("false")).first()["tokens"] == 0
    long = spark.createDataFrame([("é" * 26,), ("e" * 50,)], "line string").select(analytics.preview(F.col("line")).alias("p"))
    assert [r["p"] for r in long.collect()] == ["é" * 25 + "...", "e" * 50]
    pair = spark.createDataFrame([([1, 1, 2], [2, 3]), ([], [])], "a array<int>, b array<int>").select(*(c.alias(k) for k, c in analytics.jaccard(F.col("a"), F.col("b")).items())).collect()
    assert (pair[0]["shared_ids"], pair[0]["union_ids"]) == (1, 3) and pair[1]["jaccard"] != pair[1]["jaccard"]
    fewer = analytics.compare(spark.createDataFrame([("",), ("the",)], "text string"), M, BYTES).collect()
    assert {r["fewer"] for r in fewer} <= {"same", "first", "second"}


def test_sources_sinks_sql_and_streams(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps(samples.bpe_spec()))
    assert load(str(tmp_path / "m.json"), spark).pieces == samples.bpe().pieces
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("the thing\nand\n")
    (tmp_path / "golden.jsonl").write_text(json.dumps({"input": "a", "pieces": ["▁", "a"], "ids": [1, 2], "decoded": "a", "description": "x"}) + "\n")
    assert golden_cases(spark, str(tmp_path / "golden.jsonl")).first()["pieces"] == ["▁", "a"]
    assert read_lines(spark, str(tmp_path / "in")).count() == 2
    write_tokens(encode.encode(read_lines(spark, str(tmp_path / "in")), M, "line"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    register(spark, M, "demo")
    assert spark.sql("SELECT demo_encode('the') AS e").first()["e"]["pieces"] == ["▁the"]
    rows = spark.sql("SELECT t.* FROM VALUES ('the and'), (NULL) AS x(text), LATERAL demo_tokenize(text) AS t").collect()
    assert [r["piece"] for r in rows] == ["▁the", "▁and"] and spark.table("demo_vocab").count() == len(M.pieces)
    for frame, mode, name in ((stream_stats, "append", "s1"), (stream_totals, "complete", "s2")):
        q = frame(stream_lines(spark, str(tmp_path / "in"), 1), M).writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("s1").count() == 2 and spark.table("s2").first()["tokens"] == spark.table("s1").agg(F.sum("n_tokens")).first()[0]
