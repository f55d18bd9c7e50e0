"""What a worker holds at once: stretches of an Arrow batch, and what it remembers of words."""

import gc
import sys

import numpy as np
import pyarrow as pa
import pytest

from piecewright.functions import encoder as kernel
from piecewright.functions.encoder import Encoder, encode_arrow
from piecewright.plans import queries


def test_batches_are_encoded_in_stretches(spark):
    texts = pa.array(["the " * (k % 700) if k % 11 else None for k in range(3_000)])
    made = list(kernel.encoder_function(spark, queries.UNIGRAM, pieces=False).func(iter([texts, texts.slice(7, 0), texts.slice(40, 900)])))
    assert max(map(len, made)) <= 512 and sum(map(len, made)) == 3_900
    sizes = [r and len(r["ids"]) for part in made for r in part.to_pylist()]
    assert sizes == [None if k % 11 == 0 else k % 700 for k in [*range(3_000), *range(40, 940)]]
    rows = pa.array([None if k % 5 == 0 else ["the"] * (k % 4) for k in range(2_000)])
    made = list(kernel.batch_function(spark, queries.UNIGRAM).func(iter([rows.slice(3)])))
    assert max(map(len, made)) <= 512
    assert [r and len(r) for part in made for r in part.to_pylist()] == [r and len(r) for r in rows.slice(3).to_pylist()]


def test_stretches_by_bytes():
    for texts in (pa.array(["a" * 30] * 10 + ["b" * 500, None, ""]), pa.array([["a" * 10] * 3] * 10 + [["b" * 500], None, []])):
        parts = list(kernel.slices(texts.slice(1), 100))
        assert pa.concat_arrays(parts).equals(pa.concat_arrays([texts.slice(1)]))
        assert [len(p) for p in parts] == [3, 3, 3, 1, 2]


def test_forgotten_words_leave_at_once():
    encoder = Encoder(queries.UNIGRAM)
    encoder.REMEMBERED = 1_000
    gc.collect()
    gc.disable()
    try:
        for k in range(60):
            if k == 10:
                before = sys.getallocatedblocks()
            encode_arrow(encoder, pa.array([" ".join(f"w{k}x{j}" for j in range(2_000))]), pieces=False)
        assert sys.getallocatedblocks() - before < 30_000
    finally:
        gc.enable()


WITHOUT = [queries.UNIGRAM, queries.METASPACE, queries._FEW, queries.ADDED, queries.MERGES]


@pytest.mark.parametrize("which", range(len(WITHOUT)))
def test_unknown_and_added_texts_need_no_encoding_one_by_one(sf_dir, which, monkeypatch):
    import pyarrow.parquet as pq

    m = WITHOUT[which]
    texts = pq.read_table(f"{sf_dir}/documents.parquet", columns=["text"])["text"].to_pylist()[:300]
    texts += ["", None, "日本 ü日 日 x", "日 日", "the日the 日", "andthe[CLS]x. 日. ", " \n ", "\x00日 \x00", "<unk> <unk>日"]
    one = Encoder(m)
    want = [None if t is None else {"ids": [i for i, _ in one(t)], "pieces": [p for _, p in one(t)]} for t in texts]
    monkeypatch.setattr(Encoder, "__call__", lambda *_: pytest.fail("one by one"))
    assert encode_arrow(one, pa.array(texts)).to_pylist() == want
    assert [r and r["ids"] for r in encode_arrow(one, pa.array(texts), pieces=False).to_pylist()] == [r and r["ids"] for r in want]


def test_unknown_pieces_of_several_characters():
    """What is unused and can't be taken apart is unknown as a whole."""
    from dataclasses import replace

    m = replace(queries.MERGES, types=np.where([len(p) > 1 for p in queries.MERGES.pieces], 5, queries.MERGES.types))
    one = Encoder(m)
    texts = ["there and the 日本 thing", "x", "日the"]
    assert encode_arrow(one, pa.array(texts)).to_pylist() == [{"ids": [i for i, _ in one(t)], "pieces": [p for _, p in one(t)]} for t in texts]


@pytest.mark.parametrize("name", ["encode_pieces", "merge_unk", "byte_fallback", "roundtrip", "line_token_stats", "encode_added"])
def test_texts_are_encoded_once(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_segments_shuffle_texts_alone(spark, sf_dir):
    plan = queries.segments(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Generate" not in plan


def test_segments_of_keys_with_several_texts(spark, tmp_path):
    from pyspark.sql import functions as F

    from piecewright.operators import encode

    rows = [(1, "the end. And there"), (1, "x the y and"), (2, ""), (3, None), (4, " "), (4, None), (4, ""), (None, "a the"), (None, "b"), (5, "a|b. c")]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in rows], "doc_id long, text string, lang string, source string")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    each = encode.segments(docs.select(F.col("doc_id").alias("k"), "text"), queries.ADDED)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_pos", "segment"))), lambda x: x["segment"]), "|")
    want = each.groupBy("k").agg(F.count(F.lit(1)).alias("segments"), F.count("added_id").alias("added"), F.md5(joined.cast("binary")).alias("digest"))
    assert sorted(map(tuple, queries.segments(spark, str(tmp_path)).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
