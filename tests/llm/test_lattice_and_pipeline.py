"""The lattice and the pipeline against plain versions of the same."""

import random

import pytest
from test_llm_operators import brute_lines, brute_simhash
from test_small_parts import distance

from piecewright.llm import common, lattice
from piecewright.sources import samples
from piecewright.sources.model import META, load

PUBLIC = "/opt/tokenizers/piece_bpe_32k.model"
TEXTS = [None, "", " ", "  a", "the thing and the ones", "a  b ", "\n", "\n\nx \ny ", "\x00a \x00", META + "a", "a" + META + "b  c", "日本 🚀 naïve", "z" * 2000 + " the " + "th" * 300, "the thing"]


def viterbi(scores, longest, unknown, word):
    best = [(0.0, 0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(max(0, end - longest), end):
            found = scores.get(word[start:end]) or ((unknown, -1 - ord(word[start])) if end - start == 1 else None)
            if found and (best[end] is None or best[start][0] + found[0] > best[end][0]):
                best[end] = (best[start][0] + found[0], start, found[1])
    out, at = [], len(word)
    while at:
        out.append(best[at][2])
        at = best[at][1]
    return out[::-1]


def plain(model, text):
    from piecewright.functions.normalize import Normalizer

    scores = lattice.piece_scores(model)
    unknown = min(scores.values()) - lattice.UNKNOWN_PENALTY
    table = {model.pieces[i]: (s, i) for i, s in scores.items()}
    ids = [x for c in viterbi(table, model.longest, unknown, Normalizer(model)(text or "")) for x in (lattice.unknown_ids(model, -1 - c) if c < 0 else [c])]
    if not model.byte_fallback:
        ids = [x for k, x in enumerate(ids) if not (x == model.unk_id and k and ids[k - 1] == model.unk_id)]
    return ids


def proto_like(byte_fallback):
    """A Unigram model that normalizes as protobuf models do."""
    from dataclasses import replace

    return replace(samples.unigram(accented=False, byte_fallback=byte_fallback), add_dummy_prefix=True, escape_whitespaces=True, pre_tokenizer="none", from_json=False)


@pytest.mark.parametrize("fallback", [True, False])
def test_lattice_is_the_best_path_of_the_whole_text(spark, tmp_path, fallback):
    model, rows = proto_like(fallback), [(k if k % 5 else None, t, "c") for k, t in enumerate(TEXTS)] + [(1, "again", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, word string").repartition(2).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    key = lambda r: repr(r)
    expected = sorted(((i, plain(model, t)) for i, t, _ in rows), key=key)
    for df in (docs, docs.repartition(3)):
        got = lattice.lattice_encode(df, model).collect()
        assert sorted(((r["doc_id"], r["ids"]) for r in got), key=key) == expected
        if fallback:
            assert sorted(r["decoded"] for r in got) == sorted((t or "").replace(META, " ") for _, t, _ in rows)
    assert lattice.lattice_encode(docs.limit(0), model).count() == 0


@pytest.mark.parametrize("model", [proto_like(True), proto_like(False), samples.bpe()])
def test_the_fold_in_spark_gives_the_same_ids(spark, model):
    rng = random.Random(2)
    words = sorted({META + "".join(rng.choice("thenadioré日\x00") for _ in range(rng.randint(0, 14))) for _ in range(300)} | {"\nthe", "a" * 700, META * 3})
    many, table = lattice.LatticeBatch(model), spark.createDataFrame([(w,) for w in words], "word string")
    ids, offsets = many(words)
    found = {r["word"]: [x for c in r["ids"] for x in (lattice.unknown_ids(model, -1 - c) if c < 0 else [c])] for r in lattice.encode_words(table, model).collect()}
    assert found == {w: ids[a:b].tolist() for w, a, b in zip(words, offsets, offsets[1:])}


def test_lattice_with_a_public_vocabulary(spark, sf_dir):
    try:
        model = load(PUBLIC)
    except FileNotFoundError:
        pytest.skip("no vocabulary file")
    docs = common.documents(spark, sf_dir)
    got = {r["doc_id"]: r for r in lattice.lattice_encode(docs, model).collect()}
    rows = docs.collect()
    assert len(got) == len(rows) and all(got[r["doc_id"]]["decoded"] == r["text"] for r in rows)
    for r in random.Random(1).sample(rows, 15):
        if len(r["text"]) < 5000:
            assert got[r["doc_id"]]["ids"] == plain(model, r["text"])


def test_long_words_are_folded_as_short_ones(monkeypatch):
    rng = random.Random(6)
    for fallback in (True, False):
        model = proto_like(fallback)
        words = [META + "".join(rng.choice("theandxé🚀") for _ in range(rng.randint(1, 90))) for _ in range(60)]
        many = lattice.LatticeBatch(model)
        expected = many(words)
        monkeypatch.setattr(lattice, "LONG_WORD", 20)
        got = many(words)
        monkeypatch.undo()
        assert got[0].tolist() == expected[0].tolist() and got[1].tolist() == expected[1].tolist()


def test_texts_without_spaces(spark):
    model, text = proto_like(True), "thé" * 150_000
    rows = spark.createDataFrame([(k, text + str(k)) for k in range(3)], "doc_id long, text string")
    assert [r["decoded"] == text + str(r["doc_id"]) for r in lattice.lattice_encode(rows, model).collect()] == [True] * 3
    memory = lattice._Memory(model)
    for k in range(40):
        memory.numbers([f"{k}" + "x" * 600_000])
    assert memory.chars <= lattice.REMEMBERED_CHARS + 600_100


def test_pipeline_against_a_plain_version(spark, sf_dir):
    import corpus_pipeline as p
    from piecewright.llm.decontaminate import RATE, normal
    from piecewright.llm.toxicity import score, train

    docs = common.documents(spark, sf_dir)
    stages, now = [], docs
    for name, stage in p.STAGES:
        out, _ = common.written(stage(spark, now, sf_dir), "stage")
        if len(stages) < len(p.STAGES) - 1:
            assert out.columns == docs.columns
        stages.append({r["doc_id"]: r["text"] for r in out.collect()})
        now = out
    all_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = {r["doc_id"]: r["predicted"] for r in score(docs, train(docs, labels)).collect()}
    assert stages[0] == {i: t for i, t in all_rows if not scored[i]}
    assert stages[1] == {i: t for i, t, _, _ in brute_lines(sorted(stages[0].items()))}
    assert stages[2] == {i: stages[1][i] for i, _, c in brute_simhash(sorted(stages[1].items())) if i == c}
    items = [normal(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]

    def leaks(text):
        text = normal(text)
        return any(item in text or any(item[k : k + 20] in text for k in range(0, len(item) - 19)) and distance(item, text) <= int(RATE * len(item)) for item in items)

    assert stages[3] == {i: t for i, t in stages[2].items() if not leaks(t)}
    assert {i: t.replace(META, " ") for i, t in stages[3].items()} == stages[4]
    assert {r["doc_id"] for r in p.run(spark, sf_dir).collect()} == set(stages[4])


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls, empty and very long texts, repeated ids, clashing names and empty tables."""
    import corpus_pipeline as p
    from test_llm_operators import COPY, LONG

    line = "this very line is in all of these documents"
    rows = [(1, None), (2, ""), (3, LONG), (3, "again " + line), (None, COPY), (None, None), (4, line + "\n" + COPY), (5, line), (6, line + "\n" + COPY), (7, " \n\t"), (8, line)]
    schema = "doc_id long, text string, n_chars int, n_lines int, n_dropped int, gone long, _own0 int, drop string, score double, t string, fp long, page_id long"
    docs = spark.createDataFrame([(*r, 0, 1, 2, r[0], 4, "x", 0.5, "t", 6, 7) for r in rows], schema)
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    dropped = p.dedup_lines(spark, docs, sf_dir).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["n_chars"]) for r in dropped if r["doc_id"] in (5, 8)] == [(5, 0), (8, len(line))] and all(r["n_lines"] == 1 for r in dropped)
    ids = sorted(r["doc_id"] or 0 for r in p.dedup_documents(spark, docs, sf_dir).collect())
    assert ids.count(0) == 2 and 3 in ids and 8 not in ids
    assert p.encode(spark, docs, sf_dir).count() == len(rows)
    assert p.encode(spark, docs.limit(0), sf_dir).count() == 0
