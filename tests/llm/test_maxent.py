"""The language model against plain counts, a plain softmax token by token, and held-out texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from test_llm_operators import ODD, none, odd, prose  # noqa: F401

from piecewright.llm import chunks, maxent


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


ROWS = [*ODD, *((100 + k, prose(40)) for k in range(60)), (300, "neverseen " * 5), (301, "Tie tie tOe toe")]


def test_words_and_base_scores_are_counts(spark, odd, none, monkeypatch):  # noqa: F811
    monkeypatch.setattr(maxent, "LEAST_WEIGHTS", 12)
    got = maxent.maxent_scores(spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)).collect()
    counts = Counter(w for i, t in ROWS if not held(i) for w in tokens_of(t))
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((i, held(i), len(tokens_of(t)), sum(w in counts for w in tokens_of(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens_of(t)), 4)) for i, t in ROWS), key=repr)
    assert sorted(((*tuple(r)[:5], round(r["base_score"], 4)) for r in got), key=repr) == expected
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert maxent.maxent_scores(odd).count() == len(ODD) and maxent.maxent_scores(none).count() == 0
    unseen = next(i for i in range(99) if held(i))
    (alone,) = maxent.maxent_scores(spark.createDataFrame([(unseen, "a b")], "doc_id long, text string")).collect()
    assert (alone["n_known"], alone["train_tokens"]) == (0, 0) and alone["base_score"] == pytest.approx(3 * math.log10(1 / 1))


def plain_scores(rows, model, side):
    """log10 P of each text, a token at a time, from counts of its own."""
    counts = Counter(w for i, t in rows if not held(i) for w in tokens_of(t))
    ends = counts.pop(None)
    n, first = side * side, side * side * 7 // 8
    key = {w: xxhash.xxh3_128_digest(w) for w in {w for _, t in rows for w in tokens_of(t) if w}}
    signed = lambda b: int.from_bytes(b, "little", signed=True)
    shape = {w: zlib.crc32(w[-3:], min(len(w), 15) // 3) % 4096 for w in key}
    second = {w: signed((int.from_bytes(key[w][8:], "little") & ~4095 | shape[w]).to_bytes(8, "little")) for w in key}
    often = sorted((w for w in counts if counts[w] > 1), key=lambda w: (-counts[w], signed(key[w][:8]), second[w]))[: first - 1]
    unit = {w: first + shape[w] % (n - first) for w in key} | {w: 1 + k for k, w in enumerate(often)} | {None: 0}
    total, types, one, two = (Counter() for _ in range(4))
    for w, c in counts.items():
        total[unit[w]] += c
        types[unit[w]] += 1
        one[unit[w]] += c == 1
        two[unit[w]] += c == 2
    total[0] = ends

    def within(w):
        u, c = unit[w], counts[w]
        if u < first:
            return 1.0
        discount = min(0.95, max(0.05, one[u] / (one[u] + 2 * two[u]))) if one[u] else 0.05 if total[u] else 0.5
        return (c - discount) / total[u] if c else discount * types[u] / total[u] if total[u] else 1.0

    def stands(w):
        return 0 if w is None else 1 + (int.from_bytes(key[w][:8], "little") >> 32 if counts[w] >= maxent.LEAST_CONTEXT else shape[w] + 1)

    def softmax(before, node, bias):
        x = bias.astype(float).copy()
        for (r,) in model.rows(*(np.array([b], np.uint64) for b in before), np.array([node]) if node else 0):
            x += model.weights[r]
        return np.exp(x) / np.exp(x).sum()

    share = [[total[c * side + m] + 0.1 for m in range(side)] for c in range(side)]
    classes = np.log([sum(x) / sum(map(sum, share)) for x in share])
    members = [np.log(np.array(x) / sum(x)) for x in share]
    out = []
    for _, t in rows:
        words, score = tokens_of(t), 0.0
        for k, w in enumerate(words):
            before = [stands(words[k - j]) if k >= j else 0 for j in (1, 2)]
            c, m = divmod(unit[w], side)
            score += math.log10(softmax(before, 0, classes)[c] * softmax(before, 1 + c, members[c])[m] * within(w))
        out.append(score)
    return out


def test_scores_are_those_of_a_plain_softmax(spark, monkeypatch):
    rows = [(i, t) for i, t in ROWS if i != 15] + [(400, prose(12)), (401, "a a a")]
    made = []

    def random_model(parts, n_parts, units, size, rounds):
        model = maxent.Model.new(units, size)
        model.weights[:] = np.random.default_rng(4).normal(size=model.weights.shape)
        made.append(model)
        return model

    monkeypatch.setattr(maxent, "train", random_model)
    monkeypatch.setattr(maxent, "LEAST_WEIGHTS", 12)
    monkeypatch.setattr(maxent, "TOKENS", 64)
    got = maxent.maxent_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    expected = sorted(zip([repr(i) for i, _ in rows], plain_scores(rows, made[0], made[0].side)))
    for (_, a), (_, b) in zip(sorted((repr(r["doc_id"]), r["score"]) for r in got), expected):
        assert a == pytest.approx(b, rel=1e-4)


def test_the_model_is_a_distribution():
    shapes = np.zeros((chunks.SHAPES, 4), np.int64)
    shapes[5], shapes[9] = (60, 9, 3, 2), (7, 1, 0, 0)
    units = maxent.Units.made(16, [(11, 5, 30), (-4, 9, 7)], shapes, 20)
    model = maxent.Model.new(units, 1 << 12)
    model.weights[:] = np.random.default_rng(2).normal(size=model.weights.shape)
    every = np.arange(256)
    p = 10 ** model.log10(every, np.full(256, 77, np.uint64), np.full(256, 3, np.uint64))
    assert math.isclose(p.sum(), 1, rel_tol=1e-4)
    # Within a unit of alike words, the known words and the unknown word share the probability.
    unit = units.shapes_from + 5
    assert units.inside[unit].tolist() == [30, 8, 3 / 7]
    known = np.array([1, 1, 1, 2, 2, 5, 9, 9, 0])
    assert math.isclose((10 ** units.within(np.full(9, unit), known)).sum(), 1)
    assert units.of(np.array([11, 11, -4]), np.array([5, 6, 9]), np.array([30, 30, 7])).tolist() == [1, unit + 1, 2]


def test_size_follows_the_corpus():
    assert [maxent.side_for(v) for v in (0, 3_000, 300_000, 4_000_000, 10**12)] == [16, 16, 32, 32, 128]
    assert maxent.weights_for(10**8) > maxent.weights_for(10**7) >= 1 << maxent.LEAST_WEIGHTS and maxent.weights_for(10**12) * 4 <= 32 << 20


def test_gradients_are_summed_by_row():
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        rows, values = rng.integers(0, 40, n), rng.integers(-9, 9, (n, 4)).astype(np.float32)
        plain = np.zeros((40, 4))
        np.add.at(plain, rows, values)
        which, sums = maxent.summed(rows, values)
        assert which.tolist() == sorted(set(rows.tolist())) and (sums == plain[which]).all()


def test_training_lowers_held_out_loss(spark, monkeypatch):
    """Texts in which the two words before tell the next one; what is learned must hold for texts not learned from."""
    rng, rows = random.Random(8), []
    words = [f"w{k}" for k in range(60)]
    for i in range(400):
        at, text = rng.randrange(60), []
        for _ in range(60):
            text.append(words[at])
            at = (at * 7 + rng.choice((1, 1, 1, 2))) % 60
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def loss(rounds):
        got = maxent.maxent_scores(docs, rounds=rounds).toPandas()
        own = got[got["held_out"]]
        return own["score"].sum() / own["n_tokens"].sum(), own["base_score"].sum() / own["n_tokens"].sum()

    (unigram, base), (trained, _) = loss(0), loss(4)
    assert abs(unigram - base) < 0.1 and trained > unigram + 0.5
