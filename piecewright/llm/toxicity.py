"""Toxicity: clauses matched by a weighted finite-state grammar, with weights learned from labels."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .grammar import HEADS, INSULT, NEGATION, OTHER, QUOTE, REPORT, WORDS, Grammar

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\W\d_]+|[\"“”„«»]")
_CLAUSE = re.compile(r"[.!?;]+")
#: What parts the cells of a table, and how many of these make a line one of a table.
BAR, TABLE = "|", 3
_QUOTES = set('"“”„«»')
#: Word beginnings of these lengths, and whole words, may become entries of the insult lexicon.
STEMS = (4, 5, 6)
#: Labelled rows that are learned from, at most, of either label; chosen by a hash of the id.
SAMPLE = 15_000
#: An entry needs so many different surroundings in toxic rows, so high a log odds ratio and log likelihood ratio.
SURROUNDINGS, LOG_ODDS, EVIDENCE = 3, 2.0, 15.0
#: What is believed of a match before labels are seen: weights of a pattern's matches and of their share, and how
#: strongly. Weights are never negative, so that negation and report can only take away.
PRIOR, BELIEF = (8.0, 5.0, 1.0, 3.0, 1.0), 8.0
#: A beginning of which one word makes up so large a part stands for that word alone, and is no entry.
ONE_WORD = 0.8
#: Words whose class a worker remembers.
MEMO = 300_000


def _features(word: str) -> list[str]:
    """A word's beginnings (marked by *) and the word itself."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) >= n)]


def clauses(text: str) -> list[list[str]]:
    """The words and quotation marks of each clause, lower-cased, with English contractions spelled out. What has under
    three words is no clause by itself and belongs to the one that follows. Lines of a table that follow one another are
    one list, which begins with a bar."""
    low, out, open_, table = text.lower().replace("\u2019", "'").replace("n't", " not").replace("'ll", " will"), [], [], []
    for line in low.split("\n"):
        if line.count(BAR) >= TABLE:
            table += _TOKEN.findall(line)
            continue
        if table:
            out.append([BAR, *table])
            table = []
        for part in _CLAUSE.split(line):
            open_ += _TOKEN.findall(part)
            if len(open_) >= 3:
                out.append(open_)
                open_ = []
    return out + [x for x in (open_, [BAR, *table] if table else []) if x]


_FIXED = {w: k for k, words in reversed(WORDS.items()) if k != INSULT for w in words.split()}


@dataclass
class Lexicon:
    """word or beginning* -> weight of an insult; other classes by word."""

    insults: dict[str, float]
    memo: dict[str, tuple[int, float]] = field(default_factory=dict)

    def look(self, word: str) -> tuple[int, float]:
        if (known := self.memo.get(word)) is None:
            may = [word] if word in _FIXED else _features(word)
            weight = max((self.insults[f] for f in may if f in self.insults), default=0.0)
            known = (INSULT, weight) if weight > 0 else (QUOTE if word in _QUOTES else _FIXED.get(word, OTHER), 1.0)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = known
        return known


#: What a document's matched clauses come to: the summed weights of threats, of insults in any pattern, and what framed
#: and direct insults have beyond that, so that a stronger pattern never counts for less; and the share of matched clauses.
FEATURES = ("threat", "insult", "framed", "direct", "share")
_COUNTED = {"threat": [0], "pile": [1], "framed": [1, 2], "direct": [1, 2, 3]}


def clause_scores(text: str, lexicon: Lexicon, grammar: Grammar) -> tuple[np.ndarray, int, str | None]:
    """FEATURES of a text, how many clauses matched, and the heaviest of these. A match weighs what its word does, less
    what negation and report take away."""
    out, matched, best, top = np.zeros(len(FEATURES)), 0, 0.0, None
    look = lexicon.look
    if not any(look(w)[0] in HEADS for w in set(_WORD.findall(text.lower()))):
        return out, 0, None
    total = 0
    for clause in clauses(text):
        total += 1
        read = [look(t) for t in clause]
        if clause[0] == BAR:  # the words of a table build no clause, but insults may stand beside others
            read = [r if r[0] == INSULT else (OTHER, 1.0) for r in read]
        found = grammar.matches([c for c, _ in read])
        if not found:
            continue
        matched, own = matched + 1, 0.0
        for i, pattern, left in found:
            own += read[i][1] * left
            out[_COUNTED[pattern]] += read[i][1] * left
        out[-1] += min(own, 1.0)
        if top is None or own > best:
            best, top = own, " ".join(clause)
    out[-1] /= max(total, 5)
    out[:-1] = np.log1p(out[:-1])
    return out, matched, top


def spoken_words(text: str) -> set[str]:
    """The words of a text that are neither negated nor reported, which is where the lexicon is learned."""
    out = set()
    for clause in clauses(text):
        kinds = [_FIXED.get(w, OTHER) for w in clause]
        if REPORT in kinds:
            clause, kinds = clause[: kinds.index(REPORT)], kinds[: kinds.index(REPORT)]
        if NEGATION in kinds:
            clause = [w for i, w in enumerate(clause) if NEGATION not in kinds[max(0, i - 3) : i]]
        out.update(clause)
    return out - _QUOTES - {BAR}


@dataclass
class ToxicityModel:
    """The lexicon, and a logistic model over the FEATURES of matched clauses."""

    insults: dict[str, float]
    weights: np.ndarray
    bias: float


def _weight(odds: float) -> float:
    """A word's weight by its log odds ratio, about 1 for most insults."""
    return min(odds / 4, 2.0)


def _held(id_col: str, mod: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % mod == 0


def _logistic(x: np.ndarray, y: np.ndarray, each: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights, the bias last, by projected Newton steps on a diagonal bound of the curvature: no weight below 0, and
    each drawn towards PRIOR."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    prior, hold = np.append(PRIOR, -4.0), np.append(np.full(x.shape[1], BELIEF), 1e-3)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (each * (p - y)) + hold * (w - prior)
        curve = (x1 * (each * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(hold)
        free = np.append((w[:-1] > 0) | (grad[:-1] < 0), True)
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], grad[free])
        new = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        new[:-1] = np.maximum(new[:-1], 0)
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 5, sample: int = SAMPLE) -> ToxicityModel:
    """Learns from labelled rows whose crc32(id as text) mod held_mod isn't 0, at most `sample` of either label.

    Entries of the insult lexicon are words and word beginnings that toxic rows have, neither negated nor reported, and
    others hardly do, in at least SURROUNDINGS different surroundings (so that words of one text that was copied many
    times don't enter), besides a fixed list that holds until the labels speak against a word; their number is bounded
    by the sample's words. The weights of the grammar's patterns are fitted to the sample from PRIOR. Null ids, texts
    and labels aren't learned from; a row that is labelled twice counts as toxic if one label says so.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("k"), F.col("toxic").cast("int").alias("y")).where("k is not null and y in (0, 1)").where(~_held("k", held_mod)).groupBy("k").agg(F.max("y").alias("y"))
    turn = F.xxhash64("k")
    chosen = known.where("y = 1").orderBy(turn).limit(sample).union(known.where("y = 0").orderBy(turn).limit(sample))
    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).where("t is not null").join(F.broadcast(chosen), "k")
    rows, path = common.written(texts.select("t", "y"), "toxic-sample")

    def count(batches):
        seen: Counter = Counter()

        def out():
            names = list(seen)
            return pa.RecordBatch.from_pydict({"f": pa.array([n[0] for n in names], pa.string()), "y": pa.array([n[1] for n in names], pa.int32()), "n": pa.array([seen[n] for n in names], pa.int64())})

        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen.update((f, y) for f in {f for w in spoken_words(t) for f in _features(w)})
            if len(seen) > 400_000:
                yield out()
                seen.clear()
        yield out()

    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        common.drop_folder(spark, path)
        return ToxicityModel(dict.fromkeys(WORDS[INSULT].split(), _weight(3.0)), np.array(PRIOR), -4.0)
    odds = F.log((F.col("p") + 0.5) / (n1 + 1)) - F.log((F.col("q") + 0.5) / (n0 + 1))
    counted = rows.mapInArrow(count, "f string, y int, n long").groupBy("f").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("q"))
    both, of1 = F.col("p") + F.col("q"), n1 / (n1 + n0)
    evidence = 2 * (F.col("p") * F.log(F.col("p") / (both * of1)) + F.when(F.col("q") > 0, F.col("q") * F.log(F.col("q") / (both * (1 - of1)))).otherwise(0))
    strong = counted.withColumn("w", odds).where((F.col("p") >= SURROUNDINGS) & (F.col("w") >= LOG_ODDS)).where(evidence >= EVIDENCE).collect()  # at most the sample's words
    weights = {r["f"]: (r["w"], r["p"], r["q"]) for r in strong}
    most: Counter = Counter()  # of a beginning: toxic rows of the one word that has most
    for f, (_, p, _) in weights.items():
        for own in _features(f)[1:] if not f.endswith("*") else ():
            most[own] = max(most[own], p)
    weights = {f: v for f, v in weights.items() if most[f] < ONE_WORD * v[1]}

    def around(batches):
        for batch in batches:
            found = set()
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if y == 1:
                    words = _WORD.findall(t.lower())
                    for i, w in enumerate(words):
                        for f in _features(w):
                            if f in weights:
                                found.add((f, zlib.crc32(" ".join(words[max(0, i - 2) : i]).encode()), zlib.crc32(" ".join(words[i + 1 : i + 3]).encode())))
            yield pa.RecordBatch.from_pydict({"f": pa.array([x[0] for x in found], pa.string()), "b": pa.array([x[1] for x in found], pa.int64()), "a": pa.array([x[2] for x in found], pa.int64())})

    spread = {r["f"]: min(r["b"], r["a"]) for r in rows.mapInArrow(around, "f string, b long, a long").groupBy("f").agg(F.count_distinct("b").alias("b"), F.count_distinct("a").alias("a")).collect()}
    insults = {f: _weight(w) for f, (w, p, q) in weights.items() if spread.get(f, 0) >= max(SURROUNDINGS, 0.5 * p)}
    spoken = {r["f"]: r["q"] for r in counted.where(F.col("f").isin(WORDS[INSULT].split())).collect()}
    for w in WORDS[INSULT].split():
        if w not in insults and spoken.get(w, 0) <= 0.002 * n0 + 1:
            insults[w] = _weight(3.0)
    machine = Grammar()

    def measure(batches):
        lexicon = Lexicon(insults)
        for batch in batches:
            x = np.array([clause_scores(t, lexicon, machine)[0] for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_pydict({"y": batch.column(1), **{f"x{i}": pa.array(x[:, i]) for i in range(len(FEATURES))}})

    seen = rows.mapInArrow(measure, "y int, " + ", ".join(f"x{i} double" for i in range(len(FEATURES)))).toPandas()
    common.drop_folder(spark, path)
    y = seen["y"].to_numpy(float)
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = np.where(y == 1, shares[1] / n1, shares[0] / n0)
    w = _logistic(seen.drop(columns="y").to_numpy(float), y, each)
    return ToxicityModel(insults, w[:-1], float(w[-1]))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score, predicted, matched_clauses, top_clause) for each row, scored by its whole text alone.

    Null and empty texts match no clause and get the score of a text without matches, as do words that stand in no
    clause. Rows that repeat an id each give a row, null ids are kept, other columns are not read. Very long texts are
    read clause by clause.
    """
    common.prepare(docs.sparkSession)
    machine = Grammar()
    insults, weights, bias = model.insults, model.weights, model.bias

    def run(batches):
        lexicon = Lexicon(insults)
        for batch in batches:
            found = [clause_scores(t or "", lexicon, machine) for t in batch.column(1).to_pylist()]
            x = np.array([f[0] for f in found]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.string())], [id_col, "score", "predicted", "matched_clauses", "top_clause"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` long, score double, predicted int, matched_clauses long, top_clause string")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_mod: int = 5, sample: int = SAMPLE) -> DataFrame:
    """Trains on the labelled rows of docs and scores all of docs; held_out marks rows that aren't learned from. No
    labels of either kind: the fixed list and PRIOR hold. No rows: none."""
    common.prepare(docs.sparkSession)
    scored = score(docs, train(docs, labels, id_col, text_col, held_mod, sample), id_col, text_col)
    return scored.withColumn("held_out", F.coalesce(_held(id_col, held_mod), F.lit(False)))


def without_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """docs without the rows whose whole text scores 0.5 or more; all columns stay as they are, whatever their names, and
    each row of a repeated id is judged by its own text. Null and empty texts stay."""
    common.prepare(docs.sparkSession)
    at, machine = docs.columns.index(text_col), Grammar()
    insults, weights, bias = model.insults, model.weights, model.bias

    def run(batches):
        lexicon = Lexicon(insults)
        for batch in batches:
            x = np.array([clause_scores(t or "", lexicon, machine)[0] for t in batch.column(at).to_pylist()]).reshape(-1, len(FEATURES))
            kept = batch.filter(pa.array(x @ weights + bias < 0))
            if kept.num_rows:
                yield kept

    return docs.mapInArrow(run, docs.schema)
