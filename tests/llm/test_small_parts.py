"""Kernels of the training-data operators against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from piecewright.llm import cws, decontaminate, grammar, licenses, lines, passages, toxicity, warc
from piecewright.llm.perfect_hash import LineShard, PerfectHash
from piecewright.llm.simhash import fingerprint


def simple_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = [w for w in re.split("[\x20\x09-\x0d]+", low) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉ \t\n\x0b\x0c\r\x1c\xa0z", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text.encode()) == simple_fingerprint(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    text = " ".join(random.Random(1).choice("ab cd ef gh".split()) for _ in range(5000))
    whole = fingerprint(text.encode())
    monkeypatch.setattr("piecewright.llm.simhash.BLOCK", 97)
    assert fingerprint(text.encode()) == whole == simple_fingerprint(text)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=300))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    index = PerfectHash.build(keys)
    assert sorted(index.find(keys).tolist()) == list(range(len(keys))) and len(index) == len(keys)


def test_line_shard():
    rng = np.random.default_rng(3)
    h1, h2 = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    n, last = np.arange(20_000), np.arange(20_000)[::-1].copy()
    shard = LineShard.from_bytes(LineShard.build(h1, h2, n, last).to_bytes())
    known, counts, ids = shard.probe(h1, h2)
    assert known.all() and (counts == n).all() and (ids == last).all()
    assert not shard.probe(h1 + np.uint64(1), h2)[0].any() and not shard.probe(h1, h2 + np.uint64(1))[0].any()
    empty = LineShard.from_bytes(LineShard.build(h1[:0], h2[:0], n[:0], last[:0]).to_bytes())
    assert not empty.probe(h1[:5], h2[:5])[0].any()


def test_line_keys():
    assert lines.line_key(("Ä" * 19).encode(), 20) is None
    assert lines.line_key(("\t AB" + "é" * 18 + " \r").encode(), 20) == ("ab" + "é" * 18).encode()
    assert lines.line_key("A ".encode() * 10, 20) == "a ".encode() * 10


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=16), st.text(alphabet="abc", max_size=30), st.integers(0, 5))
def test_bit_parallel_distance(p, t, k):
    best, found = distance(p, t), decontaminate.best_end(decontaminate.bit_table(p), len(p), t, k)
    assert (found[0] if found else None) == (best if best <= k else None)


def test_items_against_all_distances():
    random.seed(2)
    for _ in range(150):
        items = [decontaminate.normal("".join(random.choice("abcdefgh ") for _ in range(random.randint(24, 60)))) for _ in range(3)]
        budgets = [int(0.1 * len(i)) for i in items]
        text = list("".join(random.choice("abcdefgh ") for _ in range(60)) + items[0] + "xyz")
        for _ in range(random.randint(0, 8)):
            at = random.randrange(len(text))
            text[at] = random.choice(["", "x", text[at] + "y"])
        text = decontaminate.normal("".join(text))
        found = decontaminate._Items([0, 1, 2], items, budgets).match(text)
        for i in range(3):
            best = distance(items[i], text)
            assert (found[i][0] if i in found else None) == (best if best <= budgets[i] and len(items[i]) >= decontaminate.SHORT else None)
            if i in found:
                d, a, b = found[i]
                assert distance(items[i], text[a:b]) == d


@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)))
def test_record_ids(page_id):
    assert warc.page_of(warc.record_id(page_id)) == page_id


def test_archives_can_be_read_by_any_zstandard_reader():
    import zstandard

    records = [warc.warc_record(i, "http://a/" + "x" * 40, (f"<p>page {i} " + "text " * 200).encode(), None if i % 3 else 0) for i in range(300)]
    data = warc.GAP.join(warc.archive_blocks(iter(records), warc._dictionary(records))) + warc.GAP
    assert [h["warc-type"] for h, _ in warc.archive_records(data)].count("revisit") == 100
    assert len(data) < sum(map(len, records)) / 4
    assert list(warc.archive_blocks(iter([]), b"")) == [] and len(list(warc.archive_blocks(iter([b"x"]), b""))) == 1
    size = int.from_bytes(data[4:8], "little")
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    assert reader.decompress(data[8 + size :], max_output_size=1 << 20) == records[0]


def test_every_so_many_blocks_begin_with_the_dictionary():
    records = [warc.warc_record(i, "u", random.Random(i).randbytes(60 + i), None) for i in range(40)]
    blocks = list(warc.archive_blocks(iter(records), b"raw dictionary bytes", 100, 3))
    read = []
    for at in range(0, len(blocks), 3):
        assert int.from_bytes(blocks[at][:4], "little") == warc.DICTIONARY_MAGIC
        read += [h["warc-record-id"] for h, _ in warc.archive_records(warc.GAP.join(blocks[at : at + 3]) + warc.GAP)]
    assert read == [f"<{warc.record_id(i)}>" for i in range(40)] and len(blocks) > 9


def test_repetitive_texts_are_verified_once(monkeypatch):
    read = []
    plain = decontaminate.best_end
    monkeypatch.setattr(decontaminate, "best_end", lambda table, m, text, budget: read.append(len(text)) or plain(table, m, text, budget))
    item = "abcdefgh " * 8 + "the end of it"
    text = "abcdefgh " * 800
    decontaminate._Items([1], [item], [5]).match(text)
    assert sum(read) <= 2 * len(text)


def test_short_items_are_matched_at_word_borders():
    items = decontaminate._Items([1, 2, 3], ["the tiny quote", "word", "one two"], [0, 0, 0])
    assert items.match("here is the tiny quote again") == {0: (0, 8, 22)} and items.match("the tiny quotes") == {} and items.match("bathe tiny quote") == {}
    assert items.match("the tiny quote") == {0: (0, 0, 14)} and items.match("a word") == {} and items.match("word") == {1: (0, 0, 4)} and items.match("one two three") == {}


def test_many_words_are_sampled_in_blocks(monkeypatch):
    rng = random.Random(17)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 40) for _ in range(n)) for n in (0, 3, 500, 700)]
    kept = list(cws._compare(texts))
    monkeypatch.setattr(cws, "MANY", 20)
    monkeypatch.setattr(cws, "BLOCK", 7)
    assert list(cws._compare(texts)) == kept


def test_samples_are_the_least_of_all_words():
    """Each sample against a loop over the words in plain arithmetic."""
    words = cws.Words()
    numbers, counts = words.count("to be or not to be that is the question to")
    words.draw(numbers[counts > 1])
    got = words.fingerprint(numbers, counts)
    names = list(words.number)
    r, c, beta = cws.draws(np.array([cws.xxhash.xxh64_intdigest(w) for w in names], np.uint64))
    for k in range(cws.SAMPLES):
        low = []
        for n, weight in zip(numbers.tolist(), counts.tolist()):
            t = np.floor(np.float32(np.log(weight)) / r[n, k] + beta[n, k])
            low.append(c[n, k] - r[n, k] * (np.float32(1) - beta[n, k]) if t == 0 else c[n, k] - r[n, k] * (t - beta[n, k] + np.float32(1)))
        assert cws._codes(np.array([min(low)], np.float32))[0] == got[k]


def test_weighted_samples_estimate_generalised_jaccard():
    rng, errors = random.Random(9), []
    for k in range(40):  # words of its own each time, as equal words have equal draws
        a = " ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) + str(k) for _ in range(200))
        b = cws.edited(a, " ".join(rng.choice("qrstuvab") + str(k) for _ in range(300)))
        x, y = Counter(a.split()), Counter(b.split())
        p = next(cws._compare([a, a]))[2]
        words = cws.Words()
        ca, cb = words.count(a), words.count(b)
        words.draw(np.unique(np.concatenate([ca[0], cb[0]])))
        errors.append(cws.likeness(words.fingerprint(*ca), words.fingerprint(*cb)) - sum((x & y).values()) / sum((x | y).values()))
        assert cws._hex(words.fingerprint(*ca)) == p
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08
    assert list(cws._compare(["", ""]))[0][2:] == (cws.EMPTY, cws.EMPTY, 1.0, 1.0) and list(cws._compare(["a b", ""]))[0][5] == 0.0


def test_bands_are_tuned():
    for s in (0.5, 0.8, 0.95):
        bands, rows = passages.tuned_bands(s)
        assert 1 - (1 - s**rows) ** bands >= 0.99


def test_links_within_a_bucket_join_what_all_pairs_join():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**60, 60, dtype=np.uint64)
    sets = []
    for k in range(80):
        own = base.copy() if k < 50 else rng.integers(0, 2**60, 60, dtype=np.uint64)
        own[rng.integers(0, 60, rng.integers(0, 6))] = rng.integers(0, 2**60, dtype=np.uint64)
        sets.append(np.unique(own))
    found = passages.links_within(list(range(80)), sets, 0.8)

    def groups(pairs):
        at = list(range(80))
        for a, b in pairs:
            at = [at[a] if x == at[b] else x for x in at]
        return sorted(Counter(at).values())

    exact = [(i, j) for i in range(80) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8]
    assert groups(found) == groups(exact) and len(found) < 80


def test_parts_of_long_lines_don_t_depend_on_what_stands_around():
    rng = random.Random(8)
    words = [f"w{k}" for k in range(5000)]
    inner = rng.sample(words, 220)

    def parts(before, after):
        t = passages.Texts([" ".join(rng.sample(words, before) + inner + rng.sample(words, after)).encode(), b"short line\n" + b"x " * 12])
        return set(t.hashes(*t.paragraphs()).tolist())

    assert len(parts(40, 90) & parts(131, 7)) >= 3


def test_minima_and_seeds_are_those_of_plain_loops():
    rng = random.Random(9)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 150))) for _ in range(5)).encode() for _ in range(6)]
    t = passages.Texts([b"", *texts, b"one two"])
    starts, ends = t.paragraphs()
    assert len(starts) and (ends - starts >= passages.LEAST_WORDS).all() and (t.doc_of(starts) == t.doc_of(ends - 1)).all()
    with np.errstate(over="ignore"):
        plain = [[min((t.shingles[a : b - 4] * passages._ODD[20 + k]).tolist()) for k in range(3)] for a, b in zip(starts, ends)]
    assert t.minima(starts, ends, 3).tolist() == plain
    for run in (20, 21, 8):
        size, expected = passages.seed_words(run), set()
        every = t.hashes(np.arange(len(t.words) - size + 1), np.arange(size, len(t.words) + 1))
        for lo, hi in t.docs.tolist():
            for at in range(lo, hi - run + 1):
                expected.add(at + int(np.argmin(every[at : at + run - size + 1])))
        assert t.seeds(run)[0].tolist() == sorted(expected)


def test_words_of_long_texts_are_those_of_short_blocks(monkeypatch):
    rng = random.Random(15)
    texts = ["".join(rng.choice("ab \n\t\r\x0bZ") * rng.randint(1, 4) for _ in range(rng.randint(0, 300))).encode() for _ in range(12)] + [b"", b" ", b"x" * 500]
    whole = passages.Texts(texts)
    monkeypatch.setattr(passages, "WORD_BYTES", 7)
    short = passages.Texts(texts)
    for name in ("words", "docs", "line_starts", "line_ends", "sums", "shingles"):
        assert (getattr(whole, name) == getattr(short, name)).all(), name
    assert len(whole.words) == sum(len(t.split()) for t in texts)
    assert [int(b - a) for a, b in whole.docs] == [len(t.split()) for t in texts]


def test_stretches_keep_what_any_first_place_covers():
    rng = random.Random(10)
    for _ in range(300):
        units = sorted((a, a + rng.randint(1, 30), rng.randint(1, 3), 2, rng.random() < 0.4) for a in (rng.randint(0, 120) for _ in range(rng.randint(1, 9))))
        state = [None] * 200
        for a, b, *_, kept in units:
            for w in range(a, b):
                state[w] = kept or bool(state[w])
        run, expected = [], []
        for w in range(200):
            if state[w] is not None:
                run.append(w)
            elif run:
                expected += [(x, state[x]) for x in run if len(run) >= 20]
                run = []
        columns = [np.array(c) for c in zip(*units)]
        docs = np.repeat([3, 8], len(units))  # the same units in two documents
        made = passages.stretches(docs, *(np.concatenate([c, c]) for c in columns), 20)
        for doc in (3, 8):
            got = sorted((w, bool(kept)) for d, a, n, _, m, kept in zip(*made) for w in range(a, a + n) if d == doc and m == 2)
            assert got == expected
    assert [len(x) for x in passages.stretches(*(np.zeros(0, np.int64),) * 5, np.zeros(0, bool), 20)] == [0] * 6


def test_grammar():
    found = grammar.Grammar().matches
    O, I, H, T, L, N, R, M, Q = range(9)
    assert found([O, I, O]) == [] and found([I]) == [] and found([O, H, T]) == []
    assert found([T, L, L, I]) == [(3, "direct", 1.0)] and found([I, O, T]) == [(0, "direct", 1.0)] and found([T, O, O, O, I]) == [(4, "framed", 1.0)]
    assert found([L, O, O, O, O, I]) == [(5, "framed", 1.0)] and found([I, O, O, O, O, I]) == [(0, "pile", 1.0), (5, "pile", 1.0)]
    assert found([T, L, N, L, I]) == [(4, "framed", grammar.NEGATED)] and found([R, T, L, L, I]) == [(4, "direct", grammar.REPORTED)]
    assert found([R, Q, T, I, Q, T, I])[0][2] == grammar.REPORTED and found([R, Q, T, I, Q, T, I])[1][2] == 1.0
    assert found([T, M, H, T]) == [(2, "threat", 1.0)] and found([T, M, N, H, T]) == [(3, "threat", grammar.NEGATED)]


def test_the_composed_machine_does_what_its_transducers_do():
    rng = random.Random(12)
    for parts in (grammar.FORWARD, grammar.BACKWARD):
        machine = grammar.composed(parts)
        for _ in range(400):
            classes = [rng.randrange(grammar.CLASSES) for _ in range(rng.randint(0, 25))]
            expected = {i: () for i, c in enumerate(classes) if c in grammar.HEADS}
            for part in parts.values():
                state = part.start
                for i, c in enumerate(classes):
                    state, out = part.step(state, c)
                    if i in expected:
                        expected[i] += out
            assert machine.run(classes) == expected


def test_clauses():
    assert toxicity.clauses("You aren\u2019t it. No! I'll go now;\nA B C") == [["you", "are", "not", "it"], ["no", "i", "will", "go", "now"], ["a", "b", "c"]]
    table = "Before it all.\na | b | the. | x\nc | d | e | f\nAfter it all"
    assert toxicity.clauses(table) == [["before", "it", "all"], ["|", "a", "b", "the", "x", "c", "d", "e", "f"], ["after", "it", "all"]]
    lexicon, found = toxicity.Lexicon({"zorg": 1.0}), grammar.Grammar()
    assert toxicity.clause_scores("the | zorg | of | you", lexicon, found)[1] == 0 and toxicity.clause_scores("the | zorg | of\n | zorg | x | y", lexicon, found)[1] <= 1
    assert toxicity.clause_scores("the | zorg | of | x\na | zorg | x | y", lexicon, found)[1] == 1
    assert toxicity.clauses("") == [] and toxicity.clauses("x") == [["x"]] and toxicity.clauses("A!! B!! C!!") == [["a", "b", "c"]]
    assert toxicity.spoken_words("You are not the idiot we saw today. He said scum is there") >= {"you", "today", "he"}
    assert not toxicity.spoken_words("You are not the idiot we saw today. He said scum is there") & {"idiot", "scum", "said"}


def test_weights_are_never_negative():
    rng = np.random.default_rng(5)
    x = rng.random((4000, len(toxicity.FEATURES)))
    y = (x[:, 3] - x[:, 1] + rng.normal(size=4000) * 0.2 > 0.3).astype(float)
    w = toxicity._logistic(x, y, np.ones(4000))
    assert (w[:-1] >= 0).all() and w[3] > 4 and w[1] == 0


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_each_license_is_told_from_the_others(name):
    scanner = licenses.Scanner(licenses.TEMPLATES)
    for text in licenses.TEMPLATES[name]:
        found = list(scanner.scan(f"some prose before\n\n{text.replace('  ', ' ')}\n\nand more"))
        assert [f[1][0] for f in found] == [name]
    assert not list(scanner.scan("I lost my driving license and need permission to redistribute the seats."))


def licenses_in(text):
    return [(n, f[0]) for n, f in licenses.Scanner(licenses.TEMPLATES).scan(text)]


def test_every_notice_of_a_line_and_of_a_block_is_found():
    prose = " and then they went on along the river" * 60
    assert licenses_in(f"Released under the MIT License.{prose}. Licensed under CC BY-NC 4.0. {prose}") == [(0, "MIT"), (0, "CC-BY-NC-4.0")]
    gpl = licenses.TEMPLATES["GPL-2.0"][1]
    assert licenses_in(f"x\nReleased under the MIT License.\n{gpl}\n{gpl}") == [(1, "MIT"), (2, "GPL-2.0"), (3, "GPL-2.0")]


@pytest.mark.parametrize("mark", ["", "* ", "# "])
def test_notices_are_found_however_they_are_laid_out(mark):
    lay = lambda *parts: "\n".join(mark + p for p in ["x = 1", *parts, "y = 2"])
    bsd = licenses.TEMPLATES["BSD-3-Clause"][0].replace(" 1. ", "\n\n1. ").replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ").split("\n")
    assert licenses_in(lay(*bsd)) == [(1, "BSD-3-Clause")]
    wrapped = [" ".join(bsd[0].split()[k : k + 9]) for k in range(0, len(bsd[0].split()), 9)] + bsd[1:]
    assert licenses_in(lay(*wrapped)) == [(1, "BSD-3-Clause")]
    assert licenses_in(lay("This is free and unencumbered software released into", "the public domain.")) == [(1, "Unlicense")]
    assert licenses_in(lay("This is free and unencumbered software released into the public", "domain.")) == [(1, "Unlicense")]
    assert licenses_in(lay("Released under the MIT", "License.")) == [(1, "MIT")]
    for bullet in ("- ", "* ", "\u2022 ", "(1) ", ""):
        bulleted = licenses.TEMPLATES["BSD-3-Clause"][0]
        for n in "123":
            bulleted = bulleted.replace(f" {n}. ", f"\n\n{bullet.replace('1', n)}")
        assert licenses_in(lay(*bulleted.split("\n"))) == [(1, "BSD-3-Clause")]
    assert licenses_in(lay("SPDX-License-Identifier: GPL-3.0-or-later")) == [(1, "GPL-3.0")] and licenses_in(lay("SPDX-License-Identifier: LGPL-2.1-only")) == [(1, "LGPL-2.1")]


def test_no_notice_is_missed_that_wording_alone_confirms():
    """Every window of every template's length, confirmed without compression, against what the scan reports."""
    rng = random.Random(41)
    scanner = licenses.Scanner(licenses.TEMPLATES)
    short = [t for t in scanner.templates if len(t.words) <= 45]
    filler = "some of the software is here and license files are shipped with it for any person who may read them".split()
    for _ in range(12):
        parts, lines = [], []
        for _ in range(rng.randint(1, 4)):
            own = rng.choice(short).text.split()
            if len(own) > 15 and rng.random() < 0.5:
                own[rng.randrange(2, len(own) - 2)] = "altered"
            parts += [rng.choice(filler) for _ in range(rng.randint(3, 25))] + own
        parts += [rng.choice(filler) for _ in range(5)]
        at = 0
        while at < len(parts):
            n = rng.randint(4, 20)
            lines.append(" ".join(parts[at : at + n]))
            at += n
        text = "\n".join(lines)
        spans = licenses.word_spans(text)
        reported, found = list(scanner.scan(text)), set()
        for t in short:
            n = len(t.words)
            for lo in range(0, len(spans) - n + 1):
                block = text[spans[lo][0] : spans[lo + n - 1][1]]
                if (said := scanner.confirm(block, t)) and said[0] == 1.0:
                    found.add((text.count("\n", 0, spans[lo + said[2]][0]), t.license))
        assert {(line, f[0]) for line, f in reported} >= found
        assert len(reported) >= len({line for line, _ in found})
