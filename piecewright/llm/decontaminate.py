"""Benchmark decontamination: exact hits of item pieces by pigeonhole, verified by Myers' bit-parallel distance."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Edits that a match may have for each character of an item.
RATE = 0.07
#: Items of fewer characters are matched without edits: at word borders if they have so many words, else against whole
#: documents, as a word or two occur in any text.
SHORT, QUOTED_WORDS = 24, 3
#: Characters of items whose pieces one automaton holds, at about 65 bytes a character; more items are searched in as
#: many readings of the texts as needed.
BLOCK_CHARS = 4 << 20


def normal(text: str) -> str:
    """Lower case, white space runs as one space."""
    return " ".join(text.lower().split())


def pieces(text: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): budget + 1 pieces of even lengths; budget edits leave one of them whole."""
    cuts = [len(text) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:])]


def bit_table(pattern: str) -> dict[str, int]:
    table: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        table[ch] = table.get(ch, 0) | 1 << i
    return table


def best_end(table: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best substring match of a pattern of length m, the first of equals; None above budget."""
    if not m:
        return 0, 0
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, at = budget + 1, -1
    if m <= budget:
        best, at = m, 0
    for j, ch in enumerate(text):
        eq = table.get(ch, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & mask
        down = plus & diagonal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = up << 1 & mask
        down = down << 1 & mask
        level = eq | minus
        plus, minus = down | ~(level | up) & mask, up & level
        if score < best:
            best, at = score, j + 1
    return None if at < 0 else (best, at)


@dataclass
class _Items:
    """One block of items in a Python worker."""

    ids: list[int]
    texts: list[str]
    budgets: list[int]

    def __post_init__(self):
        self.short: dict[str, list[int]] = {}
        self.tables = [bit_table(t) for t in self.texts]
        self.back = [bit_table(t[::-1]) for t in self.texts]
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (t, k) in enumerate(zip(self.texts, self.budgets)):
            if len(t) < SHORT:
                self.short.setdefault(t, []).append(i)
                if len(t.split()) >= QUOTED_WORDS:
                    found.setdefault(t, []).append((i, 0))
            else:
                for at, piece in pieces(t, k):
                    found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def match(self, text: str) -> dict[int, tuple[int, int, int]]:
        """item -> (distance, start, end) of its best match in a normalized text."""
        out = {i: (0, 0, len(text)) for i in self.short.get(text, [])}
        if not self.any:
            return out
        hits: dict[int, list[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for i, at in where:
                hits.setdefault(i, []).append(end + 1 - size - at)
        for i, starts in hits.items():
            if i not in out and (best := self._verified(i, sorted(set(starts)), text)):
                out[i] = best
        return out

    def _verified(self, i: int, starts: list[int], text: str) -> tuple[int, int, int] | None:
        """The best match of an item where its pieces say that it may start. Surroundings that overlap are one stretch,
        so that none of a text's characters is verified twice."""
        item, k = self.texts[i], self.budgets[i]
        m, best, stretches = len(item), None, []
        for start in starts:
            if start >= 0 and text.startswith(item, start):
                end = start + m
                if m >= SHORT or (not start or text[start - 1] == " ") and (end == len(text) or text[end] == " "):
                    return 0, start, end
            lo, hi = max(0, start - k), min(len(text), start + m + k)
            if stretches and lo <= stretches[-1][1]:
                stretches[-1][1] = hi
            else:
                stretches.append([lo, hi])
        for lo, hi in stretches if m >= SHORT else ():
            hit = best_end(self.tables[i], m, text[lo:hi], k)
            if hit and (best is None or hit[0] < best[0]):
                end = lo + hit[1]
                back = best_end(self.back[i], m, text[max(0, end - m - k) : end][::-1], k)
                best = hit[0], end - (back[1] if back else m), end
        return best


_BLOCKS: dict[str, _Items] = {}


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", rate: float = RATE) -> DataFrame:
    """(id_col, item_col, distance, budget, match_start, match_end, match): each document and each item that occurs in
    it with at most floor(rate * item characters) edits, at the place of fewest edits.

    Lower case and white space runs are evened out first, and places count in the text so changed. An item is split
    into budget + 1 pieces, of which budget edits leave one whole; all pieces of a block of items are sought at once in
    each whole text, and the hits' surroundings, joined where they overlap, are verified by Myers' bit-parallel distance.
    Items under SHORT characters are matched without edits, at word borders if they have QUOTED_WORDS words, else against
    whole documents. Of places with equal distances the first counts; of an item's ids that have one text, each gives a
    row. The items' size is measured: each block of at most about
    BLOCK_CHARS characters is broadcast and read against all documents, so that any number of items will do. Null or
    empty items match nothing, null texts count as empty, null ids are kept, and rows that repeat an id or an item id
    each give rows. Very long texts are read once, in time that grows with their length. Other columns are not read.
    Either table empty: no rows.
    """
    common.prepare(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    rows = items.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where(F.trim("t") != "")
    chars = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    texts = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("t"))
    schema = f"`{id_col}` long, `{item_col}` long, distance int, budget int, match_start int, match_end int, `match` string"
    out = None
    for block in range(blocks):
        own = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block)
        known = [(r["i"], normal(r["t"])) for r in own.toLocalIterator()]
        known = [(i, t) for i, t in known if t]
        sent, token = sc.broadcast(([i for i, _ in known], [t for _, t in known], [int(rate * len(t)) for _, t in known])), uuid.uuid4().hex

        def run(batches, sent=sent, token=token):
            if token not in _BLOCKS:
                _BLOCKS.clear()
                _BLOCKS[token] = _Items(*sent.value)
            block = _BLOCKS[token]
            for batch in batches:
                found = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = normal(text or "")
                    found += [(doc_id, block.ids[i], d, block.budgets[i], a, b, text[a:b]) for i, (d, a, b) in block.match(text).items()]
                if found:
                    columns = list(zip(*found))
                    kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [id_col, item_col, "distance", "budget", "match_start", "match_end", "match"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out
