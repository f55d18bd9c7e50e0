"""Unigram segmentation of one segment: the path of greatest float32 score."""

from __future__ import annotations

from array import array

import numpy as np

from ..sources.model import USER_DEFINED, Model, byte_piece

#: What an unknown character costs below the least normal piece.
UNKNOWN_PENALTY = 10.0


class Unigram:
    """Scores add up in float32 from the segment's start; of equal paths to a place, the one found from the earliest
    start stays. A character that no piece covers alone falls back to its bytes, at the cost of the byte pieces' own
    scores, or to the unknown piece."""

    def __init__(self, model: Model):
        one = array("f", [0.0])

        def rounded(x: float) -> float:
            one[0] = x
            return one[0]

        top = model.score_bounds[1]
        self.model, self.longest = model, model.longest
        self.pieces = {
            p: (i, rounded(rounded(len(p.encode("utf-8", "surrogatepass")) * top) - 0.1) if model.types[i] == USER_DEFINED else float(model.scores[i])) for p, i in model.matchable.items()
        }
        self.unknown = rounded(model.score_bounds[0] - UNKNOWN_PENALTY)

    def _bytes(self, ch: str) -> tuple[int, float]:
        """(id of the first byte's piece or the unknown piece, summed score of the byte pieces there are)."""
        m, total, first = self.model, array("f", [0.0]), None
        for b in ch.encode("utf-8", "surrogatepass"):
            i = m.index.get(byte_piece(b))
            first = (m.unk_id if i is None else i) if first is None else first
            if i is not None:
                total[0] += float(m.scores[i])
        return first, total[0]

    def __call__(self, text: str) -> list[tuple[int, str]]:
        n, m, pieces, longest = len(text), self.model, self.pieces, self.longest
        if not n:
            return []
        best, came, ids, new = array("f", bytes(4 * (n + 1))), [-1] * (n + 1), [0] * (n + 1), array("f", [0.0])
        for start in range(n):
            here, alone = best[start], False
            for end in range(start + 1, min(n, start + longest) + 1):
                hit = pieces.get(text[start:end])
                if hit is None:
                    continue
                alone = alone or end == start + 1
                new[0] = here + hit[1]
                if came[end] < 0 or new[0] > best[end]:
                    best[end], came[end], ids[end] = new[0], start, hit[0]
            if not alone:
                end = start + 1
                i, cost = self._bytes(text[start]) if m.byte_fallback else (m.unk_id, self.unknown)
                new[0] = here + cost
                if came[end] < 0 or new[0] > best[end]:
                    best[end], came[end], ids[end] = new[0], start, i
        out, end = [], n
        while end:
            start, i = came[end], ids[end]
            if m.byte_fallback and 0 <= i < len(m.pieces) and m.types[i] == 6:
                out += [(m.piece_to_id(byte_piece(b)), byte_piece(b)) for b in reversed(text[start:end].encode("utf-8", "surrogatepass"))]
            else:
                out.append((i, text[start:end]))
            end = start
        return out[::-1]


class UnigramBatch:
    """Unigram for many segments at once: the same steps, in the same float32, with numpy over all segments.

    Substrings that a table of hash bits doesn't rule out are looked up by 64-bit rolling hashes of their code points among those of the pieces of each length,
    which differ, and what is found is compared by code points. Steps go from place to place; at each, all segments that reach so far relax their edges by length.
    """

    _BASE = np.uint64(0x9E3779B97F4A7C15)
    #: What scores add up in.
    FLOAT: type = np.float32

    def __init__(self, model: Model):
        self.one, self.model = Unigram(model), model
        self._tables(self.one.pieces)

    def _tables(self, known: dict[str, tuple[int, float]]) -> None:
        by_length: dict[int, list[tuple[str, int, float]]] = {}
        for piece, (i, score) in known.items():
            by_length.setdefault(len(piece), []).append((piece, i, score))
        self.longest = max(by_length, default=0)
        self.tables = {}
        for n, pieces in by_length.items():
            codes = np.array([[ord(ch) for ch in p] for p, _, _ in pieces], np.uint64)
            hashes = np.zeros(len(pieces), np.uint64)
            for k in range(n):
                hashes = self._next(hashes, codes[:, k])
            order = np.argsort(hashes)
            if len(np.unique(hashes)) < len(pieces):
                raise ValueError("two pieces have one hash")
            marks = np.zeros(1 << (16 * len(pieces)).bit_length(), bool)
            marks[(hashes & np.uint64(len(marks) - 1)).astype(np.int64)] = True
            self.tables[n] = marks, hashes[order], np.array([i for _, i, _ in pieces], np.int64)[order], np.array([x for _, _, x in pieces], self.FLOAT)[order], codes[order]
        self.fallback: dict[int, tuple[float, list[int]]] = {}

    def _next(self, hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (hashes + codes + np.uint64(1)) * self._BASE
            return x ^ (x >> np.uint64(29))

    def _uncovered(self, code: int) -> tuple[float, list[int]]:
        """(cost, ids) of a character without a piece of its own."""
        if code not in self.fallback:
            ch, m = chr(code), self.model
            if not m.byte_fallback:
                found = self.one.unknown, [m.unk_id]
            else:
                first, cost = self.one._bytes(ch)
                of_bytes = 0 <= first < len(m.pieces) and m.types[first] == 6
                found = cost, [m.piece_to_id(byte_piece(b)) for b in ch.encode("utf-8", "surrogatepass")] if of_bytes else [first]
            self.fallback[code] = found
        return self.fallback[code]

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all segments in a row, where each begins and the last ends)."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        order = np.argsort(-lengths, kind="stable")
        size = lengths[order]
        codes = np.frombuffer("".join([segments[k] for k in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(codes)
        first = np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, np.int64)
        slots = first + np.arange(len(size))
        hashes, pieces = np.zeros(n, np.uint64), {}
        for k in range(1, min(self.longest, int(size[0]) if len(size) else 0) + 1):
            hashes = self._next(hashes[: n - k + 1], codes[k - 1 :])
            if k in self.tables:
                marks, table, ids, scores, spelled = self.tables[k]
                found = np.flatnonzero(marks[(hashes & np.uint64(len(marks) - 1)).astype(np.int64)])
                at = np.minimum(np.searchsorted(table, hashes[found]), len(table) - 1)
                hit = table[at] == hashes[found]
                for j in range(k):
                    hit &= codes[found + j] == spelled[at, j]
                found, at = found[hit], at[hit]
                pieces[k] = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), self.FLOAT)
                pieces[k][0][found], pieces[k][1][found] = ids[at], scores[at]
        alone = pieces[1][0] >= 0 if 1 in pieces else np.zeros(n, bool)
        missing = {c: self._uncovered(c) for c in np.unique(codes[~alone]).tolist()}
        cost = np.zeros(n, self.FLOAT)
        if missing:
            known = np.array(sorted(missing), np.uint64)
            cost[~alone] = np.array([missing[int(c)][0] for c in known], self.FLOAT)[np.searchsorted(known, codes[~alone])]
        best, came, step = np.zeros(n + len(size), self.FLOAT), np.full(n + len(size), -1, np.int32), np.zeros(n + len(size), np.int64)

        def relax(to: np.ndarray, new: np.ndarray, code: np.ndarray, start: int) -> None:
            better = (came[to] < 0) | (new > best[to])
            to = to[better]
            best[to], came[to], step[to] = new[better], start, code[better]

        for start in range(int(size[0]) if len(size) else 0):
            reach = int(np.searchsorted(-size, -start, "left"))  # segments longer than start
            at, here = first[:reach] + start, best[slots[:reach] + start]
            for k, (ids, scores) in pieces.items():
                fit = int(np.searchsorted(-size, -(start + k), "right"))  # segments of at least start + k
                if not fit:
                    break
                own = ids[at[:fit]]
                hit = np.flatnonzero(own >= 0)
                if len(hit):
                    relax(slots[hit] + start + k, here[hit] + scores[at[hit]], own[hit], start)
            bare = np.flatnonzero(~alone[at])
            if len(bare):
                relax(slots[bare] + start + 1, here[bare] + cost[at[bare]], -1 - codes[at[bare]].astype(np.int64), start)
        # Back from all ends at once.
        end, live, found, whose = size.copy(), np.flatnonzero(size > 0), [], []
        while len(live):
            slot = slots[live] + end[live]
            found.append(step[slot])
            whose.append(live)
            end[live] = came[slot]
            live = live[end[live] > 0]
        if not found:
            return np.zeros(0, np.int32), np.zeros(len(segments) + 1, np.int64)
        ids, whose = np.concatenate(found[::-1]), order[np.concatenate(whose[::-1])]
        # Steps were gathered from the last to the first; a stable sort by segment puts them in order.
        turn = np.argsort(whose, kind="stable")
        ids, whose = ids[turn], whose[turn]
        if missing:
            bad = np.flatnonzero(ids < 0)
            sizes = np.ones(len(ids), np.int64)
            spelled = [missing[-1 - c][1] for c in ids[bad].tolist()]
            sizes[bad] = [len(x) for x in spelled]
            whose, at = np.repeat(whose, sizes), np.cumsum(sizes) - sizes
            out = np.repeat(ids, sizes)
            for k, own in zip(at[bad].tolist(), spelled):
                out[k : k + len(own)] = own
            ids = out
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(segments)))))
