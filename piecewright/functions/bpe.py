"""BPE segmentation of one segment: adjacent symbols merge, the best first, while the vocabulary has the result."""

from __future__ import annotations

import heapq

from ..sources.model import UNUSED, Model, byte_piece


class Bpe:
    """Any pair whose text is a piece may merge, by greatest score and then from the left. User-defined pieces are
    symbols from the start and don't merge. A result that is marked unused is taken apart again, by the way it was
    last proposed; one that the vocabulary lacks becomes bytes or the unknown piece."""

    def __init__(self, model: Model):
        self.model, self.index, self.fixed = model, model.index, model.user_defined
        self.longest_fixed = max(map(len, self.fixed), default=0)
        self.scores = [float(s) for s in model.scores]
        self.unused = {p for p, i in model.index.items() if model.types[i] == UNUSED}

    def _symbols(self, text: str) -> tuple[list[str], list[bool]]:
        if not self.fixed:
            return list(text), [False] * len(text)
        symbols, frozen, at = [], [], 0
        while at < len(text):
            size = next((k for k in range(min(self.longest_fixed, len(text) - at), 0, -1) if text[at : at + k] in self.fixed), 0)
            symbols.append(text[at : at + max(size, 1)])
            frozen.append(size > 0)
            at += max(size, 1)
        return symbols, frozen

    def __call__(self, text: str) -> list[tuple[int, str]]:
        symbols, frozen = self._symbols(text)
        n, index, scores = len(symbols), self.index, self.scores
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list[tuple[float, int, int, str]] = []
        apart: dict[str, tuple[str, str]] = {}

        def propose(left: int, right: int) -> None:
            if left < 0 or right >= n or frozen[left] or frozen[right]:
                return
            both = symbols[left] + symbols[right]
            if (i := index.get(both)) is not None:
                if both in self.unused:
                    apart[both] = symbols[left], symbols[right]
                heapq.heappush(queue, (-scores[i], left, right, both))

        for k in range(n - 1):
            propose(k, k + 1)
        while queue:
            _, left, right, both = heapq.heappop(queue)
            # A proposal holds while its symbols stand as they did: neither merged away nor grown.
            if not symbols[left] or not symbols[right] or len(symbols[left]) + len(symbols[right]) != len(both):
                continue
            symbols[left], symbols[right] = both, ""
            after[left] = after[right]
            if after[right] < n:
                before[after[right]] = left
            propose(before[left], left)
            propose(left, after[left])
        out: list[tuple[int, str]] = []
        for s in symbols:
            if s:
                self._settle(s, apart, out)
        return out

    def _settle(self, piece: str, apart: dict[str, tuple[str, str]], out: list[tuple[int, str]]) -> None:
        m, open_ = self.model, [piece]
        while open_:
            own = open_.pop()
            i = self.index.get(own)
            if i is None:
                out += [(m.piece_to_id(byte_piece(b)), byte_piece(b)) for b in own.encode("utf-8", "surrogatepass")] if m.byte_fallback else [(m.unk_id, own)]
            elif own not in self.unused:
                out.append((i, own))
            elif own in apart:
                open_ += reversed(apart[own])
            else:
                out.append((m.unk_id, own))
