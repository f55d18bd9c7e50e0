"""Text normalization: as Column expressions where there is no character map, else as a Python kernel."""

from __future__ import annotations

import struct
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.model import META, Model


def read_charsmap(data: bytes) -> dict[bytes, str | None]:
    """source bytes -> replacement, from a precompiled character map; None: a replacement outside the map's texts.

    The map is a double-array trie, given by its size in bytes, before the replacements, which end in NUL. The trie is
    walked once, from the root over all bytes.
    """
    if len(data) < 4 or (size := struct.unpack_from("<I", data)[0]) + 4 > len(data):
        return {}
    units = struct.unpack_from(f"<{size // 4}I", data, 4)
    texts, out = data[4 + size :], {}
    if not units:
        return out

    def jump(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def text_at(offset: int) -> str | None:
        if offset >= len(texts):
            return None
        end = texts.find(b"\0", offset)
        return texts[offset : len(texts) if end < 0 else end].decode("utf-8", "surrogateescape")

    open_ = [(jump(units[0]), b"")]
    while open_:
        node, key = open_.pop()
        for byte in range(256):
            at = node ^ byte
            if at >= len(units) or units[at] & 0x800000FF != byte or at == 0 and not key:
                continue
            here, leaf = key + bytes([byte]), at ^ jump(units[at])
            if units[at] >> 8 & 1 and leaf < len(units):
                out[here] = text_at(units[leaf] & 0x7FFFFFFF)
            if len(here) < 64:
                open_.append((leaf, here))
    return out


class Normalizer:
    """A model's normalization of one text."""

    def __init__(self, model: Model):
        self.model = model

    @cached_property
    def _map(self) -> tuple[dict[str, str | None], int, frozenset[str]]:
        out = {}
        for source, to in read_charsmap(self.model.charsmap).items():
            try:
                out[source.decode("utf-8")] = to
            except UnicodeDecodeError:
                continue
        return out, max(map(len, out), default=0), frozenset(k[0] for k in out)

    def mapped(self, text: str) -> list[str]:
        """The text's parts after the character map: at each place the longest entry, else the character itself."""
        table, longest, starts = self._map
        if not table:
            return list(text)
        out, at, n = [], 0, len(text)
        while at < n:
            hit = None
            if text[at] in starts:
                hit = next((k for k in range(min(longest, n - at), 0, -1) if text[at : at + k] in table), None)
            to = table[text[at : at + hit]] if hit else None
            out.append(text[at] if to is None else to)
            at += hit if to is not None else 1 if hit is None else hit
        return out

    def __call__(self, text: str) -> str:
        m = self.model
        if not text:
            return ""
        space = META if m.escape_whitespaces else " "
        head = space if m.add_dummy_prefix else ""
        if not m.charsmap and not m.remove_extra_whitespaces:
            return head + (text.replace(" ", META) if m.escape_whitespaces else text)
        parts = self.mapped(text)
        if not m.remove_extra_whitespaces:
            return head + "".join(parts).replace(" ", space)
        start = next((i for i, p in enumerate(parts) if p != " "), len(parts))
        if start == len(parts):
            return ""
        out, after_space = [head], True
        for part in parts[start:]:
            if after_space:
                part = part.lstrip(" ")
            if part:
                after_space = part.endswith(" ")
                out.append(part.replace(" ", space))
        done = "".join(out)
        while done.endswith(space):
            done = done[: -len(space)]
        return done


def normalize(text: Column, add_dummy_prefix: bool, remove_extra_whitespaces: bool, escape_whitespaces: bool) -> Column:
    """Normalization without a character map, as one expression. Null stays null."""
    space = META if escape_whitespaces else " "
    head = F.lit(space if add_dummy_prefix else "")
    if not remove_extra_whitespaces:
        body = F.replace(text, F.lit(" "), F.lit(space)) if escape_whitespaces else text
        return F.when(text == "", F.lit("")).otherwise(F.concat(head, body))
    lean = F.regexp_replace(F.regexp_replace(text, "^ +", ""), " +", space)
    # \z rather than $, which also matches before a last line end.
    return F.when(F.regexp_replace(text, "^ +", "") == "", F.lit("")).otherwise(F.regexp_replace(F.concat(head, lean), rf"(?:{space})+\z", ""))
