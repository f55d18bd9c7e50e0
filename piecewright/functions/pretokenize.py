"""Cutting text into segments before encoding: as Python functions for kernels, and as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.model import META, METASPACE, SPLIT_METASPACE, Model

# Fixed value: the characters with Unicode's White_Space property, which differs from what Python or Java call space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

_SPACES = re.compile(f"[{WHITE_SPACE}]+")
_META_PARTS = re.compile(f"{META}[^{META}]*|^[^{META}]+", re.S)


def split_keeping(text: str, mark: str = META) -> list[str]:
    """Parts that begin at each mark; what comes before the first is a part of its own."""
    if mark == META:
        return _META_PARTS.findall(text)
    return re.findall(f"{re.escape(mark)}[^{re.escape(mark)}]*|^[^{re.escape(mark)}]+", text, re.S)


def metaspace(text: str) -> list[str]:
    text = text.replace(" ", META)
    return split_keeping(text if text.startswith(META) or not text else META + text)


def split_words(text: str) -> list[str]:
    """The words of a text. Python's own notion of space has four characters more than Unicode's property."""
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w for w in _SPACES.split(text) if w]
    return text.split()


def whitespace_metaspace(text: str) -> list[str]:
    return [META + w for w in split_words(text)]


def pre_tokenizer(model: Model) -> Callable[[str], list[str]] | None:
    return {METASPACE: metaspace, SPLIT_METASPACE: whitespace_metaspace}.get(model.pre_tokenizer)


def metaspace_column(text: Column) -> Column:
    """metaspace() as an expression."""
    marked = F.replace(text, F.lit(" "), F.lit(META))
    whole = F.when(F.startswith(marked, F.lit(META)) | (text == ""), marked).otherwise(F.concat(F.lit(META), marked))
    return F.regexp_extract_all(whole, F.lit(f"{META}[^{META}]*"), F.lit(0))


def whitespace_metaspace_column(text: Column) -> Column:
    """whitespace_metaspace() as an expression."""
    spaced = F.replace(F.translate(text, WHITE_SPACE, " " * len(WHITE_SPACE)), F.lit(" "), F.lit(" " + META))
    return F.filter(F.split(F.concat(F.lit(META), spaced), " "), lambda w: w != META)


class AddedTokens:
    """Finds added tokens in raw text, the longest at each place, from left to right."""

    def __init__(self, model: Model):
        self.ids = {t.content: t.id for t in model.matched_added_tokens}
        longest_first = sorted(self.ids, key=lambda c: (-len(c), c))
        self.pattern = "|".join(map(re.escape, longest_first))
        own = re.compile(self.pattern, re.S) if self.ids else None
        self._found = own.finditer if own else None
        self._search = own.search if own else None

    def found(self, text: str) -> bool:
        return self._search is not None and self._search(text) is not None

    def split(self, text: str) -> Iterator[tuple[str, int | None]]:
        """(text, id of an added token or None)."""
        at = 0
        for m in self._found(text) if self._found else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m.group(), self.ids[m.group()]
            at = m.end()
        if at < len(text):
            yield text[at:], None


def added_segments_column(text: Column, model: Model) -> Column:
    """array<struct<segment, added_id>> of a text, as an expression."""
    tokens = AddedTokens(model)
    if not tokens.ids:
        return F.when(text != "", F.array(F.struct(text.alias("segment"), F.lit(None).cast("int").alias("added_id")))).otherwise(F.expr("cast(array() as array<struct<segment:string,added_id:int>>)"))
    quoted = "|".join("\\Q" + c + "\\E" for c in sorted(tokens.ids, key=lambda c: (-len(c), c)))
    parts = F.filter(F.regexp_extract_all(text, F.lit(f"(?s){quoted}|(?:(?!{quoted}).)+"), F.lit(0)), lambda p: p != "")
    ids = F.create_map(*[F.lit(x) for pair in tokens.ids.items() for x in pair])
    return F.transform(parts, lambda p: F.struct(p.alias("segment"), F.try_element_at(ids, p).alias("added_id")))
