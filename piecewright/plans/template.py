"""Templates: which special tokens go around a sequence."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Part:
    """A special token, or the sequence. A part that is neither is a token of id 0 without text."""

    token: str = ""
    id: int = 0
    type_id: int = 0
    sequence: str | None = None


@dataclass(frozen=True)
class Template:
    """The pair template is kept for callers; only single sequences are encoded, so B stands for the sequence too."""

    single: tuple[Part, ...]
    pair: tuple[Part, ...] = ()


def bert(cls_id: int, sep_id: int, cls_token: str = "[CLS]", sep_token: str = "[SEP]") -> Template:
    """[CLS] A [SEP], and [CLS] A [SEP] B [SEP] for pairs."""
    cls, sep = Part(token=cls_token, id=cls_id), Part(token=sep_token, id=sep_id)
    return Template((cls, Part(sequence="A"), sep), (cls, Part(sequence="A"), sep, Part(sequence="B", type_id=1), Part(token=sep_token, id=sep_id, type_id=1)))
