"""Model inputs: templates, truncation, padding and masks as expressions over one struct column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.encoder import encoder_function
from ..plans.template import Template
from ..sources.model import Model

FIELDS = ("input_ids", "tokens", "attention_mask", "token_type_ids", "special_tokens_mask")
RIGHT, LEFT = "right", "left"
LONGEST, FIXED = "longest", "max_length"


def _struct(fields: dict[str, Column]) -> Column:
    return F.struct(*[fields[k].alias(k) for k in FIELDS])


def _repeat(value: int | str, n: Column) -> Column:
    return F.array_repeat(F.lit(value), n.cast("int"))


def new_encoding(ids: Column, tokens: Column) -> Column:
    """The five parallel arrays of ids and tokens: attention 1, types and special marks 0."""
    n = F.size(ids)
    return _struct({"input_ids": ids, "tokens": tokens, "attention_mask": _repeat(1, n), "token_type_ids": _repeat(0, n), "special_tokens_mask": _repeat(0, n)})


def add_special(ids: Column, model: Model) -> Column:
    """ids between the model's begin and end ids, also where these are -1."""
    return F.concat(F.array(F.lit(model.bos_id)), ids, F.array(F.lit(model.eos_id)))


def apply_template(enc: Column, template: Template) -> Column:
    """The single template: special tokens, and the sequence wherever A or B stands."""
    n = F.size(enc["input_ids"])
    out: dict[str, list[Column]] = {k: [] for k in FIELDS}
    for part in template.single:
        if part.sequence:
            own = {"input_ids": enc["input_ids"], "tokens": enc["tokens"], "attention_mask": _repeat(1, n), "token_type_ids": _repeat(part.type_id, n), "special_tokens_mask": _repeat(0, n)}
        else:
            own = {k: F.array(F.lit(v)) for k, v in zip(FIELDS, (part.id, part.token, 1, part.type_id, 1))}
        for k in FIELDS:
            out[k].append(own[k])
    empty = {k: F.expr(f"cast(array() as array<{'string' if k == 'tokens' else 'int'}>)") for k in FIELDS}
    return _struct({k: F.concat(*v) if v else empty[k] for k, v in out.items()})


def truncate(enc: Column, length: int) -> Column:
    """The first `length` positions of each array; a negative length cuts nothing."""
    return enc if length < 0 else _struct({k: F.slice(enc[k], 1, length) for k in FIELDS})


def pad(enc: Column, length: Column | int, pad_id: int, pad_token: str = "", side: str = RIGHT) -> Column:
    """Each array filled up to a length: pads have attention, type and special mark 0. Longer ones stay as they are."""
    length = F.lit(length) if isinstance(length, int) else length
    more = F.greatest(length - F.size(enc["input_ids"]), F.lit(0))
    fill = dict(zip(FIELDS, (pad_id, pad_token, 0, 0, 0)))
    return _struct({k: F.concat(*((enc[k], _repeat(v, more)) if side == RIGHT else (_repeat(v, more), enc[k]))) for k, v in fill.items()})


@dataclass(frozen=True)
class Pipeline:
    """How texts become model inputs. The with_ methods give changed copies."""

    model: Model
    template: Template | Callable[[Column], Column] | None = None
    max_length: int | None = None
    padding: str | None = None
    pad_length: int = 0
    pad_id: int = 0
    pad_token: str = ""
    pad_side: str = RIGHT
    cut: bool = False

    def with_template(self, template: Template | Callable[[Column], Column] | None) -> Pipeline:
        return replace(self, template=template)

    def with_truncation(self, max_length: int | None) -> Pipeline:
        return replace(self, max_length=max_length)

    def with_padding(self, strategy: str | None, length: int = 0, pad_id: int = 0, pad_token: str = "", side: str = RIGHT) -> Pipeline:
        return replace(self, padding=strategy, pad_length=length, pad_id=pad_id, pad_token=pad_token, pad_side=side)

    def encode(self, df: DataFrame, text_col: str = "text", into: str = "encoding", add_special_tokens: bool = True, batch: str | None = None) -> DataFrame:
        """df with the encoding struct: template, then truncation (which may cut a closing token off), then attention 1
        throughout, then padding. template may be any function from the encoding struct to another. Padding to the
        longest goes by `batch`, a column whose equal values form a batch; without it the whole of df is one batch,
        whose longest encoding is found by a job of its own, as no task may see all rows."""
        out = df.withColumn("_e", encoder_function(df.sparkSession, self.model, self.cut)(F.col(text_col)))
        out = out.withColumn(into, new_encoding(F.col("_e.ids"), F.col("_e.pieces"))).drop("_e")
        if self.template is not None and add_special_tokens:
            made = apply_template(F.col(into), self.template) if isinstance(self.template, Template) else self.template(F.col(into))
            out = out.withColumn(into, made)
        if self.max_length is not None:
            out = out.withColumn(into, truncate(F.col(into), self.max_length))
        enc = F.col(into)
        if self.padding == FIXED:
            return out.withColumn(into, pad(enc, self.pad_length, self.pad_id, self.pad_token, self.pad_side))
        if self.padding == LONGEST and batch is None:
            longest = out.agg(F.max(F.size(enc["input_ids"]))).first()[0] or 0
            return out.withColumn(into, pad(enc, longest, self.pad_id, self.pad_token, self.pad_side))
        if self.padding == LONGEST:
            longest = F.max(F.size(enc["input_ids"])).over(Window.partitionBy(batch))
            out = out.withColumn("_longest", longest)
            return out.withColumn(into, pad(F.col(into), F.col("_longest"), self.pad_id, self.pad_token, self.pad_side)).drop("_longest")
        return out
