"""Token arrays: encoding, labels, padding, masks and positions.

Everything here is a column expression, so a whole preparation chain stays one map-side
projection. Arrays are cut before they are built up, which bounds the work per row.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


UNCUT = 2**31 - 2  # more than an array can hold


class Tokenizer(Protocol):
    eos_id: int
    pad_id: int

    def encode(self, text: Column, max_len: int, add_special: bool = True) -> Column: ...


def ints(*values: int) -> Column:
    return F.array(*[F.lit(v).cast("int") for v in values])


def no_ids() -> Column:
    return F.array().cast("array<int>")


def repeat(value: int, count: Column) -> Column:
    return F.array_repeat(F.lit(value).cast("int"), count.cast("int"))


@dataclass(frozen=True)
class ByteTokenizer:
    """One token per UTF-8 byte, behind the special ids; needs no vocabulary file."""

    pad_id: int = 0
    bos_id: int = 1
    eos_id: int = 2
    first_byte_id: int = 3

    @property
    def vocab_size(self) -> int:
        return self.first_byte_id + 256

    def encode(self, text: Column, max_len: int, add_special: bool = True) -> Column:
        room = max_len - 1 if add_special else max_len
        data = F.substring(F.encode(text, "UTF-8"), 1, room)
        # Latin-1 maps each byte to the character of the same number.
        chars = F.split(F.decode(data, "ISO-8859-1"), "")
        ids = F.when(
            F.octet_length(data) > 0,
            F.transform(chars, lambda c: F.ascii(c) + F.lit(self.first_byte_id)),
        ).otherwise(no_ids())
        return F.concat(ints(self.bos_id), ids) if add_special else ids


def resolve_special_ids(eos: int | None, pad: int | None) -> tuple[int, int]:
    """End and padding id, each standing in for the other when only one is defined."""
    if eos is None and pad is None:
        raise ValueError("a tokenizer needs an end or a padding id")
    return (eos if eos is not None else pad, pad if pad is not None else eos)  # type: ignore


def build_input_ids(prompt: Column, response: Column, eos_id: int, max_len: int) -> Column:
    return F.slice(F.concat(prompt, response, ints(eos_id)), 1, max_len)


def build_labels(
    ids: Column, prompt_len: Column, max_len: int, mask_prompt: bool, ignore_index: int = -100
) -> Column:
    if not mask_prompt:
        return ids
    hidden = repeat(ignore_index, F.least(prompt_len, F.size(ids)))
    return F.concat(hidden, F.slice(ids, prompt_len + 1, F.lit(max_len)))


def token_lengths(prompt: Column, response: Column, max_len: int) -> tuple[Column, Column]:
    limit = F.lit(max_len)
    return F.least(F.size(prompt), limit), F.least(F.size(response), limit)


def pad_to_length(ids: Column, max_len: int, value: int) -> Column:
    kept = F.slice(ids, 1, max_len)
    return F.concat(kept, repeat(value, F.lit(max_len) - F.size(kept)))


def padding_mask(length: Column, max_len: int) -> Column:
    """Ones for real tokens, zeros for right padding; by length, as ids may equal pad."""
    real = F.least(length, F.lit(max_len))
    return F.concat(repeat(1, real), repeat(0, F.lit(max_len) - real))


def padding_mask_by_id(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda t: (t != F.lit(pad_id)).cast("int"))


def position_ids(max_len: int) -> Column:
    return F.sequence(F.lit(0), F.lit(max_len - 1))


def mask_positions(length: Column, max_len: int) -> Column:
    """Positions that count real tokens and stand still in the right padding."""
    real = F.least(length, F.lit(max_len))
    last = F.greatest(real - 1, F.lit(0))
    counted = F.when(real > 0, F.sequence(F.lit(0), last)).otherwise(no_ids())
    return F.concat(counted, F.array_repeat(last, (F.lit(max_len) - real).cast("int")))


def all_but_last(ids: Column) -> Column:
    return F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))


def all_but_first(ids: Column) -> Column:
    return F.slice(ids, F.lit(2), F.greatest(F.size(ids) - 1, F.lit(0)))


def shift_targets(ids: Column, mask: Column) -> dict[str, Column]:
    """From padded ids of length L + 1: inputs, next-token targets and their loss mask."""
    return {
        "input_tokens": all_but_last(ids),
        "target_tokens": all_but_first(ids),
        "loss_masks": all_but_first(mask),
    }


def shift_labels(ids: Column, mask: Column) -> dict[str, Column]:
    """As ``shift_targets``, with the attention mask of the inputs in place of the targets'."""
    return {
        "input_ids": all_but_last(ids),
        "labels": all_but_first(ids),
        "attention_mask": all_but_last(mask),
    }


def target_mask(ids: Column, mask: Column) -> dict[str, Column]:
    """Inputs and the mask over the same positions; the loss drops the first one later."""
    return {"input_tokens": all_but_last(ids), "target_mask": all_but_last(mask)}
