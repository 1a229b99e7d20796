"""The preparation chain: examples in, model-ready rows out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.config import PrepConfig
from tidemill.functions import tokens as tk
from tidemill.functions.templates import template
from tidemill.operators.select import apply_transform, limit_examples
from tidemill.operators.split import train_test_split
from tidemill.plans.order import Ordering


def encode_examples(
    df: DataFrame, prompt: Column, response: Column, config: PrepConfig, tokenizer: tk.Tokenizer
) -> DataFrame:
    """Token ids, labels and lengths; ragged, and cut to the longest allowed sequence, if any."""
    limit = tk.UNCUT if config.max_seq_length is None else config.max_seq_length
    encoded = df.withColumns({
        "__p": tokenizer.encode(prompt, limit, True),
        "__r": tokenizer.encode(response, limit, False),
    })
    eos, _ = tk.resolve_special_ids(tokenizer.eos_id, tokenizer.pad_id)
    with_ids = encoded.withColumn(
        "input_ids", tk.build_input_ids(F.col("__p"), F.col("__r"), eos, limit))
    prompt_length, response_length = tk.token_lengths(F.col("__p"), F.col("__r"), limit)
    return with_ids.withColumns({
        "labels": tk.build_labels(
            F.col("input_ids"), F.size("__p"), limit, config.mask_prompt, config.ignore_index),
        "prompt_length": prompt_length,
        "response_length": response_length,
    }).drop("__p", "__r")


def pad_examples(df: DataFrame, config: PrepConfig) -> DataFrame:
    """Counts of tokens; ids and labels padded to the limit, or left ragged without one."""
    counted = df.withColumns({
        "n_tokens": F.size("input_ids"),
        "n_supervised": F.size(F.array_remove("labels", config.ignore_index)),
    })
    if config.max_seq_length is None:
        return counted
    return counted.withColumns({
        "input_ids": tk.pad_to_length(F.col("input_ids"), config.max_seq_length, config.pad_id),
        "labels": tk.pad_to_length(F.col("labels"), config.max_seq_length, config.ignore_index),
    })


def prepare(
    df: DataFrame, config: PrepConfig, tokenizer: tk.Tokenizer, key: Sequence[str],
    ordering: Ordering | None = None, pad: bool = True,
) -> DataFrame:
    """Limit, split, format, encode, label and pad in one plan; ragged without ``max_seq_length`` or ``pad``.

    The limit and the split work on the key columns only; formatting and encoding are
    one projection over the example rows, which are never shuffled here.
    """
    if config.max_examples is not None and ordering is None:
        raise ValueError("a limit needs an ordering")
    examples = limit_examples(df, config.max_examples, ordering) if ordering else df
    labelled = train_test_split(examples, key, config.test_fraction, config.seed)
    shaped = apply_transform(labelled, config.transform)
    fields = [config.input_field, config.output_field]
    if config.template == "optional_input":
        fields.insert(1, "input")
    prompt, response = template(config.template)(*[F.col(f) for f in fields])
    encoded = encode_examples(shaped, prompt, response, config, tokenizer)
    return pad_examples(encoded, config if pad else replace(config, max_seq_length=None)).select(
        *key, "split", "input_ids", "labels", "prompt_length", "response_length",
        "n_tokens", "n_supervised")
