"""Settings of a data preparation run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class PrepConfig:
    data_source: str = ""
    max_examples: int | None = None
    split: str = "train"
    test_fraction: float = 0.15
    seed: int = 42
    batch_size: int = 32
    max_seq_length: int | None = 64  # None neither cuts nor pads
    ignore_index: int = -100
    mask_prompt: bool = False
    pad_id: int = 0
    input_field: str = "instruction"
    output_field: str = "output"
    template: str = "instruction"
    transform: Callable[[DataFrame], DataFrame] | None = None

    def __post_init__(self) -> None:
        if self.max_seq_length is not None and self.max_seq_length <= 0:
            raise ValueError("max_seq_length has to be positive")
        if self.batch_size <= 0:
            raise ValueError("batch_size has to be positive")
        if not 0.0 <= self.test_fraction <= 1.0:
            raise ValueError("test_fraction has to lie between 0 and 1")
        if self.max_examples is not None and self.max_examples < 0:
            raise ValueError("max_examples must not be negative")
