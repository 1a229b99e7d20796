"""Chat tables: pairs of turns, and the context each reply was given."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.plans.segments import scan_keys

TURN_SHIFT = 18
BLOCK_SHIFT = 6


def turn_pairs(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Each user turn that an assistant turn follows, as (instruction, input, output).

    ``input`` is the system message in force at that point, or empty.
    """
    scanned = scan_keys(
        df, keys=[conv], order=turn, shift=TURN_SHIFT,
        # The role as a number of its own: a plan that only needs the keys carries no text.
        following={"__answered": (F.col(role) == "assistant").cast("int"), "__reply": F.col(text)},
        held={"__system": F.when(F.col(role) == "system", F.col(text))})
    return (
        scanned.where((F.col(role) == "user") & (F.col("__answered") == 1))
        .select(
            F.concat_ws(":", conv, turn).alias("example_id"),
            conv,
            turn,
            F.col(text).alias("instruction"),
            F.coalesce("__system", F.lit("")).alias("input"),
            F.col("__reply").alias("output"),
        )
    )


def chat_blocks(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """A conversation as a sequence of message arrays, 2**BLOCK_SHIFT turns each."""
    message = F.struct(turn, F.col(role).alias("role"), F.col(text).alias("content"))
    block = F.shiftright(F.col(turn).cast("bigint"), BLOCK_SHIFT)
    return df.groupBy(conv, block.alias("block_no")).agg(
        F.array_sort(F.collect_list(message)).alias("messages"))


def chat_context(
    df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """For each assistant turn, the messages it answers.

    Written out in full, contexts grow with the square of a conversation. So a row holds
    the messages of its own block (``tail``) and the number of messages before them
    (``n_earlier``); those are ``chat_blocks`` of the same conversation with a lower
    ``block_no``. Nothing is cut: blocks and tail together are the whole history, and a
    conversation within one block has its whole history in the tail.
    """
    message = F.struct(F.col(role).alias("role"), F.col(text).alias("content"))
    scanned = scan_keys(
        df, keys=[conv], order=turn, shift=BLOCK_SHIFT,
        sums={"__seen": F.lit(1).cast("bigint")}, collected={"tail": message})
    return scanned.where(F.col(role) == "assistant").select(
        conv, turn,
        F.shiftright(F.col(turn).cast("bigint"), BLOCK_SHIFT).alias("block_no"),
        (F.col("__seen") - 1 - F.size("tail")).alias("n_earlier"),
        "tail",
        F.col(text).alias("reply"))
