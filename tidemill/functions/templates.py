"""Prompt templates as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

Pair = tuple[Column, Column]

# Prompt wordings that models are tuned on.
INSTRUCTION_PROMPT = (
    "Below is an instruction that describes a task. Write a response that appropriately "
    "completes the request.\n\n### Instruction:\n{instruction}\n\n### Response:\n"
)
QUESTION_PROMPT = (
    "Below is a medical question. Provide a clear and accurate answer.\n\n"
    "### Question:\n{question}\n\n### Answer:\n"
)
CONTEXT_PREAMBLE = (
    "Below is an instruction that describes a task, paired with an input that provides "
    "further context. Write a response that appropriately completes the request."
)
CONTEXT_SECTIONS = (
    "    ### Instruction: {instruction}", "    ### Input: {input}", "    ### Response: {output}")
# Separators before the three sections, per style.
CONTEXT_SEPARATORS = {
    "plain": ("\n\n", "\n\n", "\n\n"),
    "spaced": ("\n    \n", "\n    \n", "\n    \n"),
    "wide": ("\n\n", "\n\n\n", "\n\n"),
}


def required(column: Column, name: str) -> Column:
    """The column, or a failed job when a row lacks it."""
    missing = F.raise_error(F.lit(f"field '{name}' is null")).cast("string")
    return F.when(column.isNull(), missing).otherwise(column)


def fill(template: str, **fields: Column) -> Column:
    """Put columns into the ``{name}`` places of a template."""
    parts: list[Column] = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(required(fields[name], name))
    return F.concat(*parts)


def format_instruction(instruction: Column, output: Column) -> Pair:
    return fill(INSTRUCTION_PROMPT, instruction=instruction), required(output, "output")


def format_question(question: Column, answer: Column) -> Pair:
    return fill(QUESTION_PROMPT, question=question), required(answer, "answer")


def context_template(style: str = "plain") -> str:
    body = "".join(a + b for a, b in zip(CONTEXT_SEPARATORS[style], CONTEXT_SECTIONS))
    return CONTEXT_PREAMBLE + body


def format_alpaca(
    instruction: Column, context: Column, output: Column, eos: str = "</s>", style: str = "plain"
) -> Column:
    """One text that holds instruction, input and answer, closed by the end marker."""
    filled = fill(context_template(style), instruction=instruction, input=context, output=output)
    return F.concat(filled, F.lit(eos))


def format_optional_input(instruction: Column, context: Column, output: Column) -> Pair:
    """The input line is left out for rows without input."""
    line = F.when(F.length(context) > 0, fill("Input: {input}\n", input=context)).otherwise("")
    prompt = F.concat(fill("Instruction: {instruction}\n", instruction=instruction), line,
                      F.lit("Output: "))
    return prompt, required(output, "output")


_TEMPLATES: dict[str, Callable[..., Pair]] = {
    "instruction": format_instruction,
    "question": format_question,
    "optional_input": format_optional_input,
}


def register_template(name: str, builder: Callable[..., Pair]) -> None:
    """Make a builder (columns in, (prompt, response) out) available by name."""
    _TEMPLATES[name] = builder


def template(name: str) -> Callable[..., Pair]:
    if name not in _TEMPLATES:
        raise ValueError(f"unknown template '{name}', known: {sorted(_TEMPLATES)}")
    return _TEMPLATES[name]
