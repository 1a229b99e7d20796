"""First matching rule of a large set of patterns.

A text that matches a pattern has to hold the characters that the pattern spells out. All these literals make one
Aho-Corasick automaton, which goes over a text once and names the few rules that can match. Only their
patterns are tried, in the order of the rules and by the JVM's regular expressions, so the first match is that of a
chain of conditions over all rules, and the plan does not grow with them.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are sent to every Python worker; beyond this many characters they are refused.
MAX_RULE_CHARS = 16_000_000

#: Escapes that stand for a place or for a class of characters; other letters and digits are not looked into.
CLASS_ESCAPES = frozenset("dDwWsSbBAzZGhHvVR")
CANDIDATE = "array<struct<pattern:string,spec:string>>"


def literals(pattern: str) -> tuple[str, ...]:
    """Texts of which every match of the pattern holds one; none where that cannot be said.

    That is the longest run of plain characters outside of groups, for each alternative. Whatever is
    not understood for sure (flags, quotes, references, codes of characters) gives none.
    """
    if re.search(r"\\Q|\(\?[a-zA-Z-]", pattern):
        return ()
    found: list[str] = []
    best = run = ""
    at, depth = 0, 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "\\":
            if at == len(pattern):
                return ()
            char, at = pattern[at], at + 1
            if char.isalnum() and char not in CLASS_ESCAPES:
                return ()
            if not depth and not char.isalnum():
                run += char
                continue
        elif char == "[":
            at = _after_class(pattern, at)
            if not at:
                return ()
        elif char in "()":
            depth += 1 if char == "(" else -1
            if depth < 0:
                return ()
        elif depth:
            continue
        elif char in "*?{":
            run = run[:-1]
            if char == "{":
                at = pattern.find("}", at) + 1
                if not at:
                    return ()
        elif char == "|":
            found.append(max(best, run, key=len))
            best = run = ""
            continue
        elif char not in "+.^$":
            run += char
            continue
        best, run = max(best, run, key=len), ""
    found.append(max(best, run, key=len))
    return () if depth or not all(found) else tuple(found)


def _after_class(pattern: str, at: int) -> int:
    """Place after the bracket that ends a class of characters, which may hold others; 0 if that is not sure."""
    if pattern[at:at + 1] == "]" or pattern[at:at + 2] == "^]":
        return 0
    depth = 1
    while at < len(pattern):
        char = pattern[at]
        at += 2 if char == "\\" else 1
        depth += {"[": 1, "]": -1}.get(char, 0)
        if not depth:
            return at
    return 0


def is_plain(pattern: str) -> bool:
    """Whether the pattern spells out all that it matches."""
    return bool(pattern) and not re.search(r"[\\\[\](){}*+?.^$|]", pattern)


Rules = tuple[tuple[str, str], ...]


@lru_cache(maxsize=4)
def _automaton(rules: Rules) -> tuple[ahocorasick.Automaton | None, tuple[int, ...]]:
    """Automaton from literals to the numbers of their rules, and the rules that any text may match."""
    holders: dict[str, list[int]] = {}
    always = []
    for number, (pattern, _) in enumerate(rules):
        needed = literals(pattern)
        if not needed:
            always.append(number)
        for text in set(needed):
            holders.setdefault(text, []).append(number)
    if not holders:
        return None, tuple(always)
    automaton = ahocorasick.Automaton()
    for text, numbers in holders.items():
        automaton.add_word(text, tuple(numbers))
    automaton.make_automaton()
    return automaton, tuple(always)


def _possible(text: str | None, rules: Rules) -> list[dict] | None:
    """Rules that may match, in order, up to the first that does for sure (its pattern is left out)."""
    if text is None:
        return None
    automaton, always = _automaton(rules)
    numbers = set(always)
    if automaton is not None:
        for _, hit in automaton.iter(text):
            numbers.update(hit)
    kept = []
    for number in sorted(numbers):
        pattern, spec = rules[number]
        sure = is_plain(pattern)
        kept.append({"pattern": None if sure else pattern, "spec": spec})
        if sure:
            break
    return kept


def possible_rules(column: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Array of the rules whose literals are in the text, in their order."""
    held: Rules = tuple((pattern, spec) for pattern, spec in rules)
    size = sum(len(pattern) + len(spec) for pattern, spec in held)
    if size > MAX_RULE_CHARS:
        raise ValueError(f"rules of {size} characters; {MAX_RULE_CHARS} is the bound for what goes to every worker")

    def look(texts: pd.Series) -> pd.Series:
        return pd.Series([_possible(text, held) for text in texts], dtype=object)

    return F.pandas_udf(look, CANDIDATE)(column)


def first_match_of_many(
    df: DataFrame, rules: Sequence[tuple[str, str]], column: str, exempt: Column | None = None, out: str = "spec",
) -> DataFrame:
    """As ``first_match_rule``, for thousands of rules: the outcome of the first pattern found in the text.

    Null where no pattern is found or the text is null; ``exempt`` rows get the empty outcome. A rule without a
    literal (``.*``, one with flags) is tried on every text that no earlier sure rule decides.
    """
    text = F.col(f"`{column}`")

    def first(found: Column, rule: Column) -> Column:
        hit = rule["pattern"].isNull() | F.regexp_like(text, rule["pattern"])
        return F.when(found.isNotNull(), found).when(hit, F.struct(rule["spec"].alias("spec")))

    nothing = F.lit(None).cast("struct<spec:string>")
    ruled = df.withColumn("__rules", possible_rules(text, rules))
    chosen = F.aggregate("__rules", nothing, first, lambda found: found["spec"])
    if exempt is not None:
        chosen = F.when(exempt, F.lit("")).otherwise(chosen)
    return ruled.withColumn(out, chosen).drop("__rules")
