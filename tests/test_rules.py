"""Rules by their literals give what a chain of conditions gives."""

from __future__ import annotations

import random
import re

import pytest

from tidemill.operators import manifest, rules


@pytest.mark.parametrize("pattern, needed", [
    ("attention/(wq|wk|wv)/kernel", ("attention/",)), (".*lora_a", ("lora_a",)), ("lm_head/kernel", ("lm_head/kernel",)),
    (".*", ()), ("", ()), ("a|", ()), ("abc|x+yz", ("abc", "yz")), ("abc*", ("ab",)), ("abc?de", ("ab",)),
    ("a{0}", ()), ("ab{2,3}cd", ("cd",)), ("ab+c", ("ab",)), (r"a\.b", ("a.b",)), (r"ab\dc", ("ab",)),
    (r"\x41bcd", ()), (r"(a)\1b", ()), ("(?i)abc", ()), (r"\Qa.b\E", ()), ("x[abc]yz", ("yz",)), ("[]a]bc", ()),
    ("[a-z&&[^bc]]def", ("def",)), (r"[\]]ab", ("ab",)), ("(?:ab)?cd", ("cd",)), ("(?=ab)cd", ("cd",)), ("(abc)", ()),
    ("abc(", ()), ("abc)", ()), ("^ab$", ("ab",)), ("ab++c", ("ab",)), ("ab+?c", ("ab",)), ("a\\", ()),
])
def test_literals(pattern, needed):
    assert rules.literals(pattern) == needed


def test_literals_are_in_every_match():
    rng = random.Random(7)
    tokens = list("abc") + ["\\.", "[ab]", "[^c]", "(a|b)", "(?:bc)", "*", "+", "?", "{0}", "{2}", "|", "^", "$", ".", "\\d"]
    tried = 0
    for _ in range(4000):
        pattern = "".join(rng.choice(tokens) for _ in range(rng.randint(1, 7)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        needed = rules.literals(pattern)
        for _ in range(20):
            text = "".join(rng.choice("abc.1") for _ in range(rng.randint(0, 7)))
            if compiled.search(text):
                tried += 1
                assert not needed or any(n in text for n in needed), (pattern, text)
    assert tried > 5000


def test_same_as_a_chain(spark):
    rng = random.Random(3)
    parts = ["a", "b", "/", ".", "ab", "ba/"]
    names = [None, "", "a\nb", "b\u00e9a", "\U0001f600ab"] + [
        "".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(200)]
    chain = [("^ab/", "1"), ("b{2,}", "2"), ("(a|b)ba", "3"), ("aab", "4"), (r"a\.b", "5"), ("(?i)BA/A", "6"),
             ("a$|^b", "7"), ("\u00e9", "8"), ("aab", "9"), ("/.+/", "10")]
    df = spark.createDataFrame([(i, n, i % 9 == 0) for i, n in enumerate(names)], "id int, name string, skip boolean")
    for some in (chain, chain[::-1], chain[:1], [(".*", "x")], chain + [("", "end")]):
        for exempt in (None, df["skip"]):
            want = manifest.first_match_rule(df, some, "name", exempt)
            got = rules.first_match_of_many(df, some, "name", exempt)
            assert got.columns == want.columns
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert rules.first_match_of_many(df, [], "name").where("spec is not null").isEmpty()


def test_plan_does_not_grow_with_the_rules(spark):
    df = spark.createDataFrame([("run/17/x",), ("run/4999/x",), ("walk",)], "name string")
    many = [(f"^run/{n}/", str(n)) for n in range(5000)]

    def plan(some):
        return rules.first_match_of_many(df, some, "name")._jdf.queryExecution().toString()

    assert len(plan(many)) < len(plan(many[:10])) + 500
    got = rules.first_match_of_many(df, many, "name").collect()
    assert [r["spec"] for r in got] == ["17", "4999", None]


def test_rules_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(rules, "MAX_RULE_CHARS", 10)
    with pytest.raises(ValueError, match="bound"):
        rules.first_match_of_many(spark.range(1).selectExpr("'a' AS n"), [("abcdefgh", "xyz")], "n")
