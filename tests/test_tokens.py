from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemill.config import PrepConfig
from tidemill.functions import templates as tp
from tidemill.functions import tokens as tk
from tidemill.operators import prepare
from tidemill.plans.order import by_hash

TOKENIZER = tk.ByteTokenizer()


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "x string").select(expr.alias("y")).first()["y"]


@pytest.mark.parametrize("text", ["", "a", "héllo", "日本語", "\n\t \x00", "💡 idea", "a" * 300])
@pytest.mark.parametrize("limit", [1, 2, 4, 512])
def test_byte_ids(spark, text, limit):
    raw = [b + 3 for b in text.encode()]
    assert one(spark, text, TOKENIZER.encode(F.col("x"), limit, False)) == raw[:limit]
    assert one(spark, text, TOKENIZER.encode(F.col("x"), limit, True)) == ([1] + raw)[:limit]


def encode(spark, prompt, response, limit, mask=True):
    df = spark.createDataFrame([(prompt, response)], "p string, r string")
    config = PrepConfig(max_seq_length=limit, mask_prompt=mask)
    return prepare.pad_examples(prepare.encode_examples(
        df, F.col("p"), F.col("r"), config, TOKENIZER), config).first()


def test_masked_example(spark):
    row = encode(spark, "ab", "c", 8)
    assert row["input_ids"] == [1, 100, 101, 102, 2, 0, 0, 0]
    assert row["labels"] == [-100, -100, -100, 102, 2, -100, -100, -100]
    assert (row["prompt_length"], row["response_length"]) == (3, 1)
    assert (row["n_tokens"], row["n_supervised"]) == (5, 2)


def test_unmasked_labels_equal_ids(spark):
    row = encode(spark, "ab", "c", 8, mask=False)
    assert row["labels"][:5] == row["input_ids"][:5]
    assert row["labels"][5:] == [-100] * 3


def test_prompt_longer_than_the_limit(spark):
    row = encode(spark, "abcdefgh", "xyz", 4)
    assert row["input_ids"] == [1, 100, 101, 102]
    assert row["labels"] == [-100] * 4
    assert row["n_supervised"] == 0
    assert row["prompt_length"] == 4


def test_empty_response_keeps_the_end_token(spark):
    row = encode(spark, "a", "", 4)
    assert row["input_ids"] == [1, 100, 2, 0]
    assert row["labels"] == [-100, -100, 2, -100]
    assert row["response_length"] == 0


def test_text_cut_inside_a_character(spark):
    row = encode(spark, "é", "", 2)
    assert row["input_ids"] == [1, 0xC3 + 3]


def test_special_ids_stand_in_for_each_other():
    assert tk.resolve_special_ids(2, 0) == (2, 0)
    assert tk.resolve_special_ids(None, 0) == (0, 0)
    assert tk.resolve_special_ids(2, None) == (2, 2)
    with pytest.raises(ValueError):
        tk.resolve_special_ids(None, None)


@pytest.mark.parametrize("bad", [{"max_seq_length": 0}, {"max_seq_length": -1}, {"batch_size": 0},
                                 {"test_fraction": 1.5}, {"max_examples": -1}])
def test_config_is_checked(bad):
    with pytest.raises(ValueError):
        PrepConfig(**bad)


@pytest.mark.parametrize("length, mask, positions", [
    (0, [0, 0, 0, 0], [0, 0, 0, 0]),
    (1, [1, 0, 0, 0], [0, 0, 0, 0]),
    (3, [1, 1, 1, 0], [0, 1, 2, 2]),
    (4, [1, 1, 1, 1], [0, 1, 2, 3]),
    (9, [1, 1, 1, 1], [0, 1, 2, 3]),
])
def test_masks_and_positions(spark, length, mask, positions):
    row = spark.createDataFrame([(length,)], "n int").select(
        tk.padding_mask(F.col("n"), 4).alias("m"), tk.mask_positions(F.col("n"), 4).alias("p")).first()
    assert (row["m"], row["p"]) == (mask, positions)


def test_mask_by_id_also_hides_real_tokens_equal_to_pad(spark):
    ids = F.array(F.lit(5), F.lit(0), F.lit(7), F.lit(0))
    assert one(spark, "", tk.padding_mask_by_id(ids, 0)) == [1, 0, 1, 0]


def test_shifts(spark):
    ids, mask = tk.ints(1, 5, 6, 0), tk.ints(1, 1, 1, 0)
    row = spark.range(1).select(
        F.struct(*[c.alias(n) for n, c in tk.shift_targets(ids, mask).items()]).alias("a"),
        F.struct(*[c.alias(n) for n, c in tk.shift_labels(ids, mask).items()]).alias("b"),
        F.struct(*[c.alias(n) for n, c in tk.target_mask(ids, mask).items()]).alias("c")).first()
    assert tuple(row["a"]) == ([1, 5, 6], [5, 6, 0], [1, 1, 0])
    assert tuple(row["b"]) == ([1, 5, 6], [5, 6, 0], [1, 1, 1])
    assert tuple(row["c"]) == ([1, 5, 6], [1, 1, 1])


def test_chain_properties(spark):
    pairs = spark.createDataFrame(
        [(str(i), "q" * (i % 40), "r" * (i % 7)) for i in range(200)],
        "example_id string, instruction string, output string")
    config = PrepConfig(max_seq_length=180, mask_prompt=True)
    a = prepare.prepare(pairs.repartition(1), config, TOKENIZER, ["example_id"]).collect()
    b = prepare.prepare(pairs.repartition(17), config, TOKENIZER, ["example_id"]).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    for r in a:
        assert len(r["input_ids"]) == len(r["labels"]) == 180
        assert all(y in (x, -100) for x, y in zip(r["input_ids"], r["labels"]))
        assert r["input_ids"][0] == 1
        assert 2 in r["input_ids"] or r["n_tokens"] == 180
        assert all(y == -100 for y in r["labels"][:r["prompt_length"]])
        assert all(x == 0 for x in r["input_ids"][r["n_tokens"]:])
    assert sum(r["split"] == "test" for r in a) == 30


def test_chain_with_limit_and_optional_input(spark):
    pairs = spark.createDataFrame(
        [(str(i), "q", "in" if i % 2 else "", "r") for i in range(20)],
        "example_id string, instruction string, input string, output string")
    config = PrepConfig(max_seq_length=64, max_examples=10, template="optional_input")
    done = prepare.prepare(pairs, config, TOKENIZER, ["example_id"], by_hash(["example_id"], 42)).collect()
    assert len(done) == 10
    with pytest.raises(ValueError):
        prepare.prepare(pairs, config, TOKENIZER, ["example_id"])


def test_null_field_fails_the_job(spark):
    df = spark.createDataFrame([(None, "x")], "a string, b string")
    prompt, _ = tp.format_instruction(F.col("a"), F.col("b"))
    with pytest.raises(Exception, match="instruction"):
        df.select(prompt).collect()


def test_unknown_template_and_style():
    with pytest.raises(ValueError):
        tp.template("nope")
    with pytest.raises(KeyError):
        tp.context_template("nope")


def test_no_limit_cuts_and_pads_nothing(spark):
    rows = spark.createDataFrame([("a", "x" * 5000, "y" * 3000)], "k string, instruction string, output string")
    got = prepare.prepare(rows, PrepConfig(max_seq_length=None), TOKENIZER, ["k"]).first()
    assert got["n_tokens"] == len(got["input_ids"]) == got["prompt_length"] + 3001
    assert (got["response_length"], got["input_ids"][-1]) == (3000, TOKENIZER.eos_id)


@pytest.mark.parametrize("build", [
    tp.format_instruction, tp.format_question, lambda a, b: tp.format_optional_input(a, F.lit(""), b)])
def test_a_missing_answer_fails(spark, build):
    rows = spark.createDataFrame([("ask", None)], "a string, b string")
    with pytest.raises(Exception, match="is null"):
        rows.select(*build(F.col("a"), F.col("b"))).collect()
