"""Queries over example tables: sources, limits, splits, templates, tokens, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemill.config import PrepConfig
from tidemill.functions import templates as tp
from tidemill.functions import tokens as tk
from tidemill.operators import batching, chat, prepare, select, split
from tidemill.plans.order import by_hash, by_id, by_id_pair, dense_rank
from tidemill.queries.registry import query
from tidemill.session import scratch_dir, stage, table
from tidemill.sources import byte_ranges
from tidemill.sources import examples as src
from tidemill.sources.training import training_batches

SEED = 42
TEST_FRACTION = 0.15
LONGEST = "(SELECT max(len(ids)) FROM enc)"  # padding goes to the longest example
SHORT = 128   # cuts some prompts and some responses
BATCH = 16

TOKENIZER = tk.ByteTokenizer()
ROLE = StructType([StructField("role", StringType())])


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    return chat.turn_pairs(table(spark, sf, "conversations"))


def text_of(column: str) -> Column:
    """An integer array as text, which compares the same way in every engine."""
    return F.col(column).cast("string").alias(column)


PAIRS = """
scanned AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
    last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (
      PARTITION BY conv_id ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sys_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
pairs AS (
  SELECT concat(conv_id, ':', turn) AS example_id, conv_id, turn, text AS instruction,
    coalesce(sys_text, '') AS input, next_text AS output
  FROM scanned WHERE role = 'user' AND next_role = 'assistant')
"""
SPLIT = f"""
hashed AS (SELECT *, md5(concat('{SEED}:', example_id)) AS h FROM pairs),
labelled AS (
  SELECT *, CASE WHEN row_number() OVER (ORDER BY h, example_id)
      <= ceil(CAST({TEST_FRACTION} AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split
  FROM hashed)
"""
PROMPT_SQL = (
    "'Below is an instruction that describes a task. Write a response that appropriately "
    "completes the request.' || chr(10) || chr(10) || '### Instruction:' || chr(10) || instruction"
    " || chr(10) || chr(10) || '### Response:' || chr(10)"
)


def sql_bytes(hexed: str, limit: int = tk.UNCUT) -> str:
    """Byte ids from a hex column, cut to a limit."""
    return (f"list_transform(range(1, least(length({hexed}) // 2, {limit}) + 1), "
            f"lambda i: CAST('0x' || substr({hexed}, 2 * i - 1, 2) AS INTEGER) + 3)")


def encoded_sql(limit: int = tk.UNCUT, base: str = "pairs") -> str:
    return f"""
hexed AS (SELECT *, hex(encode({PROMPT_SQL})) AS hp, hex(encode(output)) AS hr FROM {base}),
cut AS (SELECT *, list_concat([1], {sql_bytes('hp', limit - 1)}) AS p,
               {sql_bytes('hr', limit)} AS r FROM hexed),
enc AS (SELECT *, list_concat(list_concat(p, r), [2])[1:{limit}] AS ids FROM cut),
lab AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN i <= len(p) THEN -100 ELSE x END) AS lab
        FROM enc)"""


def padded_sql(column: str, value: int, limit: str = LONGEST) -> str:
    return (f"list_concat({column}, list_transform(range({limit} - len({column})), "
            f"lambda i: {value}))")


def config(limit: int | None, mask_prompt: bool = True) -> PrepConfig:
    return PrepConfig(max_seq_length=limit, mask_prompt=mask_prompt, test_fraction=TEST_FRACTION,
                      seed=SEED, batch_size=BATCH)


def longest(spark: SparkSession, sf: str) -> int:
    """Tokens of the longest example."""
    prompt, response = tp.format_instruction(F.col("instruction"), F.col("output"))
    size = F.octet_length(prompt) + F.octet_length(response) + 2  # start and end
    return pairs(spark, sf).agg(F.max(size)).first()[0] or 1


def encoded(spark: SparkSession, sf: str, limit: int | None, mask_prompt: bool = True) -> DataFrame:
    df = pairs(spark, sf)
    prompt, response = tp.format_instruction(F.col("instruction"), F.col("output"))
    return prepare.encode_examples(df, prompt, response, config(limit, mask_prompt), TOKENIZER)


def place_sql(rank: str, rows: str, epoch: str) -> str:
    """The rounds of ``epoch_place`` over a list that begins with the rank."""
    p = split.PRIME
    mixed = lambda x: f"((({x}) * ({x}) + (({x}) >> 3) + 40692) % {p})"
    own = mixed(mixed(f"(({SEED % p} * 48271 + ({epoch}) * 69621) % {p} + r * 39373) % {p}"))
    step = f"""list_transform(list_transform(list_transform([{{'x': x, 'own': CAST({own} AS BIGINT)}}],
  lambda s: {{'x': s.x, 'own': s.own, 'm': ((s.own * {p} + {mixed('s.own + 1')}) % {rows} - s.x + {rows}) % {rows}}}),
  lambda s: {{'x': s.x, 'm': s.m, 'h': (greatest(s.x, s.m) % {p}
    + (greatest(s.x, s.m) >> 31) * 742938285 % {p} + s.own) % {p}}}),
  lambda s: CASE WHEN ({mixed(mixed('s.h'))} >> 11) % 2 = 1 THEN s.m ELSE s.x END)[1]"""
    return f"list_reduce(list_prepend(CAST({rank} AS BIGINT), range(1, {split.SWAP_ROUNDS + 1})), lambda x, r: {step})"


# --- sources -----------------------------------------------------------------------------

@query(f"WITH {PAIRS} SELECT instruction, input, output FROM pairs")
def scan_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_dir(spark, "examples") + ".jsonl"
    pairs(spark, sf).select("instruction", "input", "output").write.json(path)
    return src.load_source(spark, path)


FILES, LIMIT = 4, 200
KEYED = f"""turns AS (SELECT 'turns-' || conv_id % {FILES} || '.jsonl' AS file, conv_id, turn, role FROM conversations),
keyed AS (SELECT file, row_number() OVER (ORDER BY file, conv_id, turn) - 1 AS row_id,
  row_number() OVER (PARTITION BY file ORDER BY conv_id, turn) - 1 AS line_no, role FROM turns)"""


@query(f"""WITH {KEYED}, few AS (SELECT * FROM keyed WHERE row_id < {LIMIT})
SELECT file, row_id, line_no, role, CASE WHEN row_number() OVER (ORDER BY md5('{SEED}:' || row_id), row_id)
  <= ceil({TEST_FRACTION} * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM few""")
def jsonl_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Hardly any row of these files differs from the others, yet a limit and a split are exact."""
    folder = scratch_dir(spark, "jsonl")
    byte_ranges.write_lines(table(spark, sf, "conversations").select(
        F.concat(F.lit("turns-"), F.col("conv_id") % FILES, F.lit(".jsonl")).alias("file"),
        F.struct("conv_id", "turn").alias("line_no"), F.to_json(F.struct("role")).alias("value")), folder)
    rows = stage(src.read_keyed_examples(spark, folder, ROLE, None, "*.jsonl", range_bytes=1 << 12), "keyed")
    few = select.limit_examples(rows, LIMIT, by_id("row_id"))
    return split.train_test_split(few, ["row_id"], TEST_FRACTION, SEED).select(
        F.substring_index("file", "/", -1).alias("file"), "row_id", "line_no", "role", "split")


@query(f"""WITH {PAIRS}, rowed AS (SELECT *, row_number() OVER (ORDER BY conv_id % {FILES}, conv_id, turn) - 1 AS row_id
  FROM pairs), labelled AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY md5(concat('{SEED}:', row_id)), row_id)
    <= ceil(CAST({TEST_FRACTION} AS DOUBLE) * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM rowed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS rank,
  count(*) OVER (PARTITION BY split) AS total FROM labelled),
placed AS (SELECT *, {place_sql('rank', 'total', '0')} AS place FROM ranked),
batched AS (SELECT *, place // {BATCH} AS batch_id, place % {BATCH} AS row_in_batch FROM placed),
{encoded_sql(base='batched')},
sized AS (SELECT *, max(len(ids)) OVER (PARTITION BY split, batch_id) AS longest FROM lab),
padded AS (SELECT *, {padded_sql('ids', 0, 'longest')} AS pid, {padded_sql('lab', -100, 'longest')} AS plab FROM sized)
SELECT split, CAST(batch_id AS BIGINT) AS batch_id, CAST(count(*) AS INTEGER) AS n_rows,
  CAST(list(pid ORDER BY row_in_batch) AS VARCHAR) AS input_ids,
  CAST(list(plab ORDER BY row_in_batch) AS VARCHAR) AS labels FROM padded GROUP BY split, batch_id""")
def jsonl_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """A folder of JSON lines to the shuffled batches of an epoch, each padded to its longest row."""
    folder = scratch_dir(spark, "jsonl")
    byte_ranges.write_lines(pairs(spark, sf).select(
        F.concat(F.lit("pairs-"), F.col("conv_id") % FILES, F.lit(".jsonl")).alias("file"),
        F.struct("conv_id", "turn").alias("line_no"),
        F.to_json(F.struct("instruction", "input", "output")).alias("value")), folder)
    run = PrepConfig(data_source=folder + "/", mask_prompt=True, max_seq_length=None, test_fraction=TEST_FRACTION,
                     seed=SEED, batch_size=BATCH)
    batches = training_batches(spark, run, TOKENIZER)
    return batches.select("split", "batch_id", "n_rows", text_of("input_ids"), text_of("labels"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def scan_table(spark: SparkSession, sf: str) -> DataFrame:
    return src.load_source(spark, f"{sf}/conversations.parquet")


@query(f"WITH {PAIRS}, {SPLIT} SELECT example_id, instruction, output FROM labelled WHERE split = 'train'")
def scan_split(spark: SparkSession, sf: str) -> DataFrame:
    labelled = split.train_test_split(pairs(spark, sf), ["example_id"], TEST_FRACTION, SEED)
    return src.select_split(labelled, "train").select("example_id", "instruction", "output")


@query(f"""WITH {PAIRS}, {SPLIT}, {encoded_sql(base='labelled')}
SELECT example_id, split, CAST({padded_sql('ids', 0)} AS VARCHAR) AS input_ids,
  CAST({padded_sql('lab', -100)} AS VARCHAR) AS labels,
  len(p) AS prompt_length, len(r) AS response_length FROM lab""")
def write_read_prepared(spark: SparkSession, sf: str) -> DataFrame:
    whole = config(longest(spark, sf))
    done = prepare.prepare(pairs(spark, sf), whole, TOKENIZER, ["example_id"])
    path = scratch_dir(spark, "prepared")
    src.write_prepared(done.drop("n_tokens", "n_supervised"), path)
    return src.read_prepared(spark, path).select(
        "example_id", "split", text_of("input_ids"), text_of("labels"),
        F.col("prompt_length").cast("bigint").alias("prompt_length"),
        F.col("response_length").cast("bigint").alias("response_length"))


@query("""SELECT o_orderkey // 8 AS batch_id, CAST(o_orderkey % 8 AS INTEGER) AS row_in_batch,
  CAST(list_transform(range(16), lambda i: 0) AS VARCHAR) AS input_ids,
  CAST(list_transform(range(16), lambda i: 0) AS VARCHAR) AS labels,
  CAST(list_transform(range(16), lambda i: 1) AS VARCHAR) AS attention_mask,
  CAST(range(16) AS VARCHAR) AS position_ids FROM orders""")
def synthetic_batches(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = src.synthetic_batches(ids, batch_size=8, length=16)
    return rows.select("batch_id", "row_in_batch", *[
        text_of(c) for c in ("input_ids", "labels", "attention_mask", "position_ids")])


# --- limits, mapping, epochs -------------------------------------------------------------

@query("SELECT doc_id, source, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 150")
def limit_examples(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return select.limit_examples(docs, 150, by_id("doc_id")).select(
        "doc_id", "source", F.md5("text").alias("digest"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 12000")
def limit_examples_large(spark: SparkSession, sf: str) -> DataFrame:
    """A limit beyond what one task could merge."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.limit_examples(orders, 12_000, by_id("o_orderkey"))


@query("""SELECT key, count(*) AS n FROM (
  SELECT CASE WHEN l_linenumber > 2 THEN l_suppkey END AS key FROM lineitem ORDER BY key NULLS FIRST
  LIMIT (SELECT count(*) * 2 // 3 FROM lineitem)) GROUP BY key""")
def limit_examples_ties(spark: SparkSession, sf: str) -> DataFrame:
    """A limit over keys that repeat and are null in many rows."""
    lines = table(spark, sf, "lineitem").select(
        F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("key"))
    kept = select.take_first(lines, by_id("key"), lambda rows: F.floor(rows * 2 / 3), repeated=True)
    return kept.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
QUALIFY row_number() OVER (ORDER BY o_orderkey) <= (count(*) OVER () // (32 * 7)) * (32 * 7)""")
def trim_to_global_batch(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return select.trim_to_global_batch(orders, 32, 7, by_id("o_orderkey"))


@query("SELECT doc_id, lang AS instruction, text AS output FROM documents")
def map_fields(spark: SparkSession, sf: str) -> DataFrame:
    return select.map_fields(table(spark, sf, "documents"), "lang", "text", ["doc_id"])


@query(f"""WITH {PAIRS} SELECT example_id, lower(trim(instruction)) AS instruction,
  length(output) AS n_output FROM pairs WHERE length(output) > 200""")
def transform_hook(spark: SparkSession, sf: str) -> DataFrame:
    def tidy(df: DataFrame) -> DataFrame:
        return df.where(F.length("output") > 200).select(
            "example_id", F.lower(F.trim("instruction")).alias("instruction"),
            F.length("output").cast("bigint").alias("n_output"))

    return select.apply_transform(pairs(spark, sf), tidy)


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)
SELECT o_orderkey, CAST(rn // {BATCH} AS BIGINT) AS batch_id, CAST(e.range AS INTEGER) AS epoch
FROM r, range(3) e WHERE rn // {BATCH} < 500""")
def epoch_expand(spark: SparkSession, sf: str) -> DataFrame:
    ranked = dense_rank(table(spark, sf, "orders").select("o_orderkey"), by_id("o_orderkey"))
    batches = batching.assign_batches(ranked, BATCH)
    return select.expand_epochs(batches, epochs=3, num_steps=500).select(
        "o_orderkey", "batch_id", "epoch")


# --- split, rank, batches ----------------------------------------------------------------

@query(f"WITH {PAIRS}, {SPLIT} SELECT example_id, split FROM labelled")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return split.train_test_split(
        pairs(spark, sf), ["example_id"], TEST_FRACTION, SEED).select("example_id", "split")


@query(f"""SELECT l_suppkey, split, count(*) AS n FROM (
  SELECT l_suppkey, CASE WHEN row_number() OVER (ORDER BY md5(concat('{SEED}:', l_suppkey)), l_suppkey)
    <= ceil(0.3 * count(*) OVER ()) THEN 'test' ELSE 'train' END AS split FROM lineitem)
GROUP BY l_suppkey, split""")
def split_repeated_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The split is exact where rows are equal, too."""
    rows = split.train_test_split(
        table(spark, sf, "lineitem").select("l_suppkey"), ["l_suppkey"], 0.3, SEED, repeated=True)
    return rows.groupBy("l_suppkey", "split").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT key, o_totalprice, row_number() OVER (ORDER BY key NULLS FIRST) - 1 AS rank
FROM (SELECT nullif(o_orderkey, (SELECT max(o_orderkey) FROM orders)) AS key, o_totalprice FROM orders)""")
def dense_rank_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """A row without an id comes first."""
    orders = table(spark, sf, "orders")
    last = orders.agg(F.max("o_orderkey")).scalar()
    return dense_rank(orders.select(
        F.nullif(F.col("o_orderkey"), last).alias("key"), "o_totalprice"), by_id("key"))


@query(f"""SELECT doc_id, lang, row_number() OVER (
  ORDER BY md5(concat('{SEED}:', doc_id)), doc_id) - 1 AS rank FROM documents""")
def dense_rank_scaled(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return dense_rank(docs, by_hash(["doc_id"], SEED))


@query("""SELECT o_custkey, o_orderkey, o_totalprice,
  row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS rank FROM orders""")
def dense_rank_pair(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return dense_rank(orders, by_id_pair("o_custkey", "o_orderkey"))


@query(f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  row_number() OVER (ORDER BY h, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
    l_extendedprice) - 1 AS rank
FROM (SELECT *, md5(concat_ws(':', '{SEED}', l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))) AS h FROM lineitem)""")
def dense_rank_lineitem(spark: SparkSession, sf: str) -> DataFrame:
    """Rank over the largest table; whole rows make the key, as order lines repeat."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "__quantity", "__cents"]
    lines = table(spark, sf, "lineitem").select(*key[:4], "l_quantity", "l_extendedprice").withColumns({
        "__quantity": F.col("l_quantity").cast("bigint"),
        "__cents": F.round(F.col("l_extendedprice") * 100).cast("bigint")})
    return dense_rank(lines, by_hash(key, SEED)).drop("__quantity", "__cents")


@query(f"""WITH {PAIRS}, e AS (SELECT example_id, CAST(range AS INTEGER) AS epoch FROM pairs, range(2))
SELECT example_id, epoch, row_number() OVER (PARTITION BY epoch
  ORDER BY md5(concat('{SEED}:', epoch, ':', example_id)), example_id) - 1 AS rank FROM e""")
def shuffle_epoch(spark: SparkSession, sf: str) -> DataFrame:
    epochs = pairs(spark, sf).select("example_id").withColumn("batch_id", F.lit(0))
    expanded = select.expand_epochs(epochs, 2).drop("batch_id")
    return dense_rank(
        expanded, by_hash(["example_id"], SEED, F.col("epoch")), keys=["epoch"])


@query(f"""WITH {PAIRS}, n AS (SELECT example_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS rank,
  count(*) OVER () AS total FROM pairs)
SELECT example_id, CAST(range AS INTEGER) AS epoch, CAST({place_sql('rank', 'total', 'range')} AS BIGINT) AS place
FROM n, range(2)""")
def epoch_places(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked once; the orders of two epochs are arithmetic on the stored ranks."""
    ranked = stage(dense_rank(pairs(spark, sf).select("example_id", "conv_id", "turn"),
                              by_id_pair("conv_id", "turn"), total="total"), "ranked")
    epochs = [split.shuffle_ranked(ranked, SEED, e).withColumn("epoch", F.lit(e)) for e in range(2)]
    return epochs[0].unionByName(epochs[1]).select("example_id", "epoch", "place")


@query(f"""WITH {PAIRS} SELECT example_id,
  row_number() OVER (ORDER BY conv_id, turn) - 1 AS rank FROM pairs""")
def shuffle_off(spark: SparkSession, sf: str) -> DataFrame:
    df = pairs(spark, sf).select("example_id", "conv_id", "turn")
    return split.shuffle_order(
        df, by_id_pair("conv_id", "turn"), ["example_id"], SEED, enabled=False
    ).select("example_id", "rank")


BATCHED = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY split
    ORDER BY md5(concat('{SEED}:0:', example_id)), example_id) - 1 AS rank FROM labelled),
batched AS (SELECT *, CAST(rank // {BATCH} AS BIGINT) AS batch_id,
    CAST(rank % {BATCH} AS INTEGER) AS row_in_batch,
    count(*) OVER (PARTITION BY split) // {BATCH} AS full_batches FROM ranked)
"""


def batched(df: DataFrame, drop_last: bool = False) -> DataFrame:
    """Batches of split examples, which are stored once and then read for each pass."""
    labelled = split.train_test_split(df, ["example_id"], TEST_FRACTION, SEED)
    ranked = dense_rank(
        stage(labelled, "split"), by_hash(["example_id"], SEED, 0), keys=["split"], total="total")
    return batching.assign_batches(ranked, BATCH, drop_last)


@query(f"WITH {PAIRS}, {SPLIT}, {BATCHED} SELECT example_id, split, batch_id, row_in_batch FROM batched")
def assign_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batched(pairs(spark, sf).select("example_id")).select(
        "example_id", "split", "batch_id", "row_in_batch")


@query(f"""WITH {PAIRS}, {SPLIT}, {BATCHED} SELECT example_id, split, batch_id, row_in_batch
FROM batched WHERE batch_id < full_batches""")
def assign_batches_drop_last(spark: SparkSession, sf: str) -> DataFrame:
    return batched(pairs(spark, sf).select("example_id"), drop_last=True).select(
        "example_id", "split", "batch_id", "row_in_batch")


def padded_batches(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    padded = prepare.pad_examples(encoded(spark, sf, limit), config(limit))
    return batched(padded.select("example_id", "input_ids", "labels"))


BATCHED_ARRAYS = f"""{PAIRS}, {SPLIT}, {BATCHED}, {encoded_sql(base='batched')},
padded AS (SELECT *, {padded_sql('ids', 0)} AS pid,
  {padded_sql('lab', -100)} AS plab FROM lab)"""


@query(f"""WITH {BATCHED_ARRAYS}
SELECT split, batch_id, CAST(count(*) AS INTEGER) AS n_rows,
  CAST(list(pid ORDER BY row_in_batch) AS VARCHAR) AS input_ids,
  CAST(list(plab ORDER BY row_in_batch) AS VARCHAR) AS labels FROM padded GROUP BY split, batch_id""")
def collate_batches(spark: SparkSession, sf: str) -> DataFrame:
    ragged = batched(encoded(spark, sf, None).select("example_id", "input_ids", "labels"))
    batches = batching.pad_batches(
        batching.collate(ragged, ["input_ids", "labels"], keys=["split"]), {"input_ids": 0, "labels": -100},
        longest(spark, sf))
    return batches.select("split", "batch_id", "n_rows", text_of("input_ids"), text_of("labels"))


@query(f"""WITH {PAIRS}, {SPLIT}, {BATCHED} SELECT example_id, split, batch_id, row_in_batch,
  CAST(row_in_batch // 4 AS INTEGER) AS dp_rank, CAST(row_in_batch % 4 AS INTEGER) AS row_in_shard
FROM batched""")
def assign_dp_shards(spark: SparkSession, sf: str) -> DataFrame:
    rows = batched(pairs(spark, sf).select("example_id"))
    return batching.assign_dp_shards(rows, BATCH, shards=4).select(
        "example_id", "split", "batch_id", "row_in_batch", "dp_rank", "row_in_shard")


@query(f"""WITH {BATCHED_ARRAYS} SELECT split, batch_id, count(*) AS n_rows,
  CAST(min(len(pid)) AS INTEGER) AS min_input_ids, CAST(max(len(pid)) AS INTEGER) AS max_input_ids,
  CAST(min(len(plab)) AS INTEGER) AS min_labels, CAST(max(len(plab)) AS INTEGER) AS max_labels,
  min(len(pid)) = {LONGEST} AND max(len(pid)) = {LONGEST} AND min(len(plab)) = {LONGEST}
    AND max(len(plab)) = {LONGEST} AS ok
FROM padded GROUP BY split, batch_id""")
def batch_shape_check(spark: SparkSession, sf: str) -> DataFrame:
    whole = longest(spark, sf)
    return batching.batch_shape_check(
        padded_batches(spark, sf, whole), ["input_ids", "labels"], whole, keys=["split"])


@query("""SELECT count(*) AS samples, CAST(ceil(count(*) / 32.0) AS BIGINT) AS steps_per_epoch,
  least(CAST(ceil(count(*) / 32.0) AS BIGINT) * 3, 1000) AS total_steps,
  1000 < CAST(ceil(count(*) / 32.0) AS BIGINT) * 3 AS limited FROM orders""")
def training_plan(spark: SparkSession, sf: str) -> DataFrame:
    return batching.training_plan(table(spark, sf, "orders"), 32, 3, max_steps=1000)


@query(f"""WITH {PAIRS}, {encoded_sql()} SELECT count(*) AS samples, 'bytes' AS tokenizer,
  CAST(max(len(ids)) AS INTEGER) AS max_length, round(avg(len(ids)), 6) AS avg_length FROM lab""")
def dataset_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = batching.dataset_stats(encoded(spark, sf, None), "input_ids", "bytes")
    return stats.select("samples", "tokenizer", "max_length",
                        F.round("avg_length", 6).alias("avg_length"))


@query("""SELECT lang, count(*) AS samples, max(coalesce(length(text), 0)) AS max_length,
  round(avg(coalesce(length(text), 0)), 6) AS avg_length, true AS median_close FROM documents GROUP BY lang""")
def dataset_stats_merged(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics stored per source and language, merged per language; the median is held against all lengths."""
    docs = table(spark, sf, "documents")
    length = F.coalesce(F.char_length("text"), F.lit(0))
    parts = stage(batching.stats_parts(docs, length, ["source", "lang"]), "length-parts")
    merged = batching.merge_stats(parts, ["lang"])
    medians = merged.select(F.col("lang").alias("__lang"), "median_length")
    below = F.avg((F.col("length") < F.col("median_length")).cast("int"))
    upto = F.avg((F.col("length") <= F.col("median_length")).cast("int"))
    close = docs.select("lang", length.alias("length")).join(
        medians, F.col("lang").eqNullSafe(F.col("__lang"))).groupBy("__lang").agg(
        ((below <= 0.5 + batching.RANK_ERROR) & (upto >= 0.5 - batching.RANK_ERROR)).alias("median_close"))
    return merged.join(close, F.col("lang").eqNullSafe(F.col("__lang"))).select(
        "lang", "samples", "max_length", F.round("avg_length", 6).alias("avg_length"), "median_close")


# --- templates ---------------------------------------------------------------------------

@query(f"WITH {PAIRS} SELECT example_id, {PROMPT_SQL} AS prompt, output AS response FROM pairs")
def format_instruction(spark: SparkSession, sf: str) -> DataFrame:
    prompt, response = tp.format_instruction(F.col("instruction"), F.col("output"))
    return pairs(spark, sf).select(
        "example_id", prompt.alias("prompt"), response.alias("response"))


@query(f"""WITH {PAIRS} SELECT example_id,
  'Below is a medical question. Provide a clear and accurate answer.' || chr(10) || chr(10)
  || '### Question:' || chr(10) || instruction || chr(10) || chr(10) || '### Answer:' || chr(10) AS prompt,
  output AS response FROM pairs""")
def format_question(spark: SparkSession, sf: str) -> DataFrame:
    prompt, response = tp.format_question(F.col("instruction"), F.col("output"))
    return pairs(spark, sf).select(
        "example_id", prompt.alias("prompt"), response.alias("response"))


def alpaca_sql(first: str, second: str, third: str) -> str:
    return f"""WITH {PAIRS} SELECT example_id,
  'Below is an instruction that describes a task, paired with an input that provides further '
  || 'context. Write a response that appropriately completes the request.'
  || {first} || '    ### Instruction: ' || instruction || {second} || '    ### Input: ' || input
  || {third} || '    ### Response: ' || output || '</s>' AS text FROM pairs"""


def alpaca(spark: SparkSession, sf: str, style: str) -> DataFrame:
    text = tp.format_alpaca(F.col("instruction"), F.col("input"), F.col("output"), style=style)
    return pairs(spark, sf).select("example_id", text.alias("text"))


GAP, SPACED = "repeat(chr(10), 2)", "chr(10) || '    ' || chr(10)"


@query(alpaca_sql(GAP, GAP, GAP))
def format_alpaca(spark: SparkSession, sf: str) -> DataFrame:
    return alpaca(spark, sf, "plain")


@query(alpaca_sql(SPACED, SPACED, SPACED))
def format_alpaca_spaced(spark: SparkSession, sf: str) -> DataFrame:
    return alpaca(spark, sf, "spaced")


@query(alpaca_sql(GAP, "repeat(chr(10), 3)", GAP))
def format_alpaca_wide(spark: SparkSession, sf: str) -> DataFrame:
    return alpaca(spark, sf, "wide")


@query(f"""WITH {PAIRS} SELECT example_id, 'Instruction: ' || instruction || chr(10)
  || CASE WHEN input <> '' THEN 'Input: ' || input || chr(10) ELSE '' END || 'Output: ' AS prompt,
  output AS response FROM pairs""")
def format_optional_input(spark: SparkSession, sf: str) -> DataFrame:
    prompt, response = tp.format_optional_input(
        F.col("instruction"), F.col("input"), F.col("output"))
    return pairs(spark, sf).select(
        "example_id", prompt.alias("prompt"), response.alias("response"))


@query(f"""WITH {PAIRS} SELECT example_id, '[' || length(instruction) || '] ' || instruction AS prompt,
  trim(output) AS response FROM pairs""")
def format_custom(spark: SparkSession, sf: str) -> DataFrame:
    def counted(instruction: Column, output: Column) -> tp.Pair:
        size = F.length(instruction).cast("string")
        return F.concat(F.lit("["), size, F.lit("] "), instruction), F.trim(output)

    tp.register_template("counted", counted)
    prompt, response = tp.template("counted")(F.col("instruction"), F.col("output"))
    return pairs(spark, sf).select(
        "example_id", prompt.alias("prompt"), response.alias("response"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, turn // 64 AS block_no,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seen,
    list(role || ': ' || text) OVER (PARTITION BY conv_id, turn // 64 ORDER BY turn
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS msgs FROM conversations)
SELECT conv_id, turn, block_no, seen - coalesce(len(msgs), 0) AS n_earlier,
  coalesce(array_to_string(msgs, chr(10)), '') AS tail, text AS reply FROM c WHERE role = 'assistant'""")
def chat_context(spark: SparkSession, sf: str) -> DataFrame:
    context = chat.chat_context(table(spark, sf, "conversations"))
    rendered = F.array_join(
        F.transform("tail", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return context.withColumn("tail", rendered)


@query("""SELECT conv_id, turn // 64 AS block_no, count(*) AS n_messages,
  string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id, turn // 64""")
def chat_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = chat.chat_blocks(table(spark, sf, "conversations"))
    rendered = F.array_join(
        F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "\n")
    return blocks.select("conv_id", "block_no", F.size("messages").cast("bigint").alias("n_messages"),
                         rendered.alias("messages"))


@query(f"WITH {PAIRS} SELECT example_id, conv_id, turn, instruction, input, output FROM pairs")
def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf)


# --- tokens ------------------------------------------------------------------------------

@query(f"WITH {PAIRS}, {encoded_sql()} SELECT example_id, CAST(p AS VARCHAR) AS ids FROM cut")
def tokenize_prompt(spark: SparkSession, sf: str) -> DataFrame:
    prompt, _ = tp.format_instruction(F.col("instruction"), F.col("output"))
    ids = TOKENIZER.encode(prompt, tk.UNCUT, add_special=True)
    return pairs(spark, sf).select("example_id", ids.cast("string").alias("ids"))


@query(f"""WITH h AS (SELECT conv_id, turn, hex(encode(text)) AS hx FROM conversations)
SELECT conv_id, turn, CAST({sql_bytes('hx')} AS VARCHAR) AS ids FROM h""")
def tokenize_response(spark: SparkSession, sf: str) -> DataFrame:
    ids = TOKENIZER.encode(F.col("text"), tk.UNCUT, add_special=False)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", ids.cast("string").alias("ids"))


@query(f"WITH {PAIRS}, {encoded_sql(SHORT)} SELECT example_id, CAST(ids AS VARCHAR) AS input_ids FROM enc")
def build_input_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, SHORT).select("example_id", text_of("input_ids"))


@query(f"""WITH {PAIRS}, {encoded_sql(SHORT)} SELECT example_id, CAST(lab AS VARCHAR) AS labels,
  CAST(len(list_filter(lab, lambda x: x <> -100)) AS INTEGER) AS n_supervised FROM lab""")
def mask_prompt_labels(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, SHORT).select(
        "example_id", text_of("labels"),
        F.size(F.array_remove("labels", -100)).alias("n_supervised"))


@query(f"""WITH {PAIRS}, {encoded_sql()} SELECT example_id, CAST(ids AS VARCHAR) AS input_ids,
  CAST(ids AS VARCHAR) AS labels, CAST(len(p) AS INTEGER) AS prompt_length,
  CAST(len(r) AS INTEGER) AS response_length FROM lab""")
def keep_encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Model columns only, with the labels of an unmasked run."""
    kept = select.keep_encoded(encoded(spark, sf, None, mask_prompt=False), ["example_id"])
    return kept.withColumns({c: F.col(c).cast("string") for c in ("input_ids", "labels")})


@query(f"""WITH {PAIRS}, {encoded_sql(SHORT)} SELECT example_id,
  CAST(len(p) AS INTEGER) AS prompt_length, CAST(len(r) AS INTEGER) AS response_length FROM lab""")
def token_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return encoded(spark, sf, SHORT).select("example_id", "prompt_length", "response_length")


@query(f"""WITH {PAIRS}, {encoded_sql()} SELECT example_id,
  CAST({padded_sql('ids', 0)} AS VARCHAR) AS input_ids,
  CAST({padded_sql('lab', -100)} AS VARCHAR) AS labels FROM lab""")
def pad_to_length(spark: SparkSession, sf: str) -> DataFrame:
    whole = longest(spark, sf)
    padded = prepare.pad_examples(encoded(spark, sf, whole), config(whole))
    return padded.select("example_id", text_of("input_ids"), text_of("labels"))


def text_width(spark: SparkSession, sf: str) -> int:
    """One more than the tokens of the longest turn, behind its start id."""
    return (table(spark, sf, "conversations").agg(F.max(F.octet_length("text"))).first()[0] or 0) + 2


def padded_text(spark: SparkSession, sf: str) -> DataFrame:
    """Whole turns as ids padded to one width, with their attention mask."""
    width = text_width(spark, sf)
    return table(spark, sf, "conversations").withColumn("raw", TOKENIZER.encode(F.col("text"), width)).select(
        "conv_id", "turn", F.size("raw").alias("n"),
        tk.pad_to_length(F.col("raw"), width, TOKENIZER.pad_id).alias("ids"),
        tk.padding_mask(F.size("raw"), width).alias("mask"))


WIDTH = "(SELECT max(strlen(text)) + 2 FROM conversations)"
PADDED_TEXT = f"""h AS (SELECT conv_id, turn, hex(encode(text)) AS hx FROM conversations),
raw AS (SELECT conv_id, turn, list_concat([1], {sql_bytes('hx')}) AS raw FROM h),
padded AS (SELECT conv_id, turn, len(raw) AS n, {padded_sql('raw', 0, WIDTH)} AS ids,
  list_transform(range({WIDTH}), lambda i: CASE WHEN i < len(raw) THEN 1 ELSE 0 END) AS mask FROM raw)"""


def variant(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return df.select("conv_id", "turn", *[c.cast("string").alias(n) for n, c in columns.items()])


@query(f"""WITH {PADDED_TEXT} SELECT conv_id, turn, CAST(ids[1:len(ids) - 1] AS VARCHAR) AS input_tokens,
  CAST(ids[2:] AS VARCHAR) AS target_tokens, CAST(mask[2:] AS VARCHAR) AS loss_masks FROM padded""")
def shift_targets(spark: SparkSession, sf: str) -> DataFrame:
    df = padded_text(spark, sf)
    return variant(df, tk.shift_targets(F.col("ids"), F.col("mask")))


@query(f"""WITH {PADDED_TEXT} SELECT conv_id, turn, CAST(ids[1:len(ids) - 1] AS VARCHAR) AS input_ids,
  CAST(ids[2:] AS VARCHAR) AS labels, CAST(mask[1:len(mask) - 1] AS VARCHAR) AS attention_mask FROM padded""")
def shift_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = padded_text(spark, sf)
    return variant(df, tk.shift_labels(F.col("ids"), F.col("mask")))


@query(f"""WITH {PADDED_TEXT} SELECT conv_id, turn, CAST(ids[1:len(ids) - 1] AS VARCHAR) AS input_tokens,
  CAST(mask[1:len(mask) - 1] AS VARCHAR) AS target_mask FROM padded""")
def target_mask(spark: SparkSession, sf: str) -> DataFrame:
    df = padded_text(spark, sf)
    return variant(df, tk.target_mask(F.col("ids"), F.col("mask")))


@query(f"WITH {PADDED_TEXT} SELECT conv_id, turn, CAST(mask AS VARCHAR) AS mask FROM padded")
def padding_mask(spark: SparkSession, sf: str) -> DataFrame:
    df = padded_text(spark, sf)
    return variant(df, {"mask": tk.padding_mask(F.col("n"), text_width(spark, sf))})


@query("SELECT conv_id, turn, CAST(range(512) AS VARCHAR) AS positions FROM conversations")
def position_ids(spark: SparkSession, sf: str) -> DataFrame:
    return variant(table(spark, sf, "conversations"), {"positions": tk.position_ids(512)})


@query(f"""WITH {PADDED_TEXT} SELECT conv_id, turn,
  CAST(list_transform(range({WIDTH}), lambda i: least(i, n - 1)) AS VARCHAR) AS positions FROM padded""")
def mask_positions(spark: SparkSession, sf: str) -> DataFrame:
    df = padded_text(spark, sf)
    return variant(df, {"positions": tk.mask_positions(F.col("n"), text_width(spark, sf))})


# --- the whole chain ---------------------------------------------------------------------

@query(f"""WITH {PAIRS}, {SPLIT}, {encoded_sql(base='labelled')}
SELECT split, count(*) AS examples, CAST(sum(len(ids)) AS BIGINT) AS tokens,
  CAST(sum(len(list_filter(lab, lambda x: x <> -100))) AS BIGINT) AS supervised_tokens,
  count(*) FILTER (len(list_filter(lab, lambda x: x <> -100)) = 0) AS without_supervision
FROM lab GROUP BY split""")
def prepared_summary(spark: SparkSession, sf: str) -> DataFrame:
    done = prepare.prepare(pairs(spark, sf), config(None), TOKENIZER, ["example_id"])
    return done.groupBy("split").agg(
        F.count(F.lit(1)).alias("examples"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_supervised").alias("supervised_tokens"),
        F.count_if(F.col("n_supervised") == 0).alias("without_supervision"))
