"""Queries over per-token predictions: embeddings as logits, ten tokens per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import metrics
from tidemill.queries.registry import query
from tidemill.session import table

TOKENS_PER_SEQ = 10
SEQS_PER_BATCH = 4


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.floor(F.col("vec_id") / TOKENS_PER_SEQ).alias("seq_id"),
        (F.col("vec_id") % TOKENS_PER_SEQ).alias("pos"),
        F.col("embedding").alias("logits"), "label",
        (F.col("label") != 0).cast("int").alias("mask"))


def scored(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "nll": metrics.token_nll(F.col("logits"), F.col("label")),
        "correct": metrics.is_correct(F.col("logits"), F.col("label"))})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


PREDICTIONS = f"""
pred AS (SELECT vec_id, vec_id // {TOKENS_PER_SEQ} AS seq_id, vec_id % {TOKENS_PER_SEQ} AS pos,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v, label,
    CASE WHEN label <> 0 THEN 1 ELSE 0 END AS mask FROM embeddings)"""


def scored_sql(source: str) -> str:
    return f"""
scored AS (SELECT *, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v)))))
    - v[label + 1] AS nll,
  CASE WHEN list_position(v, list_max(v)) - 1 = label THEN 1 ELSE 0 END AS correct FROM {source})"""


SCORED = PREDICTIONS + "," + scored_sql("pred")


@query(f"WITH {SCORED} SELECT vec_id, round(nll, 6) AS nll, CAST(correct AS INTEGER) AS correct FROM scored")
def token_nll(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(scored(predictions(spark, sf)).select("vec_id", "nll", "correct"), "nll")


PIECE = 24


@query(f"WITH {SCORED} SELECT vec_id, round(nll, 6) AS nll, CAST(correct AS INTEGER) AS correct FROM scored")
def token_nll_sharded(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of logits in pieces, the last of which is shorter."""
    cuts = F.sequence(F.lit(0), F.size("logits") - 1, F.lit(PIECE))
    pieces = predictions(spark, sf).withColumn("first", F.explode(cuts)).withColumn(
        "logits", F.slice("logits", F.col("first") + 1, F.lit(PIECE)))
    return rounded(metrics.token_nll_sharded(pieces, ["vec_id"]), "nll")


def seq_mean_sql(value: str, out: str, mask: str = "mask") -> str:
    return f"""seqs AS (SELECT seq_id, sum(CASE WHEN {mask} > 0 THEN {value} ELSE 0 END)
    / greatest(CAST(sum({mask}) AS DOUBLE), 1e-10) AS r FROM scored GROUP BY seq_id)
SELECT round(avg(r), 6) AS {out} FROM seqs"""


@query(f"WITH {SCORED}, {seq_mean_sql('nll', 'loss')}")
def loss_seq_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.loss_seq_mean(scored(predictions(spark, sf)), "seq_id", "nll", "mask"), "loss")


@query(f"WITH {SCORED}, {seq_mean_sql('CAST(correct AS DOUBLE)', 'accuracy')}")
def accuracy_seq_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy_seq_mean(
        scored(predictions(spark, sf)), "seq_id", "correct", "mask"), "accuracy")


TOKEN_MEAN = "sum(CASE WHEN mask > 0 THEN nll ELSE 0 END) / (sum(mask) + 1e-8)"


@query(f"WITH {SCORED} SELECT round({TOKEN_MEAN}, 6) AS loss FROM scored")
def loss_token_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.loss_token_mean(scored(predictions(spark, sf)), "nll", "mask"), "loss")


@query(f"""WITH {PREDICTIONS}, nxt AS (SELECT vec_id, seq_id, pos, v,
    lead(label) OVER w AS label, lead(mask) OVER w AS mask FROM pred
    WINDOW w AS (PARTITION BY seq_id ORDER BY pos)),
shifted AS (SELECT * FROM nxt WHERE label IS NOT NULL), {scored_sql('shifted')},
{seq_mean_sql('nll', 'loss')}""")
def shifted_loss(spark: SparkSession, sf: str) -> DataFrame:
    shifted = metrics.shift_for_loss(predictions(spark, sf), "seq_id", "pos")
    return rounded(metrics.loss_seq_mean(scored(shifted), "seq_id", "nll", "mask"), "loss")


def eval_sql(cap: str) -> str:
    return f"""WITH {SCORED}, seqs AS (SELECT seq_id // {SEQS_PER_BATCH} AS batch_id, seq_id,
    sum(CASE WHEN mask > 0 THEN nll ELSE 0 END) / greatest(CAST(sum(mask) AS DOUBLE), 1e-10) AS l,
    sum(CASE WHEN mask > 0 THEN correct ELSE 0 END) / greatest(CAST(sum(mask) AS DOUBLE), 1e-10) AS c
  FROM scored {cap} GROUP BY 1, 2),
batches AS (SELECT batch_id, avg(l) AS l, avg(c) AS c FROM seqs GROUP BY batch_id)
SELECT count(*) AS n_batches, round(avg(l), 6) AS loss, round(avg(c), 6) AS accuracy FROM batches"""


def evaluated(spark: SparkSession, sf: str, cap: int | None) -> DataFrame:
    batches = scored(predictions(spark, sf)).withColumn(
        "batch_id", F.floor(F.col("seq_id") / SEQS_PER_BATCH))
    return rounded(metrics.eval_mean(
        batches, "batch_id", "seq_id", "nll", "correct", "mask", cap), "loss", "accuracy")


@query(eval_sql(""))
def eval_mean(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf, None)


@query(eval_sql(f"WHERE seq_id // {SEQS_PER_BATCH} < 5"))
def eval_mean_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The cap on evaluation steps is a setting of the evaluation."""
    return evaluated(spark, sf, 5)


@query(f"WITH {SCORED} SELECT label, round(exp({TOKEN_MEAN}), 6) AS perplexity FROM scored GROUP BY label")
def perplexity(spark: SparkSession, sf: str) -> DataFrame:
    loss = metrics.loss_token_mean(scored(predictions(spark, sf)), "nll", "mask", ("label",))
    return loss.select("label", F.round(metrics.perplexity(F.col("loss")), 6).alias("perplexity"))


@query(f"""WITH {PREDICTIONS}, ign AS (SELECT vec_id, seq_id, pos, v, label,
    CASE WHEN label = 3 THEN 0 ELSE 1 END AS mask FROM pred), {scored_sql('ign')},
{seq_mean_sql('nll', 'loss')}""")
def loss_ignore_index(spark: SparkSession, sf: str) -> DataFrame:
    """Label 3 stands for positions that the preparation has masked with -100."""
    masked = predictions(spark, sf).withColumn(
        "label", F.when(F.col("label") == 3, -100).otherwise(F.col("label")))
    kept = masked.withColumns({
        "mask": metrics.supervised_mask(F.col("label")),
        "label": F.greatest(F.col("label"), F.lit(0))})
    return rounded(metrics.loss_seq_mean(scored(kept), "seq_id", "nll", "mask"), "loss")
