"""The thirteen operators, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import (
    centroids,
    lexical,
    line_dedup,
    mixing,
    mixture,
    neighbours,
    packing,
    pii,
    quality,
    repeats,
    sequences,
    shingle_join,
    toxicity,
)
from tidemill.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


@query()
def op1_posting_lists(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), k=20, queries=F.col("vec_id") % 20 == 0)


@query()
def op2_anchor_pii(spark: SparkSession, sf: str) -> DataFrame:
    return pii.find_pii(table(spark, sf, "documents"))


@query()
def op3_shingle_join(spark: SparkSession, sf: str) -> DataFrame:
    return shingle_join.shingle_components(table(spark, sf, "documents"), words=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


EXPONENT, SEED = 0.5, 42

MIX = f"""WITH d AS (SELECT *, coalesce(length(text), 0) + 1 AS size,
  (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5)
  / {float(1 << 52)} AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
r AS (SELECT source, sum(size) OVER () * pow(size, {EXPONENT}) / sum(pow(size, {EXPONENT})) OVER () / size AS rate
  FROM s),
k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS k FROM r),
c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM k),
n AS (SELECT doc_id, text, lang, d.source, n_chars, count(*) FILTER (cdf <= u) AS n FROM d JOIN c
  ON d.source IS NOT DISTINCT FROM c.source GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(0, n - 1)) AS INTEGER) AS copy FROM n
WHERE n > 0"""


@query(MIX)
def op4_poisson_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), exponent=EXPONENT, seed=SEED)


@query()
def op5_sequence_files(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.encode_and_read(
        table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), end_id=2, length=2048).select(
        "doc_id", "start", "n_tokens", "ids_crc32")


LONG, EDITS = line_dedup.MIN_CHARS, line_dedup.EDITS
LINES = f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
  generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM l),
f AS (SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM t WHERE length(line) >= {LONG} GROUP BY line),
g AS (SELECT *, unnest(range(n - {EDITS}, n + {EDITS + 1})) AS like_n FROM f),
near AS (SELECT DISTINCT g.line FROM g JOIN f ON f.n = g.like_n AND f.first < g.first
  AND levenshtein(f.line, g.line) <= {EDITS}),
k AS (SELECT t.*, length(t.line) >= {LONG} AS is_long, length(t.line) < {LONG} OR coalesce(
  (t.doc_id, t.pos) = f.first AND t.line NOT IN (SELECT line FROM near), false) AS stays
  FROM t LEFT JOIN f ON t.line = f.line),
o AS (SELECT doc_id, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (stays), '') AS text,
  count(*) FILTER (is_long) AS n_lines, count(*) FILTER (NOT stays) AS n_removed FROM k GROUP BY doc_id)
SELECT doc_id, o.text, lang, source, n_chars, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed
FROM documents LEFT JOIN o USING (doc_id)"""


@query(LINES)
def op6_line_edit_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents"))


@query()
def op7_quality_lines(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_line_words")


@query()
def op8_suffix_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf, "documents"))


@query()
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query()
def op10_genetic_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, sf, "documents"), public_tokenizers.path(TOKENIZER), end_id=0, capacity=2048)


TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
        r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
RANKED = f"""WITH d AS (SELECT doc_id, {TERMS} AS terms FROM documents),
n AS (SELECT doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM n),
t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM t, c GROUP BY term),
q AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))
  AS BIGINT) AS score FROM q JOIN w USING (term) JOIN t USING (term) JOIN n USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank,
  doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 20"""


@query(RANKED)
def op11_shared_search(spark: SparkSession, sf: str) -> DataFrame:
    return lexical.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=20)


CLUSTERS, ROUNDS, CLUSTER_SEED, DIMS, SCALE = 8, 10, 3, 64, 1024


def clusters_sql() -> str:
    """The rounds written out one after another."""
    nearest = """n{i} AS MATERIALIZED (SELECT id, v, min((d, c)) AS best FROM (SELECT id, v, c,
  CAST(list_sum([(x[1] - x[2]) * (x[1] - x[2]) FOR x IN list_zip(v, m)]) AS BIGINT) AS d FROM k, c{i}) GROUP BY id, v)"""
    moved = """s{i} AS MATERIALIZED (SELECT c, p, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
  SELECT best[2] AS c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM n{i}) GROUP BY c, p),
c{j} AS MATERIALIZED (SELECT c{i}.c, coalesce(f.m, c{i}.m) AS m FROM c{i} LEFT JOIN (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS m FROM s{i} GROUP BY c) f USING (c))"""
    parts = [f"""k AS MATERIALIZED (SELECT vec_id AS id, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)
  FOR x IN embedding] AS v FROM embeddings WHERE len(embedding) = {DIMS}
  AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v AS m FROM (
  SELECT sha256('{CLUSTER_SEED}:' || id) AS h, v FROM k ORDER BY h LIMIT {CLUSTERS}))"""]
    for i in range(ROUNDS):
        parts += [nearest.format(i=i), moved.format(i=i, j=i + 1)]
    last = f"""SELECT id AS vec_id, CAST(best[2] AS INTEGER) AS cluster, best[1] AS distance,
  CAST(sum(best[1]) OVER (PARTITION BY best[2]) AS BIGINT) AS cluster_inertia,
  CAST(sum(best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256 FROM n{ROUNDS} JOIN c{ROUNDS} ON c = best[2]"""
    return "WITH " + ",\n".join([*parts, nearest.format(i=ROUNDS)]) + "\n" + last


@query(clusters_sql())
def op12_equal_average_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return centroids.cluster(table(spark, sf, "embeddings"), CLUSTERS, ROUNDS, CLUSTER_SEED, DIMS, SCALE)


BYTE_TOKENIZER = "byte_bpe_50k.json"


@query()
def op13_deficit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return mixture.pack_mixture(
        table(spark, sf, "documents"), public_tokenizers.path(BYTE_TOKENIZER), end_id=1, capacity=2048)
