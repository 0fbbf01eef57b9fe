"""Queries opN_<name>: each operator on its whole table, with production parameters; and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring, mixing, near_duplicates, packing, pii, quality_classifier, quality_rules, token_counts, topk, toxicity
from .common import FILE_ROWS, in_few_files

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return in_few_files(quality_rules.line_frequency(docs).drop("clean_text"), docs.count() // FILE_ROWS)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts n_* are of the base spans, as the digest; all_* are of all spans."""
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[F.col(f"base_{k}").alias(f"n_{k}") for k in pii.KINDS], "base_sha256", "spans", *[F.col(f"n_{k}").alias(f"all_{k}") for k in pii.KINDS])


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_shingles", "label")


OP1_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT r, source, doc_id, text, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, line,
             len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
      FROM (SELECT r, source, doc_id, text, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
h AS (SELECT source, count(DISTINCT (doc_id, text)) AS n FROM d GROUP BY source),
c AS (SELECT source, norm, count(DISTINCT (doc_id, text)) AS n FROM l GROUP BY source, norm HAVING count(DISTINCT (doc_id, text)) > {quality_rules.MAX_DOCS}),
f AS (SELECT c.source, norm FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE 1000 * c.n > {quality_rules.MAX_SHARE} * h.n),
g AS (SELECT r, sum(n) AS n FROM l JOIN f ON l.norm = f.norm AND l.source IS NOT DISTINCT FROM f.source GROUP BY r),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
t AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS k FROM t),
p AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM m WHERE k > 1) GROUP BY r),
o AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed_words
      FROM w LEFT JOIN g USING (r) LEFT JOIN dup USING (r) LEFT JOIN p USING (r))
SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.REPEAT_PERCENT} * n_words) AND n_words - n_removed_words >= CAST({quality_rules.MIN_KEPT} AS DOUBLE) * n_words AS kept
FROM o
"""

OP6_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_mixing": op2_mixing,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_personal_data": op4_personal_data,
    "op5_packing": op5_packing,
    "op6_topk_search": op6_topk_search,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_near_duplicates": op10_near_duplicates,
}
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1_SQL, "op6_topk_search": OP6_SQL}
