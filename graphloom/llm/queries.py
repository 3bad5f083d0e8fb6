"""The registered query of each operator over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, exact_dedup, language_id, license_scan, minhash, mixing, ngram_join, sharding, substring_dedup, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(documents(spark, sf_dir))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language_id.identified(docs, language_id.train(docs))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixing.mixed(docs, WEIGHTS | {s: OTHER for s in mixing.sources(docs) if s not in WEIGHTS})


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encoded(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


#: Target weights of op5: a source's number decides, so that shares differ; the schedule then isn't a mere round robin.
WEIGHTS = {f"src{i}": float(1 + i % 5) for i in range(20)}
#: The weight of any other source, so that no document is left out; the SQL knows the named ones only.
OTHER = 1.0

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_substring_dedup, op3_ngram_join, op4_language_id, op5_mixing, op6_license_scan, op7_byte_bpe, op8_exact_dedup, op9_sharding, op10_minhash)
}

_W = substring_dedup.WINDOW
_SLOTS = mixing.apportion(WEIGHTS)
_WORDS = r"regexp_extract_all(lower(text), '[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+')"

ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s + 1, s + {_W}), ' ')) AS k
        FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {_W} + 1, 0))) AS s FROM d)),
rep AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT doc_id, s, min(first) AS first FROM win JOIN rep USING (k) GROUP BY doc_id, s),
brk AS (SELECT *, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + {_W} THEN 0 ELSE 1 END AS new FROM hit),
isl AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM brk)
SELECT doc_id, CAST(min(s) AS INTEGER) AS start_word, CAST(max(s) + {_W} AS INTEGER) AS end_word, min(first) AS first_doc
FROM isl GROUP BY doc_id, island""",
    "op5_mixing": f"""
WITH RECURSIVE w AS (SELECT * FROM (VALUES {", ".join(f"('{s}', {n})" for s, n in sorted(_SLOTS.items()))}) AS t(source, per)),
cand AS (SELECT source, per, i,
                (i * {mixing.PERIOD}) // per AS released,
                -((-(i + 1) * {mixing.PERIOD}) // per) AS due,
                CASE WHEN ((i + 1) * {mixing.PERIOD}) % per <> 0 THEN 0 ELSE 1 END AS aligned
         FROM (SELECT source, per, unnest(range(per)) AS i FROM w)),
names AS (SELECT list(source ORDER BY source) AS src, list(per ORDER BY source) AS n FROM w),
step AS (
  SELECT 0 AS t, list_transform(n, lambda x: 0) AS done, 0 AS pick FROM names
  UNION ALL
  SELECT t + 1, list_transform(done, lambda x, k: CASE WHEN k = best THEN x + 1 ELSE x END), best
  FROM (SELECT t, done,
               list_sort(list_filter(list_transform(n, lambda x, k: CASE WHEN done[k] < x AND (done[k] * {mixing.PERIOD}) // x <= t
                   THEN [CAST(ceil((done[k] + 1) * {mixing.PERIOD}.0 / x) AS BIGINT), CASE WHEN ((done[k] + 1) * {mixing.PERIOD}) % x <> 0 THEN 0 ELSE 1 END, k] END),
                 lambda x: x IS NOT NULL))[1][3] AS best
        FROM step, names WHERE t < {mixing.PERIOD})),
plan AS (SELECT src[pick] AS source, done[pick] - 1 AS nth, t - 1 AS place FROM step, names WHERE pick > 0),
d AS (SELECT doc_id, min(coalesce(source, '')) AS source, max(coalesce(strlen(text), 0)) AS bytes FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
b AS (SELECT doc_id, source, CAST(coalesce(sum(bytes) OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {mixing.BLOCK_BYTES} AS block FROM d)
SELECT doc_id, b.source, block, (block // per) * {mixing.PERIOD} + place AS slot
FROM b JOIN w USING (source) JOIN plan ON plan.source = b.source AND plan.nth = block % per""",
    "op8_exact_dedup": """
SELECT DISTINCT d.doc_id, k.keep_id
FROM documents d JOIN (SELECT text, min(doc_id) AS keep_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING min(doc_id) <> max(doc_id)) k
  ON d.text = k.text
WHERE d.doc_id > k.keep_id""",
}
