"""Registry, and the inputs that the queries derive from the given tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.columns import binarize
from commentlab.scale import spread


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        REGISTRY[name] = Query(run, sql)
        return run

    return register


def six(column: str | Column) -> Column:
    return F.round(column, 6)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def languages(df: DataFrame) -> list[str]:
    """The languages that occur, sorted; rows without one cannot have a file of their own."""
    found = df.select("lang").filter(F.col("lang").isNotNull()).distinct()
    return sorted(r["lang"] for r in found.collect())


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a comment: id, lang, comment_text."""
    docs = table(spark, sf_dir, "documents")
    return spread(docs.select(F.col("doc_id").alias("id"), "lang", F.col("text").alias("comment_text")))


def comments(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """The labelled documents: id, comment_text, lang, source, n_chars, quality, toxic.

    ``wide`` spreads a small table over the cores for work on the texts.
    """
    docs = table(spark, sf_dir, "documents")
    docs = (spread(docs) if wide else docs).withColumnsRenamed(
        {"doc_id": "id", "text": "comment_text"}
    )
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    return docs.join(labels, "id").select(
        "id", "comment_text", "lang", "source", "n_chars", "quality", "toxic"
    )


COMMENTS = """
comments AS (
  SELECT d.doc_id AS id, d.text AS comment_text, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""


def scored(
    spark: SparkSession, sf_dir: str, times: int = 7919, span: int = 700, keep: tuple[str, ...] = ()
) -> DataFrame:
    """lang, id, y_true and a made-up score that follows the label and has ties."""
    score = ((F.col("id") * times) % span + (1000 - span) * F.col("toxic")).cast("double") / 1000
    return comments(spark, sf_dir).select(
        "lang", "id", F.col("toxic").alias("y_true"), score.alias("y_prob"), "quality", "n_chars", *keep
    )


def scored_sql(times: int = 7919, span: int = 700) -> str:
    return f"""{COMMENTS}, scored AS (
  SELECT lang, id, toxic AS y_true, quality, n_chars,
    CAST((id * {times}) % {span} + {1000 - span} * toxic AS DOUBLE) / 1000 AS y_prob
  FROM comments
)"""


def predictions(spark: SparkSession, sf_dir: str, **run) -> DataFrame:
    rows = scored(spark, sf_dir, **run)
    return rows.withColumn("y_pred", binarize(F.col("y_prob"), 0.5))


def predictions_sql(**run) -> str:
    return f"""{scored_sql(**run)}, pred AS (
  SELECT *, CAST(y_prob >= 0.5::DOUBLE AS INTEGER) AS y_pred FROM scored
)"""


SPLIT = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(concat(id, ':42')), id) AS rk,
    count(*) OVER (PARTITION BY lang) AS n
  FROM {source}
), parted AS (
  SELECT *, CASE WHEN rk <= n * 80 // 100 THEN 'train' WHEN rk <= n * 90 // 100 THEN 'val'
    ELSE 'test' END AS split
  FROM ranked
)"""


def auc_sql(source: str, keys: str, out: str = "aucs") -> str:
    """CTE of the mid-rank AUC per key."""
    return f"""
{out}_ranks AS (
  SELECT {keys}, y_true,
    rank() OVER (PARTITION BY {keys} ORDER BY y_prob)
      + (count(*) OVER (PARTITION BY {keys}, y_prob) - 1) / 2.0::DOUBLE AS r
  FROM {source}
), {out}_sums AS (
  SELECT {keys}, sum(r) FILTER (y_true = 1) AS s,
    CAST(count(*) FILTER (y_true = 1) AS DOUBLE) AS p,
    CAST(count(*) FILTER (y_true = 0) AS DOUBLE) AS q
  FROM {out}_ranks GROUP BY ALL
), {out} AS (
  SELECT {keys}, CASE WHEN p > 0 AND q > 0 THEN (s - p * (p + 1) / 2) / (p * q) END AS roc_auc
  FROM {out}_sums
)"""


def counts_sql(source: str, keys: str, out: str = "counts") -> str:
    """CTE of the confusion counts and the rates per key."""
    return f"""
{out}_raw AS (
  SELECT {keys}, count(*) AS n,
    count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
    count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn
  FROM {source} GROUP BY ALL
), {out} AS (
  SELECT *,
    coalesce((tp + fn)::DOUBLE / nullif(n, 0), 0) AS positive_rate,
    coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1,
    coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS "precision",
    coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
    coalesce((tp + tn)::DOUBLE / nullif(n, 0), 0) AS accuracy,
    coalesce(tn::DOUBLE / nullif(tn + fp, 0), 0) AS specificity,
    coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0) AS fpr,
    coalesce(fn::DOUBLE / nullif(fn + tp, 0), 0) AS fnr
  FROM {out}_raw
)"""


def tuned_sql(default: str = "0.5::DOUBLE") -> str:
    """CTE ``tuned``: the best threshold of every language, tuned or not."""
    return f"""
tuned AS (
  SELECT lang, coalesce(best_threshold, {default}) AS best_threshold
  FROM (SELECT DISTINCT lang FROM parted) LEFT JOIN best USING (lang)
)"""


def sweep_sql(source: str, metric: str = "f1", default: str = "0.5::DOUBLE") -> str:
    """CTE ``best`` (lang, best_threshold, best_score) by trying every threshold."""
    value = {
        "f1": "coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)",
        "precision": "coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)",
        "recall": "coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)",
    }[metric]
    return f"""
grid AS (
  SELECT i, 0.1::DOUBLE + 0.01::DOUBLE * i AS thr FROM range(81) t(i)
), tried AS (
  SELECT lang, i, thr,
    count(*) FILTER (y_true = 1 AND y_prob >= thr) AS tp,
    count(*) FILTER (y_true = 0 AND y_prob >= thr) AS fp,
    count(*) FILTER (y_true = 1 AND y_prob < thr) AS fn
  FROM {source}, grid GROUP BY lang, i, thr
), judged AS (
  SELECT lang, i, thr, {value} AS score FROM tried
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, i) AS place FROM judged
), best AS (
  SELECT lang, CASE WHEN score > 0 THEN thr ELSE {default} END AS best_threshold,
    score AS best_score
  FROM placed WHERE place = 1
)"""
