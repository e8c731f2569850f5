"""Splits, samples, ids, error samples and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from commentlab.functions.columns import binarize_label, surrogate_id
from commentlab.operators import sampling as s
from commentlab.operators.errors import error_categories, tag_errors
from commentlab.queries.base import (
    COMMENTS,
    SPLIT,
    comments,
    predictions,
    predictions_sql,
    query,
    six,
    sweep_sql,
    table,
    tuned_sql,
)
from commentlab.queries.metrics import TAGGED
from commentlab.scale import literal_table


@query(
    "surrogate_id",
    """SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS id
FROM documents""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return surrogate_id(docs, ["lang"], "doc_id")


@query(
    "binarize_label",
    """SELECT source, count(*) AS n, CAST(sum(CAST(toxic_share >= 0.5::DOUBLE AS INTEGER)) AS BIGINT) AS n_toxic
FROM (SELECT source, CAST((l.doc_id * 37) % 101 AS DOUBLE) / 100 AS toxic_share
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id) GROUP BY source""",
)
def _(spark, sf):
    share = ((F.col("id") * 37) % 101).cast("double") / 100
    rows = comments(spark, sf).select("source", binarize_label(share).alias("toxic"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic"))


@query(
    "split_80_10_10",
    f"WITH {COMMENTS}, {SPLIT.format(source='comments')} SELECT lang, id, split FROM parted",
)
def _(spark, sf):
    rows = comments(spark, sf).select("lang", "id")
    return s.split_rows(rows, ["lang"])


@query(
    "stratified_sample",
    f"""WITH {COMMENTS}, sizes AS (SELECT toxic, count(*) AS n FROM comments GROUP BY toxic),
totals AS (SELECT *, sum(n) OVER () AS total FROM sizes),
targets AS (SELECT *, least(20000, CAST(ceil(0.05::DOUBLE * total) AS BIGINT)) AS target FROM totals),
shares AS (SELECT *, target * n // total AS whole, (target * n) % total AS rest FROM targets),
quotas AS (
  SELECT toxic, whole + CAST(row_number() OVER (ORDER BY rest DESC, toxic)
    <= target - sum(whole) OVER () AS INTEGER) AS quota
  FROM shares
), ranked AS (
  SELECT id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5(concat(id, ':42')), id) AS rk
  FROM comments
)
SELECT id, toxic FROM ranked JOIN quotas USING (toxic) WHERE rk <= quota""",
)
def _(spark, sf):
    return s.stratified_sample(comments(spark, sf).select("id", "toxic"), ["toxic"])


@query(
    "error_sample",
    f"""WITH {TAGGED}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, error_type ORDER BY md5(concat(id, ':0')), id) AS rk
  FROM errors
)
SELECT lang, error_type, id, y_true, y_pred FROM ranked WHERE rk <= 50""",
)
def _(spark, sf):
    sample = s.error_sample(tag_errors(predictions(spark, sf)), ["lang"])
    return sample.select("lang", "error_type", "id", "y_true", "y_pred")


@query(
    "error_topk",
    f"""WITH {TAGGED}, margins AS (SELECT *, abs(y_prob - 0.5::DOUBLE) AS margin FROM errors),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY margin DESC, id) AS rk FROM margins)
SELECT lang, id, error_type, round(margin, 6) AS margin FROM ranked WHERE rk <= 10""",
)
def _(spark, sf):
    errors = tag_errors(predictions(spark, sf)).withColumn("best_threshold", F.lit(0.5))
    top = s.error_topk(errors, ["lang"])
    return top.select("lang", "id", "error_type", six("margin").alias("margin"))


LEXICON = [
    ("de", "profanity", "schen"), ("de", "identity_mention", "der"),
    ("en", "profanity", "thing"), ("en", "profanity", "ered"), ("en", "identity_mention", "and"),
    ("es", "profanity", "mente"), ("es", "identity_mention", "los"),
    ("fr", "profanity", "ment"), ("fr", "identity_mention", "les"),
]


# Every small letter up to the end of Cyrillic, three times or more.
STRETCHED_LETTERS = "|".join(c + "{3,}" for c in map(chr, range(0x61, 0x530)) if c.islower())


@query(
    "error_categories",
    f"""WITH {TAGGED}, lexicon(lang, category, word) AS (VALUES {', '.join(map(str, LEXICON))}),
texts AS (
  SELECT e.*, lower(c.comment_text) AS text,
    regexp_extract_all(lower(c.comment_text), '[\\p{{L}}\\p{{N}}_]+') AS words
  FROM errors e JOIN comments c USING (lang, id)
), hits AS (
  SELECT DISTINCT t.lang, t.id, t.error_type, x.category
  FROM texts t JOIN lexicon x ON t.lang = x.lang AND list_contains(t.words, x.word)
), named AS (
  SELECT lang, error_type, category FROM hits
  UNION ALL SELECT lang, error_type, 'profanity_free' FROM texts t WHERE y_true = 1
    AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.lang = t.lang AND h.id = t.id AND h.category = 'profanity')
  UNION ALL SELECT lang, error_type, 'obfuscation' FROM texts
    WHERE regexp_matches(text, '\\p{{L}}[*@$!0-9]+\\p{{L}}')
  UNION ALL SELECT lang, error_type, 'spelling_noise' FROM texts
    WHERE regexp_matches(text, '{STRETCHED_LETTERS}')
)
SELECT lang, error_type, category, count(*) AS n FROM named GROUP BY ALL""",
)
def _(spark, sf):
    words = literal_table(spark, LEXICON, "lang string, category string, word string")
    errors = tag_errors(predictions(spark, sf, keep=("comment_text",)))
    return error_categories(errors.select("lang", "id", "y_true", "error_type", "comment_text"), words)


TUNED = f"""
{predictions_sql()}, {SPLIT.format(source='pred')},
vals AS (SELECT lang, id, y_true, y_prob FROM parted WHERE split = 'val'),
{sweep_sql('vals')}, {tuned_sql()}"""
