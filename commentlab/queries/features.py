"""Term statistics, vocabulary, TF-IDF and class weights."""

from __future__ import annotations

from commentlab.operators import features as f
from commentlab.operators.model import class_weights
from commentlab.queries.base import COMMENTS, comments, query, six
from commentlab.queries.text import ANALYZED, analyzed

TERMS = f"""
{ANALYZED}, occurrences AS (
  SELECT id, lang, term, count(*) AS tf
  FROM (SELECT id, lang, unnest(grams) AS term FROM analyzed) GROUP BY ALL
), terms AS (
  SELECT lang, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM occurrences GROUP BY ALL
), sizes AS (SELECT lang, count(*) AS n_docs FROM analyzed GROUP BY lang
), vocab AS (
  SELECT lang, term, df, cf, n_docs
  FROM terms JOIN sizes USING (lang) WHERE df >= 3 AND df <= 0.95::DOUBLE * n_docs
  QUALIFY row_number() OVER (PARTITION BY lang ORDER BY cf DESC, term) <= 200000
)"""


@query("term_stats", f"WITH {TERMS} SELECT lang, term, df, cf FROM terms")
def _(spark, sf):
    return f.term_stats(analyzed(spark, sf, pairs=False), "grams", pairs=True)


@query("vocabulary", f"WITH {TERMS} SELECT lang, term, df, cf, n_docs FROM vocab")
def _(spark, sf):
    return f.vocabulary(analyzed(spark, sf, pairs=False), "grams", pairs=True)


@query(
    "tfidf",
    f"""WITH {TERMS}, weighted AS (
  SELECT id, lang, term, (1 + ln(tf)) * (ln((1 + n_docs)::DOUBLE / (1 + df)) + 1) AS w
  FROM occurrences JOIN vocab USING (lang, term)
), norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM weighted GROUP BY id)
SELECT id, lang, term, round(w / norm, 6) AS weight FROM weighted JOIN norms USING (id)""",
)
def _(spark, sf):
    rows = f.counted(analyzed(spark, sf, pairs=False), "grams", ["id", "lang"], pairs=True)
    long = f.tfidf_of(rows, f.vocabulary_of(rows), ["id", "lang"])
    return long.select("id", "lang", "term", six("weight").alias("weight"))


@query(
    "class_weights",
    f"""WITH {COMMENTS}, counts AS (SELECT lang, toxic, count(*) AS n FROM comments GROUP BY ALL)
SELECT lang, toxic, n,
  round(CAST(sum(n) OVER w AS DOUBLE) / (count(*) OVER w * n), 6) AS weight
FROM counts WINDOW w AS (PARTITION BY lang)""",
)
def _(spark, sf):
    weights = class_weights(comments(spark, sf), ["lang"])
    return weights.withColumn("weight", six("weight"))

