"""Training, prediction and external scoring."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from commentlab.operators.external import score_external
from commentlab.operators.metrics import RATES, language_metrics
from commentlab.operators.sampling import split_rows
from commentlab.operators.threshold import apply_thresholds, best_threshold
from commentlab.plans.external import run_external
from commentlab.plans.train import fit_all, prepare, score_splits, train_and_predict
from commentlab.queries.base import (
    COMMENTS,
    languages,
    SPLIT,
    auc_sql,
    comments,
    counts_sql,
    documents,
    query,
    scored,
    six,
    sweep_sql,
    tuned_sql,
)
from commentlab.queries.sampling import TUNED
from commentlab.queries.text import ANALYZED
from commentlab.session import new_path
from commentlab.scale import literal_table
from commentlab.sources.writers import load_models, save_models

METRIC_SQL = ", ".join(
    f'round({c}, 6) AS {c}' for c in ("roc_auc", "f1", '"precision"', "recall", "accuracy")
)


def _tuned(spark, sf):
    rows = scored(spark, sf).select("lang", "id", "y_true", "y_prob")
    parts = split_rows(rows, ["lang"])
    val = parts.filter(F.col("split") == "val")
    return parts, val, best_threshold(val, ["lang"])


@query(
    "evaluate_val",
    f"""WITH {TUNED}, decided AS (
  SELECT vals.*, CAST(y_prob >= best_threshold AS INTEGER) AS y_pred FROM vals JOIN tuned USING (lang)
), {counts_sql('decided', 'lang')}, {auc_sql('decided', 'lang')}
SELECT lang, {METRIC_SQL}, round(best_threshold, 6) AS best_threshold
FROM counts JOIN aucs USING (lang) JOIN tuned USING (lang)""",
)
def _(spark, sf):
    _, val, best = _tuned(spark, sf)
    metrics = language_metrics(apply_thresholds(val, best, ["lang"]))
    joined = metrics.withColumnRenamed("language", "lang").join(best, "lang")
    return joined.select("lang", *[six(c).alias(c) for c in [*RATES[1:], "best_threshold"]])


@query(
    "predict_test",
    f"""WITH {TUNED}
SELECT lang, id, y_true, round(y_prob, 6) AS y_prob,
  CAST(y_prob >= best_threshold AS INTEGER) AS y_pred, round(best_threshold, 6) AS best_threshold
FROM parted JOIN tuned USING (lang) WHERE split = 'test'""",
)
def _(spark, sf):
    parts, _, best = _tuned(spark, sf)
    decided = apply_thresholds(parts.filter(F.col("split") == "test"), best, ["lang"])
    return decided.select(
        "lang", "id", "y_true", six("y_prob").alias("y_prob"), "y_pred", six("best_threshold").alias("best_threshold")
    )


def open_stand_in():
    """A scorer without a model: the leading digits of the text's hash."""

    def predict(texts: list[str]) -> dict[str, list[float]]:
        digits = [hashlib.md5(t.encode()).hexdigest()[:6] for t in texts]
        return {"toxicity": [int(d, 16) / 16777216 for d in digits]}

    return predict


STAND_IN = "CAST(('0x' || substr(md5(comment_text), 1, 6)) AS BIGINT)::DOUBLE / 16777216"


@query(
    "score_external",
    f"""WITH docs AS (SELECT doc_id AS id, lang, text AS comment_text FROM documents)
SELECT id, lang, round({STAND_IN}, 6) AS y_prob FROM docs""",
)
def _(spark, sf):
    rows = score_external(documents(spark, sf), open_stand_in)
    return rows.select("id", "lang", six("y_prob").alias("y_prob"))


def all_splits(spark, sf):
    """Labelled documents in train / val / test."""
    rows = comments(spark, sf, wide=True).select("lang", "id", "comment_text", "toxic")
    return split_rows(rows, ["lang"])


@query(
    "run_external",
    f"""WITH {COMMENTS}, {SPLIT.format(source='comments')}, rated AS (
  SELECT lang, split, id, toxic AS y_true, {STAND_IN} AS y_prob FROM parted WHERE split <> 'train'
), vals AS (SELECT * FROM rated WHERE split = 'val'), {sweep_sql('vals', 'f1', '0.1::DOUBLE')},
{tuned_sql('0.1::DOUBLE')}, decided AS (
  SELECT rated.*, CAST(y_prob >= best_threshold AS INTEGER) AS y_pred
  FROM rated JOIN tuned USING (lang) WHERE split = 'test'
), {counts_sql('decided', 'lang')}, {auc_sql('decided', 'lang')}
SELECT lang, n AS n_samples, {METRIC_SQL} FROM counts JOIN aucs USING (lang)""",
)
def _(spark, sf):
    run = run_external(all_splits(spark, sf), open_stand_in, languages(comments(spark, sf)))
    return run.metrics.select(
        F.col("language").alias("lang"), "n_samples", *[six(c).alias(c) for c in RATES[1:]]
    )


def _fitted(spark, sf):
    cleaned = prepare(all_splits(spark, sf), False, languages(comments(spark, sf)))
    models, errors = fit_all(cleaned, languages(comments(spark, sf)))
    return cleaned, models, errors


# Languages and whether their training rows have both classes, as a fit needs.
FITTED = f"""{COMMENTS}, {SPLIT.format(source='comments')}, train AS (
  SELECT lang, count(*) AS n, count(*) FILTER (toxic = 1) AS n_pos
  FROM parted WHERE split = 'train' AND lang IS NOT NULL GROUP BY lang
), fits AS (
  SELECT lang, n_pos > 0 AND n_pos < n AS fitted, CASE WHEN NOT (n_pos > 0 AND n_pos < n) THEN
    concat('the fit needs both classes, got ', n_pos, ' positive rows of ', n) END AS error
  FROM train
)"""


@query(
    "train_lr",
    f"""WITH {FITTED}, {ANALYZED}, train_grams AS (
  SELECT p.lang, p.id, a.grams FROM parted p JOIN analyzed a USING (id) WHERE split = 'train'
), terms AS (
  SELECT lang, term, count(DISTINCT id) AS df
  FROM (SELECT lang, id, unnest(grams) AS term FROM train_grams) GROUP BY ALL
), kept AS (
  SELECT lang, least(count(*), 200000) AS n_terms
  FROM terms JOIN train USING (lang) WHERE df >= 3 AND df <= 0.95::DOUBLE * n GROUP BY lang
)
SELECT lang, CASE WHEN fitted THEN CAST(n_terms AS INTEGER) END AS n_features,
  CASE WHEN fitted THEN true END AS stationary, error
FROM fits LEFT JOIN kept USING (lang)""",
)
def _(spark, sf):
    """Vocabulary sizes, and whether the loss is stationary in the intercept.

    At the minimum of the balanced loss, mean scores of the two classes add up to one.
    """
    cleaned, models, errors = _fitted(spark, sf)
    sizes = [
        (lang, models[lang].n_features if lang in models else None, errors.get(lang))
        for lang in sorted({*models, *errors})
    ]
    sizes = literal_table(spark, sizes, "lang string, n_features int, error string")
    score = lambda y: F.avg(F.when(F.col("y_true") == y, F.col("y_prob")))
    balance = (
        score_splits(cleaned, models, ("train",))
        .groupBy("lang")
        .agg((F.abs(score(0) + score(1) - 1) < 1e-3).alias("stationary"))
    )
    return sizes.join(balance, "lang", "left").select("lang", "n_features", "stationary", "error")


@query(
    "score_lr",
    f"""WITH {FITTED}
SELECT lang, split, id, toxic AS y_true, true AS is_probability
FROM parted JOIN fits USING (lang) WHERE fitted AND split <> 'train'""",
)
def _(spark, sf):
    cleaned, models, _ = _fitted(spark, sf)
    probability = F.coalesce(F.col("y_prob").between(0, 1), F.lit(False)).alias("is_probability")
    return score_splits(cleaned, models).select("lang", "split", "id", "y_true", probability)


@query(
    "model_roundtrip",
    f"""WITH {FITTED}
SELECT lang, count(*) AS n, 0::DOUBLE AS max_difference
FROM parted JOIN fits USING (lang) WHERE fitted AND split <> 'train' GROUP BY lang""",
)
def _(spark, sf):
    cleaned, models, _ = _fitted(spark, sf)
    folder = new_path(spark, "models")
    settings = literal_table(
        spark, [(lang, 0.5, False) for lang in models], "lang string, best_threshold double, use_stopwords boolean"
    )
    save_models(models, settings, folder)
    loaded = load_models(spark.read.parquet(f"{folder}/settings"), folder)
    before = score_splits(cleaned, models).withColumnRenamed("y_prob", "before")
    after = score_splits(cleaned, loaded).withColumnRenamed("y_prob", "after")
    joined = before.join(after.select("lang", "id", "after"), ["lang", "id"])
    return joined.groupBy("lang").agg(
        F.count("*").alias("n"), F.max(F.abs(F.col("before") - F.col("after"))).alias("max_difference")
    )


@query(
    "run_all_languages",
    f"""WITH {FITTED}
SELECT lang AS language, fitted AND has_val AS val_scored, fitted AND has_test AS test_scored, error
FROM fits JOIN (
  SELECT lang, bool_or(split = 'val') AS has_val, bool_or(split = 'test') AS has_test FROM parted GROUP BY lang
) USING (lang)
UNION ALL SELECT 'it', false, false, 'no training rows for it'
WHERE NOT EXISTS (FROM fits WHERE lang = 'it')""",
)
def _(spark, sf):
    summary = train_and_predict(all_splits(spark, sf), [*languages(comments(spark, sf)), "it"]).summary
    scored_in = lambda part: F.coalesce(F.col(f"{part}_f1").between(0, 1), F.lit(False))
    return summary.select(
        "language", scored_in("val").alias("val_scored"), scored_in("test").alias("test_scored"), "error"
    )
