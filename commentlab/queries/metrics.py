"""Metrics, thresholds, run comparison and subgroup metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commentlab.operators import metrics as m
from commentlab.operators import threshold as t
from commentlab.operators.auc import roc_auc, subgroup_auc
from commentlab.operators.errors import tag_errors, union_errors
from commentlab.queries.base import (
    comments,
    auc_sql,
    counts_sql,
    predictions,
    predictions_sql,
    query,
    scored,
    scored_sql,
    six,
    sweep_sql,
)

DOUBLES = [*m.RATES, *m.ERROR_RATES]
REPORT_SQL = """
  CAST(n AS BIGINT) AS n_samples, round(positive_rate, 6) AS positive_rate,
  round(roc_auc, 6) AS roc_auc, round(f1, 6) AS f1, round("precision", 6) AS "precision",
  round(recall, 6) AS recall, round(accuracy, 6) AS accuracy,
  CAST(tp AS BIGINT) AS true_positives, CAST(tn AS BIGINT) AS true_negatives,
  CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,
  round(specificity, 6) AS specificity, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr"""


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: six(c) for c in DOUBLES if c in df.columns})


@query("binarize", f"WITH {predictions_sql()} SELECT lang, id, y_pred FROM pred")
def _(spark, sf):
    return predictions(spark, sf).select("lang", "id", "y_pred")


@query(
    "class_balance",
    f"""WITH {scored_sql()}
SELECT lang, count(*) AS n_samples, count(*) FILTER (y_true = 1) AS n_positive,
  round(avg(y_true), 6) AS positive_rate
FROM scored GROUP BY lang""",
)
def _(spark, sf):
    rows = m.class_balance(scored(spark, sf), ["lang"])
    return rows.withColumn("positive_rate", six("positive_rate"))


@query(
    "confusion",
    f"WITH {predictions_sql()}, {counts_sql('pred', 'lang')} SELECT lang, tn, fp, fn, tp FROM counts",
)
def _(spark, sf):
    return m.confusion(predictions(spark, sf), ["lang"])


@query(
    "prf_accuracy",
    f"""WITH {predictions_sql()}, {counts_sql('pred', 'lang')}
SELECT lang, round("precision", 6) AS "precision", round(recall, 6) AS recall,
  round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM counts""",
)
def _(spark, sf):
    names = ["precision", "recall", "f1", "accuracy"]
    return rounded(m.decision_metrics(predictions(spark, sf), ["lang"], names))


@query(
    "error_rates",
    f"""WITH {predictions_sql()}, {counts_sql('pred', 'lang')}
SELECT lang, round(specificity, 6) AS specificity, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr
FROM counts""",
)
def _(spark, sf):
    return rounded(m.decision_metrics(predictions(spark, sf), ["lang"], m.ERROR_RATES))


@query(
    "roc_auc",
    f"""WITH {scored_sql()}, {auc_sql('scored', 'lang')}
SELECT lang, round(roc_auc, 6) AS roc_auc FROM aucs""",
)
def _(spark, sf):
    return rounded(roc_auc(scored(spark, sf), ["lang"]).select("lang", "roc_auc"))


PER_LANGUAGE = f"""
{predictions_sql()}, {counts_sql('pred', 'lang')}, {auc_sql('pred', 'lang')}, per_language AS (
  SELECT counts.*, roc_auc FROM counts JOIN aucs USING (lang)
)"""
EVERYONE = f"""
everyone AS (SELECT 'micro' AS lang, * EXCLUDE (lang) FROM pred),
{counts_sql('everyone', 'lang', 'all_counts')}, {auc_sql('everyone', 'lang', 'all_aucs')},
overall AS (SELECT all_counts.*, roc_auc FROM all_counts JOIN all_aucs USING (lang))"""
MACRO = """
macro AS (
  SELECT 'macro' AS lang, sum(n) AS n, NULL AS tp, NULL AS fp, NULL AS fn, NULL AS tn,
    avg(positive_rate) AS positive_rate, avg(f1) AS f1, avg("precision") AS "precision",
    avg(recall) AS recall, avg(accuracy) AS accuracy, avg(specificity) AS specificity,
    avg(fpr) AS fpr, avg(fnr) AS fnr, avg(roc_auc) AS roc_auc
  FROM per_language
)"""


@query("language_metrics", f"WITH {PER_LANGUAGE} SELECT lang AS language, {REPORT_SQL} FROM per_language")
def _(spark, sf):
    return rounded(m.language_metrics(predictions(spark, sf)))


@query(
    "macro_row",
    f"WITH {PER_LANGUAGE}, {MACRO} SELECT lang AS language, {REPORT_SQL} FROM macro",
)
def _(spark, sf):
    return rounded(m.macro_row(m.language_metrics(predictions(spark, sf))))


@query(
    "micro_row",
    f"WITH {predictions_sql()}, {EVERYONE} SELECT lang AS language, {REPORT_SQL} FROM overall",
)
def _(spark, sf):
    return rounded(m.micro_row(predictions(spark, sf)))


@query(
    "metrics_report",
    f"""WITH {PER_LANGUAGE}, {MACRO}, {EVERYONE}
SELECT 0 AS section, lang AS language, {REPORT_SQL} FROM per_language
UNION ALL SELECT 1, lang, {REPORT_SQL} FROM macro
UNION ALL SELECT 2, lang, {REPORT_SQL} FROM overall""",
)
def metrics_report(spark, sf):
    return rounded(m.metrics_report(predictions(spark, sf)))


def _sweep_query(metric: str):
    sql = f"""WITH {scored_sql()}, {sweep_sql('scored', metric)}
SELECT lang, round(best_threshold, 6) AS best_threshold, round(best_score, 6) AS best_score
FROM best"""

    @query(f"threshold_sweep_{metric}", sql)
    def _(spark, sf):
        best = t.best_threshold(scored(spark, sf), ["lang"], metric)
        return best.select("lang", six("best_threshold").alias("best_threshold"), six("best_score").alias("best_score"))


for _metric in t.METRICS:
    _sweep_query(_metric)


@query(
    "tune_threshold",
    f"""WITH {scored_sql()}, {sweep_sql('scored', 'f1', '0.1::DOUBLE')}
SELECT lang, round(best_threshold, 6) AS best_threshold FROM best""",
)
def _(spark, sf):
    tuned = t.tune_threshold(scored(spark, sf), ["lang"])
    return tuned.select("lang", six("best_threshold").alias("best_threshold"))


@query(
    "apply_thresholds",
    f"""WITH {scored_sql()}, {sweep_sql('scored')}
SELECT lang, id, round(best_threshold, 6) AS best_threshold,
  CAST(y_prob >= best_threshold AS INTEGER) AS y_pred
FROM scored JOIN best USING (lang)""",
)
def _(spark, sf):
    rows = scored(spark, sf)
    decided = t.apply_thresholds(rows, t.best_threshold(rows, ["lang"]), ["lang"])
    return decided.select("lang", "id", six("best_threshold").alias("best_threshold"), "y_pred")


UNLABELLED_SQL = """
WITH everything AS (
  SELECT d.lang, d.source, coalesce(l.toxic, -1) AS y_true
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)
SELECT lang, source, count(*) AS n_rows, count(*) FILTER (y_true <> -1) AS n_labelled
FROM everything GROUP BY ALL HAVING count(*) FILTER (y_true <> -1) > 0"""


@query("labelled_languages", UNLABELLED_SQL)
def _(spark, sf):
    from commentlab.queries.base import table

    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    label = F.coalesce("toxic", F.lit(-1)).alias("y_true")
    rows = docs.join(labels, "doc_id", "left").select("lang", "source", label)
    return m.labelled_groups(rows, ["lang", "source"])


TAGGED = f"""
{predictions_sql()}, tagged AS (
  SELECT *, CASE WHEN y_true = 0 AND y_pred = 1 THEN 'FP' WHEN y_true = 1 AND y_pred = 0 THEN 'FN'
    END AS error_type
  FROM pred
), errors AS (SELECT * FROM tagged WHERE error_type IS NOT NULL)"""


@query("error_tag", f"WITH {TAGGED} SELECT lang, id, y_true, y_pred, error_type FROM errors")
def _(spark, sf):
    return tag_errors(predictions(spark, sf)).select("lang", "id", "y_true", "y_pred", "error_type")


@query("union_errors", f"WITH {TAGGED} SELECT lang, id, error_type FROM errors")
def _(spark, sf):
    return union_errors(predictions(spark, sf)).select("lang", "id", "error_type")


GOLD_SIDES = """
gold AS (SELECT lang, id, toxic AS y_true FROM comments WHERE quality = 1),
some_pred AS (SELECT lang, id, y_prob, y_pred FROM pred WHERE y_prob >= 0.1::DOUBLE)"""


def _gold_sides(spark, sf):
    rows = predictions(spark, sf)
    gold = rows.filter(F.col("quality") == 1).select("lang", "id", "y_true")
    return rows.filter(F.col("y_prob") >= 0.1).select("lang", "id", "y_prob", "y_pred"), gold


@query(
    "pred_gold_join",
    f"""WITH {predictions_sql()}, gold AS (SELECT lang, id, toxic AS y_true FROM comments)
SELECT lang, id, gold.y_true, round(y_prob, 6) AS y_prob, y_pred FROM pred JOIN gold USING (lang, id)""",
)
def _(spark, sf):
    rows = predictions(spark, sf)
    gold = comments(spark, sf).select("lang", "id", F.col("toxic").alias("y_true"))
    joined = m.join_gold(rows.select("lang", "id", "y_prob", "y_pred"), gold)
    return joined.select("lang", "id", "y_true", six("y_prob").alias("y_prob"), "y_pred")


@query(
    "pred_gold_unmatched",
    f"""WITH {predictions_sql()}, {GOLD_SIDES}
SELECT lang, id, 'prediction' AS side FROM some_pred ANTI JOIN gold USING (lang, id)
UNION ALL SELECT lang, id, 'gold' AS side FROM gold ANTI JOIN some_pred USING (lang, id)""",
)
def _(spark, sf):
    return m.unmatched_gold(*_gold_sides(spark, sf))


SECOND = {"times": 104729, "span": 800}


@query(
    "run_compare",
    f"""WITH {predictions_sql()}, second AS (
  SELECT lang, id, y_true, CAST((id * 104729) % 800 + 200 * y_true AS DOUBLE) / 1000 AS y_prob FROM pred
), second_pred AS (SELECT *, CAST(y_prob >= 0.5::DOUBLE AS INTEGER) AS y_pred FROM second),
{counts_sql('pred', 'lang', 'c1')}, {auc_sql('pred', 'lang', 'a1')},
{counts_sql('second_pred', 'lang', 'c2')}, {auc_sql('second_pred', 'lang', 'a2')},
e1 AS (SELECT 'micro' AS lang, y_true, y_prob, y_pred FROM pred),
e2 AS (SELECT 'micro' AS lang, y_true, y_prob, y_pred FROM second_pred),
{counts_sql('e1', 'lang', 'd1')}, {auc_sql('e1', 'lang', 'b1')},
{counts_sql('e2', 'lang', 'd2')}, {auc_sql('e2', 'lang', 'b2')},
single AS (
  SELECT lang, a1.roc_auc AS a, c1.f1 AS f, a2.roc_auc AS b, c2.f1 AS g
  FROM c1 JOIN a1 USING (lang) JOIN c2 USING (lang) JOIN a2 USING (lang)
), every AS (
  SELECT * FROM single
  UNION ALL SELECT 'macro', avg(a), avg(f), avg(b), avg(g) FROM single
  UNION ALL SELECT lang, b1.roc_auc, d1.f1, b2.roc_auc, d2.f1
    FROM d1 JOIN b1 USING (lang) JOIN d2 USING (lang) JOIN b2 USING (lang)
)
SELECT lang AS language, round(a, 6) AS base_roc_auc, round(b, 6) AS other_roc_auc,
  round(b - a, 6) AS delta_roc_auc, round(f, 6) AS base_f1, round(g, 6) AS other_f1,
  round(g - f, 6) AS delta_f1 FROM every""",
)
def _(spark, sf):
    first = predictions(spark, sf).withColumn("run_tag", F.lit("first"))
    second = predictions(spark, sf, **SECOND).withColumn("run_tag", F.lit("second"))
    report = m.metrics_report(first.unionByName(second), ["run_tag"])
    compared = m.run_compare(report, "first", "second")
    return compared.select("language", *[six(c).alias(c) for c in compared.columns[1:]])


SUBGROUPS = {"low_quality": "quality = 0", "long": "n_chars >= 2000", "short": "n_chars < 500"}


def _bias_sql() -> str:
    kinds = {
        "subgroup_auc": "inside",
        "bpsn_auc": "(NOT inside AND y_true = 1) OR (inside AND y_true = 0)",
        "bnsp_auc": "(inside AND y_true = 1) OR (NOT inside AND y_true = 0)",
    }
    members = " UNION ALL ".join(
        f"SELECT '{name}' AS subgroup, {cond} AS inside, y_true, y_prob FROM scored"
        for name, cond in SUBGROUPS.items()
    )
    picked = ", ".join(
        f"{k}_rows AS (SELECT * FROM members WHERE {cond}), {auc_sql(k + '_rows', 'subgroup', k)}"
        for k, cond in kinds.items()
    )
    return f"""WITH {scored_sql()}, members AS ({members}),
sizes AS (SELECT subgroup, count(*) FILTER (inside) AS subgroup_size FROM members GROUP BY ALL),
{picked}
SELECT subgroup, subgroup_size, round(s.roc_auc, 6) AS subgroup_auc,
  round(p.roc_auc, 6) AS bpsn_auc, round(q.roc_auc, 6) AS bnsp_auc
FROM sizes LEFT JOIN subgroup_auc s USING (subgroup) LEFT JOIN bpsn_auc p USING (subgroup)
  LEFT JOIN bnsp_auc q USING (subgroup)"""


@query("bias_auc", _bias_sql())
def _(spark, sf):
    groups = {name: F.expr(cond) for name, cond in SUBGROUPS.items()}
    aucs = subgroup_auc(scored(spark, sf), groups)
    kinds = ["subgroup_auc", "bpsn_auc", "bnsp_auc"]
    return aucs.select("subgroup", "subgroup_size", *[six(k).alias(k) for k in kinds])
