"""Evaluate stored predictions: metrics report and error sample of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.columns import is_label
from commentlab.operators.errors import tag_errors
from commentlab.operators.metrics import metrics_report
from commentlab.operators.sampling import error_sample
from commentlab.scale import join_small
from commentlab.sources.readers import (
    choose_languages,
    inconsistent_thresholds,
    load_predictions,
    prediction_status,
)
from commentlab.sources.writers import write_error_sample, write_table


def evaluate_run(
    spark: SparkSession,
    folder: str,
    run_tag: str,
    languages: list[str] | None = None,
    output: str | None = None,
    errors_dir: str | None = None,
    fmt: str = "csv",
    strict: bool = False,
    configured: list[str] | None = None,
    multiline: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(report, error sample); both are also written when a place for them is given.

    Languages are the given ones, else the configured ones, else those found. The report's
    ``status`` tells what it leaves out: rows with labels outside 0/1 and mixed thresholds in the
    row of their language, missing languages in the macro and micro rows. ``strict`` raises on
    all three. A language whose file holds no rows has a row without samples.
    """
    wanted = choose_languages(languages, configured) if languages or configured else None
    missing: list[str] = []
    languages = wanted
    if wanted and not strict:
        status = {r["language"]: r["status"] for r in prediction_status(spark, folder, run_tag, wanted, fmt).collect()}
        languages = [lang for lang in wanted if status[lang] == "found"]
        missing = [lang for lang in wanted if status[lang] != "found"]
        if not languages:
            raise FileNotFoundError(f"no predictions of {run_tag} under {folder}")
    predictions = load_predictions(spark, folder, run_tag, languages, fmt, multiline=multiline, strict=strict)
    if strict and (mixed := inconsistent_thresholds(predictions, ["lang"]).limit(20).collect()):
        raise ValueError(f"more than one threshold: {[r['lang'] for r in mixed]}")
    report = with_status(metrics_report(predictions, languages=languages, strict=strict), predictions, missing)
    sample = error_sample(tag_errors(predictions), ["lang"])
    if output:
        write_table(report.drop("section"), output)
    if errors_dir:
        write_error_sample(sample, errors_dir, run_tag)
    return report, sample


def _faults(predictions: DataFrame) -> DataFrame:
    """language, n_rows, n_invalid, n_thresholds of each language that has rows."""
    valid = F.coalesce(is_label(F.col("y_true")) & is_label(F.col("y_pred")), F.lit(False))
    return predictions.groupBy(F.col("lang").alias("language")).agg(
        F.count("*").alias("n_rows"),
        F.count_if(~valid).alias("n_invalid"),
        F.count_distinct("best_threshold").alias("n_thresholds"),
    )


def with_status(report: DataFrame, predictions: DataFrame, missing: list[str]) -> DataFrame:
    """``report`` with a ``status``: complete, or what is not in it."""
    told = F.array_compact(
        F.array(
            F.when(F.col("n_invalid") > 0, F.concat(F.col("n_invalid"), F.lit(" invalid rows"))),
            F.when(F.col("n_thresholds") > 1, F.concat(F.col("n_thresholds"), F.lit(" thresholds"))),
        )
    )
    own = _faults(predictions).select("language", F.array_join(told, ", ").alias("_told"))
    lost = F.lit(f"missing: {', '.join(missing)}" if missing else "complete")
    status = F.when(F.col("section") > 0, lost).when(F.col("_told") != "", F.col("_told")).otherwise("complete")
    return join_small(report, own, ["language"], "left").withColumn("status", status).drop("_told").orderBy("section", "language")


def evaluation_status(
    spark: SparkSession, folder: str, run_tag: str, languages: list[str], fmt: str = "csv"
) -> DataFrame:
    """language, status, n_rows, n_invalid, n_thresholds of every wanted language.

    Shows what a report that is not strict leaves out: missing languages, rows with labels
    outside 0/1, and files that hold more than one threshold.
    """
    status = prediction_status(spark, folder, run_tag, languages, fmt)
    found = [r["language"] for r in status.filter("status = 'found'").collect()]
    counts = ["n_rows", "n_invalid", "n_thresholds"]
    if not found:
        return status.select("*", *[F.lit(0).cast("long").alias(c) for c in counts])
    predictions = load_predictions(spark, folder, run_tag, found, fmt)
    return status.join(_faults(predictions), "language", "left").na.fill(0, counts)
