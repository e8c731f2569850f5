"""Score validation and test rows with a supplied model, tune, decide and evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.operators.external import BATCH, Predict, score_external
from commentlab.operators.metrics import labelled_groups, language_metrics, macro_row
from commentlab.operators.threshold import (
    GRID_MIN,
    apply_thresholds,
    for_languages,
    tune_threshold,
)
from commentlab.scale import join_small, literal_table
from commentlab.session import materialise
from commentlab.sources.readers import load_splits, unique
from commentlab.sources.writers import write_prediction_files, write_predictions


@dataclass
class ExternalRun:
    scored: DataFrame
    thresholds: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    macro: DataFrame


def run_external(
    splits: DataFrame,
    open_model: Callable[[], Predict],
    languages: list[str],
    threshold: float | None = None,
    batch_size: int = BATCH,
) -> ExternalRun:
    """Predictions for the test split of each language, and metrics where it has labels.

    Scoring is the expensive step and feeds both the sweep and the predictions, so its result
    is written once. A given ``threshold`` serves every language instead of a tuned one.
    """
    languages = unique(languages)
    wanted = splits.filter(F.col("lang").isin(languages) & F.col("split").isin("val", "test"))
    rated = score_external(wanted, open_model, batch_size=batch_size)
    scored = materialise(
        rated.drop("comment_text").withColumnRenamed("toxic", "y_true"), "scored", ["lang", "split"]
    )
    if threshold is None:
        tuned = tune_threshold(scored.filter(F.col("split") == "val"), ["lang"])
        thresholds = for_languages(tuned, languages, GRID_MIN)
    else:
        rows = [(lang, float(threshold)) for lang in languages]
        thresholds = literal_table(splits.sparkSession, rows, "lang string, best_threshold double")
    predictions = apply_thresholds(scored.filter(F.col("split") == "test"), thresholds, ["lang"])
    labelled = join_small(
        predictions, labelled_groups(predictions, ["lang"]).select("lang"), ["lang"], "left_semi"
    )
    metrics = language_metrics(labelled)
    return ExternalRun(
        scored, thresholds, predictions, metrics, macro_row(metrics, skip_undefined=False)
    )


def score_folder(
    spark: SparkSession,
    data_dir: str,
    open_model: Callable[[], Predict],
    languages: list[str],
    run_tag: str,
    pred_dir: str | None = None,
    threshold: float | None = None,
    batch_size: int = BATCH,
    text_col: str = "comment_text",
    label_col: str = "toxic",
    fmt: str = "csv",
    multiline: bool = True,
) -> ExternalRun:
    """Score ``{data_dir}/{lang}/val`` and ``test`` and write the predictions of the run.

    A missing file raises.
    """
    splits, _ = load_splits(
        spark, data_dir, languages, ("val", "test"), fmt,
        text_col=text_col, label_col=label_col, multiline=multiline,
    )
    run = run_external(splits, open_model, languages, threshold, batch_size)
    if pred_dir and fmt == "csv":
        write_prediction_files(run.predictions, pred_dir, run_tag, unique(languages))
    elif pred_dir:
        write_predictions(run.predictions, pred_dir, run_tag, fmt)
    return run
