"""Threshold sweep over an even grid from one histogram per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from commentlab.functions.columns import DEFAULT_THRESHOLD, binarize
from commentlab.operators.metrics import ratio
from commentlab.scale import join_small, literal_table

# The grid of the sweep.
GRID_MIN, GRID_MAX, GRID_STEPS = 0.1, 0.9, 81
METRICS = ("f1", "precision", "recall")


def grid_value(i: Column, low: float, high: float, steps: int) -> Column:
    """The i-th of ``steps`` evenly spaced values, whose last one is exactly ``high``."""
    if steps == 1:
        return F.lit(float(low))
    step = (high - low) / (steps - 1)
    return F.when(i == steps - 1, F.lit(float(high))).otherwise(F.lit(low) + F.lit(step) * i)


def grid_index(score: Column, low: float, high: float, steps: int) -> Column:
    """Index of the highest grid value that the score reaches, -1 if it reaches none.

    The division only guesses; the guess is settled by comparing with the grid values.
    """
    if steps == 1:
        return F.when(score >= F.lit(float(low)), 0).otherwise(-1)
    step = (high - low) / (steps - 1)
    inside = F.greatest(F.lit(0.0), F.least(F.lit(steps - 1.0), (score - low) / F.lit(step)))
    guess = F.floor(inside).cast("int")

    def reached(i: Column) -> Column:
        return (i < steps) & (score >= grid_value(i, low, high, steps))

    return (
        F.when(score.isNull() | F.isnan(score), F.lit(-1))
        .when(reached(guess + 1), guess + 1)
        .when(reached(guess), guess)
        .otherwise(guess - 1)
    )


def sweep(
    df: DataFrame,
    keys: list[str],
    metric: str = "f1",
    low: float = GRID_MIN,
    high: float = GRID_MAX,
    steps: int = GRID_STEPS,
    label: str = "y_true",
    score: str = "y_prob",
) -> DataFrame:
    """keys, threshold, score of the best grid value; the lowest of equally good ones.

    Thresholds between two occupied bins select the same rows, so only the lowest one of each
    such stretch can win. At most ``steps + 1`` rows per group leave the first aggregation.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    if high < low or steps < 1:
        raise ValueError("the grid must rise and have a step")
    truth = F.col(label)
    bins = (
        df.withColumn("_bin", grid_index(F.col(score), low, high, steps))
        .groupBy(*keys, "_bin")
        .agg(F.count_if(truth == 1).alias("_pos"), F.count_if(truth == 0).alias("_neg"))
    )
    from_top = (
        W.partitionBy(*keys)
        .orderBy(F.desc("_bin"))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    upwards = W.partitionBy(*keys).orderBy("_bin")
    all_rows = W.partitionBy(*keys)
    stretches = bins.select(
        *keys,
        "_bin",
        F.sum("_pos").over(from_top).alias("_tp"),
        F.sum("_neg").over(from_top).alias("_fp"),
        F.sum("_pos").over(all_rows).alias("_p"),
        (F.lag("_bin", 1, -1).over(upwards) + 1).alias("_lowest"),
    )
    tp, fp, p = F.col("_tp"), F.col("_fp"), F.col("_p")
    value = {
        "f1": ratio(2 * tp, tp + fp + p),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, p),
    }[metric]
    usable = F.when(F.col("_bin") >= 0, F.struct(value.alias("v"), (-F.col("_lowest")).alias("i")))
    best = stretches.groupBy(*keys).agg(F.max(usable).alias("_best"))
    return best.select(
        *keys,
        grid_value(-F.col("_best.i"), low, high, steps).alias("threshold"),
        F.coalesce(F.col("_best.v"), F.lit(0.0)).alias("score"),
    )


def best_threshold(df: DataFrame, keys: list[str], metric: str = "f1", **grid) -> DataFrame:
    """Best threshold and score; 0.5 and 0 where no threshold scores above 0."""
    best = sweep(df, keys, metric, **grid)
    found = F.col("score") > 0
    return best.select(
        *keys,
        F.when(found, F.col("threshold")).otherwise(F.lit(DEFAULT_THRESHOLD)).alias("best_threshold"),
        F.col("score").alias("best_score"),
    )


def tune_threshold(
    df: DataFrame,
    keys: list[str],
    steps: int = GRID_STEPS,
    low: float = GRID_MIN,
    high: float = GRID_MAX,
) -> DataFrame:
    """Best threshold by F1; the lowest grid value where every F1 is 0."""
    best = sweep(df, keys, "f1", low, high, steps)
    found = F.col("score") > 0
    return best.select(
        *keys,
        F.when(found, F.col("threshold")).otherwise(F.lit(float(low))).alias("best_threshold"),
    )


def apply_thresholds(
    df: DataFrame, thresholds: DataFrame, keys: list[str], default: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Attach each group's threshold and the decision it gives.

    A group without a threshold, such as one with nothing to tune on, gets the default.
    """
    joined = join_small(df, thresholds.select(*keys, "best_threshold"), keys, "left")
    filled = joined.withColumn("best_threshold", F.coalesce("best_threshold", F.lit(default)))
    return filled.withColumn("y_pred", binarize(F.col("y_prob"), F.col("best_threshold")))


def for_languages(
    thresholds: DataFrame, languages: list[str], default: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """(lang, best_threshold) for each of the languages, tuned or not."""
    listed = literal_table(thresholds.sparkSession, [(lang,) for lang in languages], "lang string")
    joined = listed.join(thresholds, "lang", "left")
    return joined.select(
        "lang", F.coalesce("best_threshold", F.lit(default)).alias("best_threshold")
    )
