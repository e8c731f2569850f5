"""Role resolution, labels, thresholds and ids on plain columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from commentlab.scale import join_small, same_keys
from commentlab.session import materialise

# Accepted column names per role, in order of preference. "prediction" and
# "pred" name probabilities.
LABEL_NAMES = ["y_true", "label", "target", "toxic"]
SCORE_NAMES = ["y_prob", "prob", "prediction", "pred_score", "pred"]
DECISION_NAMES = ["y_pred", "pred_label", "prediction_binary"]
# The threshold used when none is known, and the label of unlabelled rows.
DEFAULT_THRESHOLD = 0.5
UNLABELLED = -1


def pick_column(columns: list[str], candidates: list[str], required: bool = True) -> str | None:
    """First candidate that is a column. Needs the schema only, no job."""
    found = next((c for c in candidates if c in columns), None)
    if found is None and required:
        raise KeyError(f"none of {candidates} among the columns {columns}")
    return found


def binarize(score: Column, threshold: Column | float) -> Column:
    """1 where the score reaches the threshold, which is inclusive."""
    return (score >= threshold).cast("int")


def binarize_label(fraction: Column, at: float = 0.5) -> Column:
    return (fraction >= F.lit(at)).cast("int")


def stored_threshold(value: Column) -> Column:
    """A stored threshold as a number.

    An empty cell becomes NaN, which no score reaches; text that is not a number falls back to
    the default.
    """
    text = value.cast("string")
    number = text.try_cast("double")
    return F.when(text.isNull(), F.lit(float("nan"))).otherwise(
        F.coalesce(number, F.lit(DEFAULT_THRESHOLD))
    )


def is_label(label: Column) -> Column:
    return F.coalesce(label.isin(0, 1), F.lit(False))


def error_type(y_true: Column, y_pred: Column) -> Column:
    return F.when((y_true == 0) & (y_pred == 1), "FP").when((y_true == 1) & (y_pred == 0), "FN")


def numbered(df: DataFrame, group: list[str], order: list[str], out: str) -> DataFrame:
    """Ordinals 0..n-1 per group in the order of columns that are unique within it.

    Rows are sorted by ranges of group and order, so no group is sorted in one task, and stored
    as they lie. How many rows of a group each range holds gives its first ordinal there.
    """
    ordered = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    ordered = materialise(ordered.withColumn("_pos", F.monotonically_increasing_id()), "ordered")
    # The upper bits of the number name the range.
    placed = ordered.withColumn("_part", F.shiftright("_pos", 33))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        placed.groupBy(*group, "_part")
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ordinal = F.col("_start") + F.col("_pos") - F.col("_first")
    return join_small(placed, starts, [*group, "_part"]).select(*df.columns, ordinal.alias(out))


# Keys up to which ordinals are broadcast to the rows.
NUMBERED = 1_000_000


def surrogate_id(df: DataFrame, group: list[str], position: str, out: str = "id") -> DataFrame:
    """Ordinals 0..n-1 per group in the order of a unique ``position``, dense or sparse.

    The keys alone are numbered, and up to ``NUMBERED`` of them sent to the rows, which stay where
    they are. Beyond that the rows are sorted by ranges and numbered as they lie.
    """
    keys = df.select(*group, position)
    if keys.count() > NUMBERED:
        return numbered(df, group, [position], out)
    order = W.partitionBy(*group).orderBy(position)
    ordinals = materialise(keys.select("*", (F.row_number().over(order) - 1).cast("long").alias(out)), "ordinals")
    return same_keys(df, F.broadcast(ordinals), [*group, position]).select(*df.columns, out)
