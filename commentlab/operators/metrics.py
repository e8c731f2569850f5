"""Per-language, macro and micro metrics of binary decisions and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.functions.columns import is_label
from commentlab.operators.auc import count_scores, rank_totals
from commentlab.scale import literal_table

RATES = ["positive_rate", "roc_auc", "f1", "precision", "recall", "accuracy"]
ERROR_RATES = ["specificity", "fpr", "fnr"]
COUNTS = ["true_positives", "true_negatives", "false_positives", "false_negatives"]
REPORT = ["n_samples", *RATES, *COUNTS, *ERROR_RATES]
MACRO, MICRO = "macro", "micro"


def ratio(part: Column, whole: Column) -> Column:
    """0 where the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def class_balance(df: DataFrame, keys: list[str], label: str = "y_true") -> DataFrame:
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_samples"), F.count_if(F.col(label) == 1).alias("n_positive")
    )
    rate = ratio(F.col("n_positive"), F.col("n_samples"))
    return counts.withColumn("positive_rate", rate)


def confusion(
    df: DataFrame, keys: list[str], y_true: str = "y_true", y_pred: str = "y_pred"
) -> DataFrame:
    t, p = F.col(y_true), F.col(y_pred)
    return df.groupBy(*keys).agg(
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
    )


def decision_rates() -> dict[str, Column]:
    """Ratios of the confusion counts tp, fp, fn, tn."""
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return {
        "f1": ratio(2 * tp, 2 * tp + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "accuracy": ratio(tp + tn, tp + fp + fn + tn),
        "specificity": ratio(tn, tn + fp),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    }


def decision_metrics(df: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    rates = decision_rates()
    return confusion(df, keys).select(*keys, *[rates[n].alias(n) for n in names])


def invalid_labels(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose label is not 0 or 1, per group."""
    return df.groupBy(*keys).agg(F.count_if(~is_label(F.col("y_true"))).alias("n_invalid"))


def labelled_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups with at least one usable label; the others get no metrics."""
    counts = df.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("y_true").isNotNull() & (F.col("y_true") != -1)).alias("n_labelled"),
    )
    return counts.filter(F.col("n_labelled") > 0)


def _scoped_metrics(
    df: DataFrame, keys: list[str], micro: bool, languages: list[str] | None, strict: bool
) -> DataFrame:
    """One row per language and, on request, one for all languages (kind 1).

    Everything comes from a single pass: the counts ride along with the score counts.
    """
    t, p = F.col("y_true"), F.col("y_pred")
    valid = is_label(t) & is_label(p)
    if strict:
        checked = F.when(valid, t).otherwise(
            F.raise_error(F.concat(F.lit("label or decision outside 0/1 in "), F.col("lang")))
        )
        df = df.withColumn("y_true", checked.cast("int"))
    else:
        df = df.filter(valid)
    counts = {
        "n": F.lit(1),
        "pos": t == 1,
        "neg": t == 0,
        "tp": (t == 1) & (p == 1),
        "fp": (t == 0) & (p == 1),
    }
    counted = count_scores(df, [*keys, "lang"], "y_prob", counts)
    if languages and not keys:
        none = literal_table(df.sparkSession, [(lang,) for lang in set(languages)], "lang string")
        zeros = [F.lit(0).cast("long").alias(c) for c in [*counts, "n_bad"]]
        counted = counted.unionByName(
            none.select("lang", F.lit(float("-inf")).alias("_score"), *zeros)
        )
    own = [*keys, "lang"]
    sets = [own, keys] if micro else [own]
    totals = rank_totals(counted, own, list(counts), {"roc_auc": ("pos", "neg")}, sets)
    filled = totals.withColumns(
        {"fn": F.col("pos") - F.col("tp"), "tn": F.col("neg") - F.col("fp")}
    )
    rates = decision_rates()
    return filled.select(
        *keys,
        F.col("_set").alias("kind"),
        F.when(F.col("_set") == 1, MICRO).otherwise(F.col("lang")).alias("language"),
        F.col("n").alias("n_samples"),
        ratio(F.col("pos"), F.col("n")).alias("positive_rate"),
        "roc_auc",
        *[rates[r].alias(r) for r in ("f1", "precision", "recall", "accuracy")],
        F.col("tp").alias("true_positives"),
        F.col("tn").alias("true_negatives"),
        F.col("fp").alias("false_positives"),
        F.col("fn").alias("false_negatives"),
        *[rates[r].alias(r) for r in ERROR_RATES],
    )


def language_metrics(
    df: DataFrame,
    keys: list[str] | None = None,
    languages: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """The full metrics row per language of (lang, y_true, y_prob, y_pred).

    Rows with labels outside 0/1 are left out, or raise when ``strict``.
    """
    rows = _scoped_metrics(df, keys or [], False, languages, strict)
    return rows.drop("kind")


def micro_row(df: DataFrame, keys: list[str] | None = None, strict: bool = False) -> DataFrame:
    """All metrics recomputed over the rows of every language together."""
    one = df.withColumn("lang", F.lit(MICRO))
    return _scoped_metrics(one, keys or [], False, None, strict).drop("kind")


def macro_row(
    per_language: DataFrame, keys: list[str] | None = None, skip_undefined: bool = True
) -> DataFrame:
    """Unweighted means over languages; sample counts add up, the four counts stay empty.

    An undefined value is skipped, or makes its mean undefined if ``skip_undefined`` is off.
    Languages without samples have no say.
    """
    keys = keys or []
    rates = [c for c in [*RATES, *ERROR_RATES] if c in per_language.columns]

    def mean(c: str) -> Column:
        own = F.when(F.col("n_samples") > 0, F.col(c))
        whole = F.when(F.count(own) == F.count_if(F.col("n_samples") > 0), F.avg(own))
        return (F.avg(own) if skip_undefined else whole).alias(c)

    means = per_language.groupBy(*keys).agg(
        F.lit(MACRO).alias("language"),
        F.sum("n_samples").alias("n_samples"),
        *[mean(c) for c in rates],
        *[F.lit(None).cast("long").alias(c) for c in COUNTS],
    )
    return means.select(*keys, "language", *[c for c in REPORT if c in means.columns])


def metrics_report(
    df: DataFrame,
    keys: list[str] | None = None,
    languages: list[str] | None = None,
    strict: bool = False,
) -> DataFrame:
    """Language rows, then macro, then micro, numbered by ``row_no`` within ``keys``.

    Each language row also feeds the macro row of its run; a group of one keeps its values.
    """
    keys = keys or []
    rows = _scoped_metrics(df, keys, True, languages, strict)

    def place(order: int, name: Column) -> Column:
        return F.struct(F.lit(order).alias("section"), name.alias("language"))

    own = F.when(F.col("kind") == 1, F.array(place(2, F.col("language")))).otherwise(
        F.array(place(0, F.col("language")), place(1, F.lit(MACRO)))
    )
    placed = rows.withColumn("_place", F.explode(own)).drop("language").select("*", "_place.*")
    counts = (F.col("section") != 1) | (F.col("n_samples") > 0)
    report = placed.groupBy(*keys, "section", "language").agg(
        F.sum("n_samples").alias("n_samples"),
        *[F.avg(F.when(counts, F.col(c))).alias(c) for c in [*RATES, *ERROR_RATES]],
        *[F.when(F.col("section") != 1, F.sum(c)).alias(c) for c in COUNTS],
    )
    return report.select(*keys, "section", "language", *REPORT).orderBy(
        *keys, "section", "language"
    )


def run_compare(report: DataFrame, base: str, other: str) -> DataFrame:
    """ROC-AUC and F1 of two runs side by side, per report row, with their differences."""
    wide = (
        report.groupBy("language")
        .pivot("run_tag", [base, other])
        .agg(F.first("roc_auc").alias("roc_auc"), F.first("f1").alias("f1"))
    )

    def pair(metric: str) -> list[Column]:
        a, b = F.col(f"{base}_{metric}"), F.col(f"{other}_{metric}")
        return [
            a.alias(f"base_{metric}"),
            b.alias(f"other_{metric}"),
            (b - a).alias(f"delta_{metric}"),
        ]

    return wide.select("language", *pair("roc_auc"), *pair("f1"))


def join_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the gold label of the same (lang, id)."""
    return predictions.join(gold, ["lang", "id"], "inner")


def unmatched_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Keys found on one side only, from a single full join on the keys alone."""
    left = predictions.select("lang", "id", F.lit(1).alias("_p"))
    right = gold.select("lang", "id", F.lit(1).alias("_g"))
    side = F.when(F.col("_g").isNull(), "prediction").when(F.col("_p").isNull(), "gold")
    joined = left.join(right, ["lang", "id"], "full")
    return joined.select("lang", "id", side.alias("side")).filter(F.col("side").isNotNull())
