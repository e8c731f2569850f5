"""Sinks: predictions, reports, error samples and fitted models."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.operators.model import LanguageModel, model_tables

PREDICTIONS = ["id", "y_true", "y_prob", "y_pred", "best_threshold"]


def _writer(df: DataFrame, fmt: str, mode: str):
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    return writer


def write_predictions(df: DataFrame, folder: str, run_tag: str, fmt: str = "parquet") -> None:
    """One partition per (run_tag, lang); a run replaces its own partitions only.

    Rebalancing cuts each language into files of even size, however large it is.
    """
    rows = df.select(*PREDICTIONS, F.lit(run_tag).alias("run_tag"), "lang")
    (
        _writer(rows.hint("rebalance", "lang"), fmt, "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_tag", "lang")
        .save(folder)
    )


def _all_listed(stored: DataFrame, columns: list[str], listed: list) -> None:
    """Raises if ``stored`` holds rows for which no file is to be written."""
    found = {tuple(r) for r in stored.select(*columns).distinct().limit(len(listed) + 1).collect()}
    if left := sorted(found - set(listed), key=repr):
        raise ValueError(f"rows without a file of their own: {left}")


def _hadoop(spark: SparkSession, path: str):
    """The file system of a path, and a function that makes paths of it."""
    jvm = spark.sparkContext._jvm
    make = jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def write_places(
    df: DataFrame, folder: str, place: Column, places: list[str], fmt: str, drop: list[str]
) -> None:
    """Each row, without the columns ``drop``, into the table ``{folder}/{place}``, by one write.

    The partitions are moved to their places by the file system of the folder, so rows are written
    once. Raises if there are rows of other places, before anything is moved; places without rows
    get an empty table.
    """
    spark, staging = df.sparkSession, f"{folder}/_staging-{uuid.uuid4().hex}"
    numbers = {name: i for i, name in enumerate(places)}
    number = F.lit(-1)
    for name, i in numbers.items():
        number = F.when(place.eqNullSafe(F.lit(name)), i).otherwise(number)
    marked = df.withColumn("_place", number).drop(*drop)
    _writer(marked.hint("rebalance", "_place"), fmt, "error").partitionBy("_place").save(staging)
    system, path = _hadoop(spark, folder)
    try:
        if system.exists(path(f"{staging}/_place=-1")):
            raise ValueError(f"rows without a file of their own among {places}")
        for name, i in numbers.items():
            target = path(f"{folder}/{name}")
            system.delete(target, True)
            system.mkdirs(target.getParent())
            if system.exists(path(f"{staging}/_place={i}")):
                system.rename(path(f"{staging}/_place={i}"), target)
            else:
                _writer(df.drop(*drop).limit(0), fmt, "overwrite").save(f"{folder}/{name}")
    finally:
        system.delete(path(staging), True)


def write_prediction_files(
    df: DataFrame, folder: str, run_tag: str, languages: list[str]
) -> None:
    """``{folder}/{run_tag}_{lang}.csv`` per language, for readers that expect that layout."""
    name = F.concat(F.lit(f"{run_tag}_"), F.col("lang"), F.lit(".csv"))
    places = [f"{run_tag}_{lang}.csv" for lang in languages]
    write_places(df.select(*PREDICTIONS, name.alias("_name")), folder, F.col("_name"), places, "csv", ["_name"])


def write_splits(df: DataFrame, folder: str, languages: list[str], fmt: str = "csv") -> None:
    """``{folder}/{lang}/{split}.{fmt}`` per language and split, from one pass over the rows."""
    name = F.concat("lang", F.lit("/"), "split", F.lit(f".{fmt}"))
    places = [f"{lang}/{split}.{fmt}" for lang in languages for split in ("train", "val", "test")]
    write_places(df.withColumn("_name", name), folder, F.col("_name"), places, fmt, ["lang", "split", "_name"])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    _writer(df, fmt, "overwrite").save(path)


def write_error_sample(df: DataFrame, folder: str, run_tag: str, fmt: str = "csv") -> None:
    """The bounded error sample, false positives first, one partition per (run_tag, lang)."""
    rows = df.withColumn("run_tag", F.lit(run_tag)).orderBy("lang", F.desc("error_type"))
    (
        _writer(rows, fmt, "overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_tag", "lang")
        .save(folder)
    )


def save_models(
    models: dict[str, LanguageModel], settings: DataFrame, folder: str
) -> None:
    """The terms and coefficients of all languages as one table, their intercepts, and the table of
    thresholds and cleaning settings."""
    terms, intercepts = model_tables(models, settings)
    write_table(terms, f"{folder}/models", "parquet")
    write_table(intercepts, f"{folder}/intercepts", "parquet")
    write_table(settings, f"{folder}/settings", "parquet")


def load_models(settings: DataFrame, folder: str) -> dict[str, LanguageModel]:
    """One model per language of the settings table."""
    spark = settings.sparkSession
    stored = spark.read.parquet(f"{folder}/intercepts").join(settings.select("lang").distinct(), "lang", "left_semi")
    terms = spark.read.parquet(f"{folder}/models")
    return {
        r["lang"]: LanguageModel(terms.filter(F.col("lang") == r["lang"]).drop("lang"), r["intercept"], r["n_features"])
        for r in stored.orderBy("lang").collect()
    }
