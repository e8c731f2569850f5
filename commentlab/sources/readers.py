"""Readers of split tables, predictions and translated corpora."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from urllib.parse import urlparse

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from commentlab.functions.columns import (
    DECISION_NAMES,
    DEFAULT_THRESHOLD,
    LABEL_NAMES,
    SCORE_NAMES,
    UNLABELLED,
    binarize,
    pick_column,
    stored_threshold,
)
from commentlab.scale import join_small
from commentlab.session import run_each

SPLITS = ("train", "val", "test")
# Cell texts that mean "missing" in a comma-separated file.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
SPLIT_COLUMNS = ["lang", "split", "id", "comment_text", "toxic"]


def _found(df_of, what: str) -> DataFrame:
    try:
        return df_of()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in (error.getCondition() or ""):
            raise FileNotFoundError(f"{what} not found") from error
        raise


def scan_csv(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """A comma-separated file with a header, every column as text.

    A file with line breaks inside cells is one task however large: turn large ones into Parquet
    once (``csv_to_parquet``), or switch ``multiline`` off where no cell holds a line break.
    """
    reader = spark.read.option("header", True).option("multiLine", multiline)
    return _found(lambda: reader.option("quote", '"').option("escape", '"').csv(path), path)


def blank_missing(df: DataFrame) -> DataFrame:
    """NULL for the texts that mean a missing cell."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.col(f"`{c}`").isin(MISSING), F.col(f"`{c}`")) for c in texts})


def read_csv(
    spark: SparkSession, path: str, multiline: bool = True, need_id: bool = False
) -> DataFrame:
    """``scan_csv`` with missing cells blank; ordinals as ``id`` if it needs one and has none."""
    raw = scan_csv(spark, path, multiline)
    return blank_missing(with_ordinal(raw) if need_id and "id" not in raw.columns else raw)


def _columns(spark: SparkSession, path: str, fmt: str, multiline: bool) -> T.StructType | FileNotFoundError:
    try:
        raw = scan_csv(spark, path, multiline) if fmt == "csv" else _found(lambda: spark.read.format(fmt).load(path), path)
        return raw.schema
    except FileNotFoundError as error:
        return error


def _place_of(paths: dict[str, str]) -> Column:
    """The place that a row's file belongs to, from the end of its path; the longest end counts."""
    decoded = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    name = F.regexp_replace(decoded, r"/part-[^/]*$", "")
    place = F.lit(None).cast("string")
    for path, value in sorted(paths.items(), key=lambda item: len(urlparse(item[0]).path)):
        place = F.when(name.endswith(urlparse(path).path.rstrip("/")), F.lit(value)).otherwise(place)
    return place


def scan_places(
    spark: SparkSession,
    paths: dict[str, str],
    fmt: str = "csv",
    multiline: bool = True,
    need_id: bool = False,
    thresholds: bool = False,
) -> tuple[list[DataFrame], dict[str, FileNotFoundError]]:
    """Tables of many paths, each row with the ``_place`` that ``paths`` gives its path, and the
    missing paths. Files of one header are one scan; headers are read a few at a time. With
    ``thresholds`` rows also get the ``_first_threshold`` of their place where that decides."""
    listed = list(paths)
    found = dict(zip(listed, run_each(spark, lambda path: _columns(spark, path, fmt, multiline), listed)))
    missing = {path: x for path, x in found.items() if isinstance(x, FileNotFoundError)}
    alike: dict[str, list[str]] = {}
    for path, schema in found.items():
        if path not in missing:
            alike.setdefault(schema.json(), []).append(path)
    tables = []
    for own in alike.values():
        schema = found[own[0]]
        reader = spark.read.schema(schema)
        if fmt == "csv":
            reader = reader.option("header", True).option("multiLine", multiline).option("quote", '"').option("escape", '"')
        place = _place_of({path: paths[path] for path in own})
        scan = reader.format(fmt).load(own)
        if need_id and "id" not in scan.columns:
            table = with_ordinal(scan, place=place)
        else:
            table = scan.select("*", place.alias("_place"))
        if thresholds and _by_first_row(scan.columns):
            firsts = _first_of(scan, place)
            table = join_small(table, firsts, ["_place"])
        tables.append(blank_missing(table) if fmt == "csv" else table)
    return tables, missing


def read_table(
    spark: SparkSession, path: str, fmt: str = "csv", need_id: bool = False, multiline: bool = True
) -> DataFrame:
    if fmt == "csv":
        return read_csv(spark, path, multiline, need_id)
    raw = _found(lambda: spark.read.format(fmt).load(path), path)
    return with_ordinal(raw) if need_id and "id" not in raw.columns else raw


def csv_to_parquet(spark: SparkSession, source: str, target: str, multiline: bool = True) -> None:
    """Write a comma-separated file as Parquet files of even size, with ids if it has none.

    ``load_split`` reads ``{split}.parquet`` as it reads ``{split}.csv``, over many tasks.
    """
    read_csv(spark, source, multiline, need_id=True).hint("rebalance").write.parquet(target)


def with_ordinal(scan: DataFrame, out: str = "id", place: Column | None = None) -> DataFrame:
    """Ordinals 0..n-1 in the order of the files and of the rows in them.

    Takes a plain file scan. The size of each file block gives the first ordinal of the next,
    so rows are numbered where they are read. With a ``place`` of each row, which is added as
    ``_place``, the files of every place are numbered on their own.
    """
    placed = scan.select(
        "*",
        (F.lit(None).cast("string") if place is None else place).alias("_place"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_pos"),
    )
    own = W.partitionBy("_place") if place is not None else W
    before = own.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)
    blocks = (
        placed.groupBy("_place", "_file", "_block")
        .agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n", "_place")
    )
    ordinal = F.col("_start") + F.col("_pos") - F.col("_first")
    kept = scan.columns if place is None else [*scan.columns, "_place"]
    # One row per block of 128 MB or so: still a small side for a very large table.
    return join_small(placed, blocks, ["_file", "_block"], max_rows=1_000_000).select(
        *kept, ordinal.alias(out)
    )


def _as_split(df: DataFrame, lang: Column, split: Column, text_col: str, label_col: str, what: str) -> DataFrame:
    if text_col not in df.columns:
        raise KeyError(f"no text column {text_col} in {what}: {df.columns}")
    if label_col not in df.columns:
        df = df.withColumn(label_col, F.lit(UNLABELLED))
    return df.select(
        lang.alias("lang"),
        split.alias("split"),
        F.col("id").cast("string").alias("id"),
        F.col(text_col).cast("string").alias("comment_text"),
        F.col(label_col).cast("double").cast("int").alias("toxic"),
    )


def load_split(
    spark: SparkSession,
    folder: str,
    lang: str,
    split: str,
    text_col: str = "comment_text",
    label_col: str = "toxic",
    fmt: str = "csv",
    multiline: bool = True,
) -> DataFrame:
    """lang, split, id, text, label of one split; labels default to -1, ids to ordinals."""
    path = f"{folder}/{lang}/{split}.{fmt}"
    df = read_table(spark, path, fmt, need_id=True, multiline=multiline)
    return _as_split(df, F.lit(lang), F.lit(split), text_col, label_col, path)


def load_splits(
    spark: SparkSession,
    folder: str,
    languages: Iterable[str],
    splits: Iterable[str] = SPLITS,
    fmt: str = "csv",
    strict: bool = True,
    text_col: str = "comment_text",
    label_col: str = "toxic",
    multiline: bool = True,
) -> tuple[DataFrame, dict[str, str]]:
    """All splits of all languages, and the languages left out with the reason.

    A missing file raises when ``strict``; otherwise it leaves its whole language out, and if that
    holds for all of them the table is empty. Files with the same columns are one scan, whose rows
    know their language and split by their path.
    """
    names, wanted = list(splits), unique(languages)
    paths = {f"{folder}/{lang}/{split}.{fmt}": json.dumps([lang, split]) for lang in wanted for split in names}
    tables, lost = scan_places(spark, paths, fmt, multiline, need_id=True)
    missing: dict[str, str] = {}
    for path, error in lost.items():
        if strict:
            raise error
        missing.setdefault(json.loads(paths[path])[0], str(error))
    lang, split = (F.get_json_object("_place", f"$[{i}]") for i in (0, 1))
    parts = [_as_split(df, lang, split, text_col, label_col, folder) for df in tables]
    none = spark.createDataFrame([], "lang string, split string, id string, comment_text string, toxic int")
    loaded = reduce(DataFrame.unionByName, parts) if parts else none
    return loaded.filter(~F.col("lang").isin(list(missing))) if missing else loaded, missing


def unique(languages: Iterable[str]) -> list[str]:
    return list(dict.fromkeys(languages))


def choose_languages(
    explicit: list[str] | None = None,
    configured: list[str] | None = None,
    discovered: list[str] | None = None,
) -> list[str]:
    """The first non-empty list, without repeats."""
    for source in (explicit, configured, discovered):
        if source:
            return unique(source)
    raise ValueError("no languages given, configured or found")


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """``name`` of every entry of a folder; a written table counts as one entry."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    ).select("path")
    inside = F.regexp_replace("path", r"/part-[^/]*$", "")
    return listing.select(F.element_at(F.split(inside, "/"), -1).alias("name")).distinct()


def languages_of_names(names: DataFrame, run_tag: str) -> DataFrame:
    """``lang`` of the names ``{run_tag}_{lang}.csv``, sorted and unique."""
    start = f"{run_tag}_"
    matching = F.col("name").startswith(start) & F.col("name").endswith(".csv")
    lang = F.substring("name", len(start) + 1, F.length("name") - len(start) - len(".csv"))
    return (
        names.filter(matching)
        .select(lang.alias("lang"))
        .filter(F.col("lang") != "")
        .distinct()
        .orderBy("lang")
    )


def _first_of(scan: DataFrame, place: Column) -> DataFrame:
    """_place and ``_first_threshold``, the stored threshold in the first row of the place's files.

    Takes a plain file scan; the order is that of the files, their blocks and the rows in them.
    """
    at = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"),
    )
    told = F.struct(F.col("best_threshold").cast("string").alias("t"))
    marked = scan.select(place.alias("_place"), told.alias("_t"), at.alias("_at"))
    firsts = marked.groupBy("_place").agg(F.min_by("_t", "_at").alias("_f"))
    first = F.col("_f.t")
    return firsts.select("_place", F.when(~first.isin(MISSING), first).alias("_first_threshold"))


def resolve_predictions(df: DataFrame) -> DataFrame:
    """Columns under their role names: y_true, y_prob, y_pred, best_threshold, and the rest.

    Without a decision column, the stored threshold decides, or 0.5 if there is none: that of the
    file's first row where it is given as ``_first_threshold``, otherwise the row's own.
    """
    label = F.col(pick_column(df.columns, LABEL_NAMES)).cast("double").cast("int")
    score = F.col(pick_column(df.columns, SCORE_NAMES)).cast("double")
    decision = pick_column(df.columns, DECISION_NAMES, required=False)
    if "best_threshold" in df.columns:
        threshold = stored_threshold(F.col("best_threshold"))
    else:
        threshold = F.lit(DEFAULT_THRESHOLD)
    rule = stored_threshold(F.col("_first_threshold")) if "_first_threshold" in df.columns else threshold
    made = F.col(decision).cast("double").cast("int") if decision else binarize(score, rule)
    roles = {"y_true": label, "y_prob": score, "y_pred": made, "best_threshold": threshold}
    rest = [c for c in df.columns if c not in roles and c != "_first_threshold"]
    return df.select(*rest, *[c.alias(name) for name, c in roles.items()])


def inconsistent_thresholds(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Groups that hold more than one threshold, which a prediction file must not."""
    spread = predictions.groupBy(*keys).agg(
        F.min("best_threshold").alias("lowest"), F.max("best_threshold").alias("highest")
    )
    return spread.filter(~F.col("lowest").eqNullSafe(F.col("highest")))


def prediction_status(
    spark: SparkSession, folder: str, run_tag: str, languages: list[str], fmt: str = "csv"
) -> DataFrame:
    """language, status: whether the run has predictions for each of the languages."""
    wanted = spark.createDataFrame([(lang,) for lang in unique(languages)], "lang string")
    if fmt == "csv":
        found = languages_of_names(file_names(spark, folder), run_tag)
    else:
        table = read_table(spark, folder, fmt).filter(F.col("run_tag") == run_tag)
        found = table.select("lang").distinct()
    joined = wanted.join(found.withColumn("status", F.lit("found")), "lang", "left")
    return joined.select(
        F.col("lang").alias("language"), F.coalesce("status", F.lit("missing")).alias("status")
    )


def load_predictions(
    spark: SparkSession,
    folder: str,
    run_tag: str,
    languages: list[str] | None = None,
    fmt: str = "csv",
    multiline: bool = True,
    strict: bool = True,
) -> DataFrame:
    """Predictions of a run: run_tag, lang, id and the roles of every language file.

    Reads ``{folder}/{run_tag}_{lang}.csv``, or for other formats the table partitioned by
    run_tag and lang, of which only the wanted partitions are touched. A missing language
    raises unless ``strict`` is off. Files without line breaks inside cells are split over
    many tasks with ``multiline`` off.
    """
    if fmt != "csv":
        table = read_table(spark, folder, fmt)
        if _by_first_row(table.columns):
            place = F.to_json(F.struct("run_tag", "lang"))
            table = join_small(table.withColumn("_place", place), _first_of(table, place), ["_place"]).drop("_place")
        table = table.filter(F.col("run_tag") == run_tag)
        if languages:
            table = table.filter(F.col("lang").isin(unique(languages)))
            if strict:
                status = prediction_status(spark, folder, run_tag, languages, fmt)
                lost = [r["language"] for r in status.filter("status = 'missing'").collect()]
                if lost:
                    raise FileNotFoundError(f"no predictions of {run_tag} for {lost} under {folder}")
        return resolve_predictions(table)
    if not languages:
        found = languages_of_names(file_names(spark, folder), run_tag)
        languages = [r["lang"] for r in found.collect()]
    paths = {f"{folder}/{run_tag}_{lang}.csv": lang for lang in choose_languages(languages)}
    tables, lost = scan_places(spark, paths, "csv", multiline, need_id=True, thresholds=True)
    if strict and lost:
        raise next(iter(lost.values()))
    parts = [
        resolve_predictions(df.drop("run_tag", "lang").withColumnRenamed("_place", "lang"))
        .withColumn("id", F.col("id").cast("string"))
        .withColumn("run_tag", F.lit(run_tag))
        for df in tables
    ]
    if not parts:
        raise FileNotFoundError(f"no predictions of {run_tag} under {folder}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _by_first_row(columns: list[str]) -> bool:
    """Whether decisions are still to be made by a stored threshold."""
    return "best_threshold" in columns and pick_column(columns, DECISION_NAMES, required=False) is None


def translated_union(
    spark: SparkSession, manifest: dict[str, str], fmt: str = "csv", multiline: bool = True
) -> DataFrame:
    """The corpora of a manifest lang -> path under one another, tagged with their language."""
    tables, missing = scan_places(spark, {path: lang for lang, path in manifest.items()}, fmt, multiline)
    if missing:
        raise next(iter(missing.values()))
    parts = [df.drop("lang").withColumnRenamed("_place", "lang") for df in tables]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """A JSON object lang -> path; one entry per language."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")))
    return {r["key"]: r["value"] for r in pairs.collect()}


def scan_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the given columns of a set of Parquet shards."""
    return spark.read.parquet(path).select(*columns)

