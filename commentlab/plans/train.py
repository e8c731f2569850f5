"""Train a model per language, tune its threshold, predict the test split and summarise."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.columns import DEFAULT_THRESHOLD
from commentlab.functions.text import analyze, clean_text, remove_stopwords, stopword_table
from commentlab.operators.features import (
    MAX_DF,
    MAX_FEATURES,
    MIN_DF,
    NO_TERMS,
    counted,
    indexed,
    vectors,
    vocabulary_of,
)
from commentlab.operators.metrics import language_metrics
from commentlab.operators.model import (
    MAX_ITER,
    LanguageModel,
    check_classes,
    fit_vectors,
    language_model,
    model_tables,
    scores,
)
from commentlab.operators.threshold import apply_thresholds, best_threshold, for_languages
from commentlab.scale import literal_table, spread
from commentlab.session import materialise, run_each
from commentlab.sources.readers import load_splits, unique
from commentlab.sources.writers import (
    save_models,
    write_prediction_files,
    write_predictions,
    write_table,
)

# The languages and the run name used when none are given.
LANGUAGES = ["en", "es", "fr", "de", "it", "pt", "ru", "tr"]
RUN_TAG = "baseline"
TOLERANCE = 1e-6
SUMMARY = [
    "val_roc_auc", "val_f1", "val_precision", "val_recall",
    "test_roc_auc", "test_f1", "test_precision", "test_recall",
]


@dataclass
class Run:
    models: dict[str, LanguageModel]
    errors: dict[str, str]
    scored: DataFrame
    thresholds: DataFrame
    predictions: DataFrame
    metrics: DataFrame
    summary: DataFrame


def prepare(splits: DataFrame, use_stopwords: bool, languages: list[str]) -> DataFrame:
    """lang, split, id, toxic and the counted terms of each text, analysed once for the whole run.

    Written partitioned, so that each language and split is read alone.
    """
    cleaned = spread(splits).withColumn("comment_text", clean_text(F.col("comment_text")))
    if use_stopwords:
        words = stopword_table(splits.sparkSession, languages)
        cleaned = remove_stopwords(cleaned, "comment_text", words)
    words = analyze(cleaned, "comment_text", "words", pairs=False)
    return counted(words, "words", ["lang", "split", "id", "toxic"], ["lang", "split"], pairs=True)


def evaluate(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Metrics per (split, language) at the given thresholds, from one pass."""
    return language_metrics(apply_thresholds(scored, thresholds, ["lang"]), ["split"])


def fit_all(
    stored: DataFrame,
    languages: list[str],
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
    max_iter: int = MAX_ITER,
    parallelism: int = 4,
) -> tuple[dict[str, LanguageModel], dict[str, str]]:
    """Models by language, and why the others failed.

    Vocabulary, class counts and vectors of all languages come from one job each; the fits are
    distributed jobs of their own, a few of them under way at a time.
    """
    train = stored.filter((F.col("split") == "train") & F.col("lang").isin(languages))
    terms = indexed(vocabulary_of(train, min_df, max_df, max_features))
    found = terms.groupBy("lang").agg(F.count("*").alias("n_terms"))
    classes = train.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("n_pos"))
    counts = {
        r["lang"]: (r["n"], r["n_pos"], r["n_terms"] or 0)
        for r in classes.join(found, "lang", "left").collect()
    }
    rows = vectors(train, terms, ["lang", "toxic"])

    def fit(lang: str) -> LanguageModel:
        n, n_pos, n_terms = counts.get(lang, (0, 0, 0))
        if n == 0:
            raise FileNotFoundError(f"no training rows for {lang}")
        check_classes(n, n_pos)
        if n_terms == 0:
            raise ValueError(NO_TERMS)
        own = F.col("lang") == lang
        fitted = fit_vectors(rows.filter(own).select("toxic", "features"), n, n_pos, "toxic", max_iter, TOLERANCE)
        return language_model(terms.filter(own), fitted)

    def attempt(lang: str) -> tuple[str, LanguageModel | None, str | None]:
        try:
            return lang, fit(lang), None
        except Exception as error:  # one language's failure must not stop the others
            return lang, None, str(error)

    done = run_each(stored.sparkSession, attempt, languages, parallelism)
    return (
        {lang: model for lang, model, _ in done if model is not None},
        {lang: error for lang, _, error in done if error is not None},
    )


def score_splits(
    stored: DataFrame, models: dict[str, LanguageModel], splits: tuple[str, ...] = ("val", "test")
) -> DataFrame:
    """lang, split, id, y_true, y_prob of the given splits under each language's model, in one pass."""
    terms, intercepts = model_tables(models, stored)
    wanted = stored.filter(F.col("split").isin(*splits))
    found = scores(wanted, materialise(terms, "model_terms"), intercepts, ["lang", "split", "id", "toxic"])
    return found.withColumnRenamed("toxic", "y_true")


def summarise(
    metrics: DataFrame, thresholds: DataFrame, languages: list[str], errors: dict[str, str]
) -> DataFrame:
    """One row per language: validation and test metrics to 4 decimals, or the error."""
    wide = metrics.groupBy("language").pivot("split", ["val", "test"]).agg(
        *[F.first(c).alias(c) for c in ("roc_auc", "f1", "precision", "recall")]
    )
    status = literal_table(
        metrics.sparkSession,
        [(lang, errors.get(lang)) for lang in languages],
        "language string, error string",
    )
    tuned = thresholds.withColumnRenamed("lang", "language")
    joined = status.join(wide, "language", "left").join(tuned, "language", "left")
    rounded = [F.bround(c, 4).alias(c) for c in [*SUMMARY, "best_threshold"]]
    return joined.select("language", *rounded, "error").orderBy("language")


def train_and_predict(
    splits: DataFrame,
    languages: list[str],
    use_stopwords: bool = False,
    errors: dict[str, str] | None = None,
    find_threshold: bool = True,
    **fit_options,
) -> Run:
    """The whole run over (lang, split, id, comment_text, toxic) rows.

    ``errors`` names languages that already failed to load. With ``find_threshold`` off every
    language is cut at 0.5. Where no language can be trained, the summary has an error for each
    and the other tables have their columns and no rows.
    """
    languages = unique(languages)
    failed = dict(errors or {})
    todo = [lang for lang in languages if lang not in failed]
    stored = prepare(splits.filter(F.col("lang").isin(todo)), use_stopwords, todo)
    models, unfit = fit_all(stored, todo, **fit_options)
    failed |= unfit
    scored = materialise(score_splits(stored, models), "scored", ["lang", "split"])
    val = scored.filter(F.col("split") == "val")
    if find_threshold:
        thresholds = for_languages(best_threshold(val, ["lang"]), list(models))
    else:
        rows = [(lang, DEFAULT_THRESHOLD) for lang in models]
        thresholds = literal_table(splits.sparkSession, rows, "lang string, best_threshold double")
    thresholds = materialise(thresholds, "thresholds")
    metrics = materialise(evaluate(scored, thresholds), "metrics")
    predictions = apply_thresholds(scored.filter(F.col("split") == "test"), thresholds, ["lang"])
    summary = summarise(metrics, thresholds, languages, failed)
    return Run(models, failed, scored, thresholds, predictions, metrics, summary)


def train_folder(
    spark: SparkSession,
    data_dir: str,
    languages: list[str] | None = None,
    pred_dir: str | None = None,
    model_dir: str | None = None,
    run_tag: str = RUN_TAG,
    use_stopwords: bool = False,
    fmt: str = "csv",
    multiline: bool = True,
    **options,
) -> Run:
    """Train from ``{data_dir}/{lang}/{split}.{fmt}`` and write what has a place to go.

    A language with a missing file, or one that cannot be fitted, shows up in the summary with
    its error. Predictions go to one file per language, or with another ``fmt`` to a
    partitioned table; models, thresholds and the summary go to ``model_dir``. With
    ``multiline`` off, files without line breaks in cells are split over many tasks.
    """
    languages = unique(languages or LANGUAGES)
    splits, missing = load_splits(
        spark, data_dir, languages, fmt=fmt, strict=False, multiline=multiline
    )
    run = train_and_predict(splits, languages, use_stopwords, missing, **options)
    if pred_dir and fmt == "csv":
        write_prediction_files(run.predictions, pred_dir, run_tag, list(run.models))
    elif pred_dir:
        write_predictions(run.predictions, pred_dir, run_tag, fmt)
    if model_dir:
        settings = run.thresholds.withColumn("use_stopwords", F.lit(use_stopwords))
        save_models(run.models, settings, model_dir)
        write_table(run.summary, f"{model_dir}/{run_tag}_results_summary.csv")
    return run
