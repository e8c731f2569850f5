"""Both ways of an operator with a size bound give the same rows, also for shared and NULL ids."""

import pytest
from pyspark.sql import functions as F

from commentlab.operators import errors, features, sequences
from commentlab.operators.metrics import macro_row, metrics_report
from commentlab.plans.evaluate import evaluate_run, evaluation_status
from commentlab.scale import bounded
from commentlab.sources.writers import write_prediction_files, write_predictions

ROWS = [
    ("en", 1, ["a", "b", "a"]), ("en", 1, ["b"]), (None, 1, ["a"]), (None, None, ["a", "c"]), ("", 1, ["a"]), ("en", 2, []),
    ("en", 1, ["b"]),
]


@pytest.fixture(scope="module")
def grams(spark):
    return spark.createDataFrame(ROWS, "lang string, id long, grams array<string>")


def test_pack_sequences(spark, grams, rows_of):
    words = spark.createDataFrame([("en", "a", 2), ("en", "b", 3), (None, "a", 4), ("", "a", 5)], "lang string, term string, word_id int")
    near = rows_of(sequences.pack_sequences(grams, "grams", words, length=4))
    far = rows_of(sequences.pack_sequences(grams, "grams", words, length=4, max_words=1))
    assert near == far and len(near) == len(ROWS)


def test_tfidf(spark, grams, rows_of, monkeypatch):
    terms = spark.createDataFrame(
        [("en", "a", 1, 5), ("en", "b", 3, 5), (None, "a", 2, 2), ("", "a", 1, 1)], "lang string, term string, df long, n_docs long"
    )

    def weights():
        out = features.tfidf_terms(grams, "grams", terms, ["lang", "id"])
        return rows_of(out.withColumn("weight", F.round("weight", 9)))

    near = weights()
    monkeypatch.setattr(features, "within", lambda *_: False)
    assert weights() == near and len(near) == 7


def test_error_categories(spark, rows_of, monkeypatch):
    rows = [("en", 1, 1, "FN", "a rude word"), ("en", 1, 1, "FN", "kind"), (None, 1, 1, "FN", "rude"), (None, None, 0, "FP", "\u015f\u015f\u015f")]
    table = spark.createDataFrame(rows, "lang string, id long, y_true int, error_type string, comment_text string")
    lexicon = spark.createDataFrame([("en", "profanity", "rude"), (None, "profanity", "rude")], "lang string, category string, word string")
    near = rows_of(errors.error_categories(table, lexicon))
    monkeypatch.setattr(errors, "bounded", lambda *_: None)
    assert rows_of(errors.error_categories(table, lexicon)) == near
    assert (None, "FP", "spelling_noise", 1) in near and (None, "FN", "profanity", 1) in near


def test_bounded_measures_rows(spark):
    assert bounded(spark.range(5), 5).count() == 5
    assert bounded(spark.range(6), 5) is None


def predictions(spark):
    rows = [("en", str(i), i % 2, 0.9 * (i % 2), i % 2, 0.5) for i in range(10)] + [("es", "x", -1, 0.1, 0, 0.5)]
    return spark.createDataFrame(rows, "lang string, id string, y_true int, y_prob double, y_pred int, best_threshold double")


def test_macro_leaves_out_languages_without_rows(spark):
    rows = predictions(spark).filter("lang = 'en'")
    report = {r["language"]: r for r in metrics_report(rows, languages=["en", "xx"]).collect()}
    assert report["macro"]["f1"] == 1.0 and report["xx"]["n_samples"] == 0
    table = metrics_report(rows, languages=["en", "xx"]).filter("section = 0")
    assert macro_row(table).first()["f1"] == 1.0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_missing_languages_show(spark, tmp_path, fmt):
    folder = str(tmp_path)
    if fmt == "csv":
        write_prediction_files(predictions(spark), folder, "run", ["en", "es"])
    else:
        write_predictions(predictions(spark), folder, "run")
    status = {tuple(r) for r in evaluation_status(spark, folder, "run", ["en", "es", "xx"], fmt).collect()}
    assert status == {("en", "found", 10, 0, 1), ("es", "found", 1, 1, 1), ("xx", "missing", 0, 0, 0)}
    report, _ = evaluate_run(spark, folder, "run", ["en", "xx"], fmt=fmt)
    assert {r["language"]: r["f1"] for r in report.collect()} == {"en": 1.0, "macro": 1.0, "micro": 1.0}
    with pytest.raises(FileNotFoundError):
        evaluate_run(spark, folder, "run", ["en", "xx"], fmt=fmt, strict=True)


def test_writers_refuse_unlisted_rows(spark, tmp_path):
    with pytest.raises(ValueError):
        write_prediction_files(predictions(spark), str(tmp_path), "run", ["en"])
