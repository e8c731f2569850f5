"""Training per language, and the whole run."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from commentlab.operators import model as mod
from commentlab.operators.features import vocabulary
from commentlab.operators.metrics import language_metrics
from commentlab.plans.train import train_and_predict
from commentlab.sources.writers import load_models, save_models

GOOD, BAD = ["nice", "kind", "thanks", "great"], ["fool", "idiot", "trash", "stupid"]


@pytest.fixture(scope="module")
def splits(spark):
    """Two languages that can be learnt, one with a single class, one without validation rows."""
    rng = np.random.default_rng(0)
    rows = []
    for lang, n in (("en", 300), ("es", 150), ("it", 60), ("tr", 60)):
        for i in range(n):
            toxic = int(rng.random() < 0.3) if lang != "it" else 0
            words = list(rng.choice(["the", "a", "some", "text", "here"], 6))
            words += list(rng.choice(BAD if toxic else GOOD, 2))
            split = "train" if i % 10 < 7 else "val" if i % 10 < 8 and lang != "tr" else "test"
            rows.append((lang, split, str(i), " ".join(rng.permutation(words)), toxic))
    return spark.createDataFrame(rows, "lang string, split string, id string, comment_text string, toxic int")


@pytest.fixture(scope="module")
def run(splits):
    return train_and_predict(splits, ["en", "es", "it", "tr", "zz"], max_iter=100)


def test_class_weights(spark):
    df = spark.createDataFrame([("a", 0)] * 3 + [("a", 1)] + [("b", 0)], "lang string, toxic int")
    got = {(r["lang"], r["toxic"]): r["weight"] for r in mod.class_weights(df, ["lang"]).collect()}
    assert got == {("a", 0): pytest.approx(4 / 6), ("a", 1): 2.0, ("b", 0): 1.0}


def newton(x, y, weight):
    """Minimises sum(weight * loss) + |w|^2 / 2 with a free intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(x1.shape[1])
    ridge[-1, -1] = 0
    w = np.zeros(x1.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        gradient = x1.T @ (weight * (p - y)) + ridge @ w
        hessian = (x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge
        w -= np.linalg.solve(hessian, gradient)
    return 1 / (1 + np.exp(-x1 @ w))


def test_fit_minimises_the_summed_loss(spark, splits):
    rows = splits.filter("lang = 'es' AND split = 'train'").withColumn("grams", F.split("comment_text", " "))
    n, n_pos = rows.count(), rows.filter("toxic = 1").count()
    model = mod.fit_language(rows.select("toxic", "grams"), vocabulary(rows, "grams"), n, n_pos, tol=1e-10)
    table = model.transform(rows).select("toxic", vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")).collect()
    y = np.array([r["toxic"] for r in table])
    weight = np.where(y == 1, n / (2 * n_pos), n / (2 * (n - n_pos)))
    want = newton(np.array([r["x"] for r in table]), y, weight)
    assert np.abs(want - np.array([r["p"][1] for r in table])).max() < 1e-5


def test_one_class_is_refused(spark):
    with pytest.raises(ValueError, match="both classes"):
        mod.fit_language(None, None, 10, 0)


def test_run_learns_and_isolates_failures(run):
    assert set(run.models) == {"en", "es", "tr"} and set(run.errors) == {"it", "zz"}
    rows = {r["language"]: r for r in run.summary.collect()}
    assert list(rows) == ["en", "es", "it", "tr", "zz"]
    assert rows["en"]["test_roc_auc"] > 0.95 and rows["es"]["test_f1"] > 0.8
    assert "both classes" in rows["it"]["error"] and rows["it"]["test_f1"] is None
    assert "no training rows" in rows["zz"]["error"]
    # Nothing to tune on: the default threshold, and all test rows are still there.
    assert rows["tr"]["best_threshold"] == 0.5 and rows["tr"]["val_f1"] is None
    assert rows["tr"]["test_roc_auc"] > 0.9
    assert run.predictions.filter("lang = 'tr'").count() == 18


def test_predictions_follow_thresholds(run):
    off = run.predictions.filter(F.col("y_pred") != (F.col("y_prob") >= F.col("best_threshold")).cast("int"))
    assert off.count() == 0
    metrics = {r["language"]: r for r in run.metrics.filter("split = 'test'").collect()}
    for r in language_metrics(run.predictions).collect():
        assert r["f1"] == pytest.approx(metrics[r["language"]]["f1"])


def test_refit_gives_the_same_scores(splits, run, rows_of):
    again = train_and_predict(splits.repartition(5), ["en"], max_iter=100)
    a = {(r["split"], r["id"]): r["y_prob"] for r in again.scored.collect()}
    b = {(r["split"], r["id"]): r["y_prob"] for r in run.scored.filter("lang = 'en'").collect()}
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-4 for k in a)


def test_models_survive_saving(spark, run, splits, tmp_path):
    settings = run.thresholds.withColumn("use_stopwords", F.lit(False))
    save_models(run.models, settings, str(tmp_path))
    loaded = load_models(spark.read.parquet(f"{tmp_path}/settings"), str(tmp_path))
    assert set(loaded) == set(run.models)
    rows = splits.filter("lang = 'en'").withColumn("grams", F.split("comment_text", " "))
    a = [r["y_prob"] for r in mod.score(rows, run.models["en"]).orderBy("id").collect()]
    assert a == [r["y_prob"] for r in mod.score(rows, loaded["en"]).orderBy("id").collect()]


def test_stopwords_and_fixed_threshold(splits):
    run = train_and_predict(splits, ["es"], use_stopwords=True, find_threshold=False, max_iter=20)
    assert run.thresholds.first()["best_threshold"] == 0.5
    assert run.summary.first()["test_roc_auc"] > 0.9


def test_nothing_trainable(splits):
    run = train_and_predict(splits, ["zz", "it"])
    errors = {r["language"]: r["error"] for r in run.summary.collect()}
    assert "no training rows" in errors["zz"] and "both classes" in errors["it"]
    assert run.predictions.count() == run.thresholds.count() == 0 and not run.models
    learnt = train_and_predict(splits, ["es"], max_iter=5)
    for name in ("scored", "thresholds", "predictions", "metrics", "summary"):
        assert getattr(run, name).dtypes == getattr(learnt, name).dtypes


def test_languages_that_failed_to_load(splits):
    run = train_and_predict(splits, ["es", "pt"], errors={"pt": "val.csv not found"}, max_iter=5)
    assert {r["language"]: r["error"] for r in run.summary.collect()} == {"es": None, "pt": "val.csv not found"}
