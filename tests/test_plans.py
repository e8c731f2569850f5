"""The three flows from folder to folder."""

import numpy as np
import pandas as pd
import pytest

from commentlab.plans.evaluate import evaluate_run
from commentlab.plans.external import score_folder
from commentlab.plans.train import train_folder
from commentlab.sources.readers import prediction_status, read_csv
from commentlab.sources.writers import load_models


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("processed")
    rng = np.random.default_rng(2)
    for lang in ("en", "es"):
        (root / lang).mkdir()
        for split, n in (("train", 120), ("val", 30), ("test", 30)):
            toxic = rng.integers(0, 2, n)
            text = [" ".join(rng.choice(["bad", "vile"] if t else ["good", "kind"], 3)) + ",\nok" for t in toxic]
            columns = {"comment_text": text, "toxic": toxic}
            pd.DataFrame(columns).to_csv(root / lang / f"{split}.csv", index=False)
    (root / "it").mkdir()
    return root


def by_suffix():
    def open_model():
        return lambda texts: {"toxicity": [0.9 if "bad" in t or "vile" in t else 0.1 for t in texts]}

    return open_model


def test_train_then_evaluate(spark, folder, tmp_path):
    run = train_folder(spark, str(folder), ["en", "es", "it"], f"{tmp_path}/p", f"{tmp_path}/m", max_iter=50)
    assert "not found" in run.errors["it"]
    report, _ = evaluate_run(spark, f"{tmp_path}/p", "baseline", output=f"{tmp_path}/metrics.csv")
    rows = {r["language"]: r for r in report.collect()}
    assert rows["micro"]["n_samples"] == 60 and rows["macro"]["f1"] == 1.0
    stored = read_csv(spark, f"{tmp_path}/m/baseline_results_summary.csv")
    assert {r["language"]: r["error"] is None for r in stored.collect()} == {"en": True, "es": True, "it": False}
    settings = spark.read.parquet(f"{tmp_path}/m/settings")
    assert set(load_models(settings, f"{tmp_path}/m")) == {"en", "es"}


def test_score_then_evaluate(spark, folder, tmp_path):
    run = score_folder(spark, str(folder), by_suffix(), ["en", "es"], "outside", f"{tmp_path}/p")
    assert run.macro.first()["roc_auc"] == 1.0
    report, sample = evaluate_run(spark, f"{tmp_path}/p", "outside", ["en", "es"])
    assert [r["f1"] for r in report.collect()] == [1.0] * 4 and sample.count() == 0
    report, _ = evaluate_run(spark, f"{tmp_path}/p", "outside", ["en", "tr"])
    assert [r["language"] for r in report.collect()] == ["en", "macro", "micro"]
    with pytest.raises(FileNotFoundError):
        evaluate_run(spark, f"{tmp_path}/p", "outside", ["en", "tr"], strict=True)
    status = prediction_status(spark, f"{tmp_path}/p", "outside", ["en", "tr"])
    assert {r["language"]: r["status"] for r in status.collect()} == {"en": "found", "tr": "missing"}
    with pytest.raises(FileNotFoundError):
        score_folder(spark, str(folder), by_suffix(), ["en", "it"], "outside")


def test_empty_folder_gives_a_summary_of_errors(spark, tmp_path):
    run = train_folder(spark, str(tmp_path), ["en", "es"], f"{tmp_path}/p", f"{tmp_path}/m")
    assert {r["language"]: "not found" in r["error"] for r in run.summary.collect()} == {"en": True, "es": True}
    stored = read_csv(spark, f"{tmp_path}/m/baseline_results_summary.csv")
    assert stored.count() == 2 and run.predictions.count() == 0
