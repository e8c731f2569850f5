"""Scoring by a supplied model."""

import pytest
from pyspark.sql import functions as F

from commentlab.operators.external import predict_batches, score_external
from commentlab.plans.external import run_external


def by_length():
    """Inside a function, so that the scorer travels to the workers by value."""

    def open_model():
        def predict(texts):
            assert 0 < len(texts) <= 32
            return {"toxicity": [min(len(t), 100) / 100 for t in texts], "other": None}

        return predict

    return open_model


open_lengths = by_length()


def test_batches_and_single_numbers():
    sizes = []

    def predict(texts):
        sizes.append(len(texts))
        return {"toxicity": 0.5 if len(texts) == 1 else [len(t) / 10 for t in texts]}

    assert predict_batches(predict, ["a", "bb", "ccc"], 2) == [0.1, 0.2, 0.5]
    assert sizes == [2, 1] and predict_batches(predict, [], 2) == []
    with pytest.raises(ValueError, match="scores for"):
        predict_batches(lambda texts: {"toxicity": [0.1]}, ["a", "b"])


def test_scores_keep_rows_and_columns(spark):
    df = spark.range(500).select("id", F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("comment_text"))
    df = df.unionByName(spark.createDataFrame([(1000, None)], "id long, comment_text string"))
    got = score_external(df.repartition(3), open_lengths)
    assert got.columns == ["id", "comment_text", "y_prob"]
    rows = {r["id"]: r["y_prob"] for r in got.collect()}
    assert rows == {**{i: (i % 90) / 100 for i in range(500)}, 1000: 0.0}
    assert got.filter("y_prob > 0.5").count() == sum(p > 0.5 for p in rows.values())


@pytest.fixture(scope="module")
def splits(spark):
    rows = []
    for i in range(60):
        for lang in ("en", "es", "un"):
            toxic = -1 if lang == "un" else i % 2
            split = ("train", "val", "test")[i % 3]
            rows.append((lang, split, str(i), "x" * (30 + 40 * (i % 2) + i % 5), toxic))
    return spark.createDataFrame(rows, "lang string, split string, id string, comment_text string, toxic int")


def test_run_tunes_decides_and_skips_unlabelled(splits):
    run = run_external(splits, open_lengths, ["en", "es", "un", "en"])
    assert run.predictions.count() == 60 and run.scored.filter("split = 'train'").count() == 0
    thresholds = {r["lang"]: round(r["best_threshold"], 6) for r in run.thresholds.collect()}
    assert thresholds == {"en": 0.35, "es": 0.35, "un": 0.1}
    assert {r["language"]: r["f1"] for r in run.metrics.collect()} == {"en": 1.0, "es": 1.0}
    assert run.macro.first()["f1"] == 1.0


def test_global_threshold(splits):
    run = run_external(splits, open_lengths, ["en"], threshold=0.99)
    assert {r[0] for r in run.predictions.select("y_pred").distinct().collect()} == {0}
    assert run.thresholds.first()["best_threshold"] == 0.99


def test_scoring_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "abcd"), (2, "")], "id int, comment_text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id int, comment_text string").parquet(f"{tmp_path}/in")
    run = (
        score_external(stream, open_lengths).writeStream.format("parquet")
        .option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    run.awaitTermination(60)
    got = {r["id"]: r["y_prob"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {1: 0.04, 2: 0.0}
