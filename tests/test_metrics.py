"""Metrics against published values and toy tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from commentlab.operators import metrics as m

# Confusion counts (lang, tp, fp, fn, tn) behind the published tables.
BASELINE = [
    ("en", 1583, 574, 555, 19643), ("es", 27, 20, 15, 189),
    ("it", 27, 28, 22, 174), ("tr", 21, 4, 11, 264),
]
PRETRAINED = [
    ("en", 1760, 375, 378, 19842), ("es", 20, 3, 22, 206),
    ("it", 43, 62, 6, 140), ("tr", 30, 11, 2, 257),
]
# N, positive rate, F1, precision, recall, accuracy as published.
PUBLISHED = {
    "baseline": {
        "en": (22355, 0.0956, 0.7371, 0.7339, 0.7404, 0.9495),
        "es": (251, 0.1673, 0.6067, 0.5745, 0.6429, 0.8606),
        "it": (251, 0.1952, 0.5192, 0.4909, 0.5510, 0.8008),
        "tr": (300, 0.1067, 0.7368, 0.8400, 0.6562, 0.9500),
        "macro": (23157, 0.1412, 0.6500, 0.6598, 0.6476, 0.8902),
        "micro": (23157, 0.0976, 0.7296, 0.7259, 0.7333, 0.9469),
    },
    "pretrained": {
        "en": (22355, 0.0956, 0.8238, 0.8244, 0.8232, 0.9663),
        "es": (251, 0.1673, 0.6154, 0.8696, 0.4762, 0.9004),
        "it": (251, 0.1952, 0.5584, 0.4095, 0.8776, 0.7291),
        "tr": (300, 0.1067, 0.8219, 0.7317, 0.9375, 0.9567),
        "macro": (23157, 0.1412, 0.7049, 0.7088, 0.7786, 0.8881),
        "micro": (23157, 0.0976, 0.8118, 0.8043, 0.8195, 0.9629),
    },
}


def expand(spark, counts, run):
    cells = [
        (run, lang, y, p, n)
        for lang, tp, fp, fn, tn in counts
        for y, p, n in ((1, 1, tp), (0, 1, fp), (1, 0, fn), (0, 0, tn))
    ]
    df = spark.createDataFrame(cells, "run_tag string, lang string, y_true int, y_pred int, n int")
    each = F.explode(F.sequence(F.lit(1), F.col("n")))
    return df.withColumn("_i", each).withColumn("y_prob", F.col("y_pred") * 0.8 + 0.1).drop("n", "_i")


@pytest.fixture(scope="module")
def runs(spark):
    return expand(spark, BASELINE, "baseline").unionByName(expand(spark, PRETRAINED, "pretrained"))


def test_report_reproduces_published_tables(runs):
    report = {(r["run_tag"], r["language"]): r for r in m.metrics_report(runs, ["run_tag"]).collect()}
    assert len(report) == 12
    for run, table in PUBLISHED.items():
        for lang, (n, *rates) in table.items():
            row = report[run, lang]
            assert row["n_samples"] == n
            names = ("positive_rate", "f1", "precision", "recall", "accuracy")
            assert [round(row[c], 4) for c in names] == pytest.approx(rates, abs=1.01e-4)
    assert report["baseline", "macro"]["true_positives"] is None
    assert report["baseline", "micro"]["true_positives"] == 1583 + 27 + 27 + 21


def test_report_order(runs):
    one = m.metrics_report(runs.filter("run_tag = 'baseline'").drop("run_tag"))
    assert [r["language"] for r in one.collect()] == ["en", "es", "it", "tr", "macro", "micro"]


def test_parts_agree_with_report(runs):
    rows = runs.filter("run_tag = 'baseline'").drop("run_tag")
    per = m.language_metrics(rows)
    report = {r["language"]: r for r in m.metrics_report(rows).collect()}
    for part in (per, m.macro_row(per), m.micro_row(rows)):
        for r in part.collect():
            for c in ("n_samples", *m.RATES, *m.ERROR_RATES, *m.COUNTS):
                want = report[r["language"]][c]
                assert r[c] == (want if want is None else pytest.approx(want))


def toy(spark, rows):
    return spark.createDataFrame(rows, "lang string, y_true int, y_prob double, y_pred int")


def test_counts_add_up_and_rates_default_to_zero(spark):
    rows = [("a", 0, 0.1, 0), ("a", 0, 0.2, 0), ("b", 1, 0.9, 0)]
    got = {r["language"]: r for r in m.language_metrics(toy(spark, rows)).collect()}
    a, b = got["a"], got["b"]
    assert (a["roc_auc"], a["f1"], a["fnr"], a["specificity"]) == (None, 0.0, 0.0, 1.0)
    assert (b["precision"], b["recall"], b["fnr"], b["specificity"]) == (0.0, 0.0, 1.0, 0.0)
    for r in got.values():
        assert sum(r[c] for c in m.COUNTS) == r["n_samples"]


def test_empty_language(spark):
    got = m.language_metrics(toy(spark, [("a", 1, 0.9, 1)]), languages=["a", "z", "z"]).collect()
    z = next(r for r in got if r["language"] == "z")
    assert len(got) == 2 and (z["n_samples"], z["positive_rate"], z["roc_auc"]) == (0, 0.0, None)


def test_macro_skips_or_keeps_undefined(spark):
    rows = [("a", 1, 0.9, 1), ("a", 0, 0.1, 0), ("b", 0, 0.1, 0)]
    per = m.language_metrics(toy(spark, rows))
    assert m.macro_row(per).first()["roc_auc"] == 1.0
    assert m.macro_row(per, skip_undefined=False).first()["roc_auc"] is None
    assert m.macro_row(per).first()["n_samples"] == 3


def test_labels_outside_zero_one(spark):
    rows = toy(spark, [("a", 1, 0.9, 1), ("a", -1, 0.1, 0), ("a", None, 0.1, 0), ("b", -1, 0.4, 0)])
    assert m.language_metrics(rows).first()["n_samples"] == 1
    invalid = {r["lang"]: r["n_invalid"] for r in m.invalid_labels(rows, ["lang"]).collect()}
    assert invalid == {"a": 2, "b": 1}
    labelled = {r["lang"]: r["n_labelled"] for r in m.labelled_groups(rows, ["lang"]).collect()}
    assert labelled == {"a": 1}
    with pytest.raises(PySparkException, match="label or decision outside 0/1"):
        m.language_metrics(rows, strict=True).collect()


def test_gold_join_and_unmatched(spark, rows_of):
    pred = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.6), ("b", 1, 0.7)], "lang string, id int, y_prob double")
    gold = spark.createDataFrame([("a", 1, 1), ("b", 1, 0), ("b", 9, 0)], "lang string, id int, y_true int")
    assert rows_of(m.join_gold(pred, gold)) == [("a", 1, 0.5, 1), ("b", 1, 0.7, 0)]
    assert rows_of(m.unmatched_gold(pred, gold)) == [("a", 2, "prediction"), ("b", 9, "gold")]


def test_run_compare(runs):
    report = m.metrics_report(runs, ["run_tag"])
    got = {r["language"]: r for r in m.run_compare(report, "baseline", "pretrained").collect()}
    assert got["tr"]["delta_f1"] == pytest.approx(0.8219 - 0.7368, abs=2e-4)
    assert got["macro"]["other_f1"] == pytest.approx(0.7049, abs=1e-4)
