"""Exact grouped ROC-AUC against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlab.operators.auc import _pair_sum, roc_auc, subgroup_auc


def brute(labels, scores):
    pos = [s for y, s in zip(labels, scores) if y == 1]
    neg = [s for y, s in zip(labels, scores) if y != 1]
    if not pos or not neg:
        return None
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, y_true int, y_prob double")


def by_lang(df):
    return {r["lang"]: r["roc_auc"] for r in roc_auc(df, ["lang"]).collect()}


@pytest.mark.parametrize("digits", [1, 3, 12])
def test_matches_brute_force(spark, digits):
    rng = np.random.default_rng(digits)
    rows = []
    # One group holds most rows, and a third of its scores are the same.
    for lang, n in (("en", 900), ("es", 60), ("it", 7)):
        y = rng.integers(0, 2, n)
        p = np.where(rng.random(n) < 0.33, 0.0, np.round(rng.random(n) * 0.6 + 0.3 * y, digits))
        rows += [(lang, int(a), float(b)) for a, b in zip(y, p)]
    for parts in (1, 13):
        got = by_lang(frame(spark, rows).repartition(parts))
        for lang in ("en", "es", "it"):
            own = [(y, p) for g, y, p in rows if g == lang]
            assert got[lang] == pytest.approx(brute(*zip(*own)), abs=1e-12)


def test_ties_and_mirror(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 0, 0.2)]
    assert by_lang(frame(spark, rows)) == {"a": 0.75}
    mirrored = frame(spark, rows).withColumn("y_prob", 1 - F.col("y_prob"))
    assert by_lang(mirrored)["a"] == pytest.approx(0.25)


def test_undefined_groups(spark):
    rows = [
        ("one class", 0, 0.1), ("one class", 0, 0.2),
        ("nan", 1, float("nan")), ("nan", 0, 0.2),
        ("null", 1, None), ("null", 0, 0.2),
        ("inf", 1, float("inf")), ("inf", 0, 0.2),
        ("fine", 1, 0.3), ("fine", 0, -5.0),
    ]
    got = by_lang(frame(spark, rows))
    assert got.pop("fine") == 1.0
    assert set(got.values()) == {None}


def test_null_group_is_a_group(spark):
    assert by_lang(frame(spark, [(None, 1, 0.9), (None, 0, 0.1), ("x", 1, 0.1), ("x", 0, 0.9)])) == {
        None: 1.0, "x": 0.0,
    }


def test_many_parts_and_batches(spark):
    n = 30_000
    df = spark.range(n).select(
        F.lit("en").alias("lang"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        ((F.col("id") * 7919) % n).cast("double").alias("y_prob"),
    )
    labels = (np.arange(n) % 3 == 0).astype(int)
    scores = (np.arange(n) * 7919) % n
    ranks = np.argsort(np.argsort(scores)) + 1
    p = labels.sum()
    want = (ranks[labels == 1].sum() - p * (p + 1) / 2) / (p * (n - p))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert by_lang(df)["en"] == pytest.approx(want, abs=1e-12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_pair_sum_beyond_int64():
    pos, neg = np.array([3_000_000_000, 5]), np.array([4_000_000_000, 7])
    want = 3_000_000_000 * (2 * 10**10 + 4_000_000_000) + 5 * (2 * (10**10 + 4_000_000_000) + 7)
    assert _pair_sum(pos, neg, 10**10) == want


def test_subgroups_match_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(y), float(round(s, 2)), float(a), float(b))
        for y, s, a, b in zip(
            rng.integers(0, 2, 300), rng.random(300), rng.random(300), rng.random(300)
        )
    ]
    df = spark.createDataFrame(rows, "y_true int, y_prob double, a double, b double")
    got = subgroup_auc(df, {"a": F.col("a") >= 0.5, "b": F.col("b") >= 0.9})
    for r in got.collect():
        at, cut = (2, 0.5) if r["subgroup"] == "a" else (3, 0.9)
        inside = [x for x in rows if x[at] >= cut]
        outside = [x for x in rows if x[at] < cut]
        bpsn = [x for x in outside if x[0] == 1] + [x for x in inside if x[0] == 0]
        bnsp = [x for x in inside if x[0] == 1] + [x for x in outside if x[0] == 0]
        for name, part in (("subgroup_auc", inside), ("bpsn_auc", bpsn), ("bnsp_auc", bnsp)):
            assert r[name] == pytest.approx(brute([x[0] for x in part], [x[1] for x in part]))
        assert r["subgroup_size"] == len(inside)
