"""Threshold sweep against trying every threshold."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from commentlab.operators import threshold as t


def value(metric, y, p, thr):
    pred = p >= thr
    tp, fp, fn = (pred & (y == 1)).sum(), (pred & (y == 0)).sum(), (~pred & (y == 1)).sum()
    top, bottom = {"f1": (2 * tp, 2 * tp + fp + fn), "precision": (tp, tp + fp), "recall": (tp, tp + fn)}[metric]
    return top / bottom if bottom else 0.0


def best_of(metric, y, p, grid, start, default):
    scores = [value(metric, y, p, g) for g in grid]
    top = max(scores)
    return (grid[scores.index(top)], top) if top > start else (default, max(top, 0.0))


def frame(spark, groups):
    rows = [(g, int(a), float(b)) for g, (y, p) in groups.items() for a, b in zip(y, p)]
    return spark.createDataFrame(rows, "lang string, y_true int, y_prob double")


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(3)
    out = {}
    for name, n, digits in (("a", 400, 2), ("b", 50, 12), ("c", 5, 1), ("d", 200, 3)):
        y = rng.integers(0, 2, n)
        out[name] = (y, np.round(np.clip(rng.random(n) * 0.7 + 0.3 * y, 0, 1), digits))
    out["low"] = (np.array([1, 0, 1]), np.array([0.05, 0.3, 0.01]))
    out["negative"] = (np.array([0, 0]), np.array([0.5, 0.9]))
    return out


@pytest.mark.parametrize("metric", t.METRICS)
def test_best_threshold(spark, groups, metric):
    grid = np.linspace(0.1, 0.9, 81)
    got = {r["lang"]: r for r in t.best_threshold(frame(spark, groups), ["lang"], metric).collect()}
    for name, (y, p) in groups.items():
        thr, score = best_of(metric, y, p, grid, 0, 0.5)
        assert got[name]["best_threshold"] == pytest.approx(thr, abs=1e-12), name
        assert got[name]["best_score"] == pytest.approx(score, abs=1e-12), name


@pytest.mark.parametrize(("steps", "low", "high"), [(81, 0.1, 0.9), (11, 0.0, 1.0), (7, 0.2, 0.35), (1, 0.4, 0.9)])
def test_tune_threshold(spark, groups, steps, low, high):
    grid = np.linspace(low, high, steps)
    got = {r["lang"]: r[1] for r in t.tune_threshold(frame(spark, groups), ["lang"], steps, low, high).collect()}
    for name, (y, p) in groups.items():
        assert got[name] == pytest.approx(best_of("f1", y, p, grid, -1, 0.5)[0], abs=1e-12), name


def test_two_defaults(spark, groups):
    df = frame(spark, {"low": (np.array([1, 1]), np.array([0.05, 0.01]))})
    assert t.best_threshold(df, ["lang"]).first()[1:] == (0.5, 0.0)
    assert t.tune_threshold(df, ["lang"]).first()["best_threshold"] == 0.1


def test_grid_index_on_and_beside_grid_values(spark):
    grid = np.linspace(0.1, 0.9, 81)
    points = np.concatenate([grid, np.nextafter(grid, 0), np.nextafter(grid, 1), [-1, 0, 1, 5], np.arange(1001) / 1000])
    df = spark.createDataFrame([(float(x),) for x in points], "p double")
    got = df.select("p", t.grid_index(F.col("p"), 0.1, 0.9, 81)).collect()
    assert all(i == (grid <= p).sum() - 1 for p, i in got)


def test_unknown_metric(spark, groups):
    with pytest.raises(ValueError, match="unknown metric"):
        t.sweep(frame(spark, groups), ["lang"], "accuracy")


def test_groups_without_threshold_are_kept(spark, groups):
    df = frame(spark, groups)
    tuned = t.best_threshold(df.filter("lang = 'a'"), ["lang"])
    decided = t.apply_thresholds(df, tuned, ["lang"])
    assert decided.count() == df.count()
    assert {r[0] for r in decided.filter("lang <> 'a'").select("best_threshold").distinct().collect()} == {0.5}
    full = t.for_languages(tuned, ["a", "zz"], 0.1)
    assert {r["lang"]: r["best_threshold"] for r in full.collect()}["zz"] == 0.1


def test_unlabelled_rows_do_not_count(spark):
    rows = [("a", 1, 0.8), ("a", 0, 0.3), ("a", -1, 0.85), ("a", -1, 0.9)]
    df = spark.createDataFrame(rows, "lang string, y_true int, y_prob double")
    assert t.best_threshold(df, ["lang"]).first()["best_score"] == 1.0
