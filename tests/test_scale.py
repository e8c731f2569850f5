"""Checked joins, ranked selections and intermediate tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from commentlab import scale, session


@pytest.fixture(scope="module")
def big(spark):
    # Key 0 holds most rows.
    return spark.range(3000).select(
        F.when(F.col("id") == 5, None)
        .when(F.col("id") % 10 < 7, 0)
        .otherwise(F.col("id") % 50)
        .cast("int")
        .alias("k"),
        "id",
    )


@pytest.fixture(scope="module")
def small(spark):
    rows = [(k, f"v{k}") for k in range(0, 40, 2)]
    return spark.createDataFrame([*rows, (None, "none")], "k int, v string")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_small_both_ways(big, small, rows_of, how):
    values = {r["k"]: r["v"] for r in small.collect()}
    want = []
    for r in big.collect():
        found = r["k"] in values
        if how in ("inner", "left") and (found or how == "left"):
            want.append((r["k"], r["id"], values.get(r["k"])))
        elif how == "left_semi" and found or how == "left_anti" and not found:
            want.append((r["k"], r["id"]))
    want.sort(key=repr)
    assert rows_of(scale.join_small(big, small, ["k"], how)) == want
    assert rows_of(scale.join_small(big, small, ["k"], how, max_rows=3)) == want


def test_join_small_broadcasts_only_what_fits(big, small):
    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(scale.join_small(big, small, ["k"]))
    assert "_salt" in plan(scale.join_small(big, small, ["k"], max_rows=3))


def test_top_k_large_and_small(big, rows_of):
    order = [F.desc("id")]
    kept = {}
    for r in big.collect():
        kept.setdefault(r["k"], []).append(r["id"])
    for k in (3, 1500):
        want = sorted(((g, i) for g, ids in kept.items() for i in sorted(ids)[-k:]), key=repr)
        assert rows_of(scale.top_k(big, ["k"], order, k)) == want


def test_top_k_prunes_before_the_shuffle(big):
    plan = scale.top_k(big, ["k"], [F.desc("id")], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_spread_leaves_wide_inputs_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert scale.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=cores + 3)
    assert scale.spread(wide) is wide


def test_materialise_keeps_schema_and_rows(spark, rows_of):
    df = spark.createDataFrame([("07", 1, None), ("a", 2, 0.5)], "lang string, n int, x double")
    for partition_by in (None, ["lang"]):
        again = session.materialise(df, "t", partition_by)
        assert again.schema.simpleString() == df.schema.simpleString()
        assert rows_of(again) == rows_of(df)


def fake_session(master, shared=None):
    conf = SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": shared}[key] or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_work_dir_follows_the_session():
    assert session.work_dir(fake_session("spark://host", "hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.work_dir(fake_session("spark://host"))
    assert session.work_dir(fake_session("local[2]")) == session.work_dir(fake_session("local[2]"))
