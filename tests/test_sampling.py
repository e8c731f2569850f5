"""Splits, samples and surrogate ids."""

import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from commentlab.functions import columns
from commentlab.functions.columns import surrogate_id
from commentlab.operators import sampling as s
from commentlab.operators.errors import error_categories, tag_errors, union_errors
from commentlab.scale import literal_table


@pytest.fixture(scope="module")
def skewed(spark):
    """One language holds nearly all rows; one holds three."""
    lang = F.when(F.col("id") < 3, "tr").when(F.col("id") < 40, "es").otherwise("en")
    return spark.range(5000).select(lang.alias("lang"), "id", (F.col("id") % 9 == 0).cast("int").alias("toxic"))


def digest(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest()


def test_split_is_exact_and_by_hash(skewed, rows_of):
    got = s.split_rows(skewed, ["lang"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["lang"], []).append((digest(r["id"], 42), r["split"]))
    assert len(got) == 5000
    for rows in groups.values():
        n = len(rows)
        train, val = n * 80 // 100, n * 90 // 100
        want = ["train"] * train + ["val"] * (val - train) + ["test"] * (n - val)
        assert [name for _, name in sorted(rows)] == want
    again = s.split_rows(skewed.repartition(7, "id"), ["lang"])
    assert rows_of(again) == sorted((tuple(r) for r in got), key=repr)


def test_other_shares_and_seed(skewed):
    sizes = {
        r["split"]: r["count"]
        for r in s.split_rows(skewed.filter("lang = 'en'"), ["lang"], seed=7, train=60, val=40).groupBy("split").count().collect()
    }
    assert sizes == {"train": 2976, "val": 1984}


def test_published_sample_size(spark):
    sizes = literal_table(spark, [(0, 202165), (1, 21384)], "toxic int, n int")
    rows = sizes.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")
    quotas = {r["toxic"]: r["quota"] for r in s.strata_quotas(rows, ["toxic"], 20_000, 0.05).collect()}
    assert sum(quotas.values()) == 11178
    assert quotas[0] in (10108, 10109) and quotas[1] in (1069, 1070)


def test_stratified_sample_takes_lowest_hashes(skewed):
    got = s.stratified_sample(skewed, ["toxic"], cap=100, fraction=0.5).collect()
    assert len(got) == 100
    n = {0: 4444, 1: 556}
    for label, size in n.items():
        ids = sorted((digest(r["id"], 42), r["id"]) for r in got if r["toxic"] == label)
        assert abs(len(ids) - 100 * size / 5000) < 1
        every = sorted((digest(r["id"], 42), r["id"]) for r in skewed.filter(F.col("toxic") == label).collect())
        assert ids == every[: len(ids)]


def test_rows_without_language_are_kept(spark):
    df = spark.range(100).select("id", F.when(F.col("id") % 4 > 0, "en").alias("lang"))
    sizes = {(r["lang"], r["split"]): r["count"] for r in s.split_rows(df, ["lang"]).groupBy("lang", "split").count().collect()}
    assert sizes == {
        (None, "train"): 20, (None, "val"): 2, (None, "test"): 3,
        ("en", "train"): 60, ("en", "val"): 7, ("en", "test"): 8,
    }
    assert s.stratified_sample(df, ["lang"], fraction=0.2).filter("lang IS NULL").count() == 5
    ids = surrogate_id(df.withColumnRenamed("id", "pos"), ["lang"], "pos")
    assert ids.count() == 100 and ids.filter("lang IS NULL").agg(F.max("id")).first()[0] == 24


def test_empty_quota(spark):
    rows = literal_table(spark, [(i, 0) for i in range(99)] + [(99, 1)], "id int, toxic int")
    got = s.stratified_sample(rows, ["toxic"], cap=10, fraction=0.05).collect()
    assert [r["toxic"] for r in got] == [0] * 5


@pytest.mark.parametrize("pos", ["id * 5 + 1", "xxhash64(id)", "if(id < 5999, id, 1L << 62)"])
def test_surrogate_ids_are_dense(spark, pos):
    lang = F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b")
    df = spark.range(6000, numPartitions=5).select(F.expr(pos).alias("pos"), lang.alias("lang"))
    groups = {}
    for r in surrogate_id(df, ["lang"], "pos").collect():
        groups.setdefault(r["lang"], []).append((r["pos"], r["id"]))
    assert len(groups) == 3
    assert all([i for _, i in sorted(g)] == list(range(2000)) for g in groups.values())


def test_null_and_shared_ids(spark):
    """A NULL id is placed by its row; copies of an id stay together unless a tie key parts them."""
    rows = spark.range(1000).select(
        F.when(F.col("id") % 2 == 0, F.lit(7)).alias("id"), F.col("id").alias("n"), F.lit("x").alias("lang")
    )
    nulls = s.split_rows(rows.filter("id IS NULL"), ["lang"])
    assert {r["split"]: r["count"] for r in nulls.groupBy("split").count().collect()} == {"train": 400, "val": 50, "test": 50}
    copies = s.split_rows(rows.filter("id = 7"), ["lang"])
    assert copies.select("split").distinct().count() == 1 and copies.count() == 500
    parted = s.split_rows(rows, ["lang"], tie=["n"])
    assert {r["split"]: r["count"] for r in parted.groupBy("split").count().collect()} == {"train": 800, "val": 100, "test": 100}
    assert s.stratified_sample(rows, ["lang"], cap=77, fraction=0.5, tie=["n"]).count() == 77


@pytest.fixture(scope="module")
def decided(spark):
    return spark.range(600).select(
        F.when(F.col("id") < 500, "en").otherwise("es").alias("lang"),
        "id",
        (F.col("id") % 2).cast("int").alias("y_true"),
        (F.col("id") % 3 == 0).cast("int").alias("y_pred"),
        (F.col("id") / 600).alias("y_prob"),
        F.lit(0.5).alias("best_threshold"),
    )


def test_error_sample_caps_each_type(decided, rows_of):
    errors = tag_errors(decided)
    sample = s.error_sample(errors, ["lang"])
    counts = {(r[0], r[1]): r[2] for r in sample.groupBy("lang", "error_type").count().collect()}
    everything = {(r[0], r[1]): r[2] for r in errors.groupBy("lang", "error_type").count().collect()}
    assert counts == {k: min(50, n) for k, n in everything.items()}
    assert rows_of(s.error_sample(errors.repartition(9), ["lang"])) == rows_of(sample)


def test_errors_and_their_union_agree(decided, rows_of):
    assert rows_of(tag_errors(decided)) == rows_of(union_errors(decided))


def test_widest_margins(decided):
    top = s.error_topk(tag_errors(decided), ["lang"], k=6)
    for lang in ("en", "es"):
        own = [r["margin"] for r in tag_errors(decided).withColumn("margin", F.abs(F.col("y_prob") - 0.5)).filter(F.col("lang") == lang).collect()]
        got = [r["margin"] for r in top.filter(F.col("lang") == lang).collect()]
        assert sorted(got) == sorted(own)[-6:]


def test_error_categories_both_ways(spark, rows_of, monkeypatch):
    errors = literal_table(
        spark,
        [
            ("en", 1, 1, "FN", "you Fool and fool"), ("en", 2, 1, "FN", "f00l sooo bad"),
            ("en", 3, 0, "FP", "proud gay man"), ("it", 4, 0, "FP", "fool"),
        ],
        "lang string, id int, y_true int, error_type string, comment_text string",
    )
    lexicon = literal_table(
        spark, [("en", "profanity", "fool"), ("en", "profanity", "idiot"), ("en", "identity_mention", "gay")],
        "lang string, category string, word string",
    )
    want = sorted(
        [
            ("en", "FN", "profanity", 1), ("en", "FN", "profanity_free", 1), ("en", "FN", "obfuscation", 1),
            ("en", "FN", "spelling_noise", 1), ("en", "FP", "identity_mention", 1),
        ],
        key=repr,
    )
    assert rows_of(error_categories(errors, lexicon)) == want
    monkeypatch.setattr("commentlab.operators.errors.bounded", lambda df: None)
    assert rows_of(error_categories(errors, lexicon)) == want


def jobs_of(spark, work):
    """How many Spark jobs ``work`` starts."""
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs(spark, skewed):
    assert jobs_of(spark, lambda: s.split_rows(skewed, ["lang"]).collect()) <= 6
    assert jobs_of(spark, lambda: s.stratified_sample(skewed, ["toxic"], cap=100).collect()) <= 8


def test_many_groups_give_the_same_rows(spark, skewed, rows_of, monkeypatch):
    gaps = skewed.withColumn("lang", F.when(F.col("id") % 7 > 0, F.col("lang")))
    gaps = gaps.withColumn("id", F.when(F.col("id") % 11 > 0, F.col("id")))

    def both():
        split = s.split_rows(gaps, ["lang", "toxic"], tie=["toxic"])
        sample = s.stratified_sample(gaps, ["lang", "toxic"], cap=333, fraction=0.3)
        return rows_of(split), rows_of(sample)

    few = both()
    assert len(few[0]) == 5000 and len(few[1]) >= 300
    monkeypatch.setattr(s, "MAX_LINES", 0)
    assert both() == few
    monkeypatch.setattr(s, "MAX_GROUPS", 1)
    assert both() == few


def test_empty_tables(skewed):
    none = skewed.filter("id < 0")
    assert s.split_rows(none, ["lang"]).count() == s.stratified_sample(none, ["toxic"]).count() == 0
    assert surrogate_id(none, ["lang"], "id", "n").count() == 0


@pytest.mark.parametrize("pos", ["id * 5 + 1", "xxhash64(id)", "if(id < 5999, id, 1L << 62)", "id / 3", "cast(id as string)"])
@pytest.mark.parametrize("held", [100, 10_000])
def test_large_groups_are_numbered_by_ranges(spark, pos, held, monkeypatch):
    monkeypatch.setattr(columns, "NUMBERED", held)
    lang = F.when(F.col("id") % 10 > 0, "a").when(F.col("id") % 20 == 0, "b")
    df = spark.range(6000).select(F.expr(pos).alias("pos"), lang.alias("lang"), F.lit("wide").alias("text"))
    groups = {}
    for r in surrogate_id(df, ["lang"], "pos").collect():
        groups.setdefault(r["lang"], []).append((r["pos"], r["id"]))
    assert {k: len(v) for k, v in groups.items()} == {"a": 5400, "b": 300, None: 300}
    assert all([i for _, i in sorted(g)] == list(range(len(g))) for g in groups.values())
