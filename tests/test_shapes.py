"""Physical plans that large inputs depend on."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from commentlab.functions import text as t
from commentlab.functions.columns import surrogate_id
from commentlab.operators import features as f
from commentlab.operators.auc import roc_auc
from commentlab.operators.errors import tag_errors
from commentlab.operators.metrics import metrics_report
from commentlab.operators.sampling import split_rows, stratified_sample
from commentlab.operators.sequences import pack_sequences, word_ids
from commentlab.operators.threshold import best_threshold
from commentlab.queries.base import predictions

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """A stored prediction table with text, so that scans can be pruned."""
    path = str(tmp_path_factory.mktemp("shapes") / "t")
    spark.range(400).select(
        "id",
        F.when(F.col("id") % 4 == 0, "es").otherwise("en").alias("lang"),
        F.concat(F.lit("Some text "), (F.col("id") % 20).cast("string")).alias("comment_text"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        (F.col("id") % 2).cast("int").alias("y_pred"),
        (F.col("id") / 400).alias("y_prob"),
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_report_scans_once_and_reads_no_text(stored):
    text = plan(metrics_report(stored))
    assert text.count("FileScan") == 1 and "comment_text" not in text
    assert "partial_sum" in text and text.count("MapInArrow") == 1


def test_auc_sorts_by_score_ranges(stored):
    text = plan(roc_auc(stored, ["lang"]))
    assert "rangepartitioning(_score" in text
    window = next(line for line in text.splitlines() if "Window [" in line)
    assert "_first" in window and text.index("MapInArrow") > text.index("Window [")


def test_sweep_combines_before_the_shuffle(stored):
    text = plan(best_threshold(stored, ["lang"]))
    assert text.count("FileScan") == 1 and "partial_count" in text


def test_cleaning_stays_in_the_jvm(stored):
    rows = stored.select(t.clean_text(F.col("comment_text")).alias("comment_text"))
    text = plan(t.analyze(rows, "comment_text", "grams"))
    assert "Python" not in text and "Arrow" not in text and "Exchange" not in text


def test_splits_and_samples_move_no_rows(stored):
    for df in (split_rows(stored, ["lang"]), stratified_sample(stored, ["y_true"])):
        text = plan(df)
        assert "Exchange hashpartitioning" not in text and "Window" not in text


def test_vectors_and_sequences_move_no_rows(stored):
    rows = t.analyze(stored, "comment_text", "grams").select("id", "lang", "grams")
    vocab = f.vocabulary(rows, "grams")
    for df in (
        f.tfidf_terms(rows, "grams", vocab, ["id", "lang"]),
        pack_sequences(rows, "grams", word_ids(vocab)),
    ):
        assert "Exchange hashpartitioning" not in plan(df)


def test_term_counts_are_combined_by_term(stored):
    rows = t.analyze(stored, "comment_text", "grams").select("lang", "grams")
    text = plan(f.term_stats(rows, "grams"))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text


def test_surrogate_ids_are_given_where_rows_lie(stored):
    text = plan(surrogate_id(stored.select("id", "lang", "comment_text"), ["lang"], "id", "n"))
    assert "Exchange" not in text.replace("BroadcastExchange", "") and "Window" not in text


@pytest.mark.skipif(not Path(SF_DIR).exists(), reason="no test data")
def test_registered_predictions_prune_columns(spark):
    text = plan(tag_errors(predictions(spark, SF_DIR)).select("lang", "id", "error_type"))
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text
