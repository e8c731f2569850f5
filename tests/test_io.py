"""Readers and writers."""

import hashlib
import json
import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from commentlab.operators import profile as p
from commentlab.operators.sequences import pack_sequences, parse_array
from commentlab.plans.evaluate import evaluate_run
from commentlab.queries import REGISTRY
from commentlab.sources import readers as r
from commentlab.sources import writers as w


def put(path: Path, **columns) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    pd.DataFrame(columns).to_csv(path, index=False)


def test_line_breaks_quotes_and_missing_cells(spark, tmp_path):
    texts = ['x\ny "q"', "a,b", "NA", "", "null", "Nah", 'say ""hi""', "é\r\nz"]
    put(tmp_path / "en/train.csv", id=range(8), comment_text=texts, toxic=[0, 1] * 4)
    got = [x["comment_text"] for x in r.load_split(spark, str(tmp_path), "en", "train").orderBy("id").collect()]
    assert got == ['x\ny "q"', "a,b", None, None, None, "Nah", 'say ""hi""', "é\r\nz"]


def test_round_trip_through_our_own_files(spark, tmp_path, rows_of):
    rows = spark.createDataFrame(
        [("en", "test", "1", 'x\ny "q", z', 1), ("en", "train", "2", "b\\c", 0), ("en", "val", "3", "d", 0)],
        "lang string, split string, id string, comment_text string, toxic int",
    )
    w.write_splits(rows, str(tmp_path / "s"), ["en"])
    loaded, missing = r.load_splits(spark, str(tmp_path / "s"), ["en", "en"])
    assert rows_of(loaded) == rows_of(rows) and not missing


def test_defaults_for_label_and_id(spark, tmp_path):
    put(tmp_path / "es/test.csv", comment_text=["a", "b", "c"])
    rows = r.load_split(spark, str(tmp_path), "es", "test").collect()
    assert [(x["id"], x["comment_text"], x["toxic"]) for x in rows] == [("0", "a", -1), ("1", "b", -1), ("2", "c", -1)]


def test_ordinals_follow_files_and_rows(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("n"), F.sha2(F.col("id").cast("string"), 512).alias("pad"))
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        # Later files are larger, so the reader starts with them.
        sizes = F.when(F.col("n") < 100, 0).when(F.col("n") < 1000, 1).otherwise(2)
        df.repartitionByRange(3, sizes).sortWithinPartitions("n").write.option("header", True).format(fmt).save(path)
        raw = r.scan_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)
        got = r.with_ordinal(raw).select("n", "id").collect()
        assert all(int(a) == b for a, b in got) and len(got) == 5000


def test_missing_files_and_columns(spark, tmp_path):
    put(tmp_path / "en/train.csv", text=["a"])
    with pytest.raises(KeyError, match="no text column"):
        r.load_split(spark, str(tmp_path), "en", "train")
    with pytest.raises(FileNotFoundError):
        r.load_split(spark, str(tmp_path), "en", "val")
    for split in r.SPLITS:
        put(tmp_path / f"it/{split}.csv", comment_text=["a"], toxic=[0])
    put(tmp_path / "es/train.csv", comment_text=["a"], toxic=[0])
    loaded, missing = r.load_splits(spark, str(tmp_path), ["it", "es"], strict=False)
    assert {x["lang"] for x in loaded.collect()} == {"it"} and list(missing) == ["es"]
    with pytest.raises(FileNotFoundError):
        r.load_splits(spark, str(tmp_path), ["it", "es"])


def test_prediction_roles_and_thresholds(spark, tmp_path):
    d = tmp_path / "preds"
    put(d / "run_a.csv", id=[1, 2], target=[1, 0], prediction=[0.5, 0.49])
    put(d / "run_b.csv", y_true=[1.0, 0.0], y_prob=[0.5, 0.4], best_threshold=["x", "x"])
    put(d / "run_c.csv", y_true=[1, 0], pred=[0.5, 0.4], best_threshold=[None, None])
    put(d / "run_d.csv", label=[1, 0], prob=[0.5, 0.4], best_threshold=[0.45, 0.45])
    put(d / "run_e.csv", toxic=[1, 0], pred_score=[0.5, 0.4], prediction_binary=[0, 1], best_threshold=[0.1, 0.1])
    got = r.load_predictions(spark, str(d), "run")
    decisions = {}
    for x in got.orderBy("lang", F.desc("y_prob")).collect():
        decisions.setdefault(x["lang"], []).append(x["y_pred"])
    assert decisions == {"a": [1, 0], "b": [1, 0], "c": [0, 0], "d": [1, 0], "e": [0, 1]}
    assert {x["id"] for x in got.filter("lang = 'd'").collect()} == {"0", "1"}
    assert {x["lang"] for x in r.load_predictions(spark, str(d), "run", ["d", "a", "d"]).collect()} == {"a", "d"}
    with pytest.raises(FileNotFoundError):
        r.load_predictions(spark, str(d), "run", ["zz"])
    assert r.inconsistent_thresholds(got, ["lang"]).count() == 0


def test_required_roles(spark):
    with pytest.raises(KeyError):
        r.resolve_predictions(spark.createDataFrame([(1,)], "y_true int"))
    assert r.pick_column(["b", "a"], ["a", "b"]) == "a"
    assert r.pick_column(["b"], ["a"], required=False) is None


def test_language_choice_and_discovery(spark, tmp_path):
    assert r.choose_languages(["en", "es", "en"], ["it"], ["tr"]) == ["en", "es"]
    assert r.choose_languages([], ["it"]) == ["it"]
    assert r.choose_languages(None, None, ["tr"]) == ["tr"]
    with pytest.raises(ValueError):
        r.choose_languages()
    for name in ("base_tr.csv", "base_en.csv", "base_.csv", "other_en.csv", "base_x.txt"):
        (tmp_path / name).write_text("a\n1\n")
    spark.range(3).write.csv(f"{tmp_path}/base_it.csv")
    names = r.file_names(spark, str(tmp_path))
    assert [x["lang"] for x in r.languages_of_names(names, "base").collect()] == ["en", "it", "tr"]


def test_runs_replace_their_own_partitions(spark, tmp_path):
    rows = spark.createDataFrame(
        [("en", "1", 1, 0.9, 1, 0.5), ("es", "2", 0, 0.1, 0, 0.4)],
        "lang string, id string, y_true int, y_prob double, y_pred int, best_threshold double",
    )
    path = str(tmp_path / "p")
    w.write_predictions(rows, path, "one")
    w.write_predictions(rows, path, "two")
    w.write_predictions(rows.filter("lang = 'en'").withColumn("id", F.lit("7")), path, "two")
    stored = sorted((x["run_tag"], x["lang"], x["id"]) for x in spark.read.parquet(path).collect())
    assert stored == [("one", "en", "1"), ("one", "es", "2"), ("two", "en", "7"), ("two", "es", "2")]
    plan = r.load_predictions(spark, path, "two", ["en"], fmt="parquet")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_tag" in text and plan.count() == 1


def test_evaluate_run_writes_report_and_errors(spark, tmp_path):
    put(tmp_path / "p/base_en.csv", id=range(4), y_true=[1, 0, 1, 0], y_prob=[0.9, 0.8, 0.2, 0.1], best_threshold=[0.5] * 4)
    put(tmp_path / "p/base_it.csv", id=range(2), y_true=[1, 0], y_prob=[0.9, 0.1], best_threshold=[0.5] * 2)
    report, sample = evaluate_run(spark, str(tmp_path / "p"), "base", output=str(tmp_path / "m.csv"), errors_dir=str(tmp_path / "e"))
    assert [x["language"] for x in report.collect()] == ["en", "it", "macro", "micro"]
    stored = {x["language"]: x for x in r.read_csv(spark, str(tmp_path / "m.csv")).collect()}
    assert stored["macro"]["true_positives"] is None and float(stored["micro"]["n_samples"]) == 6
    errors = r.read_csv(spark, str(tmp_path / "e/run_tag=base/lang=en"))
    assert [(x["id"], x["error_type"]) for x in errors.collect()] == [("1", "FP"), ("2", "FN")]
    assert not (tmp_path / "e/run_tag=base/lang=it").exists() and sample.count() == 2


def test_manifest(spark, tmp_path):
    put(tmp_path / "es.csv", id=[1], comment_text=["hola"], toxic=[0])
    put(tmp_path / "it.csv", id=[2], comment_text=["ciao"], toxic=[1], extra=["x"])
    (tmp_path / "m.json").write_text(json.dumps({"es": f"{tmp_path}/es.csv", "it": f"{tmp_path}/it.csv"}))
    corpora = r.translated_union(spark, r.read_manifest(spark, f"{tmp_path}/m.json"))
    assert sorted((x["lang"], x["comment_text"], x["extra"]) for x in corpora.collect()) == [("es", "hola", None), ("it", "ciao", "x")]


def test_column_pruned_scan(spark, tmp_path):
    spark.range(5).selectExpr("id", "id AS a", "id AS b").write.parquet(f"{tmp_path}/shards")
    plan = r.scan_columns(spark, f"{tmp_path}/shards", ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan


def test_profiles(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), (None, 0, 2.0)], "t string, toxic int, x double")
    got = {x["column"]: x for x in p.profile_table(df).collect()}
    assert (got["t"]["n_null"], got["t"]["mean"], got["t"]["dtype"]) == (1, None, "string")
    assert (got["toxic"]["mean"], got["x"]["mean"], got["x"]["position"]) == (0.5, 2.0, 2)
    assert p.example_rows(spark.range(9)).count() == 5
    (tmp_path / "sub").mkdir()
    (tmp_path / "a b.csv").write_bytes(b"x" * 10)
    (tmp_path / "sub/c.csv").write_bytes(b"x" * 3)
    (tmp_path / "sub/none.csv").write_bytes(b"")
    (tmp_path / "big.csv").write_bytes(b"x" * 2000)
    for whole in (1 << 20, 5):
        files = {x["name"]: x for x in p.profile_files(spark, str(tmp_path), "*.csv", whole).collect()}
        assert {n: x["size_human"] for n, x in files.items()} == {
            "a b.csv": "10 B", "c.csv": "3 B", "none.csv": "0 B", "big.csv": "2.0 KB"
        }
        for x in files.values():
            data = b"x" * x["size_bytes"]
            assert x["sha256"] == hashlib.sha256(data).hexdigest() and x["modified"] is not None


def test_profiled_files_are_written_by_several_tasks(spark, tmp_path):
    names = spark.range(40).selectExpr("id AS s_suppkey", "concat('name ', id) AS s_name")
    names.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    files = REGISTRY["profile_files"].run(spark, str(tmp_path))
    want = {(i, len(f"name {i}\n"), hashlib.sha256(f"name {i}\n".encode()).hexdigest()) for i in range(40)}
    assert {tuple(x) for x in files.collect()} == want
    assert len({path.rsplit("/", 1)[1].split("-")[1] for path in files.inputFiles()}) > 1


def test_large_csv_over_many_tasks(spark, tmp_path, rows_of):
    put(tmp_path / "en/train.csv", comment_text=["a\nb", 'say "hi"', None], toxic=[0, 1, 0])
    r.csv_to_parquet(spark, f"{tmp_path}/en/train.csv", f"{tmp_path}/en/train.parquet")
    texts = [r.load_split(spark, str(tmp_path), "en", "train", fmt=fmt) for fmt in ("csv", "parquet")]
    assert rows_of(texts[0]) == rows_of(texts[1]) and texts[0].count() == 3
    put(tmp_path / "es/train.csv", comment_text=[f"word {i} of a line" for i in range(5000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        split, _ = r.load_splits(spark, str(tmp_path), ["es"], ["train"], multiline=False)
        whole, _ = r.load_splits(spark, str(tmp_path), ["es"], ["train"])
        assert split.rdd.getNumPartitions() > whole.rdd.getNumPartitions()
        assert rows_of(split) == rows_of(whole)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_token_arrays(spark):
    df = spark.createDataFrame([("[0, 5, 7]",), ("(0, 5, 7)",), (None,)], "s string")
    assert [x[0] for x in df.select(parse_array(F.col("s"))).collect()] == [[0, 5, 7], [0, 5, 7], None]


def test_packing_both_ways(spark, rows_of):
    long = [f"w{i}" for i in range(200)]
    rows = spark.createDataFrame([("en", 1, ["b", "zz", "a"]), ("en", 2, []), ("it", 3, ["a"]), ("en", 4, long)], "lang string, id int, w array<string>")
    ids = spark.createDataFrame([("en", "a", 2), ("en", "b", 3), ("en", "w127", 9), ("en", "w128", 10)], "lang string, term string, word_id int")
    got = {x["id"]: x for x in pack_sequences(rows, "w", ids).collect()}
    assert got[1]["input_word_ids"] == [3, 1, 2] + [0] * 125 and got[1]["input_mask"] == [1] * 3 + [0] * 125
    assert got[2]["input_word_ids"] == [0] * 128 and got[3]["input_word_ids"][:2] == [1, 0]
    assert got[4]["input_word_ids"] == [1] * 127 + [9] and sum(got[4]["input_mask"]) == 128
    assert all(x["all_segment_id"] == [0] * 128 for x in got.values())
    assert rows_of(pack_sequences(rows, "w", ids, max_words=2)) == rows_of(pack_sequences(rows, "w", ids))


def scans(df):
    return len(re.findall(r"\bRelation \[", df._jdf.queryExecution().optimizedPlan().toString()))


def test_files_of_one_header_are_one_scan(spark, tmp_path, rows_of):
    """Twelve files with the same columns, one of them a folder, in one scan; other headers apart."""
    want = []
    for lang in ("en", "pt-br", "x y", "z+%20"):
        for split in r.SPLITS:
            texts = [f"{lang} {split} {i}" for i in range(3)]
            path = tmp_path / lang / f"{split}.csv"
            if (lang, split) == ("en", "val"):
                spark.createDataFrame([(t, 1) for t in texts], "comment_text string, toxic int").repartition(1).write.option("header", True).csv(str(path))
            else:
                put(path, comment_text=texts, toxic=[1] * 3)
            want += [(lang, split, str(i), t, 1) for i, t in enumerate(texts)]
    loaded, missing = r.load_splits(spark, str(tmp_path), ["en", "pt-br", "x y", "z+%20"])
    assert rows_of(loaded) == sorted(want, key=repr) and not missing
    with_ids = loaded._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in with_ids and scans(loaded) == 1
    put(tmp_path / "it/test.csv", id=["a"], toxic=[0], comment_text=["other order"])
    both, _ = r.load_splits(spark, str(tmp_path), ["it", "en"], ["test"])
    assert scans(both) == 2
    assert ("it", "test", "a", "other order", 0) in rows_of(both) and both.count() == 4


def test_no_complete_language(spark, tmp_path):
    none, missing = r.load_splits(spark, str(tmp_path), ["en", "es"], strict=False)
    assert none.count() == 0 and none.columns == r.SPLIT_COLUMNS and set(missing) == {"en", "es"}


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_the_first_row_of_a_file_gives_its_threshold(spark, tmp_path, fmt):
    """Mixed thresholds make one decision rule, and still show as mixed."""
    cells = {"a": ["0.2", "0.95", "0.95"], "b": ["0.95", "0.2", None], "c": [None, "0.2", "0.2"], "d": ["x", "0.9", "0.9"]}
    rows = pd.DataFrame(
        [(lang, i, 1, 0.6, cell) for lang, own in cells.items() for i, cell in enumerate(own)],
        columns=["lang", "id", "y_true", "y_prob", "best_threshold"],
    )
    if fmt == "csv":
        for lang, own in rows.groupby("lang"):
            put(tmp_path / f"run_{lang}.csv", **own.drop(columns="lang"))
    else:
        table = spark.createDataFrame(rows.astype({"best_threshold": object}), "lang string, id int, y_true int, y_prob double, best_threshold string")
        table.coalesce(1).withColumn("run_tag", F.lit("run")).write.partitionBy("run_tag", "lang").parquet(f"{tmp_path}/t")
    got = r.load_predictions(spark, str(tmp_path) if fmt == "csv" else f"{tmp_path}/t", "run", fmt=fmt)
    decisions = {}
    for x in got.collect():
        decisions.setdefault(x["lang"], set()).add(x["y_pred"])
    assert decisions == {"a": {1}, "b": {0}, "c": {0}, "d": {1}}
    assert {x["lang"] for x in r.inconsistent_thresholds(got, ["lang"]).collect()} == {"a", "b", "c", "d"}


def test_files_are_written_once_and_moved(spark, tmp_path):
    rows = spark.range(90).select(
        F.element_at(F.array(F.lit("en"), F.lit("a b"), F.lit("z/1%")), (F.col("id") % 3 + 1).cast("int")).alias("place"), "id"
    )
    for _ in range(2):  # a second write replaces the first
        w.write_places(rows, f"{tmp_path}/out", F.col("place"), ["en", "a b", "z/1%", "none"], "csv", ["place"])
    for place, n in (("en", 30), ("a b", 30), ("z/1%", 30), ("none", 0)):
        found = r.scan_csv(spark, f"{tmp_path}/out/{place}")
        assert found.count() == n and (n == 0 or found.columns == ["id"])
    assert not list(Path(f"{tmp_path}/out").glob("_staging*"))
    with pytest.raises(ValueError, match="without a file"):
        w.write_places(rows, f"{tmp_path}/out", F.col("place"), ["en"], "csv", ["place"])
    assert r.scan_csv(spark, f"{tmp_path}/out/en").count() == 30 and not list(Path(f"{tmp_path}/out").glob("_staging*"))


def test_example_rows_are_the_same_on_every_run(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("t"), "id")).alias("t"), F.lit("x" * 100).alias("long"))
    first = {x["column"]: x["examples"] for x in p.profile_table(df, ["id"], 4).collect()}
    again = {x["column"]: x["examples"] for x in p.profile_table(df.repartition(7), ["id"], 4).collect()}
    assert first == again and len(first["id"]) == 4 and first["long"] == ["x" * 80] * 4
    assert all(t is None or t == f"t{i}" for i, t in zip(first["id"], first["t"]))
    assert p.profile_table(df.limit(0), ["id"], 4).first()["examples"] == []


def test_status_is_in_the_report(spark, tmp_path):
    put(tmp_path / "run_en.csv", id=range(4), y_true=[0, 1, 1, 7], y_prob=[0.1, 0.9, 0.8, 0.5], y_pred=[0, 1, 1, 0], best_threshold=[0.5] * 4)
    put(tmp_path / "run_es.csv", id=range(2), y_true=[0, 1], y_prob=[0.1, 0.9], y_pred=[0, 1], best_threshold=[0.5, 0.6])
    put(tmp_path / "run_it.csv", id=range(2), y_true=[0, 1], y_prob=[0.1, 0.9], y_pred=[0, 1], best_threshold=[0.5, 0.5])
    report, _ = evaluate_run(spark, str(tmp_path), "run", configured=["en", "es", "it", "xx"], multiline=False)
    status = {x["language"]: x["status"] for x in report.collect()}
    assert status == {
        "en": "1 invalid rows", "es": "2 thresholds", "it": "complete", "macro": "missing: xx", "micro": "missing: xx"
    }
    report, _ = evaluate_run(spark, str(tmp_path), "run", ["it"], configured=["en"])
    assert {x["language"]: x["status"] for x in report.collect()} == {"it": "complete", "macro": "complete", "micro": "complete"}


def test_intermediates_can_be_cleared(spark):
    from commentlab.session import clear_work, materialise, new_path

    materialise(spark.range(3), "x").count()
    folder = Path(new_path(spark, "y")).parent
    assert folder.exists()
    clear_work(spark)
    assert not folder.exists()
