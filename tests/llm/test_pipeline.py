"""The pipeline against its parts, and the entry point without the subpackage."""

import subprocess
import sys
from pathlib import Path

import corpus_pipeline
from commentlab.llm import common, quality, toxicity

from .conftest import prose
from .test_jaccard import brute

ROOT = Path(__file__).parents[2]


def test_stages_against_their_parts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    train = ~common.is_fold("doc_id", 5, 0)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = toxicity.fit(docs, labels, train)
    scored = toxicity.score(docs.select("doc_id", "text"), model).collect()
    want = {r["doc_id"] for r in scored if r["_score"] < 0.5}
    clean = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want

    trees = quality.fit(clean, labels, train)
    want = {r["doc_id"] for r in quality.score(clean.select("doc_id", "text"), trees).collect() if r["_score"] >= 0.3}
    good = corpus_pipeline.drop_poor(spark, clean, sf_dir)
    assert good.columns == docs.columns and {r["doc_id"] for r in good.collect()} == want

    found = brute([(i, rows[i]) for i in want])
    want = {i for i, (_, root) in found.items() if root == i}
    single = corpus_pipeline.drop_near_duplicates(spark, good, sf_dir)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == want

    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in packed} == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]


def test_stages_on_odd_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    text = prose(60, 1)
    for rows in ([], [(1, text, "en"), (1, text, "en"), (None, None, None), (2, "", "en"), (3, text, None)]):
        table = docs(rows)
        for _, stage in corpus_pipeline.STAGES[:3]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == table.columns
        packed = corpus_pipeline.pack(spark, table, str(tmp_path))
        assert packed.count() == len(rows)


def test_the_rest_does_not_import_the_subpackage():
    code = (
        "import sys; from importlib.abc import MetaPathFinder\n"
        "import commentlab.queries, commentlab.plans.train, commentlab.plans.evaluate, commentlab.plans.external\n"
        "assert not any(m.startswith('commentlab.llm') for m in sys.modules)\n"
        "import __spark_entry__ as e; q = e.queries()\n"
        "assert sum(n.startswith('op') and n[2].isdigit() for n in q) == 13 and 'pipeline' in q\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_point_without_what_the_subpackage_needs():
    code = (
        "import sys; sys.modules['public_tokenizers'] = None\n"
        "import __spark_entry__ as e; from commentlab.queries import REGISTRY\n"
        "assert set(e.queries()) == set(REGISTRY) and set(e.oracle_sql()) <= set(REGISTRY)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_pipeline_loses_no_text_of_a_repeated_id(spark, docs, tmp_path):
    a, b = prose(80, 1), prose(80, 2)
    rows = docs([(1, a, "en"), (5, a, "en"), (5, b, "en"), (7, a, "en"), (None, b, None), (None, None, None)])
    kept = corpus_pipeline.drop_near_duplicates(spark, rows, str(tmp_path))
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (None, b), (None, None)], key=repr)
