"""Vector joins against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from commentlab.llm import vectors

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("entry", T.LongType()),
    ]
)
ODD = [
    (900, None, 1), (901, [], 1), (902, [1.0, None], 1), (903, [float("nan"), 1.0], 1), (904, [float("inf"), 1.0], 1),
    (905, [0.0] * 8, 1), (None, [1.0] * 8, 1), (906, [1.0] * 8, None), (907, [1.0, 2.0], 1),
]


@pytest.fixture(scope="module")
def table(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, lab, "x", 0) for i, v, lab in rows], SCHEMA)

    return make


def clusters(n, seed=1, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(2, n // 12), 8))
    out = []
    for i in range(n):
        v = centres[rng.integers(len(centres))] + rng.normal(size=8) * spread * rng.choice([1, 8])
        out.append((i, [float(np.float32(x)) for x in v], int(rng.integers(2))))
    return out + [(n + k, out[3][1], out[3][2]) for k in range(7)]


def usable(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, least=0.98):
    good = [(i, np.array(np.float32(v), np.float64), lab) for i, v, lab in rows if i is not None and usable(v) and lab is not None and any(v)]
    links = {i: set() for i, _, _ in good}
    for a, (i, x, p) in enumerate(good):
        for j, y, q in good[a + 1 :]:
            if p == q and len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= least:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in sorted(links):
        if i not in root:
            queue, root[i] = [i], i
            while queue:
                for j in links[queue.pop()]:
                    if j not in root:
                        root[j] = i
                        queue.append(j)
    return {i: (len(links[i]), root[i]) for i in links}


@pytest.mark.parametrize("small", [False, True])
def test_near_vectors(table, monkeypatch, small):
    if small:  # many cells, and cells cut into blocks
        monkeypatch.setattr(vectors, "PER_PIVOT", 6)
        monkeypatch.setattr(vectors, "BLOCK", 5)
    rows = clusters(150) + ODD
    out = vectors.near_vectors(table(rows)).collect()
    assert len(out) == len(rows)
    want = brute_links(rows)
    for r in out:
        n, root = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"]) == (n, root)
        assert r["kept"] == (r["vec_id"] == root or r["vec_id"] is None)


@pytest.mark.parametrize("held", [100, 1000])
def test_near_vectors_of_many_blocks(table, monkeypatch, held):
    """Cells and blocks cut, a cell over several blocks, several jobs; in 64 dimensions a few directions are compared first."""
    for name, value in {"PER_PIVOT": 12, "LEAST_HELD": held, "HELD": held, "PAIRS": 40, "BLOCK": 16, "BRIEF": 4}.items():
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(4)
    rows = clusters(60, seed=5) + ODD
    base = rng.normal(size=(40, 12))
    for i in range(160):
        v = base[rng.integers(40)] * (1 + i % 3) + rng.normal(size=12) * 0.12
        rows.append((1000 + i, [float(np.float32(x)) for x in v], int(i % 4 == 0)))
    rows += [(2000 + i, [1.0] * 12, 7) for i in range(30)]
    out = vectors.near_vectors(table(rows)).collect()
    assert len(out) == len(rows)
    want = brute_links(rows)
    assert sum(n > 0 for n, _ in want.values()) > 100
    for r in out:
        n, root = want.get(r["vec_id"], (0, r["vec_id"]))
        assert (r["n_links"], r["component_id"]) == (n, root)


def test_near_vectors_are_stored_once(spark, table, monkeypatch):
    """However many cells a vector may have partners in; intermediates were over eight times the vectors."""
    import os

    from commentlab.session import work_dir

    monkeypatch.setattr(vectors, "PER_PIVOT", 100)
    monkeypatch.setattr(vectors, "discard", lambda spark, path: None, raising=False)
    x = np.random.default_rng(6).normal(size=(2000, 64)).astype(np.float32)
    rows = table([(i, v, 0) for i, v in enumerate(x.tolist())])

    def stored():
        return sum(os.path.getsize(f"{d}/{f}") for d, _, files in os.walk(work_dir(spark)) for f in files if f.endswith(".parquet"))

    before = stored()
    assert vectors.near_vectors(rows).count() == 2000
    assert stored() - before < 2.5 * x.nbytes


def test_scaled_and_extreme_vectors_link(table):
    rows = [(1, [1e30, 1e30], 0), (2, [1e-30, 1e-30], 0), (3, [1.0, -1.0], 0), (4, [2.0, 2.0], 0), (4, [2.0, 2.0], 0)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(table(rows)).collect()}
    assert out == {1: (3, 1, True), 2: (3, 1, False), 3: (0, 3, True), 4: (3, 1, False)}


def test_empty_tables(table):
    assert vectors.near_vectors(table([])).count() == 0
    assert vectors.top_products(table([]), F.col("vec_id") % 2 == 0).count() == 0
    assert vectors.top_products(table(clusters(20)), F.lit(False)).count() == 0


def brute_top(rows, is_query, k):
    good = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and usable(v)]
    out = []
    for i, q in {i: q for i, q in good if is_query(i)}.items():
        found = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), j) for j, x in good if j != i and len(x) == len(q))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_top_products(table, monkeypatch, small):
    if small:  # several groups, query parts and slices
        monkeypatch.setattr(vectors, "GROUP", 8)
        monkeypatch.setattr(vectors, "QUERIES", 4)
        monkeypatch.setattr(vectors, "CANDIDATES", 20)
    rows = clusters(300, seed=2) + ODD
    out = vectors.top_products(table(rows), F.col("vec_id") % 10 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute_top(rows, lambda i: i % 10 == 0, 5)


def test_few_rows_ties_and_large_numbers(table):
    rows = [(0, [1.0, 0.0], 0), (2, [0.5, 0.5], 0), (1, [0.5, 0.5], 0), (50, [3e20, 1.0], 0)]
    out = sorted(map(tuple, vectors.top_products(table(rows[:3]), F.col("vec_id") == 0).collect()))
    assert out == [(0, 1, 1, 32768), (0, 2, 2, 32768)]
    out = sorted(map(tuple, vectors.top_products(table(rows), F.col("vec_id") == 0).collect()))
    assert [r[2] for r in out] == [50, 1, 2] and out[0][3] == 2**63 - 1


def test_op4_and_op8_against_brute_force(spark, sf_dir):
    from commentlab.llm.queries import QUERIES

    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in table.collect()]
    out = sorted(map(tuple, QUERIES["op4_topk_search"](spark, sf_dir).collect()))
    assert out == brute_top(rows, lambda i: i % 50 == 0, 5)
    want = brute_links(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in QUERIES["op8_embedding_dedup"](spark, sf_dir).collect()}
    assert got == want
