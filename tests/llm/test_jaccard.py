"""The Jaccard join against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from commentlab.llm import common, jaccard

from .conftest import prose

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """doc_id -> (size, least reachable id) over all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            shared = len(x & y)
            if x and y and 100 * shared >= 80 * (len(x) + len(y) - shared):
                p, q = find(i), find(j)
                up[max(p, q)] = min(p, q)
    return {i: (len(x), find(i)) for i, x in sets}


def edited(text, rng, share):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), max(1, int(len(words) * share))):
        words[i] = f"z{rng.randrange(10**9)}"
    return " ".join(words)


def compare(df, rows):
    want = brute(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}
    assert got == want


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(docs, monkeypatch, small):
    if small:  # every bucket and family is cut into blocks and goes through the trees
        monkeypatch.setattr(jaccard, "BLOCK", 3)
        monkeypatch.setattr(jaccard, "FEW", 2)
    rng = random.Random(4)
    rows, n = [], 0
    for seed in range(6):
        text = prose(60 + 40 * seed, seed * 13)
        for _ in range(8):
            rows.append((n, edited(text, rng, rng.choice([0.004, 0.01, 0.02, 0.04]))))
            n += 1
    shared = prose(55, 99)
    for seed in range(12):  # one passage in many documents
        rows.append((n, prose(80, 500 + seed * 7) + " " + shared))
        n += 1
    long = prose(1500, 3)
    rows += [(n, long), (n + 1, edited(long, rng, 0.01)), (n + 2, edited(long, rng, 0.2))]
    rng.shuffle(rows)
    compare(jaccard.near_duplicates(docs([(i, t, "en") for i, t in rows])), rows)


def test_edges(docs):
    rows = [
        (7, "One two\tthree"), (3, "one  TWO three"), (9, "one two"), (4, None), (5, ""), (6, " \n"), (None, "one two three"),
        (8, "a b c d e"), (8, "a b c d e"), (10, "É b c d e"), (11, "é b c d e"),
    ]
    out = jaccard.near_duplicates(docs([(i, t, None) for i, t in rows])).collect()
    assert len(out) == len(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}
    assert got[7] == got[3] == (1, 3) and got[9] == (1, 9)
    assert got[4] == (0, 4) and got[5] == (0, 5) and got[6] == (0, 6) and got[None] == (1, None)
    assert got[8] == (1, 8) and got[10] != got[11]


def test_empty_table(docs):
    assert jaccard.near_duplicates(docs([])).count() == 0
    assert jaccard.keep_one(docs([])).count() == 0


def test_threshold_is_exact(docs):
    # 4 of 5 shingles shared of a union of 5: 0.8 links; 7 of 9 does not
    a, b = [f"w{i}" for i in range(9)], [f"w{i}" for i in range(8)]
    rows = [(1, " ".join(a)), (2, " ".join(b))]
    compare(jaccard.near_duplicates(docs([(i, t, "en") for i, t in rows])), rows)
    c = [f"v{i}" for i in range(12)]
    rows = [(1, " ".join(c)), (2, " ".join([*c[:-1], "x"])), (3, " ".join(["y", *c[:-1]]))]
    compare(jaccard.near_duplicates(docs([(i, t, "en") for i, t in rows])), rows)


def test_keep_one(docs):
    text = prose(100, 1)
    rows = [(5, text, "a"), (2, text, "b"), (2, text, "b"), (9, prose(100, 77), "c"), (1, None, "d"), (None, text, "e"), (1, None, "d")]
    kept = jaccard.keep_one(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.collect()) == [(False, 1), (False, 1), (False, 2), (False, 9), (True, None)]


def test_keep_one_with_repeated_ids(docs):
    """An id with several texts: each text is judged in its own group, and none is lost."""
    a, b, c = (prose(80, i) for i in (1, 2, 3))
    rows = [(1, a, "en"), (5, a, "en"), (5, b, "en"), (7, a, "en")]
    kept = jaccard.keep_one(docs(rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, a), (5, b)]
    assert kept.columns == docs(rows).columns
    rows += [(1, c, "en"), (1, a, "en"), (5, None, "en"), (5, "", "en"), (None, a, "en"), (None, None, None), (9, c, "en"), (3, "", "en")]
    near = " ".join([*b.split(" ")[:-1], "other"])
    rows += [(5, near, "en"), (8, near, "en")]
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(docs(rows)).collect()), key=repr)
    fives = [x for i, x in kept if i == 5 and x]
    assert len(fives) == 1 and fives[0] in (b, near)
    rest = [x for x in kept if not (x[0] == 5 and x[1])]
    want = [(1, a), (1, c), (5, None), (5, ""), (None, a), (None, None), (3, "")]
    assert rest == sorted(want, key=repr)


def test_points_bound_the_overlap():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2000, 600).astype(np.uint64))
        b = np.unique(rng.integers(0, 2000, 600).astype(np.uint64))
        p, q = (np.frombuffer(jaccard.point(x, jaccard.COARSE), np.uint8).astype(int) for x in (a, b))
        assert np.minimum(p, q).sum() >= len(np.intersect1d(a, b))


def test_tree_search_finds_all_that_reach_the_bound():
    rng = np.random.default_rng(2)
    coarse = rng.poisson(3, (300, jaccard.COARSE)).astype(np.int32)
    coarse[150:] = coarse[:150] + rng.poisson(0.1, (150, jaccard.COARSE))
    sizes = coarse.sum(axis=1).astype(np.int64)
    tree = jaccard.Tree(sizes, coarse, [], 80, 100)
    for x in range(0, 300, 7):
        bound = np.minimum(coarse, coarse[x]).sum(axis=1)
        want = np.flatnonzero(100 * bound >= 80 * (sizes + sizes[x] - bound))
        assert sorted(tree.search(x).tolist()) == want.tolist()


def test_hashes_do_not_depend_on_the_place():
    one = jaccard.Shingles(5).sets(pa.array(["a b c d e f g"]))[0]
    two = jaccard.Shingles(5).sets(pa.array(["x y z", "A b c\nd e  f g", None]))
    assert one.tolist() == two[1].tolist() and len(two[2]) == 0


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(50), 100 + rng.randrange(50)) for _ in range(60)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    out = common.components(spark.createDataFrame(edges, "u long, v long"), "t").collect()
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {r["node"]: r["root"] for r in out} == want and len(out) == len(want)
    assert common.components(spark.createDataFrame([], "u long, v long"), "t").count() == 0


def test_finest_points_bound_what_sets_share():
    rng = np.random.default_rng(7)
    base = np.unique(rng.integers(0, 1 << 62, 9000).astype(np.uint64))
    sets = [base[:6000], base[3000:], np.unique(rng.integers(0, 1 << 62, 5000).astype(np.uint64)), base[:600], base[:3]]
    sizes = np.array([len(x) for x in sets])
    points = jaccard.finest_points(sets, sizes)
    assert not points[4].any() and points[0].sum() == len(sets[0])
    for a in range(4):
        for b in range(4):
            bound = np.minimum(points[a], points[b]).sum(dtype=np.int64)
            assert bound >= len(np.intersect1d(sets[a], sets[b]))
    # unrelated long sets fall below the bar by their points alone
    assert np.minimum(points[0], points[2]).sum() < 0.8 * 5000


def test_alike_counts_shared_shingles_in_parts(monkeypatch, spark):
    monkeypatch.setattr(jaccard, "COMPARED", 64)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 256)
    long = prose(700, 1).split()
    texts = [" ".join(long[:n]) for n in range(560, 701, 10)]
    compare(jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")), list(enumerate(texts)))


def test_op2_against_brute_force(spark, sf_dir):
    from commentlab.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(QUERIES["op2_ngram_jaccard"](spark, sf_dir), rows)
