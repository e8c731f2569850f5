"""Phrase mining against a plain count of all phrases."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from commentlab.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """The contract, phrase by phrase."""
    count, total = {}, Counter()
    for _, text, lang in rows:
        own = count.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            longer = [b for q, b in f.items() if b >= least and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= 80 * a for b in longer):
                continue
            score, _, left, right = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "New", "York", "city", "naïve", "ünter", "Ünter", "a-b", "x\xa0y", "１", "it's", "z"]
    marks = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!", "\r\n", "\x0b", " ;", "\x1c", "\x85"]
    out = []
    for i in range(n):
        text = "".join(rng.choice(vocabulary) + rng.choice(marks) for _ in range(rng.randrange(0, 120)))
        text += rng.choice(["", " in the new york city hall", " of the city of"]) * rng.randrange(4)
        out.append((i, text, rng.choice(["en", "en", "fr", None, "und", ""])))
    return [*out, (None, None, "en"), (1, "", None), (1, out[0][1], out[0][2]), (2, " . , ", "de"), (3, "only once", "it")]


def collected(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("seed, least, top", [(1, 3, 1000), (2, 8, 5), (3, 30, 2000)])
def test_collocations_equal_a_plain_count(docs, seed, least, top):
    rows = corpus(seed)
    assert collected(phrases.collocations(docs(rows), least, top)) == brute(rows, least, top)


def test_chunks_and_tiles_change_nothing(docs, monkeypatch):
    rows = corpus(4)
    monkeypatch.setattr(phrases, "CHUNK", 500)
    monkeypatch.setattr(phrases, "TILE", 4)
    monkeypatch.setattr(phrases, "DENSE", 3)
    monkeypatch.setattr(phrases, "DENSE_TILES", 2)
    monkeypatch.setattr(phrases, "MERGE", 10)
    assert collected(phrases.collocations(docs(rows), 3, 1000)) == brute(rows, 3, 1000)
    # tables too large to be held
    monkeypatch.setattr(phrases, "HELD_WORDS", 1)
    monkeypatch.setattr(phrases, "HELD_PAIRS", 1)
    assert collected(phrases.collocations(docs(rows), 3, 1000)) == brute(rows, 3, 1000)


def test_pairs_are_dealt_out_before_spark_sums_them(spark):
    chunks = spark.createDataFrame([(0, 2, [0, 1, -1, 0, 1], [7, 9])], phrases.LINE)
    counts = phrases._counted(chunks, phrases._two)
    assert [tuple(r) for r in counts.collect()] == [(2, 7, 9, 2)]
    map_side = counts._jdf.queryExecution().executedPlan().toString().split("Exchange")[-1]
    assert "MapInArrow" in map_side and "HashAggregate" not in map_side


def test_one_word_and_long_texts(docs):
    rows = [(1, "buffalo " * 5000, "en"), (2, "x" * 100_000, "en"), (3, "Ab cD. " * 40, "en")]
    assert collected(phrases.collocations(docs(rows), 30, 10)) == brute(rows, 30, 10)


@pytest.mark.parametrize("ids, top", [(50, 3), (5000, 40), (10**10, 5)])
def test_tiles_count_pairs(ids, top, monkeypatch):
    monkeypatch.setattr(phrases, "DENSE", 50)
    monkeypatch.setattr(phrases, "MERGE", 1000)
    rng = np.random.default_rng(ids)
    counts, want = phrases.TileCounts(), Counter()
    for _ in range(8):
        i, j = ((rng.zipf(1.3, 3000) * top) % ids for _ in range(2))
        counts.add(i, j)
        want.update(zip(i.tolist(), j.tolist(), strict=True))
        if counts.held > 5000:
            for a, b, c in zip(*(x.tolist() for x in counts.drained()), strict=True):
                want[a, b] -= c
    i, j, n = counts.counted()
    want = +want
    assert dict(zip(zip(i.tolist(), j.tolist(), strict=True), n.tolist(), strict=True)) == want
    assert len(phrases.TileCounts().counted()[0]) == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a = 9_000_000_000_000
    big = "decimal(20,0)"
    row = spark.sql(f"SELECT cast({a} as {big}) * 2000000 div (cast({a + 1} as {big}) + cast({a} as {big})) AS s").first()
    assert row["s"] == a * 2000000 // (2 * a + 1)


def test_empty_table(docs):
    assert phrases.collocations(docs([])).count() == 0
    assert phrases.collocations(docs([(1, None, None), (2, "", "en")])).count() == 0
