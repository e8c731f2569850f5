"""Term statistics, vocabulary and TF-IDF against plain counting."""

import math
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from commentlab import scale
from commentlab.functions.text import with_grams
from commentlab.operators import features as f


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(30)]
    weights = 1 / np.arange(1, 31)
    docs = []
    for i in range(120):
        lang = "en" if i < 100 else "es"
        picked = rng.choice(words, size=rng.integers(0, 12), p=weights / weights.sum())
        docs.append((i, lang, [str(w) for w in picked]))
    return docs


@pytest.fixture(scope="module")
def df(spark, corpus):
    return spark.createDataFrame(corpus, "id int, lang string, grams array<string>")


def counted(corpus, lang):
    tf = [Counter(g) for _, own, g in corpus if own == lang]
    return sum((Counter(c.keys()) for c in tf), Counter()), sum(tf, Counter()), len(tf)


def test_term_counts_need_no_shuffle(df, corpus):
    counts = f.term_counts(df, "grams", ["id"])
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    want = {(i, w): n for i, _, g in corpus for w, n in Counter(g).items()}
    assert {(r["id"], r["term"]): r["tf"] for r in counts.collect()} == want


def test_term_stats(df, corpus):
    got = {(r["lang"], r["term"]): (r["df"], r["cf"]) for r in f.term_stats(df, "grams").collect()}
    want = {}
    for lang in ("en", "es"):
        docs, total, _ = counted(corpus, lang)
        want |= {(lang, w): (docs[w], total[w]) for w in total}
    assert got == want


@pytest.mark.parametrize("cap", [200_000, 7, 1])
def test_vocabulary_limits_and_cap(df, corpus, cap):
    got = {}
    for r in f.vocabulary(df, "grams", 3, 0.6, cap).collect():
        got.setdefault(r["lang"], set()).add(r["term"])
    for lang in ("en", "es"):
        docs, total, n = counted(corpus, lang)
        kept = [w for w in total if 3 <= docs[w] <= 0.6 * n]
        assert got.get(lang, set()) == set(sorted(kept, key=lambda w: (-total[w], w))[:cap])


def test_large_cap_with_ties(spark):
    """All terms tie, and the cap falls inside the tie."""
    rows = spark.range(3).select(
        F.lit("en").alias("lang"),
        F.transform(F.sequence(F.lit(0), F.lit(2999)), lambda i: F.lpad(i.cast("string"), 4, "0")).alias("grams"),
    )
    got = [r["term"] for r in f.vocabulary(rows, "grams", 3, 1.0, 2000).collect()]
    assert sorted(got) == [f"{i:04d}" for i in range(2000)]


def weights_of(grams, docs, n):
    tf = {w: c for w, c in Counter(grams).items() if w in docs}
    raw = {w: (1 + math.log(c)) * (math.log((1 + n) / (1 + docs[w])) + 1) for w, c in tf.items()}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    return {w: x / norm for w, x in raw.items()}


def test_long_form_and_vectors(df, corpus):
    vocab = f.vocabulary(df, "grams", 2, 0.9)
    long = {}
    for r in f.tfidf_terms(df, "grams", vocab, ["id", "lang"]).collect():
        long.setdefault(r["id"], {})[r["term"]] = r["weight"]
    kept = {}
    for r in vocab.collect():
        kept.setdefault(r["lang"], {})[r["term"]] = (r["df"], r["n_docs"])
    for lang in ("en", "es"):
        n = next(iter(kept[lang].values()))[1]
        docs = {w: d for w, (d, _) in kept[lang].items()}
        stages = f.vectorizer(vocab.filter(F.col("lang") == lang))
        order = {r["index"]: r["term"] for r in stages.terms.collect()}
        assert sorted(order) == list(range(len(order)))
        vectors = stages.transform(df.filter(F.col("lang") == lang))
        for r in vectors.select("id", "grams", vector_to_array("features").alias("v")).collect():
            want = weights_of(r["grams"], docs, n)
            assert long.get(r["id"], {}) == pytest.approx(want)
            assert {order[i]: x for i, x in enumerate(r["v"]) if x} == pytest.approx(want)


def test_a_vocabulary_beyond_the_bound_is_shuffled(df, monkeypatch):
    vocab = f.vocabulary(df, "grams", 2, 0.9)

    def weights():
        long = f.tfidf_terms(df, "grams", vocab, ["id", "lang"])
        plan = long._jdf.queryExecution().executedPlan().toString()
        return {(r["id"], r["lang"], r["term"]): r["weight"] for r in long.collect()}, "ShuffledHashJoin" in plan

    held, by_shuffle = weights()
    assert not by_shuffle and vocab.count() > 10
    for module in (f, scale):
        monkeypatch.setattr(module, "CAPPED_ROWS", 10)
    shuffled, by_shuffle = weights()
    assert by_shuffle and shuffled == pytest.approx(held) and held
    stages = f.vectorizer(vocab.filter("lang = 'en'"))
    assert stages.transform(df.filter("lang = 'en'")).count() == 100 and stages.size > 10


def test_the_norm_of_a_vector_is_worked_out_once(df):
    stored = f.counted(df, "grams", ["id", "lang"])
    rows = f.assembled(stored, f.indexed(f.vocabulary(df, "grams", 2, 0.9)), ["id"])
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" in plan and "aggregate(" not in plan


def test_words_are_paired_where_they_are_counted(spark, corpus, rows_of, monkeypatch):
    odd = [(200, None, ["w1", "w2", "w1", "w2"]), (201, None, ["w1"]), (202, "en", None), (202, "en", []), (203, "en", ["w1"] * 9)]
    words = spark.createDataFrame(corpus + odd, "id int, lang string, words array<string>")
    grams = with_grams(words.na.drop(subset=["words"]), "words", "grams")
    want = rows_of(f.term_stats(grams, "grams", ["lang"]))
    by_row = rows_of(f.term_counts(grams, "grams", ["id", "lang"]))
    for chunk, merge in ((1 << 18, 1 << 19), (7, 20)):
        monkeypatch.setattr(f, "CHUNK", chunk)
        monkeypatch.setattr(f, "MERGE", merge)
        assert rows_of(f.term_stats(words, "words", ["lang"], pairs=True)) == want
        stored = f.counted(words, "words", ["id", "lang"], pairs=True)
        assert rows_of(f.long_form(stored, ["id", "lang"])) == by_row
        assert stored.count() == words.count() == stored.select("_row").distinct().count()
        assert rows_of(f.vocabulary_of(stored, 1, 1.0)) == rows_of(f.vocabulary(words, "words", 1, 1.0, pairs=True))
        assert rows_of(f.vocabulary_of(stored, 1, 1.0).select("lang", "term", "df", "cf")) == want


def test_unseen_terms_and_empty_rows(spark, df):
    stages = f.vectorizer(f.vocabulary(df, "grams").filter("lang = 'en'"))
    rows = spark.createDataFrame([(["nope"],), ([],)], "grams array<string>")
    assert [r["features"].numNonzeros() for r in stages.transform(rows).collect()] == [0, 0]


def test_empty_vocabulary(df):
    with pytest.raises(ValueError, match="empty vocabulary"):
        f.vectorizer(f.vocabulary(df, "grams", min_df=10_000))


def test_no_vocabulary_on_the_driver():
    assert not any(word in Path(f.__file__).read_text() for word in ("toArrow", "collect()", "CountVectorizer"))
