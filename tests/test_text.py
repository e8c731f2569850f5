"""Cleaning rules, Unicode classes, accents, tokens and word pairs."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from commentlab.functions import text as t
from commentlab.functions.accents import strip_accents
from commentlab.scale import literal_table

CASES = [
    ("see http://a.b/c?d=1 now", "see now"),
    ("https://x.y", ""),
    ("go www.site.org today", "go today"),
    ("HTTP://X ok", "http://x ok"),
    ("@şule ok", "ok"),
    ("a@b.com", "a.com"),
    ("keep #tag", "keep #tag"),
    ("A B C\n\tD", "a b c d"),
    ("\x1c x \x85 y ", "x y"),
    (None, ""),
    ("", ""),
    ("İstanbul ŞÖYLE", "i̇stanbul şöyle"),
    ("httpx", ""),
    ("http", "http"),
    ("@ alone", "@ alone"),
]


def one(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("t"))).collect()]


def test_clean_text_cases(spark):
    assert one(spark, [c for c, _ in CASES], t.clean_text) == [want for _, want in CASES]


def test_clean_text_flags(spark):
    keep = dict(lowercase=False, urls=False, mentions=False)
    assert one(spark, ["Hi @you #Tag http://x"], lambda c: t.clean_text(c, **keep)) == [
        "Hi @you #Tag http://x"
    ]
    assert one(spark, ["a #tağ b"], lambda c: t.clean_text(c, hashtags=True)) == ["a b"]


def test_character_classes_follow_unicode(spark):
    codes = [c for c in range(1, 0x10000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, chr(c)) for c in codes], "c int, ch string")
    got = df.select("c", F.col("ch").rlike(t.WORD), F.col("ch").rlike(t.SPACE)).collect()
    assert not [c for c, _, space in got if space != chr(c).isspace()]
    off = [c for c, word, _ in got if word != (chr(c).isalnum() or chr(c) == "_")]
    # Letters newer than the JVM's Unicode version.
    assert len(off) < 100


def test_strip_accents_over_unicode(spark):
    codes = [c for c in range(0x80, sys.maxunicode + 1, 7) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c, "x" + chr(c) + "é…") for c in codes], "c int, ch string")

    def plain(text):
        return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))

    got = df.select("ch", strip_accents(F.col("ch"))).collect()
    assert not [before for before, after in got if after != plain(before)]


def test_strip_accents_sentences(spark):
    assert one(spark, ["Ça été ñandú", "한국", "ﬁne ½", None, "ascii"], strip_accents) == [
        "Ca ete nandu", "한국", "fine 1⁄2", None, "ascii",
    ]


def test_stopwords_drop_exact_tokens_only(spark):
    df = spark.createDataFrame(
        [("en", "the cat, the, end"), ("xx", "the cat"), ("en", "")], "lang string, t string"
    )
    words = literal_table(spark, [("en", ["the"])], "lang string, stopwords array<string>")
    got = [r["t"] for r in t.remove_stopwords(df, "t", words).collect()]
    assert sorted(got) == ["", "cat, the, end", "the cat"]


def test_stopword_lists_of_all_languages(spark):
    table = {r["lang"]: r["stopwords"] for r in t.stopword_table(spark, [*t.STOPWORD_LISTS, "xx"]).collect()}
    assert set(table) == set(t.STOPWORD_LISTS) and all(len(w) > 40 for w in table.values())


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ok", ["ok"]),
        ("", []),
        ("Une Été d'or", ["une", "ete", "d", "or", "une ete", "ete d", "d or"]),
        ("a_1 b", ["a_1", "b", "a_1 b"]),
    ],
)
def test_analyze(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert t.analyze(df, "t", "g").first()["g"] == want


def test_punctuation(spark):
    assert one(spark, ["«Été», ok!...no"], t.clean_punctuation) == ["Ete ok no"]


def test_cleaning_runs_on_a_stream(spark, tmp_path):
    spark.createDataFrame([("Hi @you",), ("A  B",)], "t string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t string").parquet(f"{tmp_path}/in")
    writer = stream.select(t.clean_text(F.col("t")).alias("t")).writeStream
    run = (
        writer.format("parquet").option("checkpointLocation", f"{tmp_path}/cp")
        .trigger(availableNow=True).start(f"{tmp_path}/out")
    )
    run.awaitTermination(60)
    assert sorted(r["t"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a b", "hi"]
