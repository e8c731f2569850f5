"""Comment cleaning and tokenising as native column expressions (no Python per row).

The character classes follow the Unicode meaning of word and space characters; the plain
regex shorthands of the JVM are ASCII-only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commentlab.functions.accents import strip_accents
from commentlab.scale import join_small, literal_table

# The character classes and patterns of the cleaning rules.
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_SPACE = r"[^\t-\r\x1c-\x20\x85\p{Z}]"
URL = rf"http{NOT_SPACE}+|www\.{NOT_SPACE}+"
MENTION = rf"@{WORD}+"
HASHTAG = rf"#{WORD}+"
# Language codes and the names of their stopword lists.
STOPWORD_LISTS = {
    "en": "english",
    "es": "spanish",
    "fr": "french",
    "de": "german",
    "it": "italian",
    "pt": "portuguese",
    "ru": "russian",
    "tr": "turkish",
}


def _remove(text: Column, pattern: str, *signs: str) -> Column:
    """Delete the matches; texts without one of the signs every match has skip the regex."""
    present = reduce(Column.__or__, [F.contains(text, F.lit(s)) for s in signs])
    return F.when(present, F.regexp_replace(text, pattern, "")).otherwise(text)


def remove_urls(text: Column) -> Column:
    return _remove(text, URL, "http", "www.")


def remove_mentions(text: Column) -> Column:
    return _remove(text, MENTION, "@")


def remove_hashtags(text: Column) -> Column:
    return _remove(text, HASHTAG, "#")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def clean_text(
    text: Column,
    lowercase: bool = True,
    urls: bool = True,
    mentions: bool = True,
    hashtags: bool = False,
) -> Column:
    """Missing text becomes empty; URLs and mentions go before lowercasing."""
    steps = [
        (urls, remove_urls),
        (mentions, remove_mentions),
        (hashtags, remove_hashtags),
        (lowercase, F.lower),
        (True, squeeze_spaces),
    ]
    start = F.coalesce(text.cast("string"), F.lit(""))
    return reduce(lambda t, step: step[1](t) if step[0] else t, steps, start)


def clean_punctuation(text: Column) -> Column:
    """Accents stripped, punctuation turned into spaces, spaces squeezed."""
    return squeeze_spaces(F.regexp_replace(strip_accents(text), r"[\p{P}]", " "))


def stopword_table(spark: SparkSession, languages: list[str]) -> DataFrame:
    """(lang, stopwords) for the languages that have a list; the others get no row."""
    rows = [
        (lang, sorted(set(StopWordsRemover.loadDefaultStopWords(STOPWORD_LISTS[lang]))))
        for lang in languages
        if lang in STOPWORD_LISTS
    ]
    return literal_table(spark, rows, "lang string, stopwords array<string>")


def remove_stopwords(df: DataFrame, text_col: str, stopwords: DataFrame) -> DataFrame:
    """Drop exact stopword tokens; rows of languages without a list stay as they are."""
    joined = join_small(df, stopwords, ["lang"], "left")
    kept = F.filter(
        F.split(F.col(text_col), " "), lambda w: ~F.array_contains(F.col("stopwords"), w)
    )
    cleaned = F.when(F.col("stopwords").isNull(), F.col(text_col)).otherwise(
        F.array_join(kept, " ")
    )
    return joined.withColumn(text_col, cleaned).select(*df.columns)


def tokenize(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD + "+"), F.lit(0))


def with_grams(df: DataFrame, tokens: str, out: str) -> DataFrame:
    """Words followed by the pairs of adjacent words, joined by one space."""
    words = F.col(tokens)
    pairs = F.greatest(F.size(words) - 1, F.lit(0))
    bigrams = F.zip_with(
        F.slice(words, F.lit(1), pairs),
        F.slice(words, F.lit(2), pairs),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return df.withColumn(out, F.concat(words, bigrams))


def analyze(df: DataFrame, text_col: str, out: str, pairs: bool = True) -> DataFrame:
    """The vectorizer's analyzer on cleaned text: lowercase, strip accents, words, pairs.

    Without ``pairs`` it stops at the words, for what pairs them itself as it counts.
    """
    lowered = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = df.withColumn(out, tokenize(strip_accents(lowered)))
    return with_grams(words, out, out) if pairs else words
