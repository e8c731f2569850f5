"""False positives and negatives, and the categories of their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.functions.columns import error_type
from commentlab.functions.text import tokenize
from commentlab.scale import bounded, join_small
from commentlab.session import materialise

# Signs that stand in for letters, and a letter repeated three times or more.
OBFUSCATED = r"\p{L}[*@$!0-9]+\p{L}"
STRETCHED = r"(\p{L})\1{2,}"


def tag_errors(df: DataFrame) -> DataFrame:
    """Misclassified rows with their ``error_type``."""
    tagged = df.withColumn("error_type", error_type(F.col("y_true"), F.col("y_pred")))
    return tagged.filter(F.col("error_type").isNotNull())


def union_errors(df: DataFrame) -> DataFrame:
    """False positives and false negatives under one another; the union keeps duplicates."""
    t, p = F.col("y_true"), F.col("y_pred")
    fp = df.filter((t == 0) & (p == 1)).withColumn("error_type", F.lit("FP"))
    fn = df.filter((t == 1) & (p == 0)).withColumn("error_type", F.lit("FN"))
    return fp.unionByName(fn)


def _lexicon_hits(errors: DataFrame, text_col: str, lexicon: DataFrame) -> DataFrame:
    """``errors`` with ``hits``, the distinct lexicon categories found in the text."""
    words = F.array_distinct(tokenize(F.lower(F.col(text_col))))
    small = bounded(lexicon.select("lang", "category", "word").distinct())
    if small is not None:
        lists = (
            small.groupBy("lang", "category")
            .agg(F.collect_set("word").alias("words"))
            .groupBy("lang")
            .agg(F.collect_list(F.struct("category", "words")).alias("_lists"))
        )
        found = F.filter(
            F.coalesce(F.col("_lists"), F.array()),
            lambda c: F.arrays_overlap(F.col("_words"), c["words"]),
        )
        joined = join_small(errors.withColumn("_words", words), lists, ["lang"], "left")
        hits = F.transform(found, lambda c: c["category"])
        return joined.withColumn("hits", hits).drop("_words", "_lists")
    # A stored number stands for each row: ids may be shared, languages NULL.
    errors = materialise(errors.withColumn("_row", F.monotonically_increasing_id()), "errors")
    exploded = errors.select("_row", "lang", F.explode(words).alias("word"))
    hits = (
        join_small(exploded, lexicon.select("lang", "category", "word"), ["lang", "word"])
        .groupBy("_row")
        .agg(F.collect_set("category").alias("hits"))
    )
    joined = errors.join(hits, "_row", "left").drop("_row")
    return joined.withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))


def error_categories(
    errors: DataFrame,
    lexicon: DataFrame,
    text_col: str = "comment_text",
) -> DataFrame:
    """Counts per (lang, error_type, category).

    Each lexicon category counts the texts that use one of its words. A false negative or
    positive that is labelled toxic without a ``profanity`` word is profanity-free; disguised
    and stretched spellings are found by pattern. One text may fall into several categories.
    """
    tagged = _lexicon_hits(errors, text_col, lexicon)
    text = F.lower(F.col(text_col))
    no_profanity = (F.col("y_true") == 1) & ~F.array_contains("hits", "profanity")
    patterns: dict[str, Column] = {
        "profanity_free": no_profanity,
        "obfuscation": text.rlike(OBFUSCATED),
        "spelling_noise": text.rlike(STRETCHED),
    }
    extra = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in patterns.items()]))
    categories = F.explode(F.concat(F.col("hits"), extra))
    return (
        tagged.select("lang", "error_type", categories.alias("category"))
        .groupBy("lang", "error_type", "category")
        .agg(F.count("*").alias("n"))
    )
