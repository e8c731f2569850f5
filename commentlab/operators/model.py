"""Logistic regression per language on TF-IDF vectors.

A fitted model is a table: terms with their index, inverse frequency and coefficient, beside an
intercept. Scores of all languages come from one join with that table and one sum per row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from commentlab.operators.features import NO_TERMS, counted, indexed, matched, vectors, with_vectors
from commentlab.scale import join_small, literal_table
from commentlab.session import materialise

# Settings of the fit.
MAX_ITER = 2000


@dataclass
class LanguageModel:
    """``terms`` has term, index, idf and coefficient."""

    terms: DataFrame
    intercept: float
    n_features: int

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` (with ``grams``) with the columns features and probability, as vectors."""
        nameless = self.terms.select(F.lit(None).cast("string").alias("lang"), "term", "index", "idf")
        numbered = materialise(df.withColumn("_own", F.monotonically_increasing_id()), "rows")
        scored = score(numbered.select("_own", "grams"), self, "_p")
        both = array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))).alias("probability")
        found = with_vectors(numbered, "grams", nameless).join(scored, "_own")
        return found.select(*df.columns, "features", both)


def class_weights(df: DataFrame, keys: list[str], label: str = "toxic") -> DataFrame:
    """Balanced weights n / (classes * n_class) per group and class; at most two rows a group."""
    counts = df.groupBy(*keys, label).agg(F.count("*").alias("n"))
    own = W.partitionBy(*keys)
    weight = F.sum("n").over(own).cast("double") / (F.count("*").over(own) * F.col("n"))
    return counts.select(*keys, label, "n", weight.alias("weight"))


def balanced_weight(label: str, n: int, n_pos: int) -> Column:
    return F.when(F.col(label) == 1, F.lit(n / (2 * n_pos))).otherwise(F.lit(n / (2 * (n - n_pos))))


def fit_vectors(rows: DataFrame, n: int, n_pos: int, label: str, max_iter: int, tol: float) -> LogisticRegressionModel:
    """Fit on (label, features) of one language with ``n`` rows, ``n_pos`` positive.

    Every iteration of the solver reads the stored vectors, not the text. The averaged loss of the
    solver with 1/n regularisation equals the summed loss with C=1.
    """
    solver = LogisticRegression(
        labelCol=label,
        weightCol="weight",
        regParam=1.0 / n,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
        family="binomial",
    )
    return solver.fit(rows.withColumn("weight", balanced_weight(label, n, n_pos)))


def check_classes(n: int, n_pos: int) -> None:
    if not 0 < n_pos < n:
        raise ValueError(f"the fit needs both classes, got {n_pos} positive rows of {n}")


def language_model(terms: DataFrame, fitted: LogisticRegressionModel) -> LanguageModel:
    """The ``indexed`` terms of one language with the coefficients of the fit."""
    values = np.asarray(fitted.coefficients.toArray())
    table = pa.table({"index": pa.array(np.arange(len(values)), pa.int32()), "coefficient": values})
    weights = terms.sparkSession.createDataFrame(table)
    joined = terms.join(weights, "index").select("term", "index", "idf", "coefficient")
    return LanguageModel(joined, float(fitted.intercept), len(values))


def fit_language(
    train: DataFrame,
    terms: DataFrame,
    n: int,
    n_pos: int,
    label: str = "toxic",
    max_iter: int = MAX_ITER,
    tol: float = 1e-6,
) -> LanguageModel:
    """Fit on ``train`` (grams, label) of one language with ``n`` rows, ``n_pos`` positive."""
    check_classes(n, n_pos)
    nameless = F.lit(None).cast("string")
    own = indexed(terms.withColumn("lang", nameless))
    if own.isEmpty():
        raise ValueError(NO_TERMS)
    stored = counted(train.withColumn("lang", nameless), "grams", ["lang", label])
    return language_model(own, fit_vectors(vectors(stored, own, [label]), n, n_pos, label, max_iter, tol))


def scores(stored: DataFrame, terms: DataFrame, intercepts: DataFrame, keep: list[str], out: str = "y_prob") -> DataFrame:
    """``keep`` and the probability of class 1 of each ``counted`` row of a language with a model.

    ``terms`` has lang, term, idf and coefficient, ``intercepts`` lang and intercept. A row's sums
    are put together where its terms are, so that one line per row is shuffled.
    """
    fields = list(dict.fromkeys(["lang", *keep]))
    own = join_small(stored, intercepts.select("lang", "intercept"), ["lang"])
    found = matched(own, terms.select("lang", "term", "idf", "coefficient"), [*fields, "intercept"])
    sums = found.groupBy("_row", "intercept", *fields).agg(
        F.sum(F.col("_w") * F.col("coefficient")).alias("_dot"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm")
    )
    margin = F.col("intercept") + F.coalesce(F.col("_dot") / F.col("_norm"), F.lit(0.0))
    return sums.select(*keep, (1 / (1 + F.exp(-margin))).alias(out))


def model_tables(models: dict[str, LanguageModel], template: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, term, index, idf, coefficient) and (lang, intercept, n_features) of all models."""
    spark = template.sparkSession
    rows = [(lang, m.intercept, m.n_features) for lang, m in models.items()]
    intercepts = literal_table(spark, rows, "lang string, intercept double, n_features int")
    terms = literal_table(spark, [], "lang string, term string, index int, idf double, coefficient double")
    for lang, model in models.items():
        named = model.terms.select(F.lit(lang).alias("lang"), "term", "index", "idf", "coefficient")
        terms = terms.unionByName(named)
    return terms, intercepts


def score(df: DataFrame, model: LanguageModel, out: str = "y_prob") -> DataFrame:
    """Probability of class 1 of each row's grams; the other columns are kept."""
    kept = [c for c in df.columns if c != "grams"]
    numbered = df.select(*kept, "grams")
    nameless = F.lit(None).cast("string").alias("lang")
    # the rows' own language, if they have that column, is none of the model's business
    moved = numbered.withColumnsRenamed({"lang": "_lang"}).withColumn("lang", nameless)
    fields = ["_lang" if c == "lang" else c for c in kept]
    stored = counted(moved, "grams", ["lang", *fields])
    terms = model.terms.select(nameless, "term", "idf", "coefficient")
    intercepts = literal_table(df.sparkSession, [(None, model.intercept)], "lang string, intercept double")
    return scores(stored, terms, intercepts, fields, out).withColumnsRenamed({"_lang": "lang"}).select(*kept, out)
