"""Scoring by a model supplied by the caller, in batches inside the Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from numbers import Number

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 32
SCORE_KEY = "toxicity"

# Takes a list of texts and returns {"toxicity": scores}; a single text may give one number.
Predict = Callable[[list[str]], dict[str, Sequence[float] | float]]


def predict_batches(predict: Predict, texts: list[str], size: int = BATCH) -> list[float]:
    scores: list[float] = []
    for start in range(0, len(texts), size):
        result = predict(texts[start : start + size])[SCORE_KEY]
        scores.extend([float(result)] if isinstance(result, Number) else map(float, result))
    if len(scores) != len(texts):
        raise ValueError(f"the scorer gave {len(scores)} scores for {len(texts)} texts")
    return scores


def score_external(
    df: DataFrame,
    open_model: Callable[[], Predict],
    text_col: str = "comment_text",
    out: str = "y_prob",
    batch_size: int = BATCH,
) -> DataFrame:
    """Add the model's score to every row, in the order and partition it is in.

    Only the text goes to Python and only the score comes back. The model is opened once per
    task. Also works on a streaming DataFrame.
    """

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = open_model()
        for batch in texts:
            scores = predict_batches(predict, batch.fillna("").tolist(), batch_size)
            yield pd.Series(scores, dtype="float64")

    # Marked as not repeatable, so that a filter on the score does not run the model twice.
    scorer = F.pandas_udf(run, "double").asNondeterministic()
    return df.withColumn(out, scorer(F.col(text_col)))
