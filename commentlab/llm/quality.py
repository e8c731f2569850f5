"""Quality classifier: histogram gradient-boosted trees over document statistics.

Each text becomes a row of statistics (shares of byte classes, word lengths, repetition of words
and lines, list marks). Training sorts them into quantile bins and grows depth-limited trees on
histograms of gradients; a model is three arrays over all trees' nodes, and scoring walks every
row down every tree at once with numpy.

Training rows are a bounded, documented sample: the ``MAX_TRAIN`` labelled ids with the least
hash. Scoring reads every whole text.

Defined results: a NULL or empty text has all-zero statistics and still gets a score; an id with
several labels counts by the largest; NULL ids and NULL labels do not train; with no training
row every score is 0.5, with one class only that class's smoothed share. Repeated rows are scored
alike; columns other than id and text are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from commentlab.llm import common

MAX_TRAIN = 16_000
BINS, DEPTH, TREES, RATE, LEAST, RIDGE = 64, 4, 80, 0.2, 20, 1.0

FEATURES = [
    "log_bytes", "log_words", "upper", "lower", "digit", "high", "space", "newline", "dot_comma",
    "mark", "symbol", "pipe", "mean_word", "std_word", "longest_word", "distinct_words",
    "repeat_word", "repeat_pair", "top_word", "upper_words", "mark_ends", "symbol_ends",
    "words_per_line", "distinct_lines", "short_words",
]


class Trees(NamedTuple):
    feature: np.ndarray  # trees x inner nodes, in heap order
    threshold: np.ndarray  # trees x inner nodes
    leaf: np.ndarray  # trees x leaves
    base: float


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(
        (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", bytes(range(128, 256)),
         b" \t", b"\n\r", b".,", b"!?;:'\"()-", b"#$%&*+/<=>@[\\]^_`{}~", b"|"), 1
    ):
        kind[list(chars)] = k
    return kind


KIND = _classes()


def statistics(column: pa.Array, powers: common.Powers) -> np.ndarray:
    """Rows of ``FEATURES`` for the texts of ``column``."""
    data, offsets = common.text_bytes(column)
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)), np.float64)
    size = np.diff(offsets).astype(np.float64)
    kind = KIND[data]
    out[:, 0] = np.log1p(size)
    for k in range(1, 11):
        out[:, k + 1] = common.per_text((kind == k).astype(np.float32), offsets) / np.maximum(size, 1)
    starts, ends, first = common.words(data, offsets)
    count = np.diff(first).astype(np.float64)
    some = np.maximum(count, 1)
    out[:, 1] = np.log1p(count)
    if len(starts):
        length = (ends - starts).astype(np.float64)
        mean = common.per_text(length, first) / some
        out[:, 12] = mean
        out[:, 13] = np.sqrt(np.maximum(common.per_text(length * length, first) / some - mean * mean, 0))
        out[:, 14] = common.per_text(length, first, np.maximum, 0.0)
        hashes = common.word_hashes(data, starts, ends, powers)
        doc = np.repeat(np.arange(n), np.diff(first))
        same = np.zeros(len(hashes))
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
        out[:, 16] = common.per_text(same, first) / some
        pair = hashes.copy()
        pair[:-1] = common.mix(hashes[:-1] * np.uint64(common.BASE) + hashes[1:])
        for i in range(n):
            if count[i]:
                own = np.sort(hashes[first[i] : first[i + 1]])
                runs = np.diff(np.concatenate([[-1], np.flatnonzero(own[1:] != own[:-1]), [len(own) - 1]]))
                out[i, 15] = len(runs) / count[i]
                out[i, 18] = runs.max() / count[i]
                two = np.sort(pair[first[i] : first[i + 1] - 1])
                out[i, 17] = np.count_nonzero(two[1:] == two[:-1]) / max(len(two), 1)
        total = np.zeros(len(data) + 1)
        np.cumsum(kind == 2, out=total[1:])
        lower = total[ends] - total[starts]
        np.cumsum(kind == 1, out=total[1:])
        out[:, 19] = common.per_text(((total[ends] - total[starts] > 1) & (lower == 0)) * 1.0, first) / some
        last = kind[ends - 1]
        out[:, 20] = common.per_text((last == 8) * 1.0, first) / some
        out[:, 21] = common.per_text((last >= 9) * 1.0, first) / some
        out[:, 24] = common.per_text((length <= 3) * 1.0, first) / some
    breaks = np.flatnonzero(data == 10)
    cuts = np.unique(np.concatenate([offsets, breaks + 1]))
    line_hash = common.word_hashes(data, cuts[:-1], cuts[1:], powers) if len(data) else np.zeros(0, np.uint64)
    line_first = np.searchsorted(cuts[:-1], offsets)
    lines = np.maximum(np.diff(line_first), 1)
    out[:, 22] = count / lines
    for i in range(n):
        out[i, 23] = len(set(line_hash[line_first[i] : line_first[i + 1]].tolist())) / lines[i]
    return out


def _bins(x: np.ndarray) -> list[np.ndarray]:
    cuts = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        cuts.append(values[values < column.max()])
    return cuts


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Boost ``TREES`` trees of ``DEPTH`` levels on logistic loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    feature = np.zeros((TREES, inner), np.int32)
    threshold = np.full((TREES, inner), np.inf)
    leaf = np.zeros((TREES, leaves))
    if not len(y):
        return Trees(feature, threshold, leaf, 0.0)
    base = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    if y.min() == y.max():
        return Trees(feature, threshold, leaf, base)
    cuts = _bins(x)
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width, start = 2**level, 2**level - 1
            gain = np.full(width, 1e-6)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = node * BINS + binned[:, f]
                gs, hs, ns = (
                    np.bincount(key, w, width * BINS).reshape(width, BINS).cumsum(axis=1) for w in (g, h, None)
                )
                left_g, left_h, left_n = gs[:, : len(c)], hs[:, : len(c)], ns[:, : len(c)]
                right_g, right_h, right_n = gs[:, -1:] - left_g, hs[:, -1:] - left_h, ns[:, -1:] - left_n
                better = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - gs[:, -1:] ** 2 / (hs[:, -1:] + RIDGE)
                better[(left_n < LEAST) | (right_n < LEAST)] = -1
                at = better.argmax(axis=1)
                top = better[np.arange(width), at]
                for k in np.flatnonzero(top > gain):
                    gain[k], feature[t, start + k], threshold[t, start + k] = top[k], f, c[at[k]]
            heap = start + node
            node = 2 * node + (x[np.arange(len(y)), feature[t, heap]] > threshold[t, heap])
        gs, hs = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = RATE * gs / (hs + RIDGE)
        score += leaf[t][node]
    return Trees(feature, threshold, leaf, base)


def walk(trees: Trees, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row, all rows going down each tree together."""
    total = np.full(len(x), trees.base)
    rows = np.arange(len(x))
    for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
        total += leaf[node - len(feature)]
    return 1 / (1 + np.exp(-total))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, doc_id: str, text: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of the ``most`` usable labelled ids with the least hash."""
    ids = (
        labels.filter(usable & F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("_id"), "_id")
        .limit(most)
    )
    return docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).join(F.broadcast(ids), "_id")


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Trees:
    """Trees fitted on at most ``MAX_TRAIN`` labelled documents."""
    rows = labelled_sample(docs, labels, label, doc_id, text, usable, MAX_TRAIN)
    names = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    class Work:
        @staticmethod
        def prepare():
            powers = common.Powers()

            def work(part):
                x = statistics(part.column(1), powers)
                return pa.record_batch(
                    [part.column(2).cast(pa.float64()), *map(pa.array, x.T)],
                    names=["label", *(f"f{i}" for i in range(len(FEATURES)))],
                )

            return work

    table = common.map_chunks(rows, "text", Work, f"label double, {names}").toArrow()
    data = np.column_stack([np.asarray(c) for c in table.columns]) if table.num_rows else np.zeros((0, len(FEATURES) + 1))
    data = data[np.lexsort(data.T)]  # the same fit in whatever order rows arrive
    return fit_trees(data[:, 1:], (data[:, 0] > 0).astype(np.float64))


def score(docs: DataFrame, trees: Trees, text: str = "text", at_least: float = 0.3) -> DataFrame:
    """``docs`` with ``_score`` and ``_predicted`` added, from each whole text."""
    at = docs.columns.index(text)

    class Work:
        @staticmethod
        def prepare():
            powers = common.Powers()

            def work(part):
                p = walk(trees, statistics(part.column(at), powers))
                return pa.record_batch(
                    [*part.columns, pa.array(p), pa.array((p >= at_least).astype(np.int32))],
                    names=[*part.schema.names, "_score", "_predicted"],
                )

            return work

    schema = StructType([*docs.schema, StructField("_score", DoubleType()), StructField("_predicted", IntegerType())])
    return common.map_chunks(docs, text, Work, schema)


def kept(docs: DataFrame, trees: Trees, text: str = "text", at_least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score ``at_least``, with all their columns whatever their names."""
    at = docs.columns.index(text)

    class Work:
        @staticmethod
        def prepare():
            powers = common.Powers()
            return lambda part: part.filter(pa.array(walk(trees, statistics(part.column(at), powers)) >= at_least))

    return common.map_chunks(docs, text, Work, docs.schema)
