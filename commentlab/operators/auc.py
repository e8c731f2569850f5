"""Exact ROC-AUC with mid-rank ties, grouped, for any number of rows per group.

Rows are first counted per (group, score), so repeated scores collapse before the shuffle.
The counts are then range-partitioned by score: scores are nearly unique by now, so the parts
are even however the rows are spread over groups and scores. Each part reports its totals per
group and its own share of the rank sums; a window over those few part rows adds what lies in
lower parts. No group is ever sorted in one task, and coarser groupings of the same rows (all
languages together) come out of the same pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

EXACT_INT64 = 1 << 62
# Counts a task holds at once.
BATCH_VALUES = 1 << 22


def usable_score(score: Column) -> Column:
    """False for missing, NaN and infinite scores, for which no ranking is defined."""
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))


def count_scores(df: DataFrame, keys: list[str], score: str, counts: dict[str, Column]) -> DataFrame:
    """One row per (keys, score) with the given counts and ``n_bad`` unusable scores."""
    good = usable_score(F.col(score))
    return (
        df.withColumn("_score", F.when(good, F.col(score)).otherwise(F.lit(float("-inf"))))
        .groupBy(*keys, "_score")
        .agg(
            *[F.sum(c.cast("long")).alias(name) for name, c in counts.items()],
            F.count_if(~good).alias("n_bad"),
        )
    )


def _pair_sum(pos: np.ndarray, neg: np.ndarray, below: int) -> int:
    """Twice the number of (positive, lower negative) pairs, ties counting half."""
    lower = np.cumsum(neg) - neg
    if int(pos.sum()) * (2 * (below + int(neg.sum())) + 1) < EXACT_INT64:
        return int(np.dot(pos, 2 * (lower + below) + neg))
    exact = 2 * (lower.astype(object) + below) + neg.astype(object)
    return int(np.dot(pos.astype(object), exact))


class _Part:
    """Running totals of one group inside one range partition."""

    def __init__(self, width: int, pairs: list[tuple[int, int]]):
        self.pairs = pairs
        self.first: float | None = None
        self.sums = [0] * width
        self.ranks = [0] * len(pairs)
        self.score = np.empty(0)
        self.counts = np.empty((0, width), dtype=np.int64)

    def add(self, score: np.ndarray, counts: np.ndarray) -> None:
        """Take sorted rows; the last score is held back, as its ties may follow."""
        if self.first is None:
            self.first = float(score[0])
        score = np.concatenate([self.score, score])
        counts = np.concatenate([self.counts, counts])
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        counts = np.add.reduceat(counts, starts, axis=0)
        self.score, self.counts = score[starts[-1:]], counts[-1:]
        self._fold(counts[:-1])

    def _fold(self, counts: np.ndarray) -> None:
        for i, (pos, neg) in enumerate(self.pairs):
            self.ranks[i] += _pair_sum(counts[:, pos], counts[:, neg], self.sums[neg])
        self.sums = [a + int(b) for a, b in zip(self.sums, counts.sum(axis=0))]

    def totals(self) -> tuple:
        self._fold(self.counts)
        return (self.first, *self.sums, *map(Decimal, self.ranks))


def _groups(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    """Each key of the batch with the places of its rows, in order."""
    code = np.zeros(batch.num_rows, dtype=np.int64)
    for key in keys:
        encoded = batch.column(key).dictionary_encode()
        own = encoded.indices.fill_null(len(encoded.dictionary)).to_numpy()
        code = code * (len(encoded.dictionary) + 1) + own
    order = np.argsort(code, kind="stable")
    edges = np.flatnonzero(np.diff(code[order])) + 1
    for places in np.split(order, edges):
        yield tuple(batch.column(k)[int(places[0])].as_py() for k in keys), places


def _larger(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of ``size`` or more, so that many groups cost little."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= size:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.concat_batches(held)


def _part_rows(
    sets: list[list[str]],
    keys: list[str],
    counts: list[str],
    pairs: list[tuple[int, int]],
    names: list[str],
):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[tuple, _Part] = {}
        types: list[pa.DataType] = []
        for batch in _larger(batches, BATCH_VALUES // len(counts)):
            own_types = [batch.schema.field(k).type for k in keys]
            totals = [pa.float64(), *[pa.int64()] * len(counts), *[pa.decimal128(38, 0)] * len(pairs)]
            types = [pa.int32(), *own_types, *totals]
            score = batch.column("_score").to_numpy()
            values = np.column_stack([batch.column(c).to_numpy() for c in counts])
            for number, own in enumerate(sets):
                for key, places in _groups(batch, own):
                    part = parts.setdefault((number, key), _Part(len(counts), pairs))
                    part.add(score[places], values[places])
        rows = []
        for (number, key), part in parts.items():
            named = dict(zip(sets[number], key))
            rows.append((number, *[named.get(k) for k in keys], *part.totals()))
        if rows:
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), types)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def rank_totals(
    counted: DataFrame,
    keys: list[str],
    counts: list[str],
    pairs: dict[str, tuple[str, str]],
    sets: list[list[str]] | None = None,
) -> DataFrame:
    """Totals of ``counts`` per group, and one AUC column per named (positive, negative) pair.

    ``sets`` lists the groupings wanted, each some of ``keys``; ``_set`` numbers them in the
    result. An AUC is NULL if a class is empty or if the group has unusable scores (``n_bad``).
    The number of groups is taken to be moderate: every part holds one state per group.
    """
    counts = [*counts, "n_bad"]
    index = [(counts.index(p), counts.index(n)) for p, n in pairs.values()]
    ranks = [f"_rank_{i}" for i in range(len(index))]
    big = T.DecimalType(38, 0)
    out = T.StructType(
        [T.StructField("_set", T.IntegerType())]
        + [T.StructField(k, counted.schema[k].dataType) for k in keys]
        + [T.StructField("_first", T.DoubleType())]
        + [T.StructField(c, T.LongType()) for c in counts]
        + [T.StructField(r, big) for r in ranks]
    )
    parts = (
        counted.select(*keys, "_score", *counts)
        .repartitionByRange("_score")
        .sortWithinPartitions("_score")
        .mapInArrow(_part_rows(sets or [keys], keys, counts, index, out.names), out)
    )
    group = ["_set", *keys]
    lower = W.partitionBy(*group).orderBy("_first").rowsBetween(W.unboundedPreceding, -1)

    def with_lower(pos: int, neg: int) -> Column:
        """Twice the pairs of this part's positives with the negatives of lower parts."""
        before = F.coalesce(F.sum(F.col(counts[neg])).over(lower), F.lit(0)).cast("decimal(19,0)")
        return (F.col(counts[pos]).cast("decimal(19,0)") * before * 2).cast(big)

    parts = parts.withColumns({f"{r}_lower": with_lower(*at) for r, at in zip(ranks, index)})
    totals = parts.groupBy(*group).agg(
        *[F.sum(c).alias(c) for c in counts],
        *[F.sum((F.col(r) + F.col(f"{r}_lower")).cast(big)).cast(big).alias(r) for r in ranks],
    )

    def auc(rank: str, pos: int, neg: int) -> Column:
        p, n = F.col(counts[pos]).cast("double"), F.col(counts[neg]).cast("double")
        defined = (F.col("n_bad") == 0) & (p > 0) & (n > 0)
        return F.when(defined, F.col(rank).cast("double") / (F.lit(2.0) * p * n))

    aucs = {name: auc(r, *at) for name, r, at in zip(pairs, ranks, index)}
    return totals.withColumns(aucs).drop(*ranks)


def roc_auc(
    df: DataFrame, keys: list[str], label: str = "y_true", score: str = "y_prob"
) -> DataFrame:
    """keys, n_pos, n_neg, roc_auc. Rows without a 0/1 label count for neither class."""
    counted = count_scores(
        df.filter(F.col(label).isin(0, 1)),
        keys,
        score,
        {"n_pos": F.col(label) == 1, "n_neg": F.col(label) == 0},
    )
    totals = rank_totals(counted, keys, ["n_pos", "n_neg"], {"roc_auc": ("n_pos", "n_neg")})
    return totals.select(*keys, "n_pos", "n_neg", "roc_auc")


def subgroup_auc(
    df: DataFrame,
    subgroups: dict[str, Column],
    keys: list[str] | None = None,
    label: str = "y_true",
    score: str = "y_prob",
) -> DataFrame:
    """Subgroup, BPSN and BNSP AUC for each named membership condition.

    BPSN ranks background positives against subgroup negatives, BNSP subgroup positives
    against background negatives. All of them come from one pass over the rows.
    """
    keys = keys or []
    df = df.filter(F.col(label).isin(0, 1))
    df = df if keys else df.withColumn("_all", F.lit(0))
    group = keys or ["_all"]
    positive = F.col(label) == 1
    counts: dict[str, Column] = {"p": positive, "n": ~positive}
    background: dict[str, Column] = {}
    pairs: dict[str, tuple[str, str]] = {}
    for i, member in enumerate(subgroups.values()):
        inside = F.coalesce(member, F.lit(False))
        counts |= {f"sp{i}": inside & positive, f"sn{i}": inside & ~positive}
        background |= {f"bp{i}": F.col("p") - F.col(f"sp{i}"), f"bn{i}": F.col("n") - F.col(f"sn{i}")}
        pairs |= {
            f"subgroup_auc{i}": (f"sp{i}", f"sn{i}"),
            f"bpsn_auc{i}": (f"bp{i}", f"sn{i}"),
            f"bnsp_auc{i}": (f"sp{i}", f"bn{i}"),
        }
    counted = count_scores(df, group, score, counts).withColumns(background)
    totals = rank_totals(counted, group, [*counts, *background], pairs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("subgroup"),
                    (F.col(f"sp{i}") + F.col(f"sn{i}")).alias("subgroup_size"),
                    F.col(f"subgroup_auc{i}").alias("subgroup_auc"),
                    F.col(f"bpsn_auc{i}").alias("bpsn_auc"),
                    F.col(f"bnsp_auc{i}").alias("bnsp_auc"),
                )
                for i, name in enumerate(subgroups)
            ]
        )
    )
    return totals.select(*keys, rows.alias("_r")).select(*keys, "_r.*")
