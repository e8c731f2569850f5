"""Seeded samples and splits ordered by a hash of the row id, so the layout does not matter.

Exact sizes need the hash of the k-th row of a group. It is found without sorting the group: one
histogram over hash prefixes, of all groups at once, says which prefix holds it, and only the hashes
of that prefix are counted and ranked. Every row is then placed by comparing its own hash, with no
shuffle of the table. Rows that share an id share their place, so sizes are exact up to the copies of
the id at a cut; tie columns go into the hash and part them. A NULL id is hashed as its whole row;
whether there are any is told by the histogram.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from commentlab.scale import join_small, same_keys, top_k

# Hexadecimal digits of a hash that the histogram counts by.
PREFIX = 4
# Groups whose histograms and cuts the driver holds: numbers per prefix, whatever the rows.
MAX_GROUPS = 256
# Hashes that the driver ranks.
MAX_LINES = 500_000


def hashed(ident: str | Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col(ident) if isinstance(ident, str) else ident, F.lit(seed)))


def _key(df: DataFrame, ident: str, seed: int, tie: list[str] | None, whole: bool) -> Column:
    """The hash that places a row: of its id, its tie columns if any, and the seed; ``whole`` hashes
    rows without an id as they are."""
    key = F.col(ident).cast("string")
    if whole:
        key = F.coalesce(key, F.to_json(F.struct(*df.columns)))
    return hashed(F.concat_ws(":", key, F.to_json(F.struct(*tie))) if tie else key, seed)


class Histogram:
    """Rows per group and hash prefix, and whether there are NULL ids."""

    def __init__(self, table: pa.Table, group: list[str]):
        names = zip(*(table.column(g).to_pylist() for g in group), strict=True)
        lines = zip(names, table.column("_prefix").to_pylist(), table.column("_n").to_pylist(), strict=True)
        self.groups: dict[tuple, list[tuple[str, int]]] = {}
        for name, prefix, n in sorted(lines, key=lambda line: line[1]):
            self.groups.setdefault(name, []).append((prefix, n))
        self.sizes = {name: sum(n for _, n in own) for name, own in self.groups.items()}
        self.nulls = any(n > 0 for n in table.column("_nulls").to_pylist())

    def at(self, name: tuple, rank: int) -> tuple[str, int]:
        """The prefix that holds the row of a rank, and its rank within the prefix."""
        upto = np.cumsum([n for _, n in self.groups[name]])
        rank = min(max(rank, 0), int(upto[-1]))
        i = int(np.searchsorted(upto, max(rank, 1)))
        return self.groups[name][i][0], rank - int(upto[i - 1]) if i else rank


def _histogram(df: DataFrame, group: list[str], ident: str, key: Column) -> Histogram | None:
    """The histogram of all groups, or None for too many."""
    most = MAX_GROUPS * 16**PREFIX
    counts = (
        df.select(*group, F.col(ident).isNull().alias("_null"), F.substring(key, 1, PREFIX).alias("_prefix"))
        .groupBy(*group, "_prefix")
        .agg(F.count("*").alias("_n"), F.count_if("_null").alias("_nulls"))
    )
    table = counts.limit(most + 1).toArrow()
    if table.num_rows > most:
        return None
    found = Histogram(table, group)
    return found if len(found.groups) <= MAX_GROUPS else None


# Ranks of each cut from the sizes of the groups.
Cuts = Callable[[dict[tuple, int]], dict[str, dict[tuple, int]]]


Hits = list[tuple]  # group columns, prefix, cut, rank within the prefix


def _ranked_here(keyed: DataFrame, group: list[str], fields: list, hits: Hits) -> dict[tuple, dict[str, str]]:
    """Limits by group and cut, from the few hashes that share a prefix with a cut."""
    near = keyed.filter(F.col("_prefix").isin(sorted({h[-3] for h in hits})))
    lines = near.groupBy(*group, "_hash").agg(F.count("*").alias("_n")).toArrow().sort_by("_hash")
    own: dict[tuple, list[tuple[str, int]]] = {}
    names = zip(*(lines.column(g).to_pylist() for g in group), strict=True)
    for name, h, n in zip(names, lines.column("_hash").to_pylist(), lines.column("_n").to_pylist(), strict=True):
        own.setdefault((*name, h[:PREFIX]), []).append((h, n))
    out: dict[tuple, dict[str, str]] = {}
    for *name, prefix, cut, rest in hits:
        upto = np.cumsum([n for _, n in own[(*name, prefix)]])
        at = int(np.searchsorted(upto, max(rest, 1)))
        out.setdefault(tuple(name), {})[cut] = own[(*name, prefix)][at][0] if rest > 0 else ""
    return out


def _ranked_there(keyed: DataFrame, group: list[str], fields: list, hits: Hits) -> dict[tuple, dict[str, str]]:
    """The same where many hashes share a prefix: they are ranked where they are."""
    more = [T.StructField("_prefix", T.StringType()), T.StructField("cut", T.StringType()), T.StructField("_rest", T.LongType())]
    wanted = keyed.sparkSession.createDataFrame(hits, T.StructType([*fields, *more]))
    # Counted by hash first: many rows of one id are one entry of the ranking.
    within = W.partitionBy(*group, "cut").orderBy("_hash")
    ranked = (
        same_keys(keyed, F.broadcast(wanted), [*group, "_prefix"])
        .groupBy(*group, "cut", "_rest", "_hash")
        .agg(F.count("*").alias("_n"))
        .withColumn("_at", F.sum("_n").over(within))
    )
    rest = F.greatest(F.col("_rest"), F.lit(1))
    reached = ranked.filter((F.col("_at") >= rest) & (F.col("_at") - F.col("_n") < rest))
    out: dict[tuple, dict[str, str]] = {}
    for r in reached.collect():  # a line per group and cut
        out.setdefault(tuple(r[g] for g in group), {})[r["cut"]] = "" if r["_rest"] <= 0 else r["_hash"]
    return out


def _limits(df: DataFrame, group: list[str], key: Column, histogram: Histogram, cuts: dict[str, dict]) -> DataFrame:
    """One row per group, with the hash at each cut; '' is below every row."""
    fields = [T.StructField(g, df.schema[g].dataType) for g in group]
    hits = [
        (*name, prefix, cut, rest)
        for cut, ranks in cuts.items()
        for name in histogram.groups
        for prefix, rest in [histogram.at(name, ranks[name])]
    ]
    wanted = {prefix for *_, prefix, _, _ in hits}
    lines = sum(n for own in histogram.groups.values() for prefix, n in own if prefix in wanted)
    keyed = df.select(*group, key.alias("_hash")).withColumn("_prefix", F.substring("_hash", 1, PREFIX))
    found = _ranked_here if lines <= MAX_LINES else _ranked_there
    told = found(keyed, group, fields, hits)
    rows = [(*name, *(told[name].get(c) for c in cuts)) for name in histogram.groups]
    limits = T.StructType([*fields, *[T.StructField(c, T.StringType()) for c in cuts]])
    return F.broadcast(df.sparkSession.createDataFrame(rows, limits))


def _placed(
    df: DataFrame, group: list[str], ident: str, seed: int, tie: list[str] | None, cuts: Cuts, names: list[str]
) -> DataFrame | None:
    """``df`` with ``_hash`` and the limits of its group; None for too many groups."""
    key = _key(df, ident, seed, tie, whole=False)
    histogram = _histogram(df, group, ident, key)
    if histogram is None:
        return None
    if histogram.nulls:
        key = _key(df, ident, seed, tie, whole=True)
        histogram = _histogram(df, group, ident, key)
    if not histogram.groups:
        return df.withColumns({"_hash": key} | {c: F.lit(None).cast("string") for c in names})
    limits = _limits(df, group, key, histogram, cuts(histogram.sizes))
    return same_keys(df.withColumn("_hash", key), limits, group)


def _placed_by_joins(
    df: DataFrame, group: list[str], ident: str, seed: int, tie: list[str] | None, ranks: dict[str, Column]
) -> DataFrame:
    """The same for any number of groups; ``ranks`` are expressions over ``_size`` and the groups."""
    whole = not df.filter(F.col(ident).isNull()).isEmpty()
    hashes = df.withColumn("_hash", _key(df, ident, seed, tie, whole))
    keyed = hashes.select(*group, "_hash").withColumn("_prefix", F.substring("_hash", 1, PREFIX))
    upto = W.partitionBy(*group).orderBy("_prefix")
    histogram = (
        keyed.groupBy(*group, "_prefix")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_size", F.sum("_n").over(W.partitionBy(*group)))
        .withColumn("_before", F.col("_upto") - F.col("_n"))
    )
    wanted = F.array(*[F.struct(F.lit(c).alias("cut"), r.cast("long").alias("rank")) for c, r in ranks.items()])
    first = (F.col("_before") == 0) & (F.col("rank") <= 0)
    holds = (F.col("_before") < F.col("rank")) & (F.col("rank") <= F.col("_upto"))
    hits = (
        histogram.select("*", F.explode(wanted).alias("_c"))
        .select("*", "_c.*")
        .filter(first | holds)
        .select(*group, "_prefix", "cut", (F.col("rank") - F.col("_before")).alias("_rest"))
    )
    within = W.partitionBy(*group, "cut").orderBy("_hash")
    ranked = (
        join_small(keyed, hits, [*group, "_prefix"])
        .groupBy(*group, "cut", "_rest", "_hash")
        .agg(F.count("*").alias("_n"))
        .withColumn("_at", F.sum("_n").over(within))
    )
    rest = F.greatest(F.col("_rest"), F.lit(1))
    reached = ranked.filter((F.col("_at") >= rest) & (F.col("_at") - F.col("_n") < rest))
    limit = F.when(F.col("_rest") <= 0, "").otherwise(F.col("_hash"))
    limits = reached.groupBy(*group).agg(*[F.max(F.when(F.col("cut") == c, limit)).alias(c) for c in ranks])
    return join_small(hashes, limits, group)


def split_rows(
    df: DataFrame,
    group: list[str],
    ident: str = "id",
    seed: int = 42,
    train: int = 80,
    val: int = 10,
    tie: list[str] | None = None,
) -> DataFrame:
    """``split`` = train / val / test with shares in percent, rounded down, per group.

    Exact where the id, with the ``tie`` columns, is unique or NULL; copies stay together.
    """
    names = ["_train", "_val"]

    def cuts(sizes: dict[tuple, int]) -> dict[str, dict[tuple, int]]:
        shares = {"_train": train, "_val": train + val}
        return {cut: {name: n * share // 100 for name, n in sizes.items()} for cut, share in shares.items()}

    placed = _placed(df, group, ident, seed, tie, cuts, names)
    if placed is None:
        size = F.col("_size")
        ranks = {"_train": F.floor(size * train / 100), "_val": F.floor(size * (train + val) / 100)}
        placed = _placed_by_joins(df, group, ident, seed, tie, ranks)
    h = F.col("_hash")
    name = F.when(h <= F.col("_train"), "train").when(h <= F.col("_val"), "val").otherwise("test")
    return placed.withColumn("split", name).select(*df.columns, "split")


def quotas_of(sizes: dict[tuple, int], cap: int | None, fraction: float) -> dict[tuple, int]:
    """``strata_quotas`` from the sizes of a few strata."""
    total = sum(sizes.values())
    target = math.ceil(fraction * total)
    target = target if cap is None else min(cap, target)
    quotas = {name: target * n // total for name, n in sizes.items()}
    order = sorted(sizes, key=lambda name: (-(target * sizes[name] % total), [(v is not None, v) for v in name]))
    for name in order[: target - sum(quotas.values())]:
        quotas[name] += 1
    return quotas


def strata_quotas(df: DataFrame, strata: list[str], cap: int | None, fraction: float) -> DataFrame:
    """Rows to take per stratum: the smaller of cap and the rounded-up fraction of all rows,
    shared out in proportion; what rounding leaves goes to the largest remainders."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("n"))
    everything = W.partitionBy(F.lit(0))
    share = F.ceil(F.lit(fraction) * F.col("total")).cast("long")
    target = share if cap is None else F.least(F.lit(cap).cast("long"), share)
    exact = F.col("target").cast("decimal(19,0)") * F.col("n").cast("decimal(19,0)")
    counted = (
        sizes.withColumn("total", F.sum("n").over(everything))
        .withColumn("target", target)
        .withColumn("whole", F.floor(exact / F.col("total")).cast("long"))
        .withColumn("rest", (exact % F.col("total")).cast("long"))
        .withColumn("left", F.col("target") - F.sum("whole").over(everything))
    )
    order = everything.orderBy(F.desc("rest"), *strata)
    extra = (F.row_number().over(order) <= F.col("left")).cast("long")
    return counted.select(*strata, "n", (F.col("whole") + extra).alias("quota"))


def stratified_sample(
    df: DataFrame,
    strata: list[str],
    ident: str = "id",
    seed: int = 42,
    cap: int | None = 20_000,
    fraction: float = 0.05,
    tie: list[str] | None = None,
) -> DataFrame:
    """The quota of each stratum, in hash order; copies of the id at the cut all come along."""
    placed = _placed(
        df, strata, ident, seed, tie, lambda sizes: {"_limit": quotas_of(sizes, cap, fraction)}, ["_limit"]
    )
    if placed is None:
        quotas = strata_quotas(df, strata, cap, fraction).select(*strata, F.col("quota").alias("_quota"))
        sized = join_small(df, quotas, strata)
        # The quota is one value per stratum, so grouping by it as well changes nothing.
        placed = _placed_by_joins(sized, [*strata, "_quota"], ident, seed, tie, {"_limit": F.col("_quota")})
    return placed.filter(F.col("_hash") <= F.col("_limit")).select(*df.columns)


def error_sample(
    errors: DataFrame, keys: list[str], ident: str = "id", k: int = 50, seed: int = 0
) -> DataFrame:
    """At most ``k`` rows per group and error type, the same ones on every run."""
    return top_k(errors, [*keys, "error_type"], [hashed(ident, seed), F.col(ident)], k)


def error_topk(errors: DataFrame, keys: list[str], k: int = 10, ident: str = "id") -> DataFrame:
    """The ``k`` errors per group with the widest margin between score and threshold."""
    margins = errors.withColumn("margin", F.abs(F.col("y_prob") - F.col("best_threshold")))
    return top_k(margins, keys, [F.desc("margin"), F.col(ident)], k)
