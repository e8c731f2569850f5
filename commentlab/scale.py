"""Helpers that keep joins, ranks and scans safe when one key holds much of the data."""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Rows a side may have before it is joined by shuffle instead of broadcast.
SMALL_ROWS = 50_000
# The same in bytes, for tables with long rows.
SMALL_BYTES = 256 << 20
# Rows up to which a capped table with short rows is broadcast.
CAPPED_ROWS = 2_000_000
# Spark prunes row_number() <= k before the shuffle up to this k
# (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1_000


def spread(df: DataFrame) -> DataFrame:
    """Spread a plain scan that has fewer splits than the cluster has cores.

    Only scans below one split per core are shuffled, so the moved volume is bounded by
    ``cores * split size``; a large table is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded(small: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame | None:
    """``small`` as a local relation if it has at most ``max_rows`` rows, else None.

    Rows and bytes are measured where the rows are; only a side within both bounds is fetched.
    """
    probe = small.limit(max_rows + 1).persist(StorageLevel.DISK_ONLY)
    try:
        size = F.sum(F.octet_length(F.to_json(F.struct("*")))) if small.columns else F.lit(0)
        rows, size = probe.agg(F.count("*"), size).first()
        if rows > max_rows or (size or 0) > SMALL_BYTES:
            return None
        return small.sparkSession.createDataFrame(probe.toArrow(), schema=small.schema)
    finally:
        probe.unpersist()


def within(small: DataFrame, max_rows: int, max_bytes: int = SMALL_BYTES) -> bool:
    """Whether ``small`` has at most so many rows and bytes; measured where the rows are."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, size = small.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and (size or 0) <= max_bytes


def join_capped(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", held: bool | None = None
) -> DataFrame:
    """Join ``big`` with a table that its maker caps, such as a vocabulary.

    Measured to be within ``CAPPED_ROWS`` and ``SMALL_BYTES`` (or told so by ``held``) it is
    broadcast; beyond that both sides are shuffled, the smaller one as hash tables, and adaptive
    execution splits hot keys. The rows are the same. NULL keys match each other.
    """
    held = within(small, CAPPED_ROWS) if held is None else held
    return same_keys(big, F.broadcast(small) if held else small.hint("shuffle_hash"), on, how)


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int = SMALL_ROWS,
    salts: int = 64,
) -> DataFrame:
    """Join ``big`` with a table that is expected, but not assumed, to be small.

    The size is measured first. Up to ``max_rows`` rows the side is broadcast and ``big``
    does not move. Beyond that both sides are shuffled on the key plus a salt taken from the
    row's own hash, so that one hot key is spread over ``salts`` tasks. Both ways give the
    same rows for inner, left, semi and anti joins. NULL keys match each other, as they do
    when ``small`` comes from a grouping of ``big``.
    """
    local = bounded(small, max_rows)
    if local is not None:
        return same_keys(big, F.broadcast(local), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)))
    copies = small.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    return same_keys(salted, copies, [*on, "_salt"], how).drop("_salt")


def same_keys(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on equal keys in which NULL equals NULL."""
    theirs = {key: f"_small_{key}" for key in on}
    same = [F.col(key).eqNullSafe(F.col(other)) for key, other in theirs.items()]
    joined = big.join(small.withColumnsRenamed(theirs), reduce(Column.__and__, same), how)
    return joined.drop(*theirs.values())


def top_k(
    df: DataFrame, group: list[str], order: list[Column], k: int, salts: int = 256
) -> DataFrame:
    """First ``k`` rows of each group in ``order``, which must be a total order.

    For small ``k`` Spark keeps k rows per group in every task before the shuffle. For larger
    ``k`` the groups are salted first: the overall first k are among the first k of each salt.
    """
    if k > GROUP_LIMIT:
        keys = W.partitionBy(*group, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(salts)))
            .withColumn("_rank", F.row_number().over(keys))
            .filter(F.col("_rank") <= k)
            .drop("_salt", "_rank")
        )
    ranked = df.withColumn("_rank", F.row_number().over(W.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_rank") <= k).drop("_rank")


def literal_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from a short list held by the caller (languages, lexicons, manifests)."""
    return spark.createDataFrame(rows, schema)
