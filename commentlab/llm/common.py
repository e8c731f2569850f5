"""Shared helpers: bounded Arrow chunks, byte views of texts, folds, graph components."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Hashable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commentlab.session import materialise

# Bytes of text that a task handles at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 1 << 18
# A side is broadcast up to this many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000


def kept(key: Hashable, make: Callable):
    """What ``make`` gives, made once in the life of a Python worker and shared by its tasks.

    Functions travel by value, so a global of theirs would be new in every task.
    """
    held = sys.modules.setdefault("_commentlab_kept", ModuleType("_commentlab_kept")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def forget() -> None:
    """Drops what the worker keeps, in tasks that need the room and none of it."""
    sys.modules.pop("_commentlab_kept", None)
    pa.default_memory_pool().release_unused()


def release() -> None:
    """Gives memory that is free back to the system, at the end of a task whose worker lives on."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; NULL for a NULL id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % n


def is_fold(doc_id: str | Column, n: int, k: int) -> Column:
    """Whether the id falls in fold ``k`` of ``n``; false for a NULL id."""
    return F.coalesce(fold(doc_id, n) == k, F.lit(False))


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``limit`` bytes in column ``text``, or one row."""
    column = batch.column(text)
    ends = np.cumsum(np.diff(_offsets(column)))
    start, n = 0, batch.num_rows
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _offsets(column: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind, column.offset + len(column) + 1)
    return offsets[column.offset :].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the n + 1 offsets; a NULL text is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = _offsets(column)
    data = column.buffers()[2]
    everything = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return everything[offsets[0] : offsets[-1]], offsets - offsets[0]


def per_text(values: np.ndarray, offsets: np.ndarray, add: np.ufunc = np.add, empty=0) -> np.ndarray:
    """``add`` over each text's own slice of ``values``; ``empty`` where a text has none."""
    n = len(offsets) - 1
    out = np.full((n, *values.shape[1:]), empty, values.dtype if add is not np.add else np.float64)
    full = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(full):
        out[full] = add.reduceat(values, offsets[:-1][full], axis=0, dtype=out.dtype)
    return out


def map_chunks(
    df: DataFrame,
    text: str,
    work: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    schema: str,
    limit: int = CHUNK_BYTES,
) -> DataFrame:
    """``work`` on bounded slices of ``df``; ``open`` attributes build per-task state once."""
    at = df.columns.index(text)
    prepare = getattr(work, "prepare", None)

    def run(batches):
        act = prepare() if prepare else work
        for batch in batches:
            for part in chunks(batch, at, limit):
                out = act(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def small_enough(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` (narrow rows) has at most ``rows`` rows; counted, not collected."""
    return df.limit(rows + 1).count() <= rows


def semi_by_id(big: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``big`` with (or, for an anti join, without) their key in ``ids``.

    Ids are broadcast only when counted to be few; beyond that both sides are shuffled. The
    rows are the same either way.
    """
    if small_enough(ids):
        return big.join(F.broadcast(ids), key, how)
    return big.join(ids.hint("shuffle_merge"), key, how)


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node in ``edges`` (u, v); root is the least node it can reach.

    Alternating large-star and small-star rounds: each round is two map-side combined minima
    and two joins on node keys, stored in the shared folder, so a lost executor costs a
    re-read. Ends when a round changes nothing, after a number of rounds that grows with the
    logarithm of the longest chain.
    """
    now = materialise(
        edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        name,
    )
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (
            both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = materialise(small, name)


def whole_groups(batches, keys: int):
    """Tables made of whole groups of rows with equal first ``keys`` columns, and their bounds.

    The input is sorted by these columns; a group is carried over until it has ended.
    """
    carried = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if carried is not None:
            table = pa.concat_tables([carried, table])
        bounds = _bounds(table, keys)
        if len(bounds) > 2:
            yield table.slice(0, bounds[-2]).combine_chunks(), bounds[:-1]
            carried = table.slice(bounds[-2])
        else:
            carried = table
    if carried is not None:
        yield carried.combine_chunks(), _bounds(carried, keys)


def _bounds(table: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    for i in range(keys):
        c = np.asarray(table.column(i))
        change[1:] |= c[1:] != c[:-1]
    return np.concatenate([[0], np.flatnonzero(change), [table.num_rows]])


def whole_column(table: pa.Table, i: int) -> pa.Array:
    """A column as one array."""
    return pa.concat_arrays(table.column(i).chunks)


def in_blocks(
    rows: DataFrame, key: str, member: str, block: int, weight: str | None = None, block_weight: int = 1
) -> DataFrame:
    """Rows with columns own, a, b added: a group within ``block`` once (0, 0), a larger one by block pairs.

    With a ``weight`` column, blocks also hold about ``block_weight`` of it at most. Sizes come
    from a map-side combined count, so a hot group is never in one task.
    """
    parts = F.ceil(F.count("*") / block)
    if weight:
        # blocks never outnumber the members
        parts = F.greatest(parts, F.least(F.count("*"), F.ceil(F.sum(weight) / block_weight)))
    large = rows.groupBy(key).agg(parts.cast("int").alias("_blocks")).filter("_blocks > 1")
    marked = rows.join(large.select(key, "_blocks"), key, "left")
    own = F.pmod(F.xxhash64(member, F.lit(11)), F.col("_blocks")).cast("int")
    pairs = F.when(F.col("_blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_blocks") - 1))
    return (
        marked.withColumn("_own", F.when(F.col("_blocks").isNull(), 0).otherwise(own))
        .withColumn("_other", F.explode(pairs))
        .withColumn("a", F.least("_own", "_other"))
        .withColumn("b", F.greatest("_own", "_other"))
        .drop("_blocks", "_other")
        .withColumnRenamed("_own", "own")
    )


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


# A random odd base and its inverse modulo 2**64, for hashes of byte strings.
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the base and of its inverse, grown when a longer chunk arrives."""

    def __init__(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        while len(self.up) < n:
            for name, base in (("up", BASE), ("down", INVERSE)):
                old = getattr(self, name)
                step = np.uint64(pow(base, len(old), 1 << 64))
                setattr(self, name, np.concatenate([old, old * step]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of each byte string ``data[start:end]``, whatever its position."""
    powers.to(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers.up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers.down[starts])


# [\x20\x09-\x0D]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte spans of all words, and per text the number of the first word (n + 1 values)."""
    solid = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], solid[:-1]]) if len(data) else solid
    after = np.concatenate([solid[1:], [False]]) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | cut[:-1]))
    ends = np.flatnonzero(solid & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
