"""Exact vector joins: top-k inner products by a Voronoi join, near duplicates by a metric range join.

Both cut space by pivots, a bounded sample of the vectors, and learn from summaries how far a
cell reaches. In the top-k join, what cannot matter to a cell is not sent there; in the range join
each vector is stored once and blocks of cells are read again by every task that needs them, so its
disk does not grow with the number of cells a vector may have partners in. Cells are cut further
into blocks, so neither a hot cell nor a hot copy is held whole. Pivots decide cost only: every
vector takes part, and all results are exact.

Defined results: vectors that are NULL, empty, or hold NULL or non-finite components take no part
(for cosines, zero vectors neither), nor do rows without an id; vectors of different lengths are
never compared. Columns other than id, vector and label are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentlab.llm import common
from commentlab.session import discard, materialise, new_path

# Vectors of either side that a task compares at a time.
BLOCK = 2048
# Distinct vectors per pivot of the range join, and components of all its pivots at most.
PER_PIVOT, PIVOT_COMPONENTS = 2048, 1 << 22
# Buckets for vectors of labels without a pivot.
LOOSE = 4096
# Components of a block of the range join: at most, at least where there are cores for it, and taken from a batch at a time.
HELD, LEAST_HELD, SLICE = 8 << 20, 1 << 16, 1 << 21
# Components that vectors are compared by first, the length of the rest among them.
BRIEF = 16
# Pairs of blocks joined by one job.
PAIRS = 128
# Queries per group, queries and candidates per task of the top-k join.
GROUP, QUERIES, CANDIDATES = 512, 2048, 16_384


def _usable(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision, or None."""
    out = []
    for value in column:
        if not value.is_valid or value.values is None or not len(value.values) or value.values.null_count:
            out.append(None)
            continue
        v = np.asarray(value.values, np.float64)
        out.append(v if np.isfinite(v).all() else None)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _by_length(columns: pa.Array) -> dict[int, np.ndarray]:
    """Row numbers of the binary vectors of each length."""
    lengths = np.array([len(x) // 8 for x in columns.to_pylist()])
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _pivots(rows: DataFrame, key: str, n: int, most: int, per: int) -> list:
    """A hash sample of about ``n / per`` rows, at most about ``most``."""
    every = max(per, math.ceil(n / most))
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(every)) == 0).collect()


# ---------------------------------------------------------------- near duplicates


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = 0.98
) -> DataFrame:
    """vec_id, n_links, component_id, kept: links between vectors of one label with cosine >= ``least``.

    On unit vectors that is a distance of at most ``eps = sqrt(2 - 2 * least)``. Equal vectors of a
    label become one entry with a count. Each entry belongs to the cell of its nearest pivot. Of two
    entries of different cells within ``eps``, each lies at most ``eps`` beyond the bisector of both
    pivots, so only those of either cell are compared. Cells that stand together are stored as a
    block, once; a task reads two blocks of a label that have cells near enough. It compares in
    single precision and decides by double precision what that leaves open. Copies of vectors and
    rows with repeated ids count each. Emitted edges are a spanning forest per pair of blocks.

    ``vectors`` is read three times: write it first if it is expensive to derive.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), F.col(label).alias("label"))
    kinds = dict(rows.dtypes)
    kind, stored = kinds["vec_id"], np.float32 if kinds["v"] == "array<float>" else np.float64
    eps = math.sqrt(max(2 - 2 * least, 0.0)) + 1e-7

    def sample(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, names, which, entry, x in _entries(batch):
                for i in np.flatnonzero(common.mix(entry) % np.uint64(PER_PIVOT) == 0).tolist():
                    if entry[i] in seen:
                        continue
                    if len(seen) < PER_PIVOT:
                        seen.add(entry[i])
                    yield pa.record_batch(
                        [pa.array([entry[i]]), pa.array([names[which[i]]]), pa.array([x.shape[1]], pa.int32()), pa.array([x[i].tobytes()])],
                        names=["entry", "part", "d", "v"],
                    )

    some = rows.mapInArrow(sample, "entry long, part string, d int, v binary").dropDuplicates(["entry"])
    some = materialise(some, "pivots")
    every = math.ceil((some.agg(F.sum("d")).first()[0] or 0) / PIVOT_COMPONENTS)
    if every > 1:
        some = some.filter(F.pmod(F.xxhash64("entry", F.lit(5)), F.lit(every)) == 0)
    cells = _Cells(some.collect())

    def describe(batches):
        for batch in batches:
            told = np.zeros(batch.num_rows, bool)
            columns = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int32, np.float32, np.int32)]
            for at, names, which, entry, x in _entries(batch):
                told[at] = True
                slot, gap = cells.place(names, which, x)
                for column, values in zip(columns, (entry, slot, gap, x.shape[1]), strict=True):
                    column[at] = values
            yield pa.record_batch(
                [batch.column(0), *(pa.array(c, mask=~told) for c in columns)], names=["vec_id", "entry", "slot", "gap", "d"]
            )

    told = materialise(rows.mapInArrow(describe, f"vec_id {kind}, entry long, slot int, gap float, d int"), "vectors")
    entries = told.filter("entry is not null").groupBy("entry").agg(
        F.min("vec_id").alias("least_id"), F.count("*").alias("copies"),
        F.max("slot").alias("slot"), F.max("gap").alias("gap"), F.max("d").alias("d"),
    )
    entries = materialise(entries, "entries")
    sizes = entries.groupBy("slot").agg(F.max("gap").alias("gap"), F.sum("d").alias("size")).collect()
    first, parts, pairs = cells.blocks({r["slot"]: (r["gap"], r["size"]) for r in sizes}, eps, spark.sparkContext.defaultParallelism)

    def send(batches):
        for batch in batches:
            for _, names, which, entry, x in _entries(batch):
                # copies in a batch are one row
                entry, one, copies = np.unique(entry, return_index=True, return_counts=True)
                which, x = which[one], x[one]
                slot, _ = cells.place(names, which, x)
                own = (common.mix(entry) >> np.uint64(32)).astype(np.int64) % parts[slot]
                yield pa.record_batch(
                    [
                        pa.array((first[slot] + own).astype(np.int32)),
                        pa.array(slot.astype(np.int32)),
                        pa.array(_digests(names)[which]),
                        pa.array(entry),
                        pa.array(copies.astype(np.int64)),
                        _binary(x.astype(stored)),
                    ],
                    names=["block", "slot", "part", "entry", "n", "v"],
                )

    schema = "block int, slot int, part long, entry long, n long, v binary"
    path = new_path(spark, "vector_blocks")
    rows.mapInArrow(send, schema).hint("rebalance", "block").write.mode("error").partitionBy("block").parquet(path)
    blocks = spark.read.schema(schema).parquet(path).select("block", "slot", "part", "entry", "n", "v")

    def join(batches):
        for held in _runs(batches):
            # vectors of different lengths are never compared
            pair = int(held[0].column(0)[0].as_py())
            for group in _sorted_rows(held, stored):
                yield from _Pair(pair >> 32, pair & 0xFFFFFFFF, *group, cells, least, eps).solve()

    found = []
    for at in range(0, len(pairs), PAIRS):
        # a union of nothing but single partitions would be one partition, so there is another, empty, side
        none = (F.lit(None).cast(t).alias(c) for c, t in blocks.dtypes)
        legs = [spark.range(2).filter("id < 0").select(F.col("id").alias("pair"), *none)]
        for a, b in pairs[at : at + PAIRS]:
            leg = blocks.filter(F.col("block").isin(a, b)).coalesce(1)
            legs.append(leg.select(F.lit(a << 32 | b).cast("long").alias("pair"), *blocks.columns))
        found.append(materialise(reduce(DataFrame.union, legs).mapInArrow(join, "u long, v long, n long"), "vector_links"))
    found = reduce(DataFrame.union, found) if found else spark.createDataFrame([], "u long, v long, n long")
    discard(spark, path)

    links = found.filter("u = v").groupBy(F.col("u").alias("entry")).agg(F.sum("n").alias("n"))
    roots = common.components(found.filter("u <> v").select("u", "v"), "vector_components")
    roots = roots.join(entries.select(F.col("entry").alias("node"), "least_id"), "node")
    least_ids = roots.groupBy("root").agg(F.min("least_id").alias("component_id"))
    roots = roots.join(least_ids, "root").select(F.col("node").alias("entry"), "component_id")
    named = entries.select("entry", "least_id", "copies").join(links, "entry", "left").join(roots, "entry", "left")
    # an entry of one row without links is its own component
    named = named.filter("copies > 1 or n is not null").select(
        "entry",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "least_id").alias("component_id"),
    )
    out = told.select("vec_id", "entry").join(named, "entry", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _entries(batch: pa.RecordBatch):
    """Usable rows of (id, vector, label) by length: row numbers, names of parts and which each is of, digests,
    vectors in double precision."""
    values = len(batch.column(1).values) if batch.num_rows else 0
    step = max(1, SLICE * batch.num_rows // max(values, 1))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        column, labels = part.column(1), part.column(2).dictionary_encode()
        offsets = np.asarray(column.offsets).astype(np.int64)
        flat = column.values.slice(offsets[0], offsets[-1] - offsets[0]).cast(pa.float64(), safe=False)
        flat = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
        usable = np.asarray(column.is_valid()) & np.asarray(labels.is_valid()) & np.asarray(part.column(0).is_valid())
        lengths = np.where(usable, np.diff(offsets), 0)
        which = np.asarray(labels.indices.fill_null(0))
        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.flatnonzero(lengths == n)
            x = flat.reshape(-1, n) if len(at) * n == len(flat) else flat[(offsets[at] - offsets[0])[:, None] + np.arange(n)]
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            at, x = at[good], x[good] + 0.0
            if len(at):
                parts = [f"{name}/{n}" for name in labels.dictionary.to_pylist()]
                heads, data, width = [a.encode() + b"|" for a in parts], x.tobytes(), 8 * n
                keys = [
                    hashlib.blake2b(heads[a] + data[i * width : (i + 1) * width], digest_size=8).digest()
                    for i, a in enumerate(which[at].tolist())
                ]
                yield start + at, parts, which[at], np.frombuffer(b"".join(keys), np.int64), x


def _digests(names: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(a.encode(), digest_size=8).digest() for a in names), np.int64)


def _binary(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(x))])


def _directions(d: int) -> np.ndarray:
    """A few directions at right angles to each other, the same ones in every task."""
    return np.linalg.qr(np.random.default_rng(5).normal(size=(d, BRIEF - 1)))[0]


def _slack(d: int) -> float:
    """More than a product of two unit vectors of ``d`` components is off in single precision."""
    return (d + 8) * 2.0**-22


class _Cells:
    """Cells of the parts that have pivots, numbered so that near ones stand together; the other parts share buckets."""

    def __init__(self, sampled: list):
        by_part: dict[tuple[int, str], list] = {}
        for r in sampled:
            v = np.frombuffer(r["v"], np.float64)
            by_part.setdefault((r["d"], r["part"]), []).append(v / _norm(v))
        self.parts: dict[str, tuple[int, int]] = {}
        units: dict[int, list] = {}
        self.start: dict[int, int] = {}
        self.n = 0
        for d, part in sorted(by_part):
            p = _ordered(np.unique(np.array(by_part[d, part]), axis=0))
            self.start.setdefault(d, self.n)
            units.setdefault(d, []).append(p)
            self.parts[part] = (self.n, self.n + len(p))
            self.n += len(p)
        self.units = {d: np.concatenate(ps) for d, ps in units.items()}

    def pivots(self, d: int, slots) -> np.ndarray:
        return self.units[d][slots - self.start[d]]

    def place(self, names: list[str], which: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell or bucket of each vector, and the distance to the cell's pivot; equal vectors get the same ones."""
        slot, gap = np.zeros(len(x), np.int64), np.full(len(x), 2.0)
        order, counts = np.argsort(which, kind="stable"), np.bincount(which, minlength=len(names))
        for part, own in zip(names, np.split(order, np.cumsum(counts)[:-1]), strict=True):
            if part not in self.parts:
                slot[own] = self.n + zlib.crc32(part.encode()) % LOOSE
                continue
            low, high = self.parts[part]
            p = self.pivots(x.shape[1], np.arange(low, high))
            step = max(1, min(BLOCK, (1 << 22) // len(p)))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                unit = x[some] / _norm(x[some])[:, None]
                near = _nearest(unit, p)
                slot[some] = low + near
                gap[some] = np.sqrt(((unit - p[near]) ** 2).sum(axis=1))
        return slot, gap

    def blocks(self, sizes: dict[int, tuple[float, int]], eps: float, cores: int):
        """First block and number of blocks of each slot, and the pairs of blocks that may hold partners.

        ``sizes`` has the largest distance to the pivot and the components of each slot in use.
        """
        most = max(LEAST_HELD, min(HELD, math.ceil(sum(size for _, size in sizes.values()) / (2 * cores))))
        first, parts = np.zeros(self.n + LOOSE, np.int64), np.ones(self.n + LOOSE, np.int64)
        block, room, pairs = -1, 0, set()
        for slot in sorted(sizes):
            size = sizes[slot][1]
            if size > room:
                block, room = block + 1, most
            first[slot], parts[slot] = block, max(1, math.ceil(size / most))
            block, room = block + parts[slot] - 1, room - size if parts[slot] == 1 else 0
            own = range(int(first[slot]), int(first[slot] + parts[slot]))
            pairs |= {(a, b) for a in own for b in own if a <= b}
        for d, p in self.units.items():
            for low, high in (ends for part, ends in self.parts.items() if int(part.rsplit("/", 1)[1]) == d):
                used = np.array([s for s in range(low, high) if s in sizes], np.int64)
                if not len(used) or first[used[0]] == first[used[-1]] + parts[used[-1]] - 1:
                    continue
                units, reach = p[used - self.start[d]], np.array([sizes[s][0] for s in used.tolist()])
                for at, slot in enumerate(used.tolist()):
                    apart = np.sqrt(np.maximum(2 - 2 * (units @ units[at]), 0))
                    near = used[apart <= reach + reach[at] + eps + 1e-6]
                    cut = [np.arange(first[s], first[s] + parts[s]) for s in near[parts[near] > 1].tolist()]
                    theirs = np.unique(np.concatenate([first[near], *cut])).tolist()
                    for own in range(int(first[slot]), int(first[slot] + parts[slot])):
                        pairs.update((min(own, b), max(own, b)) for b in theirs)
        return first, parts, sorted((int(a), int(b)) for a, b in pairs)


def _ordered(p: np.ndarray) -> np.ndarray:
    """The rows of ``p`` so that near ones stand together: halved again and again between two far ones."""
    if len(p) <= 2:
        return p
    far = p[np.argmin(p @ p[0])]
    by = np.argsort(p @ (far - p[np.argmin(p @ far)]), kind="stable")
    half = len(p) // 2
    return np.concatenate([_ordered(p[by[:half]]), _ordered(p[by[half:]])])


def _nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Number of the pivot nearest to each unit vector; it depends on no other vector, whatever the rounding."""
    cos = x.astype(np.float32) @ p.astype(np.float32).T
    rows, out, least = np.arange(len(x)), cos.argmax(axis=1), -2 * _slack(x.shape[1])
    most = cos[rows, out]
    cos -= most[:, None]
    cos[rows, out] = -4
    for i in np.flatnonzero(cos.max(axis=1) >= least).tolist():
        some = np.union1d(np.flatnonzero(cos[i] >= least), out[i])
        out[i] = some[np.argmax([math.fsum(row) for row in (p[some] * x[i]).tolist()])]
    return out


def _runs(batches):
    """The batches of each run of rows with one number in the first column."""
    held, number = [], None
    for batch in batches:
        numbers = np.asarray(batch.column(0))
        cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts[:-1], cuts[1:], strict=True):
            if stop == start:
                continue
            if held and numbers[start] != number:
                yield held
                held = []
            number = numbers[start]
            held.append(batch.slice(start, stop - start))
    if held:
        yield held


def _sorted_rows(held: list[pa.RecordBatch], kind) -> list[tuple]:
    """(block, slot, part, entry, n, vectors) of the rows of each length, sorted; rows of one entry are added up."""
    sizes = [np.diff(common._offsets(b.column(6))) for b in held]
    out = []
    for size in np.unique(np.concatenate(sizes)).tolist():
        columns = [[], [], [], [], [], []]
        for batch, own in zip(held, sizes, strict=True):
            at = np.flatnonzero(own == size)
            data, offsets = common.text_bytes(batch.column(6))
            if len(at) == len(own):
                x = data.view(kind).reshape(len(own), -1)
            else:
                x = data[offsets[at][:, None] + np.arange(size)].view(kind)
            for c, column in enumerate(columns[:5]):
                column.append(np.asarray(batch.column(c + 1))[at])
            columns[5].append(x)
        block, slot, part, entry, n, x = (np.concatenate(c) for c in columns)
        order = np.lexsort((entry, block, slot, part))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(entry[order]) != 0) | (np.diff(slot[order]) != 0) | (np.diff(block[order]) != 0)
        n = np.add.reduceat(n[order], np.flatnonzero(new))
        order = order[new]
        out.append((block[order], slot[order], part[order], entry[order], n, x[order]))
    held.clear()
    return out


class _Pair:
    """The links between the vectors of one length in a pair of blocks, or within a block."""

    def __init__(self, low: int, high: int, block, slot, part, entry, n, x, cells: _Cells, least: float, eps: float):
        self.entry, self.n, self.x, self.cells, self.least, self.eps = entry, n.astype(np.float64), x, cells, least, eps
        self.slack = _slack(x.shape[1])
        self.unit = np.empty(x.shape, np.float32)
        self.brief = np.empty((len(x), BRIEF), np.float32) if x.shape[1] > 2 * BRIEF else None
        directions = _directions(x.shape[1]) if self.brief is not None else None
        for at in range(0, len(x), BLOCK):
            unit = self.double(np.arange(at, min(at + BLOCK, len(x))))
            self.unit[at : at + BLOCK] = unit
            if self.brief is not None:
                some = unit @ directions
                rest = np.sqrt(np.maximum(1 - (some * some).sum(axis=1), 0) + self.slack)
                self.brief[at : at + BLOCK] = np.column_stack([some, rest])
        self.room = np.empty(min(len(x), BLOCK) ** 2, np.float32)
        change = np.flatnonzero((np.diff(block) != 0) | (np.diff(slot) != 0) | (np.diff(part) != 0)) + 1
        bounds = [0, *change.tolist(), len(x)]
        self.sides: dict[int, tuple[list, list]] = {}
        self.whole = low == high
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            side = self.sides.setdefault(int(part[start]), ([], []))
            side[int(block[start] != low)].append((int(slot[start]), start, stop))
        self.links, self.parent, self.edges = np.zeros(len(x)), np.arange(len(x)), []

    def double(self, at: np.ndarray) -> np.ndarray:
        x = self.x[at].astype(np.float64)
        return x / _norm(x)[:, None]

    def solve(self):
        for left, right in self.sides.values():
            if self.whole:
                right = left
            if not left or not right:
                continue
            if self.whole:
                for _, start, stop in left:
                    self.compare(np.arange(start, stop), None)
            if len(left) > 1 or len(right) > 1 or left[0][0] != right[0][0]:
                self.cross(left, right)
            elif not self.whole:
                self.compare(*(np.arange(start, stop) for _, start, stop in (left[0], right[0])))
        known = np.flatnonzero(self.links > 0)
        edges = np.array(self.edges, np.int64).reshape(-1, 2)
        u, v = (np.concatenate([self.entry[known], self.entry[edges[:, i]]]) for i in (0, 1))
        n = np.concatenate([self.links[known].astype(np.int64), np.zeros(len(edges), np.int64)])
        if len(u):
            yield pa.record_batch([pa.array(u), pa.array(v), pa.array(n)], names=["u", "v", "n"])

    def cross(self, left: list, right: list) -> None:
        """Different cells of a part: what of either lies near enough to the other."""
        slots = [np.array([s for s, _, _ in side]) for side in (left, right)]
        p, q = (self.cells.pivots(self.x.shape[1], s) for s in slots)
        theirs = [self.beyond(start, stop, q[j], p)[0] for j, (_, start, stop) in enumerate(right)]
        for i, (slot, start, stop) in enumerate(left):
            mine, most = self.beyond(start, stop, p[i], q)
            for j in np.flatnonzero((mine <= most[:, None]).any(axis=1)).tolist():
                if self.whole and j <= i:
                    continue
                begin, end = right[j][1:]
                if right[j][0] == slot:
                    self.compare(np.arange(start, stop), np.arange(begin, end))
                    continue
                rows, cols = np.flatnonzero(mine[j] <= most[j]), np.flatnonzero(theirs[j][i] <= most[j])
                # both distances add up to eps at most, so one of them is at most half of it
                half = most[j] / 2 + self.slack
                low, near = mine[j][rows] <= half, theirs[j][i][cols] <= half
                self.compare(start + rows[low], begin + cols)
                self.compare(start + rows[~low], begin + cols[near])

    def beyond(self, start: int, stop: int, own: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far each vector of a cell is from the bisector with each other cell, a row per cell, times the
        distance of the pivots; and up to where it may have a partner there."""
        most = self.eps * np.sqrt(np.maximum(2 - 2 * (others @ own), 0)) + 2 * self.slack
        return (own - others).astype(np.float32) @ self.unit[start:stop].T, most.astype(np.float32)

    def compare(self, rows: np.ndarray, cols: np.ndarray | None) -> None:
        """Links between two sets of vectors, or within one."""
        for at in range(0, len(rows), BLOCK):
            r = rows[at : at + BLOCK]
            others = rows[at:] if cols is None else cols
            for other in range(0, len(others), BLOCK):
                self.decide(r, others[other : other + BLOCK], cols is None)

    def decide(self, r: np.ndarray, c: np.ndarray, ordered: bool) -> None:
        """Links between few vectors; where ``ordered``, from each to those after it."""
        if self.brief is not None:
            # no product of two vectors is larger than that of their components along some
            # directions and of the lengths of their rests
            most = self.products(self.brief, r, c)
            if most.max() < self.least - 2 * self.slack:
                return
            some = most >= self.least - 2 * self.slack
            r, c = r[some.any(axis=1)], c[some.any(axis=0)]
        cos = self.products(self.unit, r, c)
        if cos.max() < self.least - self.slack:
            return
        near = cos >= self.least + self.slack
        i, j = np.nonzero((cos >= self.least - self.slack) & ~near)
        if ordered:
            near &= r[:, None] < c[None, :]
            i, j = (x[r[i] < c[j]] for x in (i, j))
        for at in range(0, len(i), BLOCK):
            a, b = i[at : at + BLOCK], j[at : at + BLOCK]
            near[a, b] = (self.double(r[a]) * self.double(c[b])).sum(axis=1) >= self.least
        lines, columns = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
        if not len(lines):
            return
        near, r, c = near[np.ix_(lines, columns)], r[lines], c[columns]
        weigh = near.astype(np.float64)
        self.links[r] += weigh @ self.n[c]
        self.links[c] += self.n[r] @ weigh
        self.unite(near, r, c)

    def products(self, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of each of two sets of rows with each; overwritten by the next call."""
        return np.matmul(x[r], x[c].T, out=self.room[: len(r) * len(c)].reshape(len(r), len(c)))

    def unite(self, near: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> None:
        """Joins the trees of near vectors; an edge for every tree that ends."""
        roots = self.roots(np.concatenate([rows, cols]))
        if (roots == roots[0]).all():
            return
        for i in range(len(rows)):
            roots = np.unique(self.roots(np.append(cols[near[i]], rows[i])))
            if len(roots) > 1:
                self.parent[roots[1:]] = roots[0]
                self.edges.extend((x, int(roots[0])) for x in roots[1:].tolist())

    def roots(self, at: np.ndarray) -> np.ndarray:
        root = self.parent[at]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[at] = root
                return root
            root = up


def _norm(x: np.ndarray):
    """Length of the last axis, safe for very large and very small components."""
    top = np.abs(x).max(axis=-1, keepdims=True)
    return (np.sqrt(((x / top) ** 2).sum(axis=-1, keepdims=True)) * top)[..., 0]


# ---------------------------------------------------------------- top-k inner products


def top_products(
    vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5, scale: float = 256.0
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest products of each query with other rows.

    Components become floor(scale * x); scores are exact integers, equal scores go to the smaller
    id. A repeated query id is one query; repeated rows are candidates each.

    Vectors fall into Voronoi cells; a cell tells how near its k + 1 nearest members are to its
    pivot. A query q then knows that pivot p offers products of at least ``q.p - |q| * d`` each:
    the k + 1 largest of these bound its result from below. Queries are grouped by their nearest
    group pivot g, with radius r and least bound t over the group; a vector x can matter to a
    group only if ``g.x + r * |x| >= t``, and only then is it sent there.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("v"), is_query.alias("query"))
    kind = dict(rows.dtypes)["vec_id"]

    def describe(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                usable = _usable(part.column(1))
                keep = np.array([v is not None and x.is_valid for v, x in zip(usable, part.column(0), strict=True)], bool)
                with np.errstate(over="ignore"):
                    whole = [np.floor(scale * v) if ok else None for v, ok in zip(usable, keep, strict=True)]
                keep &= np.array([w is not None and np.isfinite(w).all() for w in whole], bool)
                at = np.flatnonzero(keep)
                yield pa.record_batch(
                    [
                        part.column(0).take(pa.array(at)),
                        part.column(2).take(pa.array(at)),
                        pa.array([whole[i].tobytes() for i in at], pa.binary()),
                    ],
                    names=["vec_id", "query", "v"],
                )

    told = materialise(rows.mapInArrow(describe, f"vec_id {kind}, query boolean, v binary"), "products")
    queries = told.filter("query").dropDuplicates(["vec_id"])
    counts = told.agg(F.count("*").alias("n"), F.sum(F.col("query").cast("int")).alias("q")).first()
    n, n_queries = counts["n"], counts["q"] or 0
    groups = max(1, min(64, math.ceil(n_queries / GROUP)))
    pivots: dict[int, list] = {}
    for r in _pivots(told.select("vec_id", "v"), "vec_id", n, 512, 256):
        pivots.setdefault(len(r["v"]) // 8, []).append(np.frombuffer(r["v"], np.float64))
    pivots = {d: np.unique(np.array(vs), axis=0) for d, vs in pivots.items()}
    # nearest members of each cell, by their distance to its pivot
    nearest: dict[tuple[int, int], list[float]] = {}

    def cells(batches):
        for batch in batches:
            for d, at in _by_length(batch.column(1)).items():
                if d not in pivots:
                    continue
                gap, cell = _closest(_matrix(batch.column(1).take(pa.array(at))), pivots[d])
                for c in np.unique(cell):
                    some = np.sort(gap[cell == c])[: k + 1]
                    yield pa.record_batch(
                        [pa.array([d] * len(some), pa.int32()), pa.array([c] * len(some), pa.int32()), pa.array(some)],
                        names=["d", "cell", "gap"],
                    )

    first = Window.partitionBy("d", "cell").orderBy("gap")
    summary = told.select("vec_id", "v").mapInArrow(cells, "d int, cell int, gap double")
    for r in summary.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1).collect():
        nearest.setdefault((r["d"], r["cell"]), []).append(r["gap"])
    centres = {d: p[:: max(1, len(p) // groups)][:groups] for d, p in pivots.items()}

    def bound(batches):
        for batch in batches:
            for d, at in _by_length(batch.column(1)).items():
                some = batch.take(pa.array(at))
                q = _matrix(some.column(1))
                floor = np.full(len(q), -np.inf)
                group, radius = np.zeros(len(q), np.int64), np.full(len(q), np.inf)
                if d in pivots:
                    radius, group = _closest(q, centres[d])
                    length = np.sqrt((q * q).sum(axis=1))
                    offers = [
                        q @ pivots[d][c] - length * gap for (dim, c), gaps in nearest.items() if dim == d for gap in gaps
                    ]
                    if len(offers) > k:
                        floor = np.sort(np.array(offers), axis=0)[-k - 1]
                        floor -= 1e-6 * (1 + np.abs(floor) + length * length)
                yield pa.record_batch(
                    [some.column(0), pa.array([f"{d}/{g}" for g in group], pa.string()), pa.array(radius),
                     pa.array(floor), some.column(1)],
                    names=["vec_id", "g", "radius", "floor", "v"],
                )

    asked = materialise(
        queries.select("vec_id", "v").mapInArrow(bound, f"vec_id {kind}, g string, radius double, floor double, v binary"),
        "queries",
    )
    told_groups = {
        r["g"]: (r["radius"], r["floor"], r["n"])
        for r in asked.groupBy("g").agg(
            F.max("radius").alias("radius"), F.min("floor").alias("floor"), F.count("*").alias("n")
        ).collect()
    }

    def send(batches):
        for batch in batches:
            for d, at in _by_length(batch.column(1)).items():
                some = batch.take(pa.array(at))
                x = _matrix(some.column(1))
                length = np.sqrt((x * x).sum(axis=1))
                for g, (radius, floor, _) in told_groups.items():
                    dim, c = map(int, g.split("/"))
                    if dim != d:
                        continue
                    if np.isfinite(radius) and np.isfinite(floor):
                        reach = x @ centres[d][c] + radius * length
                        need = np.flatnonzero(reach + 1e-6 * (1 + np.abs(reach)) >= floor)
                    else:
                        need = np.arange(len(x))
                    if len(need):
                        rows_ = some.take(pa.array(need))
                        yield pa.record_batch(
                            [rows_.column(0), pa.array([g] * len(need), pa.string()), rows_.column(1)],
                            names=["vec_id", "g", "v"],
                        )

    sent = materialise(told.select("vec_id", "v").mapInArrow(send, f"vec_id {kind}, g string, v binary"), "sent")
    sizes = {r["g"]: r["count"] for r in sent.groupBy("g").count().collect()}
    slices = {g: max(1, math.ceil(m / CANDIDATES)) for g, m in sizes.items()}
    parts = {g: max(1, math.ceil(m / QUERIES)) for g, (_, _, m) in told_groups.items()}
    per_group = lambda table: F.create_map(*[F.lit(x) for kv in (table or {"": 1}).items() for x in kv])[F.col("g")]
    own = lambda table, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), per_group(table)).cast("int")
    every = lambda table: F.explode(F.sequence(F.lit(0), per_group(table) - 1))
    left = asked.select("vec_id", "g", "v", own(parts, 1).alias("p")).filter(F.col("g").isin(*sizes))
    left = left.withColumn("s", every(slices))
    right = sent.select("vec_id", "g", "v", own(slices, 2).alias("s")).withColumn("p", every(parts))

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        ids, mine = (np.asarray(t.column("vec_id")) for t in (x, q))
        out = [], [], []
        if len(ids) and len(mine):
            order = np.argsort(ids, kind="stable")
            ids = ids[order]
            data = _matrix(common.whole_column(x, x.column_names.index("v")))[order]
            asking = _matrix(common.whole_column(q, q.column_names.index("v")))
            exact = np.abs(data).max() * np.abs(asking).max() * data.shape[1] < 2**53
            if not exact:
                whole = np.vectorize(int, otypes=[object])
                data, asking = whole(data), whole(asking)
            for at in range(0, len(mine), 256):
                scores = asking[at : at + 256] @ data.T
                for i, row in enumerate(scores):
                    query = mine[at + i]
                    row = row if exact else np.clip(row, -(2**63), 2**63 - 1)
                    if exact and len(row) > 4 * (k + 1):
                        others = row.copy()
                        others[ids == query] = -np.inf
                        least = np.partition(others, -k)[-k]
                        some = np.flatnonzero(others >= least)
                    else:
                        some = np.flatnonzero(ids != query)
                    best = some[np.argsort(-row[some], kind="stable")][:k]
                    out[0].extend([query] * len(best))
                    out[1].extend(ids[best].tolist())
                    out[2].extend(int(s) for s in row[best])
        return pa.table([pa.array(c, t) for c, t in zip(out, (q.schema.field("vec_id").type, x.schema.field("vec_id").type, pa.int64()), strict=True)],
                        names=["query_id", "vec_id", "score"])

    local = (
        left.groupBy("g", "p", "s").cogroup(right.groupBy("g", "p", "s"))
        .applyInArrow(solve, f"query_id {kind}, vec_id {kind}, score long")
    )
    ranks = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(ranks)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _closest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance to, and number of, the nearest pivot."""
    square = (x * x).sum(axis=1)[:, None] - 2 * (x @ pivots.T) + (pivots * pivots).sum(axis=1)
    cell = square.argmin(axis=1)
    gap = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
    return gap, cell
