"""N-gram Jaccard join with count-vector R-trees.

A document is its set of word shingles. Hashing the shingles into groups and counting them makes
it a point; two sets share at most the summed coordinate minima of their points, so an R-tree over
points (packed by size, then by coordinates; a node keeps the coordinate maxima and the size range
of what lies below) rules out all pairs whose bound is too low. Survivors are verified on the sets.

Points alone do not thin out a large corpus: every node that holds a dozen unrelated documents
reaches the bound. So R-trees are built over buckets: linked documents must share one of the first
``n - ceil(t * n) + 1`` shingles of any common order. The order here puts shingles last that a
sample of documents shows to be frequent, and is a pure function of the shingle, so the sample
decides speed, never results. The steps:

1. one pass over the texts: size, digest, point, and the routing shingles;
2. equal sets become one class; routing shingles that only one class has are dropped;
3. per bucket, the R-tree finds pairs that reach the bound; a spanning forest of them goes on;
4. the forests' components are candidate families; their members' sets are read again;
5. per family, R-tree search and exact verification, skipping what is linked already; the
   components of the verified links are the result.

Buckets and families above ``BLOCK`` members (families also above ``BLOCK_SHINGLES`` shingles) are
cut into blocks, and every pair of blocks is a group of its own, so none is held whole. All links between different texts count: a pair that
is not verified is one that other verified links connect already.

Defined results: words are cut at ASCII white space after lower-casing A-Z; a text with fewer
words than a shingle is one shingle; without words (or NULL) the set is empty and linked with
nothing; repeated rows and equal sets are linked; a row without an id takes no part and has no
component. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from commentlab.llm import common
from commentlab.session import materialise

# Coordinates of a point, and of the finer point of a set above LARGE shingles.
COARSE, FINE, LARGE = 64, 256, 512
# Bytes of the finest points that a family task holds; their groups follow the size of its sets.
FINEST_BYTES = 1 << 26
# Members of a bucket or family that one task handles at a time, and shingles of a family.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 23
# Shingles compared at a time.
COMPARED = 1 << 19
# Points under one R-tree leaf.
LEAF = 32
# Members up to which a bucket's pairs are bounded directly.
FEW = 8
# One of so many documents is looked at for frequent shingles.
SAMPLE = 16
HOT_BITS = 22


class Shingles:
    """Turns text columns into sorted shingle sets; one object per task."""

    def __init__(self, k: int, hot: np.ndarray | None = None):
        self.k, self.hot, self.powers = k, hot, common.Powers()
        self.weights = common.mix(np.arange(1, k + 2, dtype=np.uint64)) | np.uint64(1)

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """Per text the sorted distinct shingles: 63 bits of hash under a bit for frequent ones."""
        data, offsets = common.text_bytes(column)
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        data = lower[data]
        starts, ends, first = common.words(data, offsets)
        h = common.word_hashes(data, starts, ends, self.powers)
        count = np.diff(first)
        n = len(h)
        values = np.zeros(n, np.uint64)
        if n >= self.k:
            for j in range(self.k):
                values[: n - self.k + 1] += h[j : n - self.k + 1 + j] * self.weights[j]
        with np.errstate(over="ignore"):
            for i in np.flatnonzero((count > 0) & (count < self.k)):
                own = h[first[i] : first[i + 1]] * self.weights[: count[i]]
                values[first[i]] = own.sum() + self.weights[self.k] * np.uint64(count[i])
        values = common.mix(values)
        frequent = np.zeros(n, np.uint64)
        if self.hot is not None:
            frequent = self.hot[(values >> np.uint64(1) & np.uint64((1 << HOT_BITS) - 1)).astype(np.int64)].astype(np.uint64)
        values = (values >> np.uint64(1)) | (frequent << np.uint64(63))
        stop = np.where(count >= self.k, first[1:] - self.k + 1, np.minimum(first[:-1] + 1, first[1:]))
        return [_unique(values[a:b]) for a, b in zip(first[:-1], stop, strict=True)]


def _unique(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def point(own: np.ndarray, groups: int) -> bytes:
    """Counts of the set's shingles by group, one byte each; 255 means 255 or more."""
    counts = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def coarse_points(column: pa.Array) -> np.ndarray:
    """Rows of counts; a full byte becomes a number no set reaches, so bounds stay bounds."""
    raw, _ = common.text_bytes(column)
    return np.where(raw == 255, 1 << 24, raw.astype(np.int32)).reshape(-1, COARSE)


def fine_points(column: list[bytes | None]) -> np.ndarray:
    """Rows of finer counts, all zero for small sets; no rows if no set is large."""
    if not any(column):
        return np.zeros((0, FINE), np.int32)
    raw = np.frombuffer(b"".join(x or bytes(FINE) for x in column), np.uint8)
    return np.where(raw == 255, 1 << 24, raw.astype(np.int32)).reshape(-1, FINE)


def finest_points(sets: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Rows of exact counts over a quarter as many groups as the largest set has shingles.

    With a few shingles a group, unrelated sets share few of them; points whose groups are full
    look alike whatever they hold. The groups halve until the rows fit ``FINEST_BYTES``.
    """
    kind = np.uint16 if sizes.max() < 1 << 16 else np.int32
    groups = 1 << max(8, int(sizes.max() // 4).bit_length())
    while groups > FINE and len(sets) * groups * np.dtype(kind).itemsize > FINEST_BYTES:
        groups //= 2
    out = np.zeros((len(sets), groups), kind)
    for row, own in zip(out, sets, strict=True):
        if len(own) > LARGE:
            row[:] = np.bincount((own & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return out


def _alike(shared, a, b, num: int, den: int):
    """Whether sharing (at most) ``shared`` elements makes sets of these sizes alike enough."""
    shared = np.minimum(shared, np.minimum(a, b))
    return den * shared >= num * (a + b - shared)


class Tree:
    """R-tree over points, packed bottom-up; search gives candidates among the living."""

    def __init__(self, sizes: np.ndarray, coarse: np.ndarray, finer: list[np.ndarray], num: int, den: int):
        self.sizes, self.coarse, self.finer, self.num, self.den = sizes, coarse, finer, num, den
        strips = max(1, int(np.sqrt(len(sizes) / LEAF)))
        by_size = np.argsort(sizes, kind="stable")
        axis = coarse.var(axis=0).argmax() if len(sizes) else 0
        order = [part[np.argsort(coarse[part, axis], kind="stable")] for part in np.array_split(by_size, strips)]
        self.leaves = [leaf for part in order for leaf in np.array_split(part, max(1, -(-len(part) // LEAF))) if len(leaf)]
        self.top = np.array([coarse[leaf].max(axis=0) for leaf in self.leaves])
        self.low = np.array([sizes[leaf].min() for leaf in self.leaves])
        self.high = np.array([sizes[leaf].max() for leaf in self.leaves])
        self.alive = np.ones(len(sizes), bool)

    def enough(self, shared: np.ndarray, a: int, b: np.ndarray) -> np.ndarray:
        return _alike(shared, a, b, self.num, self.den)

    def search(self, x: int) -> np.ndarray:
        """Living entries whose bound with entry ``x`` allows a link."""
        n, mine = self.sizes[x], self.coarse[x]
        fits = (self.high * self.den >= n * self.num) & (self.low * self.num <= n * self.den)
        near = np.flatnonzero(fits)
        if len(near) > 1:
            most = np.minimum(np.minimum(self.top[near], mine).sum(axis=1), self.high[near])
            near = near[self.enough(most, n, np.maximum(self.low[near], most))]
        if not len(near):
            return near
        found = np.concatenate([self.leaves[i] for i in near])
        found = found[self.alive[found]]
        b = self.sizes[found]
        found = found[(b * self.den >= n * self.num) & (b * self.num <= n * self.den)]
        found = found[self.enough(np.minimum(self.coarse[found], mine).sum(axis=1), n, self.sizes[found])]
        for points in self.finer if n > LARGE else ():
            large = self.sizes[found] > LARGE
            bound = np.minimum(points[found[large]], points[x]).sum(axis=1, dtype=np.int64)
            keep = ~large
            keep[large] = self.enough(bound, n, self.sizes[found[large]])
            found = found[keep]
        return found


def spanning(tree: Tree, verify=None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the tree's (verified) links."""
    edges = []
    for seed in range(len(tree.sizes)):
        if not tree.alive[seed]:
            continue
        tree.alive[seed] = False
        queue = [seed]
        while queue:
            x = queue.pop()
            found = tree.search(x)
            if verify is not None and len(found):
                found = found[verify(x, found)]
            tree.alive[found] = False
            for y in found.tolist():
                edges.append((x, y))
                queue.append(y)
    return edges


def _edges(ids: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    return pa.record_batch([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"])


def bucket_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of pairs that reach the bound, from rows (key, a, b, class, n, coarse, fine).

    Buckets of up to ``FEW`` members give their pairs (at most 28), larger ones a forest.
    """

    def run(batches):
        for table, bounds in common.whole_groups(batches, 3):
            ids = np.asarray(common.whole_column(table, 3))
            sizes = np.asarray(common.whole_column(table, 4)).astype(np.int64)
            coarse, fine = coarse_points(common.whole_column(table, 5)), fine_points(table.column(6).to_pylist())
            many = np.diff(bounds)
            group = np.repeat(np.arange(len(many)), many)
            few = np.repeat(many <= FEW, many)
            for step in range(1, FEW):
                i = np.flatnonzero((group[step:] == group[:-step]) & few[step:])
                j = i + step
                keep = _alike(np.minimum(sizes[i], sizes[j]), sizes[i], sizes[j], num, den)
                i, j = i[keep], j[keep]
                for part in np.array_split(np.arange(len(i)), len(i) // 4096 + 1):
                    x, y = i[part], j[part]
                    ok = _alike(np.minimum(coarse[x], coarse[y]).sum(axis=1), sizes[x], sizes[y], num, den)
                    x, y = x[ok], y[ok]
                    both = np.flatnonzero((sizes[x] > LARGE) & (sizes[y] > LARGE))
                    if len(both):
                        ok = np.ones(len(x), bool)
                        bound = np.minimum(fine[x[both]], fine[y[both]]).sum(axis=1)
                        ok[both] = _alike(bound, sizes[x[both]], sizes[y[both]], num, den)
                        x, y = x[ok], y[ok]
                    if len(x):
                        yield pa.record_batch([pa.array(ids[x]), pa.array(ids[y])], names=["u", "v"])
            for g in np.flatnonzero(many > FEW):
                own = slice(bounds[g], bounds[g + 1])
                tree = Tree(sizes[own], coarse[own], [fine[own]] if len(fine) else [], num, den)
                edges = spanning(tree)
                if edges:
                    yield _edges(ids[own], edges)

    return rows.mapInArrow(run, "u long, v long").distinct()


def alike(mine: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of the other sets are linked with this one, by counting what they share."""
    sizes, every = np.array([len(x) for x in others], np.int64), np.concatenate(others)
    at = np.minimum(np.searchsorted(mine, every), len(mine) - 1)
    shared = np.add.reduceat((mine[at] == every).astype(np.int64), np.cumsum(sizes) - sizes)
    return _alike(shared, len(mine), sizes, num, den)


def family_links(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) forests of verified links, from rows (family, a, b, class, shingles)."""

    def run(batches):
        for table, bounds in common.whole_groups(batches, 3):
            every_id, every_set = np.asarray(common.whole_column(table, 3)), common.whole_column(table, 4)
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in every_set[a:b].to_pylist()]
                sizes = np.array([len(x) for x in sets], np.int64)
                coarse = np.frombuffer(b"".join(point(x, COARSE) for x in sets), np.uint8).reshape(-1, COARSE)
                finer = []
                if sizes.max() > LARGE:
                    finer.append(fine_points([point(x, FINE) if len(x) > LARGE else None for x in sets]))
                    finer.append(finest_points(sets, sizes))
                tree = Tree(sizes, np.where(coarse == 255, 1 << 24, coarse.astype(np.int32)), finer, num, den)

                def verify(x, found, sets=sets, sizes=sizes):
                    mine, before = sets[x], np.cumsum(sizes[found]) - sizes[found]
                    parts = np.split(found, np.flatnonzero(np.diff(before // COMPARED)) + 1)
                    return np.concatenate([alike(mine, [sets[y] for y in part], num, den) for part in parts])

                edges = spanning(tree, verify)
                if edges:
                    yield _edges(every_id[a:b], edges)

    return rows.mapInArrow(run, "u long, v long")


def frequent_shingles(rows: DataFrame, k: int) -> np.ndarray:
    """A map of 2**HOT_BITS hash slots in which a sampled shingle is frequent.

    Counted in one of ``SAMPLE`` documents, by slot: tasks send counts of slots, whose number is
    fixed; a slot is frequent if it is in at least 8 sampled documents and 8 times the mean.
    """
    size = 1 << HOT_BITS

    def run(batches):
        shingles, counts = Shingles(k), np.zeros(size, np.int32)
        for batch in batches:
            for part in common.chunks(batch, 1):
                for own in shingles.sets(part.column(1)):
                    np.add.at(counts, (own & np.uint64(size - 1)).astype(np.int64), 1)
        full = np.flatnonzero(counts > 1)
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array(counts[full], pa.int32())], names=["slot", "n"])

    sample = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0)
    slots = sample.mapInArrow(run, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n"))
    stats = slots.agg(F.sum("n") / F.lit(float(size))).first()[0] or 0.0
    least = max(8, 8 * stats)
    hot = np.zeros(size, bool)
    hot[np.asarray(slots.filter(F.col("n") >= least).select("slot").toArrow().column(0))] = True
    return hot


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100
) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; links where den * shared >= num * union."""
    return classified(docs, doc_id, text, k, num, den).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def classified(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100,
    hot: np.ndarray | None = None,
) -> DataFrame:
    """doc_id, n, class, group, component_id of every row: its set, the class of a linked group that
    names the group, and the least id of the group. Rows without words or id have no class."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    hot = np.packbits(frequent_shingles(rows, k)) if hot is None else hot

    class Describe:
        @staticmethod
        def prepare():
            shingles = Shingles(k, np.unpackbits(hot).astype(bool))

            def work(part):
                sets = shingles.sets(part.column(1))
                empty = np.array([not len(x) for x in sets], bool) | np.asarray(part.column(0).is_null())
                route = [x[: len(x) - -(-num * len(x) // den) + 1] if len(x) else x for x in sets]
                ends = np.cumsum([0, *map(len, route)]).astype(np.int32)
                flat = np.concatenate(route)
                return pa.record_batch(
                    [
                        part.column(0),
                        pa.array([len(x) for x in sets], pa.int64()),
                        pa.array(_class_ids(sets), mask=empty),
                        pa.array([point(x, COARSE) for x in sets], pa.binary()),
                        pa.array([point(x, FINE) if len(x) > LARGE else None for x in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64))),
                    ],
                    names=["doc_id", "n", "class", "coarse", "fine", "route"],
                )

            return work

    schema = f"doc_id {kind}, n long, class long, coarse binary, fine binary, route array<long>"
    told = materialise(common.map_chunks(rows, "text", Describe, schema), "shingled")
    there = told.filter("class is not null")
    classes = materialise(
        there.groupBy("class").agg(
            F.min("doc_id").alias("least_id"), *(F.any_value(c).alias(c) for c in ("n", "coarse", "fine"))
        ),
        "classes",
    )
    same_key = Window.partitionBy("key")
    shared = (
        there.select(F.explode("route").alias("key"), "class")
        .withColumns({"_low": F.min("class").over(same_key), "_high": F.max("class").over(same_key)})
        .filter("_low <> _high")
        .select("key", "class")
        .distinct()
    )
    buckets = common.in_blocks(materialise(shared, "buckets"), "key", "class", BLOCK).join(classes, "class")
    buckets = buckets.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "class")
    near = bucket_links(buckets.select("key", "a", "b", "class", "n", "coarse", "fine"), num, den)
    families = common.components(near, "families").withColumnsRenamed({"node": "class", "root": "family"})
    families = materialise(families.join(classes.select("class", "least_id", "n"), "class"), "family")

    class Reread:
        @staticmethod
        def prepare():
            shingles = Shingles(k, np.unpackbits(hot).astype(bool))

            def work(part):
                sets = shingles.sets(part.column(1))
                return pa.record_batch(
                    [pa.array(_class_ids(sets)), pa.array([x.tobytes() for x in sets], pa.binary())],
                    names=["class", "shingles"],
                )

            return work

    ids = families.select(F.col("least_id").alias("doc_id")).distinct()
    sets = common.map_chunks(common.semi_by_id(rows, ids, "doc_id"), "text", Reread, "class long, shingles binary")
    members = families.select("family", "class", "n")
    members = common.in_blocks(members, "family", "class", BLOCK, "n", BLOCK_SHINGLES)
    members = members.join(sets.dropDuplicates(["class"]), "class")
    members = members.repartition("family", "a", "b").sortWithinPartitions("family", "a", "b", "class")
    links = family_links(members.select("family", "a", "b", "class", "shingles"), num, den)
    linked = common.components(links, "links").join(
        classes.select(F.col("class").alias("node"), "least_id"), "node"
    )
    roots = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = linked.join(roots, "root").select(F.col("node").alias("class"), F.col("root").alias("group"), "component_id")
    named = classes.select("class", "least_id").join(linked, "class", "left")
    named = named.select(
        "class", F.coalesce("group", "class").alias("group"), F.coalesce("component_id", "least_id").alias("component_id")
    )
    # rows without a class ask nothing
    lone = told.filter("class is null").select("doc_id", "n", "class", F.col("class").alias("group"), F.col("doc_id").alias("component_id"))
    return there.join(named, "class").select("doc_id", "n", "class", "group", "component_id").unionByName(lone)


def _class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits that stand for a whole set."""
    return np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=8).digest() for x in sets), np.int64)


def with_class(rows: DataFrame, text: str, hot: np.ndarray, k: int = 5) -> DataFrame:
    """``rows`` with ``_class``, the class that ``classified`` gives the row; NULL without words."""

    class Work:
        @staticmethod
        def prepare():
            shingles = Shingles(k, np.unpackbits(hot).astype(bool))

            def work(part):
                sets = shingles.sets(part.column(at))
                empty = np.array([not len(x) for x in sets], bool)
                return pa.record_batch([*part.columns, pa.array(_class_ids(sets), mask=empty)], names=[*part.schema.names, "_class"])

            return work

    at = rows.columns.index(text)
    schema = T.StructType([*rows.schema, T.StructField("_class", T.LongType())])
    return common.map_chunks(rows, text, Work, schema)


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: one with the group's least id.

    Rows without words or without an id all stay. Where several rows have one id, rows are told
    apart by their sets: of the rows of that id and set that stands for its group one stays, and
    rows of the id that belong to other groups are judged there.
    """
    k = how.get("k", 5)
    hot = np.packbits(frequent_shingles(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), k))
    found = classified(docs, doc_id, text, hot=hot, **how).filter("doc_id is not null")
    found = materialise(found.select("doc_id", "class", "group", "component_id"), "near")
    again = found.groupBy("doc_id").count().filter("count > 1")
    again = materialise(again.select(F.col("doc_id").alias(doc_id)), "repeated")
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct()
    if again.isEmpty():
        return common.semi_by_id(docs, gone, doc_id, "left_anti")
    gone = common.semi_by_id(gone, again, doc_id, "left_anti")
    single = common.semi_by_id(common.semi_by_id(docs, gone, doc_id, "left_anti"), again, doc_id, "left_anti")
    # the set that stands for a group, of those that its least id has
    stands = found.filter("doc_id = component_id and class is not null").groupBy("doc_id", "group").agg(F.min("class").alias("class"))
    stands = stands.select(F.col("doc_id").alias(doc_id), F.col("class").alias("_class"))
    # rows without an id are in no semi join
    told = with_class(common.semi_by_id(docs, again, doc_id), text, hot, k)
    lone = told.filter("_class is null")
    there = told.dropDuplicates([doc_id, "_class"]).join(stands, [doc_id, "_class"], "left_semi")
    return single.unionByName(lone.drop("_class")).unionByName(there.select(*docs.columns))
