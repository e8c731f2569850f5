"""Token ids in binary files, with Elias-Fano coded document boundaries.

A file (a shard) holds the ids of a run of documents, one after another, in 2 bytes each if the
vocabulary allows it and in 4 otherwise, and where each document ends among them. The ends are a
rising sequence: their low bits are packed side by side, their high parts are one bit per document
in a bit string that counts up in unary, some 2 + log2(ids / documents) bits for each. The place of
every 256th of those bits is kept, so that a boundary is found by a look at one of these samples and
at the few words behind it (select), with no table of 64-bit offsets. Document ids, which rise as
well, are coded the same way.

A shard is small enough to be read as one value by an executor of 3 GB; larger executors can have
larger ones. Shards are ranges of the document id. Their bounds are quantiles of the ids alone; rows of an id
that spans several ranges are dealt over all of them, so an id that holds many of the rows is no
task's burden, and a range that holds more ids than a file may is written as several files. Tasks
write through Spark's own committed writer, so a lost executor leaves no half file. A manifest
tells the number of ids before each shard.

Layout, little-endian: the eight fields of ``HEAD``; then packed low bits, high bits and samples of
the ends, the same of the document ids, the ids, and a line feed (Spark's writer ends a row so).

Defined results: a NULL text is an empty one and holds the end id alone; every row, also a repeated
one, is a document; rows of one id follow each other in no stated order; NULL ids come first; the
string of an added token is that token, as in the library's plain call; an empty table writes no
shard. Columns other than id and text are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentlab.llm import common
from commentlab.llm.packing import END, LibraryEncoder
from commentlab.session import new_path

# Bytes of text encoded at a time.
TEXT_BYTES = 1 << 20
# Bytes of text that a shard is meant to hold, and ids that it holds at most (or one document).
SHARD_BYTES = 1 << 24
SHARD_IDS = 1 << 24
MAGIC = b"EFTOKENS"
# magic, range, number in the range, documents, ids, bytes of an id, NULL ids, lowest document id
HEAD = "<8sqqqqqqq"
HEAD_SIZE = struct.calcsize(HEAD)
# One in so many bits of the high part has its place kept.
SAMPLE = 256
LEAST = -(1 << 63)


class EliasFano:
    """A rising sequence of whole numbers from 0 on, in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        low_bits = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        size = (int(places[-1]) + 1 if n else 0) + 63 >> 6 << 6
        high = np.zeros(size, np.uint8)
        high[places] = 1
        words = np.packbits(high, bitorder="little").view("<u8")
        return cls(n, low_bits, low, words, places[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        sizes = struct.pack("<qqqqq", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples))
        return b"".join([sizes, self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()])

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at byte ``at``, and where it ends."""
        n, low_bits, lows, highs, samples = struct.unpack_from("<qqqqq", data, at)
        at += 40
        low = np.frombuffer(data, np.uint8, lows, at)
        high = np.frombuffer(data, "<u8", highs, at + lows)
        at += lows + 8 * highs
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", samples, at)), at + 4 * samples

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            out |= ((self.low[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def select(self, i: np.ndarray) -> np.ndarray:
        """Place of the i-th set bit of the high part: from the sample before it, word by word."""
        word = (self.samples[i // SAMPLE] >> 6).astype(np.int64)
        begin = (self.samples[i // SAMPLE] & 63).astype(np.uint64)
        current = self.high[word] >> begin << begin
        left = i % SAMPLE  # set bits still to pass
        todo = np.arange(len(i))
        while len(todo):
            ones = np.bitwise_count(current[todo]).astype(np.int64)
            todo = todo[left[todo] >= ones]
            left[todo] -= np.bitwise_count(current[todo])
            word[todo] += 1
            current[todo] = self.high[word[todo]]
        bits = np.unpackbits(current.astype("<u8").view(np.uint8), bitorder="little").reshape(len(i), 64)
        inside = (np.cumsum(bits, axis=1, dtype=np.int64) > left[:, None]).argmax(axis=1)
        return word * 64 + inside

    def at(self, i: np.ndarray) -> np.ndarray:
        """Values at the given places, each found on its own."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        high = (self.select(i) - i).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(i)

    def values(self) -> np.ndarray:
        """All values, from one pass over the bits."""
        places = np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little"))
        high = (places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        return high | self._low(np.arange(self.n))


class Shard:
    """One file: document ids, boundaries and token ids, read in place."""

    def __init__(self, data: bytes):
        data = memoryview(data)
        magic, self.part, self.number, self.n, self.size, width, self.nulls, self.least = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ends, at = EliasFano.read(data, HEAD_SIZE)
        self.names, at = EliasFano.read(data, at)
        self.ids = np.frombuffer(data, f"<u{width}", self.size, at)

    def bounds(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the given documents begin and end among the ids."""
        i = np.asarray(i, np.int64)
        both = self.ends.at(np.concatenate([i, np.maximum(i - 1, 0)])).astype(np.int64)
        return np.where(i > 0, both[len(i) :], 0), both[: len(i)]

    def document(self, i: int) -> np.ndarray:
        (begin,), (end,) = self.bounds(np.array([i]))
        return self.ids[begin:end]

    def doc_ids(self) -> pa.Array:
        """Document ids in order, the NULL ones first."""
        told = (self.names.values() + np.uint64(self.least % (1 << 64))).astype(np.int64)
        return pa.concat_arrays([pa.nulls(self.nulls, pa.int64()), pa.array(told, pa.int64())])


def shard_bytes(part: int, number: int, doc_ids: np.ndarray, nulls: int, lengths: np.ndarray, ids: bytes, width: int) -> bytes:
    """A shard of documents in order; ``doc_ids`` are those of the documents after the NULL ones."""
    least = int(doc_ids[0]) if len(doc_ids) else 0
    names = EliasFano.of(doc_ids.astype(np.uint64) - np.uint64(least % (1 << 64)))
    head = struct.pack(HEAD, MAGIC, part, number, len(lengths), int(lengths.sum()), width, nulls, least)
    return b"".join([head, EliasFano.of(np.cumsum(lengths)).to_bytes(), names.to_bytes(), ids])


def _bounds(keys: DataFrame, shard: int) -> np.ndarray:
    """Document ids at which the next range begins; an id of many rows may occur repeatedly."""
    total = keys.agg(F.sum("_bytes")).first()[0] or 0
    parts = -(-total // shard)
    if parts < 2:
        return np.zeros(0, np.int64)
    shares = F.percentile_approx("_key", [i / parts for i in range(1, parts)], 100 * parts)
    return np.array(keys.agg(shares).first()[0], np.int64)


def write(
    docs: DataFrame, path: str, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
    shard: int = SHARD_BYTES, most: int = SHARD_IDS,
) -> None:
    """The ids of all documents, each with the end id behind, in ``path``: shards and a manifest."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    key = F.coalesce("doc_id", F.lit(LEAST))
    starts = _bounds(rows.select(key.alias("_key"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).alias("_bytes")), shard)

    class Work:
        @staticmethod
        def prepare():
            encoder = common.kept(("library", vocabulary), lambda: LibraryEncoder(vocabulary))
            kind = "<u2" if max(len(encoder.width), END + 1) <= 1 << 16 else "<u4"

            def work(some):
                ids, bounds, _, _ = encoder.encode(some.column(1))
                n = some.num_rows
                ends = bounds[1:] + np.arange(1, n + 1)
                out = np.full(len(ids) + n, END, kind)
                mine = np.ones(len(out), bool)
                mine[ends - 1] = False
                out[mine] = ids
                cuts = np.concatenate([[0], ends]) * out.itemsize
                held = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)])
                # an id that lies at several bounds may go to any range between them
                keys = np.asarray(some.column(0).fill_null(LEAST))
                low, high = (np.searchsorted(starts, keys, side=side) for side in ("left", "right"))
                dealt = common.mix(np.asarray(some.column(2)).astype(np.uint64) + np.uint64(1))
                part = low + (dealt % (high - low + 1).astype(np.uint64)).astype(np.int64)
                return pa.record_batch(
                    [pa.array(part, pa.int32()), some.column(0), held.cast(pa.binary())], names=["part", "doc_id", "ids"]
                )

            return work

    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    coded = common.map_chunks(numbered, "text", Work, "part int, doc_id long, ids binary", TEXT_BYTES)
    ranged = coded.repartitionById(len(starts) + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"))

    def packed(batches):
        encoder_size = common.kept(("library", vocabulary), lambda: LibraryEncoder(vocabulary)).width
        width = 2 if max(len(encoder_size), END + 1) <= 1 << 16 else 4
        part, number, names, sizes, held, count = None, 0, [], [], [], 0

        def flush():
            every = pa.concat_arrays(names)
            lengths = np.concatenate(sizes) // width
            known = np.asarray(every.drop_null()).astype(np.int64)
            blob = shard_bytes(part, number, known, every.null_count, lengths, b"".join(held), width)
            return pa.record_batch([pa.array([blob], pa.binary())], names=["shard"])

        for batch in batches:
            parts = np.asarray(batch.column(0))
            data, offsets = common.text_bytes(batch.column(2))
            at = 0
            while at < len(parts):
                if part is not None and (parts[at] != part or count >= most):
                    yield flush()
                    number = number + 1 if parts[at] == part else 0
                    names, sizes, held, count = [], [], [], 0
                part = int(parts[at])
                same = at + int(np.searchsorted(parts[at:], part, side="right"))
                room = int(np.searchsorted(offsets, offsets[at] + (most - count) * width))
                stop = max(at + 1, min(same, room))
                names.append(batch.column(1).slice(at, stop - at))
                sizes.append(np.diff(offsets[at : stop + 1]))
                held.append(data[offsets[at] : offsets[stop]].tobytes())
                count += int(offsets[stop] - offsets[at]) // width
                at = stop
        if part is not None:
            yield flush()

    shards = ranged.mapInArrow(packed, "shard binary")
    # the text writer puts the bytes of a string in the file as they are
    shards.select(F.col("shard").cast("string")).write.option("maxRecordsPerFile", 1).text(f"{path}/shards")
    _manifest(spark, path).write.parquet(f"{path}/manifest")


def _files(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/shards")
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """file, part, number, documents, ids, first_document, first_id of each shard, from the heads."""

    def heads(batches):
        for batch in batches:
            found = [struct.unpack(HEAD, x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3, 4)]
            yield pa.record_batch([batch.column(0), *columns], names=["file", "part", "number", "documents", "ids"])

    only = _files(spark, path).select("file", F.substring("content", 1, HEAD_SIZE).alias("head")).filter(F.length("head") == HEAD_SIZE)
    rows = only.mapInArrow(heads, "file string, part long, number long, documents long, ids long")
    # a short row per shard
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        "*",
        F.coalesce(F.sum("documents").over(before), F.lit(0)).alias("first_document"),
        F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first_id"),
    )


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, from the files of ``path``."""
    manifest = spark.read.parquet(f"{path}/manifest").select("file", "first_id")
    if common.small_enough(manifest):
        manifest = F.broadcast(manifest)
    files = _files(spark, path).join(manifest, "file").select("first_id", "content")

    def run(batches):
        for batch in batches:
            for first, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(content.as_buffer())
                ends = shard.ends.values().astype(np.int64)
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                doc_ids = shard.doc_ids()
                for a in range(0, shard.n, 10_000):
                    b = min(a + 10_000, shard.n)
                    ids = shard.ids[starts[a] : ends[b - 1]].astype("<u4")
                    cuts = (starts[a:b] - starts[a]).tolist() + [len(ids)]
                    crc = [zlib.crc32(ids[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]
                    columns = [
                        doc_ids.slice(a, b - a), pa.array(starts[a:b] + first), pa.array(ends[a:b] - starts[a:b]), pa.array(crc, pa.int64()),
                    ]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32))))
                    yield pa.record_batch(columns, names=["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return files.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, path: str | None = None, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, as the files written from them say."""
    path = path or new_path(docs.sparkSession, "token_files")
    write(docs, path, vocabulary, **options)
    return read(docs.sparkSession, path)
