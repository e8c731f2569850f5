"""Best-fit packing of token sequences by bulk-synchronous supersteps.

Documents are tokenised where they lie, only lengths and digests go on; longer ones are cut into
full pieces after a first shorter one. Lengths and gaps are whole numbers up to the capacity, so
documents sorted by length, and sequences sorted by gap, are runs of equal values: the sorted order
is kept as runs, of which there are never more than a bounded number, whatever the corpus holds.

A superstep takes the longest run of documents left and sweeps over the successor gaps, smallest
first: each gap takes as many documents as fit, and where a run of documents meets more or fewer
gaps than it needs, rank decides which rows get which. Gaps are updated and the next superstep
follows; what finds no gap opens sequences. Tasks then place every row by its rank within its
length. Ranks come from counts per (length, bucket), so a length that holds most rows is spread
over as many tasks as its rows need.

Ids are those of the library's plain call: the string of an added token is that token.

Defined results: a NULL text is an empty one, whose piece is the end token alone; every row, also a
repeated one or one with a NULL id, is a document of its own; an empty table gives no rows.
Columns other than id and text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from commentlab.llm import common
from commentlab.llm.bpe import SPACE, TEXT_BYTES, Encoder, character_classes, gather
from commentlab.session import materialise

END = 2
CAPACITY = 1024
# Rows that one task ranks.
RANKED = 16_000


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library, which sees each distinct pre-token of a worker once.

    New pre-tokens go to the library as one text whose pre-tokens they are: those that begin with
    U+0020 side by side, others with line feeds between them. The bytes of the ids tell where one
    ends and the next begins. A text that holds an added token of the vocabulary, as the string
    of the end mark, goes to the library whole unless ``plain``, when such strings are ordinary.
    """

    def __init__(self, path: str, plain: bool = False):
        self.kinds = character_classes()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each id
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.width[i] = len(token)  # byte-level vocabularies spell a byte as a character
        self.path, self.whole = path, None
        self.added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.ascii_space = frozenset(i for i in range(128) if self.kinds[i] == SPACE)
        self._clear()

    def encode(self, column: pa.Array):
        """Ids and bounds as ever; places are not told (None) if a text holds an added token."""
        ids, bounds, per, starts = super().encode(column)
        held = np.zeros(len(column), bool)
        for token in self.added:
            held |= np.asarray(pc.match_substring(column, token).fill_null(False))
        if not held.any():
            return ids, bounds, per, starts
        self.whole = self.whole or Tokenizer.from_file(self.path)
        own = np.split(ids, bounds[1:-1])
        for i in np.flatnonzero(held).tolist():
            found = self.whole.encode(column[i].as_py(), add_special_tokens=False).ids
            own[i] = np.array(found, np.int32)
        return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])]), None, None

    def _ids(self, text: bytes) -> np.ndarray:
        found = self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids
        return np.array(found, np.int64)

    def _space(self, word: bytes) -> bool:
        """Whether a word begins with white space as the encoder's classes call it."""
        return word[0] in self.ascii_space if word[0] < 128 else self.kinds[ord(word.decode()[0])] == SPACE

    def _merged(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # white space is what the encoder's classes call so: str.isspace() has U+001C to U+001F as well
        led, lone, rest = [], [], []
        for i, w in enumerate(new):
            if not self._space(w):
                lone.append(i)
            elif w[0] == 0x20 and len(w) > 1 and not self._space(w[1:]):
                led.append(i)
            else:
                rest.append(i)
        parts, lengths = [], []
        for which, gap in ((led, b""), (lone, b"\n")):
            if which:
                ids = self._ids(gap.join([new[i] for i in which]))
                ends = np.cumsum([len(new[i]) + len(gap) for i in which])
                # the ids before each pre-token's end; its line feed, if any, is the last of them
                upto = np.searchsorted(np.cumsum(self.width[ids]), ends, side="right")
                begin = np.concatenate([[0], upto[:-1]])
                keep = np.ones(len(ids), bool)
                if gap:
                    keep[upto[:-1] - 1] = False
                    upto = np.append(upto[:-1] - 1, len(ids))
                parts.append(ids[keep])
                lengths.append(upto - begin)
        for i in rest:
            parts.append(self._ids(new[i]))
            lengths.append(np.array([len(parts[-1])]))
        order = np.array(led + lone + rest, np.int64)
        flat, many = np.concatenate(parts), np.concatenate(lengths)
        ends = np.empty(len(new), np.int64)
        size = np.empty(len(new), np.int64)
        ends[order], size[order] = np.cumsum(many), many
        return flat[gather(ends - size, size)], size


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of each document's pieces."""
    kind = dict(docs.dtypes)[doc_id]

    class Work:
        @staticmethod
        def prepare():
            encoder = common.kept(("library", vocabulary), lambda: LibraryEncoder(vocabulary))

            def work(part):
                ids, bounds, _, _ = encoder.encode(part.column(1))
                rows, piece, start, length, crc, held = [], [], [], [], [], []
                for i, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    own = np.append(ids[a:b], END).astype("<u4")
                    cuts = [0, *range(len(own) % capacity or capacity, len(own), capacity), len(own)]
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        rows.append(i)
                        piece.append(k)
                        start.append(x)
                        length.append(y - x)
                        crc.append(zlib.crc32(own[x:y].tobytes()))
                        if with_ids:
                            held.append(own[x:y].astype(np.int32))
                columns = [
                    part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(held, pa.list_(pa.int32())))
                    names.append("ids")
                return pa.record_batch(columns, names=names)

            return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return common.map_chunks(rows, "text", Work, schema, TEXT_BYTES)


def supersteps(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the rows of each length go, from the number of rows of each length.

    Rows of the result: length, first rank, rows, rows per sequence, first sequence, offset. Rank r
    of a run goes to sequence ``first + (r - first rank) // per``.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs (first sequence, number)
    sizes: list[int] = []  # the gaps there are, sorted
    steps, opened = [], 0

    def give(gap: int, run: tuple[int, int]) -> None:
        if gap and run[1]:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append(run)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, number = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    sizes.pop(at)
            else:
                gap, first, number = capacity, opened, -(-left // (capacity // length))
                opened += number
            per = gap // length
            full = min(number, left // per)
            for some, each in ((full, per), (int(full < number and 0 < left - full * per < per), left - full * per)):
                if some and each:
                    steps.append((length, rank, some * each, each, first, capacity - gap))
                    give(gap - each * length, (first, some))
                    rank, left, first, number = rank + some * each, left - some * each, first + some, number - some
            give(gap, (first, number)) if gap < capacity else None
    return np.array(steps, np.int64).reshape(-1, 6)


def place(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (rows with doc_id, piece, length) with sequence_id and offset added."""
    cut = materialise(cut, "pieces")
    total = cut.count()
    buckets = max(1, -(-total // RANKED))
    keyed = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    counts = materialise(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), "piece_counts")
    plan = supersteps({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("_row", F.row_number().over(within)).join(offsets, ["length", "_bucket"])
    ranked = ranked.select(*cut.columns, (F.col("_before") + F.col("_row") - 1).alias("_rank"))
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    at = cut.columns.index("length")
    width = int(total) + 1
    keys = plan[:, 0] * width + plan[:, 1]

    def run(batches):
        for batch in batches:
            length, rank = np.asarray(batch.column(at)), np.asarray(batch.column(batch.num_columns - 1))
            step = plan[np.searchsorted(keys, length * width + rank, side="right") - 1]
            past = rank - step[:, 1]
            yield pa.record_batch(
                [
                    *batch.columns[:-1],
                    pa.array(step[:, 4] + past // step[:, 3]),
                    pa.array(step[:, 5] + past % step[:, 3] * length),
                ],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)


def pack(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces of all documents."""
    return place(pieces(docs, vocabulary, doc_id, text, capacity), capacity)
