"""Phrase collocations: contiguous phrases counted by direct-address tiles of ranked ids.

Texts are cut into chunks whose words are numbered inside the chunk. The words that are frequent in
the corpus get ids by falling frequency, so that a pair of adjacent ids falls into a tile of the
square of ids: the tiles of frequent words are dense, and a task counts them with ``bincount`` in an
array with one cell for each pair; pairs of sparse tiles are kept as sorted coordinates with their
counts. Pairs that are frequent are ranked and numbered again, and stand for two words in the next
round: two overlapping pairs are a phrase of three words, two pairs side by side one of four. A
frequent phrase has frequent parts only, so nothing else is looked at.

Tables of frequent words and pairs are measured. Up to a bound they go to every worker, who numbers
its texts with them. Beyond it no table is held whole by a task or the driver: a chunk asks by a join
for the ids of its own distinct words and pairs, and gets them back as one row. The rows are the same.
A word or pair is one row per task or chunk however often it occurs there, so no key holds much of
any shuffle.

Defined results: a NULL text is empty; a NULL language is ``und``; repeated rows and rows with NULL
ids count as rows; an empty table gives no rows. Columns other than text and language are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from commentlab.llm import common
from commentlab.scale import top_k, within
from commentlab.session import materialise

LEAST = 30
LONGEST = 4
TOP = 2000
# Percentage of a phrase's occurrences at which a longer one stands for it.
COVERED = 80
UNKNOWN = "und"
# Bytes of text in a chunk.
CHUNK = 1 << 21
# Words and their bytes, and pairs, up to which every worker holds the table.
HELD_WORDS, HELD_BYTES, HELD_PAIRS = 500_000, 32 << 20, 2_000_000
# Side of a tile, how many pairs make it dense, and coordinates kept before they are sent.
TILE = 1024
DENSE = TILE * TILE // 16
MERGE = 1 << 19
DENSE_TILES = 4

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class TileCounts:
    """Counts of pairs of ids: dense tiles as arrays, the rest as sorted coordinates."""

    def __init__(self) -> None:
        self.dense: dict[tuple[int, int], np.ndarray] = {}
        self.sparse: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        # tile by tile: rows of tiles first
        row, column = i // TILE, j // TILE
        wide = int(column.max()) + 1
        tile = row * wide + column
        size = (int(row.max()) + 1) * wide
        cell = (i % TILE) * TILE + j % TILE
        rest = np.ones(len(i), bool)
        if size <= 1 << 22:
            many = np.bincount(tile, minlength=size)
            full = set(np.flatnonzero(many >= DENSE).tolist()) | {x * wide + y for x, y in self.dense if y < wide and many[min(x * wide + y, size - 1)]}
        else:  # so many tiles that only the first can be dense in one call
            full = {0}
        for t in sorted(full):
            at = divmod(t, wide)
            if at not in self.dense and len(self.dense) >= DENSE_TILES:
                continue
            mine = tile == t
            counts = np.bincount(cell[mine], minlength=TILE * TILE)
            self.dense[at] = self.dense[at] + counts if at in self.dense else counts
            rest &= ~mine
        if rest.any():
            self._keep(i[rest], j[rest], np.ones(int(rest.sum()), np.int64))

    def _keep(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> None:
        part = _merged(i, j, n)
        self.sparse.append(part)
        self.held += len(part[0])

    def drained(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j, n of the sparse pairs, which are then forgotten."""
        parts, self.sparse, self.held = self.sparse, [], 0
        return _merged(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else (np.zeros(0, np.int64),) * 3

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """i, j, n of all pairs that are not drained."""
        parts = [self.drained()]
        for (x, y), counts in self.dense.items():
            cell = np.flatnonzero(counts)
            parts.append((x * TILE + cell // TILE, y * TILE + cell % TILE, counts[cell]))
        return _merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _merged(i: np.ndarray, j: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted coordinates, each once, with the sum of its counts."""
    if not len(i):
        return i, j, n
    wide = int(j.max()) + 1
    if int(i.max()) + 1 < (1 << 62) // wide:
        code = i * wide + j
        order = np.argsort(code)
        code, n = code[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        return *divmod(code[first], wide), np.add.reduceat(n, first)
    order = np.lexsort((j, i))
    i, j, n = i[order], j[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    return i[first], j[first], np.add.reduceat(n, first)


def _squeezed(seq: np.ndarray) -> np.ndarray:
    """A sequence in which -1, which parts phrases, stands once at a time."""
    gap = seq < 0
    return seq[~(gap & np.concatenate([[False], gap[:-1]]))]


def _array(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _parsed(some: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray]:
    """The texts of a chunk as numbers of its distinct words, -1 between phrases; and the language,
    the bytes and the count of each of these words."""
    data, offsets = common.text_bytes(some.column(1))
    data = LOWER[data]
    solid = ~GAP[data]
    head = np.zeros(len(data) + 1, bool)
    head[offsets] = True
    starts = np.flatnonzero(solid & (head[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (head[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    # the bytes of the words lie side by side once the gaps are gone
    sides = np.concatenate([[0], np.cumsum(ends - starts)])
    told = pa.Array.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(sides), pa.py_buffer(data[solid])]
    )
    told = (told.cast(pa.binary()) if len(data) < 1 << 31 else told).dictionary_encode()
    word = np.asarray(told.indices)
    of_text = np.searchsorted(offsets, starts, side="right") - 1
    langs = some.column(0).fill_null(UNKNOWN).dictionary_encode()
    code = np.asarray(langs.indices).astype(np.int64)[of_text] * len(told.dictionary) + word
    size = len(langs.dictionary) * len(told.dictionary)
    if size < 4 * len(code):  # as many cells as words: counted in place
        cells = np.bincount(code, minlength=size)
        distinct = np.flatnonzero(cells)
        counts, number = cells[distinct], np.zeros(size, np.int32)
        number[distinct] = np.arange(len(distinct))
        seq = number[code]
    else:
        distinct, seq, counts = np.unique(code, return_inverse=True, return_counts=True)
    breaks = np.searchsorted(np.flatnonzero(BREAK[data]), starts)
    parted = np.zeros(len(starts), bool)
    parted[1:] = (breaks[1:] != breaks[:-1]) | (of_text[1:] != of_text[:-1])
    out = np.full(len(starts) + int(parted.sum()), -1, np.int32)
    out[np.arange(len(starts)) + np.cumsum(parted)] = seq
    of_lang, of_word = (pa.array(x) for x in divmod(distinct, max(1, len(told.dictionary))))
    return out, langs.dictionary.take(of_lang), told.dictionary.take(of_word), counts


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))


def word_counts(docs: DataFrame, least: int) -> DataFrame:
    """lang, word, f of the frequent words, and with a NULL word the number of a language's words.

    A task adds its chunks up before anything is shuffled.
    """

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for some in common.chunks(batch, 1, CHUNK):
                _, langs, words, counts = _parsed(some)
                one = pa.table({"lang": langs, "word": words, "n": pa.array(counts, pa.int64())})
                held, size = [*held, one], size + len(one)
                if size > MERGE // 2 and len(held) > 1:
                    held = [_sums(pa.concat_tables(held), ["lang", "word"])]
                    size = len(held[0]) // 2
        if held:
            every = _sums(pa.concat_tables(held), ["lang", "word"])
            total = _sums(every, ["lang"]).append_column("word", pa.nulls(_sums(every, ["lang"]).num_rows, pa.binary()))
            for table in (every, total.select(every.column_names)):
                yield from table.set_column(1, "word", table.column("word").cast(pa.string())).to_batches(1 << 16)
            del held, every, total, table
        common.release()

    partial = docs.mapInArrow(run, "lang string, word string, n long")
    counts = partial.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    return materialise(counts.filter(F.col("word").isNull() | (F.col("f") >= least)), "counts")


def _sums(table: pa.Table, by: list[str]) -> pa.Table:
    return table.group_by(by).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _chunk_line(chunk: int, seq: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([chunk]), pa.array([len(ids)], pa.int32()), _array(_squeezed(seq), pa.int32()), _array(ids, pa.int64())]
    return pa.record_batch(columns, names=["chunk", "known", "seq", "ids"])


LINE = "chunk long, known int, seq array<int>, ids array<long>"


def numbered_here(docs: DataFrame, words: DataFrame) -> DataFrame:
    """chunk, known, seq, ids: the texts of each chunk as places in ``ids``, its frequent words; with a
    table of words small enough for every worker."""
    table = words.select("lang", F.col("word").cast("binary").alias("word"), "id").toArrow().sort_by("lang")
    names = table.column("lang").to_pylist()
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    word_column, id_column = (pa.concat_arrays(table.column(c).chunks) if len(names) else pa.array([]) for c in ("word", "id"))
    known = {
        names[a]: (word_column.slice(a, b - a), np.asarray(id_column.slice(a, b - a))) for a, b in zip(cuts, cuts[1:], strict=False) if b > a
    }
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        known = shared.value
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in common.chunks(batch, 1, CHUNK):
                seq, langs, words, _ = _parsed(some)
                ids = np.full(len(words), -1, np.int64)
                for lang in pc.unique(langs).to_pylist():
                    if lang in known:
                        own = np.flatnonzero(np.asarray(pc.equal(langs, lang)))
                        found = pc.index_in(words.take(pa.array(own)), value_set=known[lang][0])
                        hit = np.asarray(found.is_valid())
                        ids[own[hit]] = known[lang][1][np.asarray(found.drop_null())]
                number = np.full(len(ids) + 1, -1, np.int32)  # the last one answers for -1
                number[:-1][ids >= 0] = np.arange(int((ids >= 0).sum()))
                yield _chunk_line(chunk, number[seq], ids[ids >= 0])
                chunk += 1
                del seq, langs, words, ids, number
        common.release()

    return materialise(docs.mapInArrow(run, LINE), "by_word")


def numbered_there(docs: DataFrame, words: DataFrame) -> DataFrame:
    """The same by a join, for a table of any size: a chunk asks for the ids of its own words."""
    kinds = {
        "chunk": pa.int64(), "local": pa.int64(), "lang": pa.string(), "word": pa.string(),
        "known": pa.int32(), "seq": pa.list_(pa.int32()),
    }

    def line(rows: int, chunk: int, **columns) -> pa.RecordBatch:
        columns["chunk"] = pa.array(np.full(rows, chunk))
        return pa.record_batch([columns.get(c, pa.nulls(rows, kind)) for c, kind in kinds.items()], names=list(kinds))

    def run(batches):
        # numbers that no other task gives
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for some in common.chunks(batch, 1, CHUNK):
                seq, langs, words, counts = _parsed(some)
                n = len(counts)
                yield line(1, chunk, known=pa.array([n], pa.int32()), seq=_array(seq, pa.int32()))
                for at in range(0, n, 1 << 16):
                    k = min(1 << 16, n - at)
                    own = {"lang": langs.slice(at, k), "word": words.slice(at, k).cast(pa.string())}
                    yield line(k, chunk, local=pa.array(np.arange(at, at + k)), **own)
                chunk += 1

    coded = materialise(docs.mapInArrow(run, "chunk long, local long, lang string, word string, known int, seq array<int>"), "chunks")
    asked = coded.filter(F.col("local").isNotNull()).select("chunk", "local", "lang", "word")
    texts = coded.filter(F.col("known").isNotNull())
    return _renumbered(texts, asked, words, ["lang", "word"], _word_numbers, "by_word")


def ranked(counts: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``counts`` with ids 0, 1, 2, ... in ``order``, numbered by sorted ranges."""
    sorted_rows = materialise(counts.orderBy(*order).withColumn("_pos", F.monotonically_increasing_id()), name)
    part = F.shiftright("_pos", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range of the sort
    starts = sorted_rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = sorted_rows.withColumn("_part", part).join(F.broadcast(starts), "_part")
    ordinal = F.col("_before") + F.col("_pos").bitwiseAND((1 << 33) - 1)
    return materialise(numbered.select(*counts.columns, ordinal.alias("id")), name)


def _renumbered(chunk_rows: DataFrame, asked: DataFrame, table: DataFrame, on: list[str], renumber, name: str) -> DataFrame:
    """chunk, seq, ids: ``renumber(row, local numbers, ids)`` with the ids a chunk's own items have in ``table``."""
    answers = asked.join(table.select(*on, "id"), on).groupBy("chunk").agg(
        F.collect_list("local").alias("locals"), F.collect_list("id").alias("ids")
    )
    joined = chunk_rows.select("chunk", "known", "seq").join(answers, "chunk").select("chunk", "known", "seq", "locals", "ids")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                known = batch.column(1)[k].as_py()
                seq, local, ids = (np.asarray(batch.column(c)[k].values) for c in (2, 3, 4))
                order = np.argsort(local)
                yield _chunk_line(batch.column(0)[k].as_py(), renumber(known, seq, local[order]), ids[order])

    return materialise(joined.mapInArrow(run, LINE), name)


def _word_numbers(known: int, seq: np.ndarray, local: np.ndarray) -> np.ndarray:
    table = np.full(known + 1, -1, np.int32)
    table[local] = np.arange(len(local))
    return table[seq]  # the last entry answers for -1


def _pair_codes(known: int, seq: np.ndarray) -> np.ndarray:
    """Code of the pair that begins at each place of a chunk, -1 where there is none."""
    a, b = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    return np.where((a < 0) | (b < 0), -1, a * known + b)


def _pair_numbers(known: int, seq: np.ndarray, local: np.ndarray) -> np.ndarray:
    code = _pair_codes(known, seq)
    at = np.minimum(np.searchsorted(local, code), len(local) - 1)
    return np.where(local[at] == code, at, -1).astype(np.int32)


def _counted(chunk_rows: DataFrame, pairs_of) -> DataFrame:
    """size, i, j, f: counts of the pairs of ids that ``pairs_of(seq, ids)`` gives by size, summed over
    all chunks.

    A task adds up ``MERGE`` coordinates at a time itself. They are dealt out before Spark sums them,
    else each map task would hold a hash table of all of its pairs beside the worker's arrays.
    """

    def lines(size: int, i: np.ndarray, j: np.ndarray, n: np.ndarray):
        for at in range(0, len(i), 1 << 17):
            some = slice(at, at + (1 << 17))
            columns = [pa.array(np.full(len(i[some]), size, np.int32)), *[pa.array(x[some]) for x in (i, j, n)]]
            yield pa.record_batch(columns, names=["size", "i", "j", "n"])

    def run(batches):
        counts: dict[int, TileCounts] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                seq, ids = (np.asarray(batch.column(c)[k].values) for c in (0, 1))
                for size, (i, j) in pairs_of(seq, ids).items():
                    own = counts.setdefault(size, TileCounts())
                    own.add(i, j)
                    if own.held > MERGE:
                        yield from lines(size, *own.drained())
        for size in list(counts):
            yield from lines(size, *counts.pop(size).counted())
        common.release()

    partial = chunk_rows.select("seq", "ids").mapInArrow(run, "size int, i long, j long, n long")
    return partial.repartition("size", "i", "j").groupBy("size", "i", "j").agg(F.sum("n").alias("f"))


def _two(seq: np.ndarray, ids: np.ndarray) -> dict:
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    return {2: (ids[seq[:-1][both]], ids[seq[1:][both]])}


def _three_and_four(seq: np.ndarray, ids: np.ndarray) -> dict:
    """Pairs that overlap in a word, and pairs side by side with a frequent one across."""
    both = (seq[:-1] >= 0) & (seq[1:] >= 0)
    three = both[:-1] & both[1:]
    return {3: (ids[seq[:-1][both]], ids[seq[1:][both]]), 4: (ids[seq[:-2][three]], ids[seq[2:][three]])}


def longer_here(by_word: DataFrame, pairs: DataFrame) -> DataFrame:
    """size, i, j, f of phrases of three and four words as pairs of pair ids; with a table of pairs
    small enough for every worker, as sorted arrays."""
    table = pairs.select("i", "j", "id").toArrow()
    i, j, number = (np.asarray(table.column(c)).astype(np.int64) for c in ("i", "j", "id"))
    wide = int(j.max()) + 1 if len(j) else 1
    order = np.argsort(i * wide + j)
    shared = by_word.sparkSession.sparkContext.broadcast(((i * wide + j)[order], number[order], wide))

    def pairs_of(seq: np.ndarray, ids: np.ndarray) -> dict:
        codes, numbers, wide = shared.value
        a, b = (np.where(x >= 0, ids[x], -1) if len(ids) else x for x in (seq[:-1], seq[1:]))
        code = np.where((a < 0) | (b < 0) | (b >= wide), -1, a * wide + b)
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        # places in the sorted table stand for the pairs
        return _three_and_four(np.where(codes[at] == code, at, -1) if len(codes) else np.full(len(code), -1), numbers)

    return _counted(by_word, pairs_of)


def longer_there(by_word: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same by a join, for a table of any size: a chunk asks for the ids of its own pairs."""

    def ask(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                seq, ids = (np.asarray(batch.column(c)[k].values) for c in (1, 2))
                code = _pair_codes(len(ids), seq)
                code = np.unique(code[code >= 0])
                for at in range(0, len(code), 1 << 17):
                    some = code[at : at + (1 << 17)]
                    i, j = divmod(some, len(ids))
                    chunk = pa.array(np.full(len(some), batch.column(0)[k].as_py()), pa.int64())
                    yield pa.record_batch([chunk, pa.array(some), pa.array(ids[i]), pa.array(ids[j])], names=["chunk", "local", "i", "j"])

    asked = by_word.select("chunk", "seq", "ids").mapInArrow(ask, "chunk long, local long, i long, j long")
    return _counted(_renumbered(by_word, asked, pairs, ["i", "j"], _pair_numbers, "by_pair"), _three_and_four)


def frequent_phrases(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text"):
    """(words, phrases, totals): lang, word, f, id of the frequent words; ids (an array of word ids)
    and f of the frequent phrases of 2 to 4 words; lang and n, the number of all words."""
    texts = _texts(docs, lang, text)
    counts = word_counts(texts, least)
    totals = counts.filter(F.col("word").isNull()).select("lang", F.col("f").alias("n"))
    words = ranked(counts.filter(F.col("word").isNotNull()), [F.desc("f"), F.col("lang"), F.col("word")], "words")
    number = numbered_here if within(words.select("lang", "word"), HELD_WORDS, HELD_BYTES) else numbered_there
    by_word = number(texts, words)

    two = _counted(by_word, _two).filter(F.col("f") >= least).select("i", "j", "f")
    pairs = ranked(two, [F.desc("f"), F.col("i"), F.col("j")], "pairs")
    longer = longer_here if within(pairs.select("id"), HELD_PAIRS) else longer_there
    more = materialise(longer(by_word, pairs).filter(F.col("f") >= least), "longer")

    def ends(side):
        return pairs.select(F.col("id").alias(side), F.array("i", "j").alias(f"{side}_words"))

    longer = more.join(ends("i"), "i").join(ends("j"), "j")
    new = F.when(F.col("size") == 3, F.slice("j_words", 2, 1)).otherwise(F.col("j_words"))
    phrases = pairs.select(F.array("i", "j").alias("ids"), "f").unionByName(
        longer.select(F.concat("i_words", new).alias("ids"), "f")
    )
    return words, materialise(phrases, "phrases"), totals


def _slices_of(lengths: range, whole: Column) -> Column:
    """All contiguous parts of an array of ``LONGEST`` elements or fewer with the given lengths."""
    parts = [
        F.when(F.size(whole) >= at + k, F.slice(whole, at + 1, k)) for k in lengths for at in range(LONGEST - k + 1)
    ]
    return F.array_compact(F.array(*parts))


def collocations(
    docs: DataFrame, least: int = LEAST, top: int = TOP, covered: int = COVERED, lang: str = "lang", text: str = "text"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's best ``top`` phrases.

    The score is that of the weakest cut into two parts, floor(2000000 a / (l + r)). A phrase that
    lies in a longer frequent one at least ``covered`` percent of the time is left out.
    """
    words, phrases, totals = frequent_phrases(docs, least, lang, text)
    big = "decimal(20,0)"
    every = phrases.unionByName(words.select(F.array("id").alias("ids"), "f")).withColumnsRenamed({"ids": "part", "f": "part_f"})

    size = F.size("ids")
    cut = F.explode(F.sequence(F.lit(1), size - 1)).alias("k")
    halves = phrases.select("ids", F.col("f").alias("a"), cut).select(
        "ids", "a", "k", F.explode(F.array(F.struct(F.lit(True).alias("left"), F.slice("ids", F.lit(1), F.col("k")).alias("part")),
                                           F.struct(F.lit(False).alias("left"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("part")))).alias("h"),
    ).select("ids", "a", "k", "h.*")
    sums = halves.join(every, "part").groupBy("ids", "a", "k").agg(
        F.max(F.when(F.col("left"), F.col("part_f"))).alias("l"), F.max(F.when(~F.col("left"), F.col("part_f"))).alias("r")
    )
    score = F.expr(f"cast(a as {big}) * 2000000 div (cast(l as {big}) + cast(r as {big}))").cast("long").alias("score")
    best = sums.groupBy("ids", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("b")).select("ids", "a", "b.score", "b.l", "b.r")

    inside = phrases.filter(size > 2).select(F.explode(_slices_of(range(2, LONGEST), F.col("ids"))).alias("part"), "f", size.alias("of"))
    inside = inside.filter(F.size("part") < F.col("of")).groupBy("part").agg(F.max("f").alias("within"))
    kept = best.join(inside.withColumnRenamed("part", "ids"), "ids", "left")
    stands = F.expr(f"100 * cast(within as {big}) >= {covered} * cast(a as {big})")
    kept = kept.filter(~F.coalesce(stands, F.lit(False))).drop("within")

    spelled = kept.select("*", F.posexplode("ids").alias("at", "id")).join(words.select("id", "lang", "word"), "id")
    spelled = spelled.groupBy("ids", "a", "score", "l", "r", "lang").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = spelled.select("lang", F.concat_ws(" ", F.col("w.word")).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    first = top_k(named, ["lang"], order, top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return first.withColumn("rank", rank).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
