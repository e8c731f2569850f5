"""Cross-tokenizer alignment: where the tokens of two vocabularies end together.

A is a byte-level vocabulary, B a piece model; both spell the bytes of one space and the text. The
byte offsets where a token of each ends cut the tokens into groups, and the two tokens that end
there are linked.

A fragment is what a byte range of a text says: the tokens that end in it, and how many of them
each vocabulary has up to the first common end (an open prefix), between common ends (closed
groups) and after the last one (an open suffix). As a list of sizes, fragments compose by adding
the last size of the left to the first of the right; that is associative, with ``[0]`` as the
neutral element. Texts of more than ``PART`` bytes are cut into ranges that different tasks
tokenise, each with as much text around its range as decides its tokens, and trees of ``FAN``
children put the fragments of a text together. Other texts are one fragment.

Counts of linked pairs: one of two tokens that end together spells the end of the other, so a pair
is told by the longer one and the length of the shorter one. That gives every possible pair a
number below the sum of all token lengths of both vocabularies; tasks count by these numbers, and
the counts that reach the driver are bounded by the vocabularies, whatever the corpus holds.

Defined results: NULL and empty texts, and texts that a vocabulary does not spell back (those with
U+2581), have no tokens; strings of special tokens are ordinary text; every row, also a repeated
one or one with a NULL id, is a text of its own; an empty table gives no rows. Columns other than
id and text are not read.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from commentlab.llm import common
from commentlab.llm.bpe import Encoder, gather
from commentlab.llm.packing import LibraryEncoder
from commentlab.session import materialise

# Bytes of a long text that one task tokenises, and fragments that are composed at a time.
PART = 1 << 16
FAN = 8
# Bytes of text aligned at a time.
TEXT_BYTES = 1 << 18
# Tokens whose groups are written out at a time.
TOKENS = 1 << 17
# Words that a worker remembers for each vocabulary.
CACHE = 150_000
BLANK = "▁"


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level vocabulary, which spells every byte as a character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    out = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        out[i] = bytes(byte[c] for c in token)
    for i in tokenizer.get_added_tokens_decoder():
        out[i] = b""  # never found in ordinary text
    return out


def piece_tokens(path: str) -> tuple[list[bytes], np.ndarray]:
    """Bytes of each id of a piece model, and which ids stand for one byte."""
    model = SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    single = np.array([model.is_byte(i) for i in range(size)])
    out = []
    for i in range(size):
        piece = model.id_to_piece(i)
        if single[i]:
            out.append(bytes([int(piece[3:5], 16)]))
        else:
            out.append(b"" if model.is_control(i) or model.is_unknown(i) else piece.replace(BLANK, " ").encode())
    return out, single


class PieceEncoder(Encoder):
    """Ids of a piece model for texts that begin with a space, whose words the model sees once.

    A word is a run of spaces and what follows up to the next one. No piece of the model holds a
    space after something else, so pieces never cross words.
    """

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        self.tokens, _ = piece_tokens(path)
        if any(b" " in t.lstrip(b" ") for t in self.tokens):
            raise ValueError("the model has pieces that cross words")
        self.width = np.array([len(t) for t in self.tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(self.width)])
        self.blank = self.model.encode("a ")[len(self.model.encode("a")) :]
        self._clear()

    def _clear(self) -> None:
        super()._clear()
        self.bad = np.zeros(0, bool)

    def _merged(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # the model puts a space before what it is given
        found = self.model.encode([w[1:].decode() for w in new], num_threads=1)
        found = [x or self.blank for x in found]
        per = np.array([len(x) for x in found], np.int64)
        ids = np.concatenate([np.array(x, np.int64) for x in found])
        begin = np.concatenate([[0], np.cumsum(per)[:-1]])
        spelled = np.add.reduceat(self.width[ids], begin)
        size = np.array([len(w) for w in new], np.int64)
        bad = spelled != size
        same = np.flatnonzero(~bad)
        ours = gather(np.cumsum(size)[same] - size[same], size[same])
        own = np.frombuffer(b"".join(new), np.uint8)[ours]
        keep = np.repeat(~bad, per)
        theirs = self.bytes[gather(self.starts[ids[keep]], self.width[ids[keep]])]
        off = np.flatnonzero(own != theirs)
        bad[same[np.searchsorted(np.cumsum(size[same]), off, side="right")]] = True
        self.bad = np.concatenate([self.bad, bad])
        return ids, per

    def spelled(self, data: np.ndarray, offsets: np.ndarray):
        """Ids, their ends in ``data``, and which texts are not spelled back."""
        blank = data == 0x20
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        starts = np.flatnonzero(blank & (head[:-1] | ~np.concatenate([[False], blank[:-1]])))
        cuts = np.append(starts, len(data)).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        codes = self._codes(words.cast(pa.binary()) if len(data) < 1 << 31 else words)
        begin, per = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        ids = self.ids[gather(begin, per)]
        total = np.concatenate([[0], np.cumsum(self.width[ids])])
        first = np.cumsum(per) - per
        ends = total[1:] + np.repeat(starts - total[first], per)
        bad = np.zeros(len(offsets) - 1, bool)
        wrong = starts[self.bad[codes]]
        bad[np.searchsorted(offsets, wrong, side="right") - 1] = True
        return ids, ends, bad


class Aligner:
    """Tokens and group sizes of a column of texts that begin with a space."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = LibraryEncoder(byte_path, plain=True), PieceEncoder(piece_path)
        self.a.cache = self.b.cache = CACHE

    def fragments(self, column: pa.Array, lo: np.ndarray | None = None, hi: np.ndarray | None = None):
        """(ids, bounds, sizes, bounds) of A and of B, and which texts are not spelled back.

        ``lo`` and ``hi`` are byte ranges within the texts; without them a text is one range. The
        sizes of a text are those of its fragment, suffix last.
        """
        data, offsets = common.text_bytes(column)
        if not len(data):
            none = np.zeros(len(column) + 1, np.int64)
            sizes = np.zeros(len(column), np.int64), np.arange(len(column) + 1)
            return [(np.zeros(0, np.int64), none, *sizes)] * 2, np.zeros(len(column), bool)
        b_ids, b_ends, bad = self.b.spelled(data, offsets)
        if bad.any():  # without their texts the rest is as it was
            if lo is not None:
                lo, hi = np.where(bad, 0, lo), np.where(bad, 0, hi)
            found, _ = self.fragments(pc.if_else(pa.array(bad), "", column), lo, hi)
            return found, bad
        a_ids = self.a.encode(column)[0]
        a_ends = np.cumsum(self.a.width[a_ids])
        marks = np.zeros(len(data) + 1, np.uint8)
        marks[a_ends] += 1
        marks[b_ends] += 1
        first, last = (offsets[:-1], offsets[1:]) if lo is None else (offsets[:-1] + lo, offsets[:-1] + hi)
        out = []
        for ids, ends in ((a_ids, a_ends), (b_ids, b_ends)):
            x, y = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="right")
            own = gather(x, y - x)  # tokens that end in their text's range
            bounds = np.concatenate([[0], np.cumsum(y - x)])
            # a size ends at every common end, and with the range
            closing = np.flatnonzero(marks[ends[own]] == 2) + 1
            of_text = np.searchsorted(bounds, closing, side="left") - 1
            stops = np.concatenate([closing, bounds[1:]])
            order = np.argsort(np.concatenate([of_text * 2, np.arange(len(x)) * 2 + 1]), kind="stable")
            stops = stops[order]
            sizes = np.diff(stops, prepend=0)
            size_bounds = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(x)) + 1)])
            out.append((ids[own], bounds, sizes, size_bounds))
        return out, bad


def _led(column: pa.Array) -> pa.Array:
    """The texts with a space before them; NULL and empty ones are empty."""
    text = column.fill_null("")
    return pc.if_else(pc.equal(pc.binary_length(text), 0), text, pc.binary_join_element_wise(" ", text, ""))


def ranges(data: bytes, part: int) -> list[tuple[int, int, int, int]]:
    """(lo, hi, begin, end): byte ranges of a text, and the slice that decides the range's tokens.

    Slices begin and end before a space that follows something else and is followed by no white
    space, where tokens of both vocabularies end. Where the next such place is far away the range
    ends there, so slices overlap by a quarter of a part at most.
    """
    x = np.frombuffer(data, np.uint8)
    white = common.SPACE[x]
    low = x < 0x80
    here = np.flatnonzero((x[1:-1] == 0x20) & ~white[:-2] & ~white[2:] & (low[:-2] | low[2:])) + 1
    safe = np.concatenate([[0], here, [len(x)]])
    edges = [0]
    while edges[-1] < len(x):
        want = min(edges[-1] + part, len(x))
        after = safe[np.searchsorted(safe, want)]
        before = safe[np.searchsorted(safe, want, side="right") - 1]
        edges.append(int(after if after - before > part // 4 else want))
    return [
        (lo, hi, int(safe[np.searchsorted(safe, lo, side="right") - 1]), int(safe[np.searchsorted(safe, hi)]))
        for lo, hi in zip(edges, edges[1:], strict=False)
    ]


LISTS = "a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"


def _lists(found) -> list[pa.Array]:
    (a, a_bounds, a_sizes, a_cuts), (b, b_bounds, b_sizes, b_cuts) = found
    pairs = ((a, a_bounds), (b, b_bounds), (a_sizes, a_cuts), (b_sizes, b_cuts))
    return [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x, pa.int32())) for x, cut in pairs]


def _closed(found):
    """Fragments of whole texts without their last size, which is 0."""
    out = []
    for ids, bounds, sizes, cuts in found:
        keep = np.ones(len(sizes), bool)
        keep[cuts[1:] - 1] = False
        out.append((ids, bounds, sizes[keep], cuts - np.arange(len(cuts))))
    return out


def compose(group: pa.Table) -> pa.Table:
    """The fragments of neighbouring ranges of one text as one fragment."""
    rows = group.sort_by("part").to_pylist()
    out = {c: rows[0][c] for c in ("doc_id", "row")} | {"part": rows[0]["part"] // FAN}
    out |= {"parts": -(-rows[0]["parts"] // FAN), "bad": any(r["bad"] for r in rows)}
    for side in "ab":
        out[f"{side}_ids"] = [i for r in rows for i in r[f"{side}_ids"]]
        out[f"{side}_sizes"] = reduce(lambda x, y: [*x[:-1], x[-1] + y[0], *y[1:]], (r[f"{side}_sizes"] for r in rows))
    return pa.Table.from_pylist([out], group.schema)


def _long_texts(docs: DataFrame, byte_path: str, piece_path: str, part: int) -> DataFrame:
    """doc_id and the lists of texts of more than ``part`` bytes, cut up and put together again."""
    kind = dict(docs.dtypes)["doc_id"]
    numbered = docs.withColumn("row", F.monotonically_increasing_id())

    def cut(batches):
        for batch in batches:
            for one in common.chunks(batch, 1, part):
                for doc, text, row in zip(*(c.to_pylist() for c in one.columns), strict=True):
                    data = b" " + text.encode()
                    found = ranges(data, part)
                    for i, (lo, hi, begin, end) in enumerate(found):
                        values = [doc, row, i, len(found), lo - begin, hi - begin, data[begin:end].decode()]
                        types = [one.schema.field(0).type, *[pa.int64()] * 5, pa.string()]
                        columns = [pa.array([v], t) for v, t in zip(values, types, strict=True)]
                        yield pa.record_batch(columns, names=["doc_id", "row", "part", "parts", "lo", "hi", "text"])

    class Work:
        @staticmethod
        def prepare():
            aligner = common.kept(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))

            def work(some):
                lo, hi = (np.asarray(some.column(i)) for i in (4, 5))
                found, bad = aligner.fragments(some.column(6), lo, hi)
                names = ["doc_id", "row", "part", "parts", "bad", "a_ids", "b_ids", "a_sizes", "b_sizes"]
                return pa.record_batch([*some.columns[:4], pa.array(bad), *_lists(found)], names=names)

            return work

    head = f"doc_id {kind}, row long, part long, parts long"
    slices = numbered.mapInArrow(cut, f"{head}, lo long, hi long, text string")
    spread = materialise(slices, "parts").repartition(F.col("row"), F.col("part"))
    found = materialise(common.map_chunks(spread, "text", Work, f"{head}, bad boolean, {LISTS}", TEXT_BYTES), "fragments")
    most = found.agg(F.max("parts")).first()[0] or 1
    while most > 1:
        grouped = found.groupBy(F.col("row").alias("_row"), F.floor(F.col("part") / FAN).alias("_at"))
        found, most = grouped.applyInArrow(compose, found.schema), -(-most // FAN)

    def whole(name):
        # the last size of a whole text is 0
        ids = F.col(name) if name.endswith("ids") else F.slice(name, 1, F.size(name) - 1)
        return F.when(F.col("bad"), F.array().cast("array<int>")).otherwise(ids).alias(name)

    return found.select("doc_id", *[whole(c) for c in ("a_ids", "b_ids", "a_sizes", "b_sizes")])


def _parts_of(docs: DataFrame, doc_id: str, text: str, part: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of texts up to ``part`` bytes, and of longer ones."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    long = F.coalesce(F.octet_length("text") > part, F.lit(False))
    return rows.filter(~long), rows.filter(long)


def aligned(
    docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", part: int = PART
) -> DataFrame:
    """doc_id, a_ids, b_ids, a_sizes, b_sizes: tokens of both vocabularies, and how many each group has."""
    kind = dict(docs.dtypes)[doc_id]
    short, long = _parts_of(docs, doc_id, text, part)

    class Work:
        @staticmethod
        def prepare():
            aligner = common.kept(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))

            def work(some):
                found = _closed(aligner.fragments(_led(some.column(1)))[0])
                return pa.record_batch([some.column(0), *_lists(found)], names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

            return work

    found = common.map_chunks(short, "text", Work, f"doc_id {kind}, {LISTS}", TEXT_BYTES)
    return found.unionByName(_long_texts(long, byte_path, piece_path, part))


class Numbers:
    """A number for every pair of tokens that can end together; small, and sent with the tasks."""

    def __init__(self, a: list[bytes], b: list[bytes], single: np.ndarray):
        self.single = single
        self.a_size, self.b_size = (np.array([len(t) for t in x], np.int64) for x in (a, b))
        self.a_start = np.cumsum(self.a_size) - self.a_size
        self.b_start = self.a_size.sum() + np.cumsum(self.b_size) - self.b_size
        self.singles = int(self.a_size.sum() + self.b_size.sum())
        self.n = self.singles + len(a)

    def codes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.a_size[a], self.b_size[b]
        out = np.where(x >= y, self.a_start[a] + y, self.b_start[b] + x) - 1
        return np.where(self.single[b], self.singles + a, out).astype(np.int32)


class Pairs(Numbers):
    """The numbers and the pairs they stand for, for the driver."""

    def __init__(self, byte_path: str, piece_path: str):
        a, (b, single) = byte_tokens(byte_path), piece_tokens(piece_path)
        super().__init__(a, b, single)
        self.numbers = Numbers(a, b, single)
        a_ids = {t: i for i, t in enumerate(a) if t}
        b_ids = {t: i for i, t in enumerate(b) if t and not single[i]}
        bytes_ids = {t: i for i, t in enumerate(b) if single[i]}
        ends = [(i, t[-k:]) for i, t in enumerate(a) for k in range(1, len(t) + 1)]
        self.a_of = [i for i, _ in ends] + [a_ids.get(t[-k:], -1) for t in b for k in range(1, len(t) + 1)]
        self.b_of = [b_ids.get(t, -1) for _, t in ends] + [i for i, t in enumerate(b) for _ in t]
        self.a_of = np.array(self.a_of + list(range(len(a))), np.int64)
        self.b_of = np.array(self.b_of + [bytes_ids.get(t[-1:], -1) for t in a], np.int64)


def _links(a: np.ndarray, b: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray, pairs: Numbers) -> np.ndarray:
    """Codes of the tokens that end each group."""
    return pairs.codes(a[np.cumsum(a_sizes) - 1], b[np.cumsum(b_sizes) - 1])


def _spell(found, digits: np.ndarray, place: np.ndarray) -> list[str]:
    """Digest of each text's groups, written as decimal ids; '' without tokens."""
    (a, a_bounds, a_sizes, cuts), (b, b_bounds, b_sizes, _) = found
    size = len(a) + len(b)
    keys, a_done, b_done = np.zeros(size, np.int64), np.cumsum(a_sizes), np.cumsum(b_sizes)
    mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    mark_a[a_done - 1], mark_b[b_done - 1] = 1, 2
    keys[np.arange(len(a)) + np.repeat(b_done - b_sizes, a_sizes)] = a * 3 + mark_a
    keys[np.arange(len(b)) + np.repeat(a_done, b_sizes)] = b * 3 + mark_b
    said = place[keys + 1] - place[keys]
    listed = digits[gather(place[keys], said)].tobytes()
    ends = np.concatenate([[0], np.cumsum(said)])[a_bounds + b_bounds].tolist()
    pairs = zip(ends, ends[1:], strict=False)
    return [hashlib.sha256(listed[x : y - 1]).hexdigest() if y > x else "" for x, y in pairs]


def _flat(some: pa.RecordBatch):
    """The four list columns of a batch as arrays with bounds."""
    out = []
    for ids, sizes in ((1, 3), (2, 4)):
        pair = []
        for i in (ids, sizes):
            column = some.column(i)
            pair += [np.asarray(column.flatten()).astype(np.int64), np.concatenate([[0], np.cumsum(pc.list_value_length(column))])]
        out.append(tuple(pair))
    return out


def _told(rows: DataFrame, text: str, find, pairs: Numbers, limit: int) -> DataFrame:
    """doc_id, n_a, n_b, groups_sha256 and the codes of the links of each row."""
    many = max(len(pairs.a_size), len(pairs.b_size))

    def tables():
        said = [b"%d%s" % (i, mark) for i in range(many) for mark in (b",", b"|", b";")]
        return np.frombuffer(b"".join(said), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in said])])

    class Work:
        @staticmethod
        def prepare():
            digits, place = common.kept(("decimals", many), tables)
            groups_of = find()

            def work(some):
                found = groups_of(some)
                (a, a_bounds, a_sizes, cuts), (b, b_bounds, b_sizes, _) = found
                links = pa.array(_links(a, b, a_sizes, b_sizes, pairs), pa.int32())
                return pa.record_batch(
                    [
                        some.column(0),
                        pa.array(np.diff(a_bounds), pa.int64()),
                        pa.array(np.diff(b_bounds), pa.int64()),
                        pa.array(_spell(found, digits, place)),
                        pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), links),
                    ],
                    names=["doc_id", "n_a", "n_b", "groups_sha256", "links"],
                )

            return work

    kind = dict(rows.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_a long, n_b long, groups_sha256 string, links array<int>"
    return common.map_chunks(rows, text, Work, schema, limit)


def link_counts(told: DataFrame, size: int) -> np.ndarray:
    """How often each code occurs in ``links``; ``size`` numbers, bounded by the vocabularies."""

    def count(batches):
        common.forget()
        total = np.zeros(size, np.int64)
        for batch in batches:
            for some in common.chunks(batch, 0, TOKENS):
                total += np.bincount(np.asarray(some.column(0).flatten()), minlength=size)
        code = np.flatnonzero(total)
        yield pa.record_batch([pa.array(code, pa.int32()), pa.array(total[code])], names=["code", "n"])

    found = told.select("links").mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[np.asarray(found.column("code"))] = np.asarray(found.column("n"))
    return out


def digests(
    docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", part: int = PART
) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text.

    Texts are tokenised once. What is stored are the codes of the links and the digest; a second
    pass over them looks their corpus-wide counts up.
    """
    short, long = _parts_of(docs, doc_id, text, part)

    def encoder():
        aligner = common.kept(("aligner", byte_path, piece_path), lambda: Aligner(byte_path, piece_path))
        return lambda some: _closed(aligner.fragments(_led(some.column(1)))[0])

    pairs = Pairs(byte_path, piece_path)
    told = _told(short, "text", encoder, pairs.numbers, TEXT_BYTES)
    composed = _long_texts(long, byte_path, piece_path, part)
    told = told.unionByName(_told(composed, "a_ids", lambda: _flat, pairs.numbers, TOKENS))
    told = materialise(told, "links")
    counts = link_counts(told, pairs.n)
    real = pairs.b_of >= 0
    highest = np.zeros(len(pairs.b_size), np.int64)
    np.maximum.at(highest, pairs.b_of[real], counts[real])
    best = real & (counts == highest[pairs.b_of])
    shared = docs.sparkSession.sparkContext.broadcast((counts, best))

    def look_up(batches):
        common.forget()
        counts, best = shared.value
        for batch in batches:
            for some in common.chunks(batch, 4, TOKENS):
                links, size = np.asarray(some.column(4).flatten()), np.asarray(pc.list_value_length(some.column(4)))
                ends = np.concatenate([[0], np.cumsum(size)])
                sums = [np.concatenate([[0], np.cumsum(x[links])])[ends] for x in (best, counts)]
                yield pa.record_batch(
                    [*some.columns[:3], *[pa.array(size, pa.int64())] * 2, *[pa.array(np.diff(x), pa.int64()) for x in sums], some.column(3)],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
                )

    kind = dict(told.dtypes)["doc_id"]
    numbers = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"))
    return told.mapInArrow(look_up, f"doc_id {kind}, {numbers}, groups_sha256 string")


def pair_counts(aligned_rows: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """a_id, b_id, n: how many links of the corpus hold each pair; as many rows as pairs occur."""
    pairs = Pairs(byte_path, piece_path)
    told = _told(aligned_rows, "a_ids", lambda: _flat, pairs.numbers, TOKENS)
    counts = link_counts(told, pairs.n)
    code = np.flatnonzero(counts)
    table = pa.table({"a_id": pairs.a_of[code].astype(np.int32), "b_id": pairs.b_of[code].astype(np.int32), "n": counts[code]})
    return aligned_rows.sparkSession.createDataFrame(table)
