"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding.

A text is an array of code points, each mapped to a class (letter, number, white space, other).
Every character acts on the state of the scan either as a constant (it begins a run) or as the
identity (it continues one); composition of such functions is associative, and its prefix scan is
a running maximum over the last place that was constant. From run starts and a look at the
neighbours all token boundaries of the public pattern follow without a regular expression:

* a run of letters, numbers or others is a token, with one U+0020 before it taken along;
* of white space before such a run the last character is left: it joins the run if it is U+0020;
* ``'s 't 're 've 'm 'll 'd`` are tokens of their own if the apostrophe begins a match, that is, if
  its run is that one character and no U+0020 stands before it.

Tokens are slices of the column's own bytes, which Arrow reduces to the distinct ones of a chunk;
those not seen before by the worker are merged together: a padded matrix of symbols, the pair of
least rank in each row merged per step. Ids keep their token's offset in the text, and decoding
concatenates the bytes of the ids.

Defined results: a NULL text is empty; empty texts have no ids; special tokens are ordinary text.
Columns other than those asked for are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from commentlab.llm import common

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# Distinct tokens that a worker remembers.
CACHE = 400_000
# Bytes of text encoded at a time.
TEXT_BYTES = 1 << 21


def character_classes() -> np.ndarray:
    """Class of every code point."""
    kind = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            first, last = ord(run.group()[0]), ord(run.group()[-1])
            kind[first : last + 1] = k
    return kind


def boundaries(cp: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Places where tokens begin in concatenated texts; ``first`` are the texts' first places."""
    n = len(cp)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds[cp]
    head = np.zeros(n + 1, bool)  # a text begins here
    head[first] = True
    tail = head[1:]  # a text ends here
    fresh = head[:-1].copy()  # constants of the scan: a run begins here
    fresh[1:] |= kind[1:] != kind[:-1]
    space = kind == SPACE
    blank = cp == 0x20
    after_blank = np.zeros(n, bool)  # a U+0020 of the same text stands before
    after_blank[1:] = blank[:-1]
    after_blank &= ~head[:-1]
    next_solid = np.zeros(n, bool)
    next_solid[:-1] = ~space[1:]
    next_solid &= ~tail
    begin = fresh & ~after_blank & ~space
    # White space: where its run begins, and its last character before something else.
    begin |= space & (fresh | next_solid)
    at = np.flatnonzero((cp == 0x27) & fresh & ~after_blank & ~tail)
    if len(at):
        run = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # start of the run of each place
        one, two = np.minimum(at + 1, n - 1), np.minimum(at + 2, n - 1)
        alone = run[one] != run[at]
        a, b = cp[one], cp[two]
        single = alone & np.isin(a, [ord(c) for c in "stmd"])
        pair = (
            alone & ~tail[one] & (at + 2 < n)
            & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        )
        for which, length in ((single, 2), (pair & ~single, 3)):
            begin[at[which] + 1] = False
            end = at[which] + length
            end = end[end < n]
            begin[end[~space[end] | next_solid[end] | fresh[end]]] = True
    return np.flatnonzero(begin)


class Merger:
    """Token ids of byte strings by ranked pair merging, many at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.size = max(ranks.values()) + 1
        tokens = [b""] * self.size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        lengths = np.array([len(t) for t in tokens], np.int64)
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        # every way to make a token of two tokens
        keys, made = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a * self.size + b)
                    made.append(rank)
        order = np.argsort(keys)
        keys, made = np.array(keys, np.int64)[order], np.array(made, np.int32)[order]
        self.bits = 22
        self.table_key = np.full(1 << self.bits, -1, np.int64)
        self.table_value = np.zeros(1 << self.bits, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # open addressing, all keys at once
            free = self.table_key[slot[left]] == -1
            self.table_key[slot[left[free]]] = keys[left[free]]
            placed = self.table_key[slot[left]] == keys[left]
            self.table_value[slot[left[placed]]] = made[left[placed]]
            left = left[~placed]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that two symbols make, or a number above all ranks."""
        none = np.int64(1 << 30)
        keys = a * self.size + b
        keys[(a < 0) | (b < 0)] = -2
        out = np.full(len(keys), none)
        slot, left = self._slot(keys), np.flatnonzero(keys >= 0)
        while len(left):
            seen = self.table_key[slot[left]]
            hit = seen == keys[left]
            out[left[hit]] = self.table_value[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of each byte string; one that is a token itself is not taken apart."""
        whole = [self.ranks.get(w) for w in words]
        out: list[np.ndarray] = [None if r is None else np.array([r], np.int64) for r in whole]
        order = sorted((i for i, r in enumerate(whole) if r is None), key=lambda i: len(words[i]))
        at = 0
        while at < len(order):
            longest, stop = len(words[order[at]]), at
            while stop < len(order) and len(words[order[stop]]) <= max(longest + 2, 4) and stop - at < 20_000:
                stop += 1
            some = order[at:stop]
            at = stop
            if len(words[some[-1]]) > 400:
                for i in some:
                    out[i] = self._long(words[i])
                continue
            for i, ids in zip(some, self._matrix([words[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _matrix(self, words: list[bytes]) -> list[np.ndarray]:
        lengths = np.array([len(w) for w in words], np.int64)
        wide = int(lengths.max())
        symbols = np.full((len(words), wide + 1), -1, np.int64)
        flat = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        symbols[np.arange(wide + 1) < lengths[:, None]] = flat
        left = lengths.copy()
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(words), wide)
        live = np.arange(len(words))
        while len(live):
            best = ranks[live].argmin(axis=1)
            made = ranks[live, best]
            go = made < (1 << 30)
            live, best, made = live[go], best[go], made[go]
            if not len(live):
                break
            symbols[live, best] = made
            place = np.arange(wide)
            moved = symbols[live]
            # close the gap after the merged symbol
            shift = place[None, :] > best[:, None]
            moved[:, :-1] = np.where(shift, moved[:, 1:], moved[:, :-1])
            moved[:, -1] = -1
            symbols[live] = moved
            r = ranks[live]
            r[:, :-1] = np.where(place[None, :-1] > best[:, None], r[:, 1:], r[:, :-1])
            r[:, -1] = 1 << 30
            rows = np.arange(len(live))
            r[rows, best] = self.rank(moved[rows, best], moved[rows, np.minimum(best + 1, wide)])
            back = best > 0
            r[rows[back], best[back] - 1] = self.rank(moved[rows[back], best[back] - 1], moved[rows[back], best[back]])
            ranks[live] = r
            left[live] -= 1
        return [row[:n] for row, n in zip(symbols, left, strict=True)]

    def _long(self, word: bytes) -> np.ndarray:
        """One long string: a heap of pairs over a linked list, n log n."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank(np.array(ids[:-1], np.int64), np.array(ids[1:], np.int64)).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < 1 << 30]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    r = int(self.rank(np.array([ids[x]]), np.array([ids[y]]))[0])
                    if r < 1 << 30:
                        heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([i for i in ids if i >= 0], np.int64)


def load_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file of ranks: base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of all elements of many slices, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes text columns; tokens seen before are looked up, up to ``cache`` of them."""

    cache = CACHE

    def __init__(self, ranks: dict[bytes, int]):
        self.kinds, self.merger = character_classes(), Merger(ranks)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.ids = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)  # ends[i] is where the ids of token i - 1 end

    def _merged(self, new: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all new tokens, one after another, and how many each has."""
        merged = self.merger.merge(new)
        return np.concatenate(merged), np.array([len(x) for x in merged], np.int64)

    def _learn(self, new: list[bytes]) -> None:
        merged, lengths = self._merged(new)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, merged.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])

    def _codes(self, tokens: pa.Array) -> np.ndarray:
        """Number of each token among the known ones, after learning the new ones."""
        told = tokens.dictionary_encode()
        data, offsets = common.text_bytes(told.dictionary)
        data, places = data.tobytes(), offsets.tolist()
        words = [data[a:b] for a, b in zip(places, places[1:], strict=False)]
        if len(self.known) > self.cache:
            self._clear()
        codes = list(map(self.known.get, words))
        if None in codes:
            n = len(self.known)
            fresh = [i for i, code in enumerate(codes) if code is None]
            self._learn([words[i] for i in fresh])
            for i, at in enumerate(fresh, n):
                codes[at] = i
        return np.array(codes, np.int64)[np.asarray(told.indices)]

    def _spelled(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the slices of ``data`` that begin at ``starts``, and how many each has."""
        cuts = np.append(starts, len(data)).astype(np.int64)
        tokens = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        codes = self._codes(tokens.cast(pa.binary()) if len(data) < 1 << 31 else tokens)
        begin, per = self.ends[codes], self.ends[codes + 1] - self.ends[codes]
        return self.ids[gather(begin, per)], per

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, the texts' bounds in them (n + 1), ids per token, tokens' places."""
        data, offsets = common.text_bytes(column)
        at = np.flatnonzero((data & 0xC0) != 0x80)  # where code points begin
        if len(at) == len(data):
            cp, first = data, offsets
        else:
            cp = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            first = np.searchsorted(at, offsets)
        starts = boundaries(cp, first, self.kinds)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(column) + 1, np.int64), np.zeros(0, np.int64), starts
        ids, per = self._spelled(data, at[starts])
        of_text = np.searchsorted(starts, first)
        bounds = np.concatenate([[0], np.cumsum(per)])[of_text]
        return ids, bounds, per, starts

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, and the bounds (n + 1) of each id's bytes."""
        begin = self.merger.starts[ids]
        lengths = self.merger.starts[ids + 1] - begin
        return self.merger.bytes[gather(begin, lengths)], np.concatenate([[0], np.cumsum(lengths)])


def encoded(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, places: token ids, and for each id the code point where its token begins."""
    kind = dict(docs.dtypes)[doc_id]
    ranks = load_ranks(vocabulary)

    class Work:
        @staticmethod
        def prepare():
            encoder = common.kept(("ranks", vocabulary), lambda: Encoder(ranks))

            def work(part):
                ids, bounds, per, starts = encoder.encode(part.column(1))
                lengths = np.array([len(x or "") for x in part.column(1).to_pylist()], np.int64)
                place = np.repeat(starts, per) - np.repeat(np.cumsum(lengths) - lengths, np.diff(bounds))
                ends = pa.array(bounds.astype(np.int32))
                return pa.record_batch(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32())),
                        pa.ListArray.from_arrays(ends, pa.array(place, pa.int64())),
                    ],
                    names=["doc_id", "ids", "places"],
                )

            return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return common.map_chunks(rows, "text", Work, f"doc_id {kind}, ids array<int>, places array<long>", TEXT_BYTES)


def decoded(rows: DataFrame, vocabulary: str, ids: str = "ids") -> DataFrame:
    """``rows`` with the bytes of ``ids`` added as ``decoded``; NULL ids are no bytes."""
    tokens_of = load_ranks(vocabulary)

    def run(batches):
        tokens = {rank: token for token, rank in tokens_of.items()}
        at = None
        for batch in batches:
            at = batch.schema.get_field_index(ids) if at is None else at
            out = [b"".join(tokens[i] for i in x or ()) for x in batch.column(at).to_pylist()]
            yield pa.record_batch([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, StructType([*rows.schema, StructField("decoded", BinaryType())]))


def digests(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: a round trip told by digests, ids staying in the task."""
    kind = dict(docs.dtypes)[doc_id]
    ranks = load_ranks(vocabulary)

    class Work:
        @staticmethod
        def prepare():
            encoder = common.kept(("ranks", vocabulary), lambda: Encoder(ranks))
            numbers = [b"%d " % i for i in range(encoder.merger.size)]
            digits = np.frombuffer(b"".join(numbers), np.uint8)
            place = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])

            def work(part):
                ids, bounds, _, _ = encoder.encode(part.column(1))
                said = place[ids + 1] - place[ids]
                listed = digits[gather(place[ids], said)].tobytes()
                said = np.concatenate([[0], np.cumsum(said)])[bounds].tolist()
                plain, ends = encoder.decode(ids)
                plain, ends = plain.tobytes(), ends[bounds].tolist()
                sha = hashlib.sha256
                return pa.record_batch(
                    [
                        part.column(0),
                        pa.array(np.diff(bounds)),
                        pa.array([sha(listed[a : max(a, b - 1)]).hexdigest() for a, b in zip(said, said[1:], strict=False)]),
                        pa.array([sha(plain[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

            return work

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return common.map_chunks(rows, "text", Work, schema, TEXT_BYTES)
