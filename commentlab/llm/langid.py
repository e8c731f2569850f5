"""Language identification with error-correcting output codes.

Every language owns a codeword of +1/-1 bits. For each bit a binary n-gram classifier tells the
languages with +1 from those with -1: its weight of a hashed n-gram is the log ratio of the
n-gram's mean smoothed probability on either side. A text is read by all bit classifiers, and
loss-weighted decoding picks the codeword with the least summed logistic loss; a small gap to the
runner-up is flagged as ambiguous.

Training counts n-grams of every training row: tasks count per language, Spark adds up, and the
driver receives languages x buckets numbers, whatever the input's size.

Defined results: a text that is NULL, empty or has no letter gives ``und`` with score 0; rows with
a NULL language or a NULL id do not train; equal losses go to the alphabetically first language;
without any training row every text is ``und``; repeated rows count as often as they occur; columns
other than id, text and language are not read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from commentlab.llm import common

ORDERS = (2, 3, 4)
BUCKET_BITS = 16
# Distinct languages that a task counts before it hands its counts on.
LANGUAGES_HELD = 32
# n-grams of one order beyond which further evidence is averaged instead of added.
EVIDENCE = 200
# Gap in loss below which a decision is ambiguous.
AMBIGUOUS = 1.0

_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class LanguageModel(NamedTuple):
    languages: list[str]
    codes: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # bits x buckets


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """``k`` codewords: all useful splits for up to 7 languages, else random ones far apart."""
    if k <= 7:
        rows = 2 ** max(k - 1, 0) - 1
        bits = [[1 if i == 0 or not (j >> (i - 1)) & 1 else -1 for j in range(1, rows + 1)] for i in range(k)]
        return np.array(bits, np.float32).reshape(k, rows)
    bits, rng, best = int(np.ceil(10 * np.log2(k))), np.random.default_rng(seed), None
    for _ in range(50):
        draw = rng.choice(np.array([1, -1], np.float32), (k, bits))
        useful = np.abs(draw.sum(axis=0)) < k
        apart = np.min(bits - draw @ draw.T + 2 * bits * np.eye(k))
        if useful.all() and (best is None or apart > best[0]):
            best = (apart, draw)
    return best[1] if best else draw


def _grams(n: int, letters: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram at each byte; -1 where it would run past its own text."""
    h = np.full(len(letters), n, np.uint32) * np.uint32(0x165667B1)
    for j in range(n):
        h[: max(len(letters) - j, 0)] += letters[j:] * _MULTIPLIERS[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out = (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)
    for j in range(1, n):
        last = offsets[1:] - j
        out[last[last >= offsets[:-1]]] = -1
    return out


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes as numbers, everything in ASCII but letters as a space."""
    data, offsets = common.text_bytes(pc.utf8_lower(column))
    keep = np.arange(256, dtype=np.uint32)
    keep[[b for b in range(128) if not 97 <= b <= 122]] = 32
    return keep[data], offsets


def _has_letter(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.match_substring_regex(column.fill_null(""), r"\p{L}"), bool)


def count_grams(rows: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, bucket, n) over all rows; buckets of the orders lie one after another."""
    at = rows.select(lang, text)
    size = 1 << BUCKET_BITS

    def emit(held):
        for name, counts in held.items():
            full = np.flatnonzero(counts)
            yield pa.record_batch(
                [pa.array([name] * len(full), pa.string()), pa.array(full, pa.int32()), pa.array(counts[full], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in common.chunks(batch, 1):
                names = part.column(0).to_pylist()
                letters, offsets = _letters(part.column(1))
                for name in set(names):
                    if name not in held and len(held) >= LANGUAGES_HELD:
                        yield from emit(held)
                        held = {}
                    held.setdefault(name, np.zeros(len(ORDERS) * size, np.int64))
                lengths = np.diff(offsets)
                for i, n in enumerate(ORDERS):
                    bucket = _grams(n, letters, offsets)
                    for name in set(names):
                        own = np.repeat(np.array([x == name for x in names], bool), lengths) & (bucket >= 0)
                        if name not in held:
                            held[name] = np.zeros(len(ORDERS) * size, np.int64)
                        held[name][i * size : (i + 1) * size] += np.bincount(bucket[own], minlength=size)
        yield from emit(held)

    return at.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").sum("n").toDF(
        "lang", "bucket", "n"
    )


def fit(rows: DataFrame, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit the bit classifiers on every row that has a text and a language."""
    table = count_grams(rows.filter(rows[text].isNotNull() & rows[lang].isNotNull()), text, lang).toArrow()
    languages = sorted(set(table.column("lang").to_pylist()))
    size = len(ORDERS) << BUCKET_BITS
    counts = np.zeros((len(languages), size))
    at = {name: i for i, name in enumerate(languages)}
    which = np.array([at[x] for x in table.column("lang").to_pylist()], np.int64)
    counts[which, np.asarray(table.column("bucket"), np.int64)] = np.asarray(table.column("n"))
    codes = codewords(len(languages))
    weights = np.zeros((codes.shape[1] if len(languages) else 0, size), np.float32)
    share = np.empty_like(counts)
    for i in range(len(ORDERS)):
        part = slice(i << BUCKET_BITS, (i + 1) << BUCKET_BITS)
        smooth = counts[:, part] + 0.5
        share[:, part] = smooth / smooth.sum(axis=1, keepdims=True)
    for b in range(codes.shape[1] if len(languages) else 0):
        plus, minus = share[codes[:, b] > 0].mean(axis=0), share[codes[:, b] < 0].mean(axis=0)
        weights[b] = np.log(plus / minus)
    return LanguageModel(languages, codes, weights)


def decode(margins: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, its probability and the loss gap to the next, per row of bit margins."""
    loss = np.zeros((len(margins), len(codes)))
    for k, word in enumerate(codes):
        loss[:, k] = np.logaddexp(0, -margins * word).sum(axis=1)
    best = loss.argmin(axis=1)
    least = loss[np.arange(len(loss)), best]
    score = 1 / np.exp(least[:, None] - loss).sum(axis=1)
    rest = loss.copy()
    rest[np.arange(len(loss)), best] = np.inf
    return best, score, rest.min(axis=1) - least if len(codes) > 1 else np.full(len(loss), np.inf)


def predict(docs: DataFrame, model: LanguageModel, held_out: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row, from its whole text."""
    languages, codes, weights = model
    bits = codes.shape[1] if len(languages) else 0

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        column = part.column(2)
        n = part.num_rows
        names, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
        known = _has_letter(column) if languages else np.zeros(n, bool)
        if known.any():
            letters, offsets = _letters(column)
            margins = np.zeros((n, bits))
            for i, order in enumerate(ORDERS):
                bucket = _grams(order, letters, offsets)
                there = bucket >= 0
                grams = np.maximum(common.per_text(there.astype(np.float32), offsets), 1)
                bucket[~there] = 0
                scale = np.minimum(grams, EVIDENCE) / grams / len(ORDERS)
                for b in range(bits):
                    own = weights[b, i << BUCKET_BITS : (i + 1) << BUCKET_BITS][bucket]
                    own[~there] = 0
                    margins[:, b] += common.per_text(own, offsets) * scale
            best, p, gap = decode(margins, codes)
            names[known] = np.array(languages, object)[best[known]]
            score[known] = np.clip(p[known], 0, 1)
            unsure[known] = gap[known] < AMBIGUOUS
        return pa.record_batch(
            [part.column(0), part.column(1), pa.array(names.tolist(), pa.string()), pa.array(score), pa.array(unsure)],
            names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
        )

    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(docs[doc_id].alias("doc_id"), held_out.alias("held_out"), docs[text].alias("text"))
    return common.map_chunks(
        rows, "text", work, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )
