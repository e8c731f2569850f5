"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

Two words are alike by the gap-weighted subsequences of four characters they share: each
occurrence that spans s characters (s <= 6, so up to two foreign characters may sit inside) weighs
``DECAY ** (s - 4)``. Words carry their bounds, punctuation inside a word is dropped, and runs of
single characters are joined, so ``i.d.i.o.t`` and ``i d i o t`` read as one word.

Labels are per document; a sentence of a clean document is clean, and the worst word's sentence of
a toxic document is toxic. Training alternates between picking that word under the current model
and fitting: ``LANDMARKS`` words span the Nystroem features, a squared-hinge linear machine is
fitted on them by Newton steps. As the kernel is an explicit sum over subsequences, the fitted
machine collapses into one weight per (hashed) subsequence, and scoring is linear in the text. A
document's decision is that of its worst word, mapped to a probability by Platt's logistic.

Training rows are a bounded, documented sample (``MAX_TRAIN`` ids per class with the least hash,
``PER_DOC`` words each, words up to ``MAX_WORD`` characters); scoring reads every whole text.

Defined results: a NULL or empty text, or one without letters or digits, scores as having no toxic
word; with no training row or one class only the score is 0; an id with several labels counts by
the largest; NULL ids and labels do not train. Columns other than id and text are not read.
"""

from __future__ import annotations

from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from commentlab.llm import common
from commentlab.llm.quality import labelled_sample
from commentlab.session import materialise

MAX_TRAIN = 6_000
PER_DOC = 6
MAX_WORD = 40
LANDMARKS = 256
ROUNDS = 3
DECAY = 0.5
BITS = 18
# Offsets of the second to fourth character, for spans of four to six characters.
SHAPES = [s for span in (3, 4, 5) for s in ((*c, span) for c in combinations(range(1, span), 2))]
_M = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


class ToxicModel(NamedTuple):
    weights: np.ndarray  # one per hashed subsequence
    bias: float
    slope: float  # Platt's logistic of a document's margin
    shift: float
    fitted: bool


def _keep() -> np.ndarray:
    """What a character becomes: itself, a space (32), or nothing (0)."""
    keep = np.arange(0x3100, dtype=np.uint32)
    for c in range(0x3100):
        if c < 128 and not chr(c).isalnum():
            keep[c] = 32 if chr(c).isspace() else 0
        elif 0x80 <= c <= 0xBF or 0x2000 <= c <= 0x206F or c == 0x3000:
            keep[c] = 32 if c in (0x85, 0xA0, 0x3000) or 0x2000 <= c <= 0x200A or c in (0x2028, 0x2029) else 0
    return keep


KEEP = _keep()


def characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts as `` word word ... `` and per text its first place (n + 1).

    Every text begins with a space, so each word has a space before and one after it.
    """
    texts = pc.utf8_lower(column.fill_null(""))
    lengths = np.asarray(pc.utf8_length(texts)).astype(np.int64) + 1
    joined = "\n" + "\n".join(texts.to_pylist()) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(cp, len(KEEP) - 1)
    out = np.where(cp < len(KEEP), KEEP[low], cp)
    first = np.concatenate([[0], np.cumsum(lengths)])
    fixed = np.zeros(len(out), bool)
    fixed[first] = True
    out = out.copy() if not out.flags.writeable else out
    out[first] = 32
    before = np.concatenate([[0], np.cumsum(out != 0)])
    first, out, fixed = before[first], out[out != 0], fixed[out != 0]
    space = out == 32
    single = np.zeros(len(out), bool)  # a space with one character on either side, then a space
    if len(out) > 4:
        lone = np.zeros(len(out), bool)
        lone[1:-1] = ~space[1:-1] & space[:-2] & space[2:]
        single[1:-1] = space[1:-1] & lone[:-2] & lone[2:]
    double = np.zeros(len(out), bool)
    double[:-1] = space[:-1] & space[1:]
    drop = (single | double) & ~fixed
    drop[-1:] = False
    before = np.concatenate([[0], np.cumsum(~drop)])
    return out[~drop], before[first]


def subsequences(cp: np.ndarray):
    """For each shape: places where a subsequence starts, its bucket, and its weight."""
    n = len(cp)
    a, b, c, d = (cp * m for m in _M)
    spaces = np.cumsum(cp == 32)
    inside: dict[int, np.ndarray] = {}
    for i, j, k in SHAPES:
        if n <= k:
            continue
        if k not in inside:
            inside[k] = spaces[k - 1 : n - 1] == spaces[: n - k]  # no bound between the ends
        h = a[: n - k] + b[i : n - k + i] + c[j : n - k + j] + d[k:]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        yield inside[k], (h >> np.uint32(32 - BITS)).astype(np.int32), DECAY ** (k - 3)


def norms(lengths: np.ndarray) -> np.ndarray:
    """Kernel norm of a word of so many characters, bounds included, without repetitions."""
    total = np.zeros(len(lengths))
    for *_, k in SHAPES:
        total += np.maximum(lengths - k, 0) * DECAY ** (2 * (k - 3))
    return np.sqrt(np.maximum(total, 1))


def worst_words(column: pa.Array, model: ToxicModel, top: int = 1):
    """Each text's margin, and per text the ``top`` words with their margins if ``top`` > 1."""
    cp, first = characters(column)
    total = np.zeros(len(cp), np.float32)
    for inside, bucket, weight in subsequences(cp):
        total[: len(bucket)] += np.where(inside, model.weights[bucket], 0) * np.float32(weight)
    starts = np.flatnonzero(cp == 32)[:-1]  # the last space of all only ends a word
    ends = np.append(starts[1:], len(cp) - 1)
    score = np.add.reduceat(total, starts) if len(starts) else np.zeros(0)
    lengths = ends - starts + 1
    score = np.where(lengths > 2, score / norms(lengths) + model.bias, -np.inf)
    word = np.searchsorted(starts, first)
    best = common.per_text(score, word, np.maximum, -np.inf)
    best[~np.isfinite(best)] = min(model.bias, -1.0) if model.fitted else 0.0
    if top == 1:
        return best, None
    lists = []
    for i in range(len(best)):
        own = np.arange(word[i], word[i + 1])
        own = own[(lengths[own] > 2) & (lengths[own] <= MAX_WORD + 2)]
        chosen, seen = [], set()
        for w in own[np.argsort(-score[own], kind="stable")][: 20 * top]:
            text = cp[starts[w] + 1 : ends[w]].tobytes().decode("utf-32-le", "surrogatepass")
            if text not in seen:
                seen.add(text)
                chosen.append((text, float(score[w])))
            if len(chosen) == top:
                break
        lists.append(chosen)
    return best, lists


def features(words: list[str]) -> list[dict[int, float]]:
    """The explicit normalised kernel features of short words."""
    out = []
    for word in words:
        cp = np.array([32, *map(ord, word), 32], np.uint32)
        own: dict[int, float] = {}
        for inside, bucket, weight in subsequences(cp):
            for b in bucket[inside].tolist():
                own[b] = own.get(b, 0.0) + weight
        norm = float(norms(np.array([len(cp)]))[0])
        out.append({k: v / norm for k, v in own.items()})
    return out


def nystroem_machine(words: list[str], y: np.ndarray, weight: np.ndarray, marks: list[str]) -> tuple[np.ndarray, float]:
    """Subsequence weights and bias of a squared-hinge SVM on Nystroem features."""
    of_marks = features(marks)
    place = {b: i for i, b in enumerate(sorted(set().union(*of_marks)))}
    basis = np.zeros((len(marks), len(place)))
    for i, own in enumerate(of_marks):
        for b, v in own.items():
            basis[i, place[b]] = v
    values, vectors = np.linalg.eigh(basis @ basis.T)
    good = values > 1e-6 * values.max()
    map_ = vectors[:, good] / np.sqrt(values[good])  # K_LL ** -1/2
    kernel = np.zeros((len(words), len(marks)))
    for i, own in enumerate(features(words)):
        known = [(place[b], v) for b, v in own.items() if b in place]
        if known:
            at, v = zip(*known, strict=True)
            kernel[i] = basis[:, at] @ np.array(v)
    z = np.column_stack([kernel @ map_, np.ones(len(words))])
    beta = np.zeros(z.shape[1])
    ridge = np.full(z.shape[1], 1e-2 * len(y) / 1000 + 1e-3)
    ridge[-1] = 1e-6
    for _ in range(25):
        slack = 1 - y * (z @ beta)
        on = slack > 0
        grad = ridge * beta - z[on].T @ (weight[on] * y[on] * slack[on])
        hess = np.diag(ridge) + (z[on] * weight[on, None]).T @ z[on]
        step = np.linalg.solve(hess, grad)
        beta = beta - step
        if np.abs(step).max() < 1e-8:
            break
    table = np.zeros(1 << BITS, np.float32)
    table[list(place)] = (map_ @ beta[:-1]) @ basis
    return table, float(beta[-1])


def _gram_weights(rows: DataFrame) -> ToxicModel:
    """A first model: log ratio of the documents of either class that hold a subsequence."""
    size = 1 << BITS

    def run(batches):
        counts = np.zeros((2, size), np.int64)
        for batch in batches:
            for part in common.chunks(batch, 1):
                cp, first = characters(part.column(1))
                label = np.asarray(part.column(2)).astype(np.int64)
                marks = [(inside, bucket) for inside, bucket, w in subsequences(cp) if w == 1]
                for i in range(part.num_rows):
                    own = [b[first[i] : first[i + 1]][s[first[i] : first[i + 1]]] for s, b in marks]
                    seen = np.unique(np.concatenate(own)) if own else np.zeros(0, np.int64)
                    counts[int(label[i] > 0), seen] += 1
        full = np.flatnonzero(counts.sum(axis=0))
        yield pa.record_batch([pa.array(full, pa.int32()), pa.array(counts[0, full]), pa.array(counts[1, full])], names=["b", "neg", "pos"])

    table = (
        rows.select("_id", "text", "label").mapInArrow(run, "b int, neg long, pos long").groupBy("b")
        .agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos")).toArrow()
    )
    counts = np.zeros((2, size))
    at = np.asarray(table.column("b"))
    counts[0, at], counts[1, at] = np.asarray(table.column("neg")), np.asarray(table.column("pos"))
    total = np.maximum(counts.sum(axis=0), 1)
    expected = max(counts[1].max(), 1) / max(counts[0].max() + counts[1].max(), 1)
    # positive documents beyond what chance would give, in standard deviations
    surprise = (counts[1] - total * expected) / np.sqrt(total * expected * (1 - expected) + 1)
    return ToxicModel(np.maximum(surprise, 0).astype(np.float32), 0.0, 1.0, 0.0, True)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Fit on at most ``MAX_TRAIN`` labelled documents of each class."""
    flag = F.col(label) > 0
    rows = labelled_sample(docs, labels.filter(flag), label, doc_id, text, usable, MAX_TRAIN).unionByName(
        labelled_sample(docs, _without(labels, label, doc_id), label, doc_id, text, usable, MAX_TRAIN)
    )
    rows = materialise(rows.repartition(32, "_id"), "toxic_sample")
    empty = ToxicModel(np.zeros(1 << BITS, np.float32), 0.0, 0.0, -40.0, False)
    if len(rows.select(F.col("label") > 0).distinct().collect()) < 2:
        return empty
    model = _gram_weights(rows)
    for _ in range(ROUNDS):
        found = _pick(rows, model)
        toxic_docs = sum(is_toxic for is_toxic, _ in found)
        clean_docs = len(found) - toxic_docs
        positive: dict[str, int] = {}
        clean: dict[str, int] = {}
        for is_toxic, picks in found:
            if is_toxic and picks:
                positive[picks[0][0]] = positive.get(picks[0][0], 0) + 1
            for word, _s in picks if not is_toxic else ():
                clean[word] = clean.get(word, 0) + 1
        # words of a larger share of the toxic documents than of the clean ones
        positive = {w: n for w, n in positive.items() if n * clean_docs > clean.get(w, 0) * toxic_docs}
        clean = {w: n for w, n in clean.items() if w not in positive}
        if not positive or not clean:
            break  # the last model stays
        order = lambda c: sorted(c, key=lambda w: (-c[w], w))
        good, bad = order(positive), order(clean)
        words = good + bad
        y = np.concatenate([np.ones(len(good)), -np.ones(len(bad))])
        weight = np.concatenate([np.sqrt([positive[w] for w in good]), np.sqrt([clean[w] for w in bad])])
        weight[: len(good)] *= weight[len(good) :].sum() / weight[: len(good)].sum() / 2
        marks = good[: LANDMARKS * 3 // 4] + bad[: LANDMARKS - min(len(good), LANDMARKS * 3 // 4)]
        table, bias = nystroem_machine(words, y, weight, marks)
        model = ToxicModel(table, bias, 1.0, 0.0, True)
    margins = _pick(rows, model)
    m = np.array([p[0][1] if p else min(model.bias, -1.0) for _, p in margins])
    t = np.array([x for x, _ in margins], float)
    slope, shift = _platt(m, t)
    return model._replace(slope=slope, shift=shift)


def _without(labels: DataFrame, label: str, doc_id: str) -> DataFrame:
    """Labels of the ids that no row calls toxic."""
    return labels.groupBy(doc_id).agg(F.max(label).alias(label)).filter(F.col(label) <= 0)


def _pick(rows: DataFrame, model: ToxicModel) -> list[tuple[bool, list[tuple[str, float]]]]:
    """Per sampled document: whether toxic, and its worst words; at most PER_DOC short words each."""

    def work(part):
        _, lists = worst_words(part.column(1), model, PER_DOC)
        return pa.record_batch(
            [
                part.column(0), part.column(2),
                pa.array([[w for w, _ in x] for x in lists], pa.list_(pa.string())),
                pa.array([[s for _, s in x] for x in lists], pa.list_(pa.float64())),
            ],
            names=["id", "label", "words", "scores"],
        )

    kind = dict(rows.dtypes)
    schema = f"id {kind['_id']}, label {kind['label']}, words array<string>, scores array<double>"
    table = common.map_chunks(rows.select("_id", "text", "label"), "text", work, schema).toArrow().to_pylist()
    table.sort(key=lambda r: (r["id"], r["words"]))
    return [(r["label"] > 0, list(zip(r["words"], r["scores"], strict=True))) for r in table]


def _platt(m: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope (at least 0.1) and shift of a logistic of the margins, by Newton steps."""
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    z = np.column_stack([m, np.ones(len(m))])
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve((z * w[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - target) + 1e-3 * beta)
        beta = beta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(max(beta[0], 0.1)), float(beta[1])


def probability(column: pa.Array, model: ToxicModel) -> np.ndarray:
    """Platt's logistic of each text's margin."""
    margin, _ = worst_words(column, model)
    return 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -40, 40)))


def kept(docs: DataFrame, model: ToxicModel, text: str = "text", below: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``below``, with all their columns whatever their names."""
    at = docs.columns.index(text)
    work = lambda part: part.filter(pa.array(probability(part.column(at), model) < below))
    return common.map_chunks(docs, text, work, docs.schema)


def score(docs: DataFrame, model: ToxicModel, text: str = "text", at_least: float = 0.5) -> DataFrame:
    """``docs`` with ``_score`` and ``_predicted`` added, from each whole text."""
    at = docs.columns.index(text)

    def work(part):
        p = probability(part.column(at), model)
        return pa.record_batch(
            [*part.columns, pa.array(p), pa.array((p >= at_least).astype(np.int32))],
            names=[*part.schema.names, "_score", "_predicted"],
        )

    schema = StructType([*docs.schema, StructField("_score", DoubleType()), StructField("_predicted", IntegerType())])
    return common.map_chunks(docs, text, work, schema)

