"""Token alignment against a plain reading of the contract on whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from commentlab.llm import alignment

from .conftest import prose
from .test_tokens import EDGE, hard_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=B), alignment.byte_tokens(A), alignment.piece_tokens(B)[0]


def groups(text, libraries):
    """Groups of (A ids, B ids) of one text, token by token."""
    tokenizer, model, a_bytes, b_bytes = libraries
    if not text:
        return []
    a, b = tokenizer.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a) != whole or b"".join(b_bytes[i] for i in b) != whole:
        return []
    out, now, x, y, i, j = [], ([], []), 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            x, i = x + len(a_bytes[a[i]]), i + 1
            now[0].append(a[i - 1])
        else:
            y, j = y + len(b_bytes[b[j]]), j + 1
            now[1].append(b[j - 1])
        if x == y:
            out.append(now)
            now = ([], [])
    return out


def brute(texts, libraries):
    """The contract's columns for each text."""
    found = [groups(t, libraries) for t in texts]
    links = [[(g[0][-1], g[1][-1]) for g in x] for x in found]
    counts = Counter(p for x in links for p in x)
    best: dict[int, int] = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for x, pairs in zip(found, links, strict=True):
        said = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in x)
        out.append((
            sum(len(a) for a, _ in x), sum(len(b) for _, b in x), len(x), len(pairs),
            sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs),
            hashlib.sha256(said.encode()).hexdigest() if x else "",
        ))
    return out


ODD = [None, "", " ", "   ", "a ", " a", "a▁b", "▁", "x\x00y", "\t\n", "<s> a </s>", "<|endoftext|> x", "<0x41>", "中文 字", "é́ﬁ  ü", "a  b", "a  b", "ﷺ", "𐍈 ok"]


def texts_of_all_kinds():
    rng = random.Random(5)
    alphabet = ["a", "b", "the", " ", "  ", "é", "中", " ", "\n", "\t", "1", ",", "'s", "😀", "　"]
    mixed = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    return ODD + EDGE + hard_texts(150) + mixed + [prose(3000, 2), "a" * 5000, "中" * 3000 + " x " + "b c " * 500, "y" * 300 + " " * 900 + "z z"]


@pytest.mark.parametrize("part", [1 << 16, 300, 37])
def test_groups_equal_a_plain_reading(docs, libraries, part):
    texts = texts_of_all_kinds()
    rows = [(i, t, "en") for i, t in enumerate(texts)] + [(None, texts[-3], "en"), (7, "the b", None), (7, "the b", None)]
    out = alignment.digests(docs(rows), A, B, part=part).collect()
    want = brute([t for _, t, _ in rows], libraries)
    key = lambda r: repr(r)
    mine = sorted(((r["doc_id"], *[r[c] for c in COLUMNS]) for r in out), key=key)
    assert mine == sorted(((i, *w) for (i, _, _), w in zip(rows, want, strict=True)), key=key)


def test_long_texts_are_cut_and_composed(docs, libraries):
    text = prose(4000, 9)
    rows = alignment.aligned(docs([(1, text, "en"), (1, text, "en"), (2, "a b", "en")]), A, B, part=500).collect()
    want = groups(text, libraries)
    for r in rows:
        if r["doc_id"] == 1:
            assert r["a_ids"] == [i for a, _ in want for i in a] and r["b_ids"] == [i for _, b in want for i in b]
            assert r["a_sizes"] == [len(a) for a, _ in want] and r["b_sizes"] == [len(b) for _, b in want]
    assert len(rows) == 3
    many = alignment.ranges((" " + text).encode(), 500)
    assert len(many) > 50 and all(begin <= lo < hi <= end for lo, hi, begin, end in many)
    assert sum(end - begin for _, _, begin, end in many) < 1.2 * len(text)


def test_fragments_are_a_monoid(libraries):
    """Any cut into ranges, composed in any bracketing, says the same."""
    rng = random.Random(2)
    aligner, text = alignment.Aligner(A, B), " it's cross-tokenizer-alignment über1234 naïve   words," * 3
    size = len(text.encode())
    whole = aligner.fragments(pa.array([text]))[0]

    def add(x, y):
        return (x[0] + y[0], [*x[1][:-1], x[1][-1] + y[1][0], *y[1][1:]])

    for _ in range(40):
        cuts = [0, *sorted(rng.sample(range(1, size), 7)), size]
        column = pa.array([text] * 8)
        found = aligner.fragments(column, np.array(cuts[:-1]), np.array(cuts[1:]))[0]
        for side in (0, 1):
            ids, bounds, sizes, ends = found[side]
            parts = [
                (ids[bounds[k] : bounds[k + 1]].tolist(), sizes[ends[k] : ends[k + 1]].tolist()) for k in range(8)
            ]
            while len(parts) > 1:
                k = rng.randrange(len(parts) - 1)
                parts[k : k + 2] = [add(parts[k], parts[k + 1])]
            assert parts[0] == (whole[side][0].tolist(), whole[side][2].tolist())


def test_every_pair_that_ends_together_has_its_own_number():
    pairs = alignment.Pairs(A, B)
    a, (b, single) = alignment.byte_tokens(A), alignment.piece_tokens(B)
    code = np.flatnonzero((pairs.a_of >= 0) & (pairs.b_of >= 0))
    code = code[(pairs.a_size[pairs.a_of[code]] > 0) & (pairs.b_size[pairs.b_of[code]] > 0)]
    back = pairs.codes(pairs.a_of[code], pairs.b_of[code])
    told = {}
    for c, k in zip(code.tolist(), back.tolist(), strict=True):
        x, y = int(pairs.a_of[c]), int(pairs.b_of[c])
        assert a[x].endswith(b[y]) or b[y].endswith(a[x])
        assert told.setdefault(k, (x, y)) == (x, y)
    assert pairs.n < 2_000_000


def test_pair_counts(docs):
    rows = alignment.aligned(docs([(1, "the the the", "en"), (2, "the", "en")]), A, B)
    out = alignment.pair_counts(rows, A, B).collect()
    assert [r["n"] for r in out] == [4]


def test_empty_table(docs):
    assert alignment.digests(docs([]), A, B).count() == 0


def test_op11_on_the_given_table(spark, sf_dir, libraries):
    from commentlab.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    out = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, sf_dir).collect()}
    want = brute([r["text"] for r in rows], libraries)
    assert out == {r["doc_id"]: w for r, w in zip(rows, want, strict=True)}
