"""Byte-level BPE and best-fit packing against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from commentlab.llm import bpe, packing

from .conftest import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.load_ranks(RANKS))


def hard_texts(n=400):
    rng = random.Random(3)
    alphabet = list("abcst'revmlld  \n\t.,!?0123") + ["'s", "'re", "'ll", "'t", " '", "é", "ß", "中", "😀", " ", " ", "\x1c", "́", "²", "<|endoftext|>"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60))) for _ in range(n)]


EDGE = ["", " ", "  ", "\n\n a", "it's", "'s's't", "x 's", "''s", "a'", "'", "a 'll b're", "it'sabc", "\n's", "a  b   ", "a" * 3000, "x" * 500 + " " * 700 + "y"]


def test_ids_equal_the_library(encoder, library):
    texts = EDGE + hard_texts() + [prose(2000, 5)]
    ids, bounds, _, _ = encoder.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode_ordinary(t), repr(t)


def test_every_character_splits_as_in_the_library(encoder, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c} {c}1{c}{c}" for c in every[i : i + 500]) for i in range(0, len(every), 500)]
    ids, bounds, _, _ = encoder.encode(pa.array(texts))
    off = [i for i, t in enumerate(texts) if ids[bounds[i] : bounds[i + 1]].tolist() != library.encode_ordinary(t)]
    assert not off


def test_long_strings_merge_as_short_ones(encoder, library):
    word = ("ab" * 500 + "the" * 200).encode()
    assert encoder.merger._long(word).tolist() == library._encode_single_piece(word.decode())


def test_places_and_decoding(spark, docs):
    rows = [(1, "it's a  story", "en"), (2, None, None), (3, "", "en"), (1, "it's a  story", "en")]
    out = bpe.decoded(bpe.encoded(docs(rows), RANKS), RANKS).collect()
    texts = {r["doc_id"]: r for r in out}
    assert len(out) == 4 and texts[2]["ids"] == [] and texts[3]["decoded"] == b""
    assert bytes(texts[1]["decoded"]).decode() == "it's a  story"
    assert texts[1]["places"][:3] == [0, 2, 4]


def test_digests(docs, library):
    text = prose(300, 1)
    out = {r["doc_id"]: r for r in bpe.digests(docs([(1, text, "en"), (None, None, None)]), RANKS).collect()}
    ids = library.encode_ordinary(text)
    assert out[1]["n_tokens"] == len(ids)
    assert out[1]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert out[1]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert out[None]["ids_sha256"] == out[None]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert bpe.digests(docs([]), RANKS).count() == 0


def check_packing(rows, capacity):
    ends: dict[int, int] = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(ends.values()) <= capacity
    return len(ends)


def test_pieces_carry_the_library_ids(docs):
    tokenizer = Tokenizer.from_file(JSON)  # as the contract calls it: added tokens count
    assert tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids == [64, 220, 50256, 275]
    texts = {1: prose(900, 2), 2: None, 3: "", 4: "it's  <|endoftext|>\n\n x", 5: "中" * 50}
    out = packing.pack(docs([(i, t, "en") for i, t in texts.items()]), JSON, capacity=64).collect()
    check_packing(out, 64)
    for i, t in texts.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(len(mine)))
        assert sum(r["length"] for r in mine) == len(ids)
        assert all(r["length"] == 64 for r in mine[1:])
        for r in mine:
            own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(own.tobytes())


def test_op5_ids_equal_the_library_on_control_characters():
    tokenizer = Tokenizer.from_file(JSON)
    marks = [*"\x1c\x1d\x1e\x1f\x85\xa0", "\u2028", "\u3000", " ", ",", "--", "a", "7", "\n"]
    texts = EDGE + hard_texts() + ["\x1c,", "\x1f--", " \x1d.", "a\x1e\x1e b"]
    texts += ["".join(random.Random(i).choices(marks, k=30)) for i in range(300)]
    together = packing.LibraryEncoder(JSON)
    ids, bounds, _, _ = together.encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    tokenizer.encode_special_tokens = True
    ids, bounds, _, _ = packing.LibraryEncoder(JSON, plain=True).encode(pa.array(texts))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == tokenizer.encode(t).ids, repr(t)


def test_repeated_rows_and_null_ids_are_documents(docs):
    rows = [(1, "a b c", "en")] * 5 + [(None, "a b c", "en")] * 2
    out = packing.pack(docs(rows), JSON).collect()
    assert len(out) == 7 and check_packing(out, 1024) == 1
    assert packing.pack(docs([]), JSON).count() == 0


def test_supersteps_pack_like_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        capacity = rng.choice([16, 100])
        lengths = sorted((rng.randint(1, capacity) for _ in range(rng.randrange(1, 300))), reverse=True)
        gaps: list[int] = []
        for n in lengths:  # best-fit decreasing, one document at a time
            fits = [g for g in gaps if g >= n]
            if fits:
                gaps.remove(min(fits))
                gaps.append(min(fits) - n)
            else:
                gaps.append(capacity - n)
        counts = {n: lengths.count(n) for n in set(lengths)}
        plan = packing.supersteps(counts, capacity)
        used: dict[int, int] = {}
        for length, _, rows, per, first, offset in plan.tolist():
            for r in range(rows):
                seq, at = first + r // per, offset + r % per * length
                assert used.get(seq, 0) == at
                used[seq] = at + length
        assert sum(used.values()) == sum(lengths) and max(used.values()) <= capacity
        assert len(used) == len(gaps)
        assert {n: sum(s[2] for s in plan.tolist() if s[0] == n) for n in counts} == counts


def test_packing_is_near_the_lower_bound(spark, sf_dir):
    from commentlab.llm.queries import QUERIES

    out = QUERIES["op5_best_fit_packing"](spark, sf_dir)
    total = out.agg(F.sum("length")).first()[0]
    assert check_packing(out.collect(), 1024) <= 1.02 * -(-total // 1024) + 1


def test_op6_against_the_library(spark, sf_dir, library):
    from commentlab.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = QUERIES["op6_byte_bpe"](spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
