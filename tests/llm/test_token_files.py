"""Binary token files: exact round trips, boundaries, ranges."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from commentlab.llm import token_files
from commentlab.llm.token_files import EliasFano, Shard

from .conftest import prose
from .test_tokens import EDGE, hard_texts

JSON = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    """(doc_id, n_tokens, crc) of each row by the library's plain call, in order of the id."""
    tokenizer = Tokenizer.from_file(JSON)
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def check(out, want):
    """Rows agree with the library and tile the ids without a gap, ids rising."""
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in out), key=repr) == sorted(want, key=repr)
    rows = sorted(out, key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    names = [r["doc_id"] for r in rows]
    assert names == sorted(names, key=lambda i: (i is not None, i or 0))


@pytest.mark.parametrize("top, n", [(0, 1), (0, 300), (5, 1000), (10**9, 1000), (2**63, 50), (700, 700), (10**5, 1)])
def test_boundaries_come_back(top, n):
    rng = random.Random(top + n)
    values = np.array(sorted(rng.randint(0, top) for _ in range(n)), np.uint64)
    coded = EliasFano.of(values)
    back, end = EliasFano.read(memoryview(coded.to_bytes()), 0)
    assert end == len(coded.to_bytes())
    assert (back.values() == values).all()
    some = np.array(rng.choices(range(n), k=200))
    assert (back.at(some) == values[some]).all()


def test_no_values():
    coded, _ = EliasFano.read(memoryview(EliasFano.of(np.zeros(0)).to_bytes()), 0)
    assert len(coded.values()) == 0 and len(coded.at(np.zeros(0))) == 0


def test_boundaries_take_little_space():
    lengths = np.random.default_rng(1).integers(1, 2000, 100_000)
    coded = EliasFano.of(np.cumsum(lengths)).to_bytes()
    assert 8 * len(coded) < (2 + np.log2(lengths.mean()) + 0.5) * len(lengths)


@pytest.mark.parametrize("width", [2, 4])
def test_a_shard_tells_each_document(width):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 50, 700)
    ids = rng.integers(0, 1 << 8 * width - 1, lengths.sum()).astype(f"<u{width}")
    names = np.sort(rng.integers(-(10**12), 10**12, 690))
    shard = Shard(token_files.shard_bytes(4, 1, names, 10, lengths, ids.tobytes(), width))
    assert (shard.part, shard.number, shard.n) == (4, 1, 700)
    assert shard.doc_ids().to_pylist() == [None] * 10 + names.tolist()
    ends = np.cumsum(lengths)
    for i in (0, 1, 255, 256, 257, 512, 699):
        assert (shard.document(i) == ids[ends[i] - lengths[i] : ends[i]]).all()
    with pytest.raises(ValueError):
        Shard(b"x" * 200)


@pytest.mark.parametrize("options", [{}, {"shard": 2000}, {"shard": 900, "most": 100}])
def test_round_trip(docs, options):
    texts = [*EDGE, *hard_texts(60), None, "a <|endoftext|> b", prose(2000, 4), "\x1c,"]
    rng = random.Random(1)
    rows = [(rng.randrange(-50, 10**15), t) for t in texts] + [(None, "x"), (None, None), (-(1 << 63), "least"), ((1 << 63) - 1, "last")]
    rows += [(77, f"copy {i % 3}") for i in range(150)]
    out = token_files.round_trip(docs([(i, t, "en") for i, t in rows]), JSON, **options).collect()
    check(out, brute(rows))


def test_files_hold_the_ids(spark, docs, tmp_path):
    text = prose(300, 1)
    path = f"{tmp_path}/files"
    token_files.write(docs([(5, text, "en"), (3, "it's", "en")]), path, JSON, shard=500)
    out = token_files.read(spark, path, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(JSON)
    assert {r["doc_id"]: r["ids"] for r in out} == {5: tokenizer.encode(text).ids + [2], 3: tokenizer.encode("it's").ids + [2]}
    # Spark writes an empty file where a write's first task has no rows
    shards = [p for p in tmp_path.glob("files/shards/part-*") if p.stat().st_size]
    assert len(shards) == 2
    first, second = sorted((Shard(p.read_bytes()) for p in shards), key=lambda s: s.part)
    assert first.doc_ids().to_pylist() == [3] and second.document(0).tolist() == tokenizer.encode(text).ids + [2]


def test_one_id_of_many_rows_is_spread(spark, docs, tmp_path):
    rows = [(9, prose(50, i % 4), "en") for i in range(300)] + [(i, "a", "en") for i in range(20)]
    path = f"{tmp_path}/files"
    token_files.write(docs(rows), path, JSON, shard=10_000)
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 5
    assert max(r["documents"] for r in manifest) < 120 and sum(r["documents"] for r in manifest) == 320
    check(token_files.read(spark, path).collect(), brute([(i, t) for i, t, _ in rows]))


def test_empty_table(docs):
    assert token_files.round_trip(docs([]), JSON).count() == 0


def test_op13_on_the_given_table(spark, sf_dir):
    from commentlab.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op13_token_files"](spark, sf_dir).collect(), brute(rows))
