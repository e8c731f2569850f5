import os

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        # names that operators use inside
        T.StructField("_score", T.DoubleType()), T.StructField("class", T.StringType()), T.StructField("label", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text, lang) tuples, with extra columns of clashing names."""

    def make(rows):
        full = [(i, t, lang, "s", None, 1.0, "c", "l") for i, t, lang in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


WORDS = "stone river light paper garden window morning story winter bridge letter market music forest".split()


def prose(n, seed):
    """n words that hardly repeat."""
    return " ".join(f"{WORDS[(i * 7 + seed) % len(WORDS)]}{(i * 31 + seed * 17) % 997}" for i in range(n))
