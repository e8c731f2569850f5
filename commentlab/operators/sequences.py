"""Fixed-length word-id sequences and the parsing of stored ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from commentlab.scale import bounded, join_small
from commentlab.session import materialise

# Sequence length and the ids of padding and of unknown words.
LENGTH, PAD, UNKNOWN, FIRST_WORD = 128, 0, 1, 2
# Between language and word in a table of several languages; no word contains it.
MARK = "\x01"
# Words up to which the table is held by every executor.
MAX_VOCABULARY = 2_000_000


def parse_array(text: Column) -> Column:
    """A serialised list of integers, in square or round brackets."""
    return F.from_json(F.translate(text, "()", "[]"), "array<int>")


def word_ids(terms: DataFrame) -> DataFrame:
    """(lang, term, word_id) of a capped vocabulary (lang, term, cf), frequent terms first."""
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cf"), "term"))
    return terms.select("lang", "term", (rank + FIRST_WORD - 1).alias("word_id"))


def _look_up(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Word ids in place of ``_tokens``, batch by batch against a shared word table.

    A worker makes the table of a broadcast once and keeps it for all its tasks; a batch asks it
    for its distinct words.
    """
    lang = F.coalesce("lang", F.lit(MARK))
    table = words.select(F.concat(lang, F.lit(MARK), "term").alias("word"), "word_id").toArrow()
    shared = rows.sparkSession.sparkContext.broadcast([table])

    def ids_of(tokens: pa.Array) -> pa.Array:
        if isinstance(shared.value[0], pa.Table):
            words, ids = (shared.value[0].column(c).to_pylist() for c in ("word", "word_id"))
            shared.value[0] = dict(zip(words, ids, strict=True))
        known = shared.value[0]
        told = tokens.flatten().dictionary_encode()
        distinct = np.array([known.get(w, UNKNOWN) for w in told.dictionary.to_pylist()], np.int32)
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array([0, *lengths.cumsum()], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(distinct[np.asarray(told.indices)]))

    marked = F.transform("_tokens", lambda t: F.concat(lang, F.lit(MARK), t))
    return rows.withColumn("_ids", F.arrow_udf(ids_of, "array<int>")(marked))


def _join_ids(rows: DataFrame, words: DataFrame, ident: str) -> DataFrame:
    """The same through a shuffle, for word tables too large to share.

    A stored number stands for each row, so that rows with equal or NULL ids stay apart.
    """
    rows = materialise(rows.withColumn("_row", F.monotonically_increasing_id()), "sequences")
    places = F.posexplode_outer("_tokens").alias("_at", "term")
    found = join_small(rows.select("_row", "lang", ident, places), words, ["lang", "term"], "left")
    word = F.coalesce(F.col("word_id"), F.lit(UNKNOWN)).cast("int")
    entry = F.when(F.col("_at").isNotNull(), F.struct("_at", word.alias("w")))
    ordered = F.sort_array(F.collect_list(entry))
    return found.groupBy("_row", "lang", ident).agg(F.transform(ordered, lambda x: x["w"]).alias("_ids"))


def pack_sequences(
    df: DataFrame,
    tokens: str,
    ids: DataFrame,
    ident: str = "id",
    length: int = LENGTH,
    max_words: int = MAX_VOCABULARY,
) -> DataFrame:
    """lang, id, input_word_ids, input_mask, all_segment_id of the given length.

    The length is the operator's: later tokens are cut off and short texts are padded. Up to
    ``max_words`` words the ids are found where the row is, without a shuffle.
    """
    rows = df.select("lang", ident, F.slice(tokens, 1, length).alias("_tokens"))
    words = ids.select("lang", "term", "word_id")
    shared = bounded(words, max_words)
    found = _look_up(rows, shared) if shared is not None else _join_ids(rows, words, ident)
    fill = F.array_repeat(F.lit(PAD), length)
    ones = F.transform("_ids", lambda _: F.lit(1))
    return found.select(
        "lang",
        ident,
        F.slice(F.concat("_ids", fill), 1, length).alias("input_word_ids"),
        F.slice(F.concat(ones, fill), 1, length).alias("input_mask"),
        fill.alias("all_segment_id"),
    )
