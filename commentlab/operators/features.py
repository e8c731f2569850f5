"""Term statistics, vocabulary and TF-IDF vectors per language.

A text is analysed once: its distinct terms and their counts are stored as one row (``counted``),
and vocabulary, vectors and scores read that. Terms meet their vocabulary entry by a join.

Tasks count numbers instead of strings: the terms of some rows are numbered, a pair of adjacent
words is a pair of numbers, and only what is distinct becomes a string again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from commentlab.functions.columns import numbered
from commentlab.scale import CAPPED_ROWS, join_capped, join_small, top_k, within
from commentlab.session import materialise, new_path

# Settings of the TF-IDF features.
MIN_DF, MAX_DF, MAX_FEATURES = 3, 0.95, 200_000
# Elements of arrays that a task handles at a time; a longer row is handled alone.
CHUNK = 1 << 18
# Lines of counts that a task adds up before it sends them on.
MERGE = 1 << 19
NO_TERMS = "empty vocabulary: no terms left after the frequency limits"


def _runs(df: DataFrame, grams: str, keep: list[str]) -> tuple[DataFrame, Column]:
    """Rows, and on them the distinct terms of each with their count ``tf``, without a shuffle.

    The terms of a row are sorted in place and their runs measured. What explodes the runs must do
    so in the expression: a filter on a column of them would be pushed below and repeat the work.
    """
    g, at = F.col("_sorted"), F.col("_starts")
    n = F.size(g)

    def starts_run(i):
        return (i == 0) | (F.get(g, i) != F.get(g, i - 1))

    positions = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    runs = F.transform(
        at,
        lambda p, j: F.struct(
            F.get(g, p).alias("term"),
            (F.coalesce(F.get(at, j + 1), n) - p).alias("tf"),
        ),
    )
    rows = df.select(*keep, F.sort_array(grams).alias("_sorted"))
    return rows.withColumn("_starts", F.filter(positions, starts_run)), runs


def long_form(stored: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, term, tf: one row per distinct term of a row with ``terms``."""
    return stored.select(*keep, F.explode("terms").alias("_run")).select(*keep, "_run.*")


def term_counts(df: DataFrame, grams: str, keep: list[str]) -> DataFrame:
    """One row per (input row, term) with its count ``tf``, without a shuffle."""
    rows, runs = _runs(df, grams, keep)
    return rows.select(*keep, F.explode(runs).alias("_run")).select(*keep, "_run.*")


def _slices(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of at most ``CHUNK`` elements in the arrays of a column, or one row."""
    ends = np.cumsum(_sizes(batch.column(at)))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + CHUNK, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def _sizes(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)


def _coded(column: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct terms of arrays of words, and of each occurrence its row and the term's number.

    With ``pairs`` the pairs of adjacent words, joined by one space, are terms too.
    """
    sizes = _sizes(column)
    row = np.repeat(np.arange(len(sizes)), sizes)
    told = column.flatten().dictionary_encode("encode")
    words, code = told.dictionary, np.asarray(told.indices).astype(np.int64)
    if not pairs:
        return words, row, code
    n, at = max(1, len(words)), np.flatnonzero(row[1:] == row[:-1])
    both, number = np.unique(code[at] * n + code[at + 1], return_inverse=True)
    first, second = (words.take(pa.array(x)) for x in divmod(both, n))
    terms = pa.concat_arrays([words, pc.binary_join_element_wise(first, second, " ")])
    return terms, np.concatenate([row, row[at]]), np.concatenate([code, len(words) + number])


def _runs_of(column: pa.Array, pairs: bool) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms, and row, number and ``tf`` of each distinct term of a row, by rows."""
    terms, row, code = _coded(column, pairs)
    n = max(1, len(terms))
    key, tf = np.unique(row * n + code, return_counts=True)
    return terms, key // n, key % n, tf


def counted(
    df: DataFrame, grams: str, keep: list[str], partition_by: list[str] | None = None, pairs: bool = False
) -> DataFrame:
    """``keep``, terms and a number ``_row`` of every row, written once for all that reads them.

    With ``pairs`` the column ``grams`` holds words, and pairs of adjacent ones are terms as well.
    """
    terms = T.ArrayType(T.StructType([T.StructField("term", T.StringType()), T.StructField("tf", T.IntegerType())]))
    rows = df.select(*keep, grams)

    def run(batches):
        for batch in batches:
            for some in _slices(batch, len(keep)):
                names, row, code, tf = _runs_of(some.column(len(keep)), pairs)
                runs = pa.StructArray.from_arrays([names.take(pa.array(code)), pa.array(tf, pa.int32())], ["term", "tf"])
                ends = pa.array(np.searchsorted(row, np.arange(some.num_rows + 1)), pa.int32())
                columns = [*some.columns[: len(keep)], pa.ListArray.from_arrays(ends, runs)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "terms"])

    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("terms", terms)])
    told = rows.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    return materialise(told, "terms_of_rows", partition_by)


def term_stats(df: DataFrame, grams: str, keys: list[str] | None = None, pairs: bool = False) -> DataFrame:
    """Document and corpus frequency per (lang, term), combined map-side by term.

    With ``pairs`` the column ``grams`` holds words, and pairs of adjacent ones are terms as well.
    """
    keys = keys or ["lang"]
    if pairs:
        return _summed(df.select(*keys, grams), keys, lambda column: _runs_of(column, True))
    long = term_counts(df, grams, keys)
    return long.groupBy(*keys, "term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def _stored_runs(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """What ``_runs_of`` gives, of the terms of ``counted`` rows."""
    sizes = _sizes(column)
    term, tf = column.flatten().flatten()
    told = term.dictionary_encode("encode")
    return told.dictionary, np.repeat(np.arange(len(sizes)), sizes), np.asarray(told.indices).astype(np.int64), np.asarray(tf)


def _groups(some: pa.RecordBatch, n_keys: int) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's group of equal first columns, and a row of each group."""
    group = np.zeros(some.num_rows, np.int64)
    first = np.zeros(min(1, some.num_rows), np.int64)
    for column in some.columns[:n_keys]:
        told = column.dictionary_encode("encode")
        code = group * max(1, len(told.dictionary)) + np.asarray(told.indices)
        _, first, group = np.unique(code, return_index=True, return_inverse=True)
    return group, first


def _added(lines: list[pa.Table], keys: list[str]) -> pa.Table:
    """Lines of equal keys and term as one."""
    by = [*keys, "term"]
    sums = pa.concat_tables(lines).group_by(by, use_threads=False).aggregate([("df", "sum"), ("cf", "sum")])
    return sums.select([*by, "df_sum", "cf_sum"]).rename_columns([*by, "df", "cf"])


def _summed(rows: DataFrame, keys: list[str], runs: Callable) -> DataFrame:
    """keys, term, df, cf from rows of keys and what ``runs`` reads; added up in tasks, then between them."""
    n = len(keys)

    def lines(some: pa.RecordBatch) -> pa.Table:
        terms, row, code, tf = runs(some.column(n))
        group, first = _groups(some, n)
        size = max(1, len(terms))
        key, number = np.unique(group[row] * size + code, return_inverse=True)
        counts = [np.bincount(number, minlength=len(key)), np.bincount(number, tf, len(key)).astype(np.int64)]
        of = pa.array(first[key // size])
        columns = [*[c.take(of) for c in some.columns[:n]], terms.take(pa.array(key % size)), *map(pa.array, counts)]
        return pa.table(columns, names=[*keys, "term", "df", "cf"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for some in _slices(batch, n):
                held.append(lines(some))
                size += len(held[-1])
                if size > MERGE:
                    held = [_added(held, keys)]
                    size = len(held[0])
                    if size > MERGE // 2:
                        yield from held.pop().to_batches(1 << 16)
                        size = 0
        if held:
            yield from _added(held, keys).to_batches(1 << 16)

    kinds = [T.StructField("term", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("df", "cf")]]
    partial = rows.mapInArrow(run, T.StructType([*rows.schema.fields[:n], *kinds]))
    return partial.groupBy(*keys, "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def vocabulary(
    df: DataFrame,
    grams: str,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int = MAX_FEATURES,
    pairs: bool = False,
) -> DataFrame:
    """lang, term, df, cf, n_docs of the kept terms: the most frequent ones per language,
    ties by term. With ``pairs`` the column ``grams`` holds words, see ``term_stats``."""
    sizes = df.groupBy("lang").agg(F.count("*").alias("n_docs"))
    return _kept_terms(term_stats(df, grams, pairs=pairs), sizes, min_df, max_df, max_features)


def vocabulary_of(
    stored: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF, max_features: int = MAX_FEATURES
) -> DataFrame:
    """The vocabulary of rows that are ``counted`` already."""
    sizes = stored.groupBy("lang").agg(F.count("*").alias("n_docs"))
    return _kept_terms(_summed(stored.select("lang", "terms"), ["lang"], _stored_runs), sizes, min_df, max_df, max_features)


def _kept_terms(stats: DataFrame, sizes: DataFrame, min_df: int, max_df: float, max_features: int) -> DataFrame:
    """What the limits leave is written and read again. A histogram over the counts finds the count
    at which a language's cap falls, so that only terms with that count or more are ranked."""
    kept = materialise(
        join_small(stats.filter(F.col("df") >= min_df), sizes, ["lang"]).filter(
            F.col("df") <= F.lit(max_df) * F.col("n_docs")
        ),
        "terms",
    )
    above = W.partitionBy("lang").orderBy(F.desc("cf"))
    cut = (
        kept.groupBy("lang", "cf")
        .agg(F.count("*").alias("_n"))
        .withColumn("_upto", F.sum("_n").over(above))
        .filter(F.col("_upto") - F.col("_n") < max_features)
        .groupBy("lang")
        .agg(F.min("cf").alias("_lowest"))
    )
    candidates = join_small(kept, cut, ["lang"]).filter(F.col("cf") >= F.col("_lowest"))
    return top_k(candidates.drop("_lowest"), ["lang"], [F.desc("cf"), F.col("term")], max_features)


def inverse_frequency(n_docs, df):
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + n_docs) / (1 + df)) + 1


def indexed(terms: DataFrame) -> DataFrame:
    """lang, term, idf and index (0, 1, ... per language, frequent terms first) of a vocabulary.

    Numbers come from sorted ranges of (lang, rank), so no language is numbered by one task.
    """
    idf = inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf")
    rows = terms.select("lang", "term", idf, (-F.col("cf")).alias("_rank"))
    placed = numbered(rows, ["lang"], ["_rank", "term"], "index")
    return materialise(placed.select("lang", "term", "idf", F.col("index").cast("int").alias("index")), "indexed")


def _weight() -> Column:
    return (1 + F.log("tf")) * F.col("idf")


def _normed(rows: DataFrame) -> DataFrame:
    """``rows`` with ``_w`` over the norm of its ``_row``; lines of a row lie side by side."""
    kept = [c for c in rows.columns if c not in ("_row", "_w")]

    def normed(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        w = table.column("_w").to_numpy()
        norm = np.sqrt(np.add.reduceat(w * w, starts))
        weight = pa.array(w / np.repeat(norm, np.diff(starts, append=len(w))))
        whole = table.select(kept).append_column("weight", weight).combine_chunks()
        return whole.to_batches()[0]

    def run(batches):
        carried = None  # the lines of a row that may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if carried is None else pa.concat_tables([carried, table])
            row = table.column("_row").to_numpy()
            starts = np.flatnonzero(np.concatenate([row[:1] == row[:1], row[1:] != row[:-1]]))
            if len(starts) > 1:
                yield normed(table.slice(0, starts[-1]), starts[:-1])
            carried = table.slice(starts[-1]) if len(starts) else None
        if carried is not None:
            yield normed(carried, np.zeros(1, np.int64))

    fields = [f for f in rows.schema if f.name in kept]
    return rows.mapInArrow(run, T.StructType([*fields, T.StructField("weight", T.DoubleType())]))


def tfidf_of(stored: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of the vectors of ``counted`` rows: keep, term, weight.

    Where the terms can be broadcast the lines of a row stay side by side and are normed where they
    are; where they are shuffled, a second shuffle brings them together again.
    """
    long = long_form(stored, list(dict.fromkeys([*keep, "lang", "_row"])))
    idf = inverse_frequency(F.col("n_docs"), F.col("df")).alias("idf")
    terms = materialise(terms.select("lang", "term", idf), "idf")
    held = within(terms, CAPPED_ROWS)
    found = join_capped(long, terms, ["lang", "term"], held=held)
    weighted = found.select("_row", *keep, "term", _weight().alias("_w"))
    if held:
        return _normed(weighted)
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy("_row")))
    return weighted.select(*keep, "term", (F.col("_w") / norm).alias("weight"))


def tfidf_terms(df: DataFrame, grams: str, terms: DataFrame, keep: list[str]) -> DataFrame:
    """Long form of the vectors of all languages: keep, term, weight; one pass serves all."""
    stored = counted(df, grams, list(dict.fromkeys([*keep, "lang"])))
    return tfidf_of(stored, terms, keep)


def matched(stored: DataFrame, terms: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``_row`` and, where a term is in ``terms``, its columns and weight ``_w``.

    Every row keeps at least one line, also one without a known term.
    """
    fields = list(dict.fromkeys([*keep, "lang", "_row"]))
    long = stored.select(*fields, F.posexplode_outer("terms").alias("_at", "_run"))
    long = long.select(*fields, "_at", "_run.*")
    found = join_capped(long, terms, ["lang", "term"], "left").withColumn("_w", _weight())
    return found.filter(F.col("idf").isNotNull() | (F.coalesce("_at", F.lit(0)) == 0))


VECTOR = "struct<type:tinyint,size:int,indices:array<int>,values:array<double>>"


def assembled(stored: DataFrame, terms: DataFrame, keep: list[str], out: str = "features") -> DataFrame:
    """_row, lang, ``keep`` and the fields of the L2-normed TF-IDF vector of each ``counted`` row."""
    fields = list(dict.fromkeys(["lang", *keep]))
    entry = F.when(F.col("idf").isNotNull(), F.struct("index", "_w"))
    # A norm folded over the entries would be pushed into their division and worked out for each of them.
    rows = matched(stored, terms, fields).groupBy("_row", *fields).agg(
        F.sort_array(F.collect_list(entry)).alias("_e"), F.sqrt(F.sum(F.col("_w") * F.col("_w"))).alias("_norm")
    )
    sizes = terms.groupBy("lang").agg(F.count("*").cast("int").alias("_size"))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.col("_size").alias("size"),
        F.transform("_e", lambda x: x["index"]).alias("indices"),
        F.transform("_e", lambda x: x["_w"] / F.col("_norm")).alias("values"),
    ).cast(VECTOR)
    sized = join_small(rows, sizes, ["lang"])
    return sized.select("_row", *fields, vector.alias(out))


def vectors(stored: DataFrame, terms: DataFrame, keep: list[str], out: str = "features") -> DataFrame:
    """``keep`` and the L2-normed TF-IDF vector of each ``counted`` row, written once by language.

    ``terms`` is ``indexed``. The vectors are put together in the JVM and read back as such.
    """
    placed = assembled(stored, terms, keep, out)
    path = new_path(stored.sparkSession, "vectors")
    placed.hint("rebalance", "lang").write.partitionBy("lang").parquet(path)
    schema = T.StructType([T.StructField(f.name, VectorUDT()) if f.name == out else f for f in placed.schema])
    return stored.sparkSession.read.schema(schema).parquet(path).select("_row", *keep, out)


class TermVectors:
    """The terms of one language as indices of a vector: ``transform`` turns ``grams`` into one."""

    def __init__(self, terms: DataFrame):
        self.terms = indexed(terms.withColumn("lang", F.lit(None).cast("string")))
        self.size = self.terms.count()
        if not self.size:
            raise ValueError(NO_TERMS)

    def transform(self, df: DataFrame, grams: str = "grams", out: str = "features") -> DataFrame:
        """``df`` with the vectors; the rows and their vectors are written once."""
        return with_vectors(df, grams, self.terms, out)


def with_vectors(df: DataFrame, grams: str, terms: DataFrame, out: str = "features") -> DataFrame:
    """``df`` with the vector of each row by the ``indexed`` terms of one language, without a name."""
    kept = materialise(df.withColumn("_row_of", F.monotonically_increasing_id()), "rows")
    stored = counted(kept.withColumn("lang", F.lit(None).cast("string")), grams, ["lang", "_row_of"])
    return kept.join(vectors(stored, terms, ["_row_of"], out).drop("_row"), "_row_of").drop("_row_of")


def vectorizer(terms: DataFrame) -> TermVectors:
    """``terms`` holds term, df, cf and n_docs of one language."""
    return TermVectors(terms)
