"""Profiles of tables and of files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 23
# Bytes up to which a file is read as one value.
WHOLE_BYTES = 64 << 20


def profile_table(df: DataFrame, key: list[str] | None = None, n: int = 0, width: int = 80) -> DataFrame:
    """One row per column: position, dtype, rows, nulls, and the mean of numeric columns.

    The mean of a 0/1 label is its positive rate. With a ``key`` there are also ``examples``, the
    beginnings of the column's values in up to ``n`` rows: of each ``n``-th of the rows, dealt by a
    hash of the key, the one with the least hash. All columns come from one aggregation.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}

    def cell(i: int, name: str, kind: str):
        mean = F.avg(name) if name in numeric else F.lit(None).cast("double")
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("column"),
            F.lit(kind).alias("dtype"),
            F.count("*").alias("n_rows"),
            (F.count("*") - F.count(name)).alias("n_null"),
            mean.alias("mean"),
        )

    cells = F.array(*[cell(i, name, kind) for i, (name, kind) in enumerate(df.dtypes)])
    if not key:
        return df.agg(cells.alias("_cells")).select(F.explode("_cells").alias("c")).select("c.*")
    digest = F.md5(F.concat_ws(":", *key))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % n
    row = F.to_json(F.struct(*[F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns]))
    picks = [F.min(F.when(share == i, F.struct(digest.alias("h"), row.alias("row")))).alias(f"_{i}") for i in range(n)]
    rows = F.transform(F.array(*[F.col(f"_{i}.row") for i in range(n)]), lambda x: F.from_json(x, "map<string,string>"))
    one = df.agg(cells.alias("_cells"), *picks).select("_cells", F.filter(rows, lambda x: x.isNotNull()).alias("_rows"))
    own = F.transform("_rows", lambda x: x[F.col("c.column")]).alias("examples")
    return one.select(F.explode("_cells").alias("c"), "_rows").select("c.*", own)


def example_rows(df: DataFrame, n: int = 5) -> DataFrame:
    return df.limit(n)


def _open(path: str):
    scheme, rest = path.split(":", 1)
    # The listing gives "file:/x" and plain characters; a URI wants "file:///x" and escapes.
    root = "//" if scheme == "file" and not rest.startswith("//") else ""
    system, inner = fs.FileSystem.from_uri(f"{scheme}:{root}{quote(rest, safe='/:@')}")
    return system.open_input_stream(inner)


def _digest(path: str) -> str:
    sha = hashlib.sha256()
    with _open(path) as stream:
        while block := stream.read(CHUNK):
            sha.update(block)
    return sha.hexdigest()


def _empty_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The files without bytes, which readers leave out; listed by the driver, as Spark lists too.

    Folders are listed one by one: a recursive listing asks for the permissions of every file, for
    which a local file system starts a process each.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = spark._jvm.org.apache.hadoop.fs.GlobFilter(pattern)
    rows, left = [], [root]
    while left:
        for status in system.listStatus(left.pop()):
            if status.isDirectory():
                left.append(status.getPath())
            elif status.getLen() == 0:
                path = status.getPath()
                if matches.accept(path) and not path.getName().startswith(("_", ".")):
                    rows.append((path.toString(), 0, status.getModificationTime(), hashlib.sha256().hexdigest()))
    found = spark.createDataFrame(rows, "path string, size_bytes long, modified long, sha256 string")
    return found.withColumn("modified", F.timestamp_millis("modified"))


def _readable(size: Column) -> Column:
    """A size in the largest unit of 1,024 that it reaches, with one decimal."""
    text = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], 1):
        step = 1 << 10 * power
        scaled = F.concat(F.format_string("%.1f", size / step), F.lit(f" {unit}"))
        text = F.when(size >= step, scaled).otherwise(text)
    return text


def profile_files(
    spark: SparkSession, folder: str, pattern: str = "*", whole: int = WHOLE_BYTES
) -> DataFrame:
    """path, name, size_bytes, size_human, modified, sha256 of every file under a folder.

    Names that start with "_" or "." are not data and left out. Files of up to ``whole`` bytes
    are read as one value and digested in the JVM, through the session's file systems. A digest
    is sequential by nature, so a larger file is streamed by one task in blocks of fixed size.
    """
    scan = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(folder)
        .withColumnsRenamed({"length": "size_bytes", "modificationTime": "modified"})
    )
    facts = ["path", "size_bytes", "modified"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(sha256=frame["path"].map(_digest))

    fits = F.col("size_bytes") <= whole
    small = scan.filter(fits).select(*facts, F.sha2("content", 256).alias("sha256"))
    large = scan.filter(~fits).select(*facts)
    large = large.mapInPandas(run, "path string, size_bytes long, modified timestamp, sha256 string")
    files = small.unionByName(large).unionByName(_empty_files(spark, folder, pattern))
    name = F.element_at(F.split("path", "/"), -1)
    human = _readable(F.col("size_bytes"))
    return files.select("path", name.alias("name"), "size_bytes", human.alias("size_human"), "modified", "sha256")
