"""Helpers shared by the corpus operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components, shared_dir
from ledgerloom.operators.components import written as stage

__all__ = ["connected_components", "create", "documents", "filesystem", "fresh", "join_counted", "mix", "numbered", "own_columns", "shared_dir", "stage", "texts_of", "word_pattern", "words_col", "slices"]

#: Fixed value: the words of every contract are runs of anything but ASCII white space.
word_pattern = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_col(text: str | Column) -> Column:
    """The words of a text, none for null, in the JVM."""
    c = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(c, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def create(uri: str) -> pa.NativeFile:
    """A new file to write to; its folder is made if need be. Names of their own for every attempt let a repeated task do no harm."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def mix(x: np.ndarray) -> np.ndarray:
    """Stir 64-bit integers."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b or b"" for b in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Cut a row of sizes into consecutive slices of about `most` in total, at least one item each."""
    out, lo, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > most:
            out.append((lo, i))
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        out.append((lo, len(sizes)))
    return out


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in whatever case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs written once with a number per row, and the name of that column, so that decisions find their rows again even where ids repeat or are null."""
    row = fresh(docs, "_row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), row


def join_counted(left: DataFrame, right: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """left joined with right's row of its key, however many rows share one: right tells their number in `count`, of `rows` in all.

    Keys with more than a quarter of a partition's share of rows, thus at most four a partition, are broadcast; their
    rows stay where they are, and only the others are shuffled. `count` is not among the result's columns.
    """
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col(count) > max(1.0, rows / (4 * parts))
    many, few = F.broadcast(right.filter(hot).drop(count)), right.filter(~hot).drop(count)
    return left.join(many, key).unionByName(left.join(F.broadcast(right.filter(hot).select(key)), key, "left_anti").join(few, key))
