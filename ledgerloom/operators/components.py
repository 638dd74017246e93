"""Connected components by alternating star contraction, entirely in DataFrame joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Edges that a file holds at least, unless there are fewer.
FILE_ROWS = 20_000
#: How much larger than its file a table is in memory, at most.
INFLATED = 100.0


def shared_dir(spark: SparkSession, what: str) -> str:
    """A fresh folder below spark.checkpoint.dir; a temporary folder only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, what: str) -> DataFrame:
    """`written`, in a session that takes files for INFLATED times their size in memory, unless it has a factor of its own.

    Spark broadcasts by the size of files, of which zstd leaves a fifteenth of what the driver would hold, and less where
    rows repeat. At run time joins whose side is small as shuffled are broadcast all the same.
    """
    conf = df.sparkSession.conf
    if float(conf.get("spark.sql.sources.fileCompressionFactor")) == 1.0:
        conf.set("spark.sql.sources.fileCompressionFactor", str(INFLATED))
    return written(df, what)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many rows need when they are written, at most as many as it is shuffled into."""
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.coalesce(max(1, min(most, -(-rows // FILE_ROWS))))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; the component is the smallest node reachable.

    Each round hangs every larger neighbour, then every smaller one, under the smallest node of its
    neighbourhood. Rounds grow with the logarithm of the component size. Null ends and loops are ignored. Edges never
    become more, so the first count says in how few files each round writes its own.
    """
    e = (
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = written(e, "edges")
    before, count = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = written(few_files(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), count), "edges")
        n, parts, s = e.agg(F.count("*"), F.count_distinct("u"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if (n, s) == before and n == parts or not n:
            break
        before = (n, s)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
