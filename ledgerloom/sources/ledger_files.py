"""Ledger files: CSV tables, decision tables and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import ALIASES, is_relevant
from ledgerloom.operators.components import shared_dir, stage

COLUMNS = ["company", "date_announced", "date_reported", "jobs_cut_sg", "jobs_cut_global", "pct_workforce", "industry", "source_link", "notes", "status", "event_id"]
NUMBERS = ["jobs_cut_sg", "jobs_cut_global", "pct_workforce"]


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def row_numbered(df: DataFrame) -> DataFrame:
    """df with row_idx from 0, gapless in the order of files and of rows in them; one count per file split comes to the driver."""
    d = stage(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    part = F.shiftrightunsigned("_id", 33)
    base, bases = 0, []
    for p, n in sorted(map(tuple, d.groupBy(part.alias("p")).count().collect())):
        bases.append((p, base))
        base += n
    bases = df.sparkSession.createDataFrame(bases, "_part long, _base long")
    return d.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("row_idx", F.col("_base") + (F.col("_id") - F.shiftleft(F.col("_part"), 33))).drop("_id", "_part", "_base")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Any CSV table, all text, every column of the file, with row_idx; blank lines don't count, and carriage returns are line ends."""
    d = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("enforceSchema", False).csv(path)
    return row_numbered(d.select(*(F.regexp_replace(c, "\r\n?", "\n").alias(c) for c in d.columns)))


def typed(d: DataFrame, raw: bool = False) -> DataFrame:
    """Text rows as ledger rows: the known columns (raw: all), figures as numbers, and what can't be read in `<name>_raw`."""
    if not raw:
        d = d.select(*(F.col(c) if c in d.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS), "row_idx")
    for c in NUMBERS:
        if c in d.columns:
            d = d.withColumn(f"{c}_raw", F.col(c)).withColumn(c, F.nullif(F.trim(c), F.lit("")).try_cast("double"))
    return d


def read_ledger(spark: SparkSession, path: str, raw: bool = False) -> DataFrame:
    """A CSV ledger with row_idx, the row's number from 0; a missing path is an empty table. raw keeps every column of the file."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"{c} {'double' if c in NUMBERS else 'string'}" for c in COLUMNS) + ", row_idx long")
    return typed(read_csv(spark, path), raw)


def parse_ledger(spark: SparkSession, text: str) -> DataFrame:
    """Ledger rows of a CSV text."""
    folder = shared_dir(spark, "text")
    spark.createDataFrame([(text.replace("\r\n", "\n").replace("\r", "\n"),)], "value string").coalesce(1).write.text(folder)
    return typed(read_csv(spark, folder))


def read_aliases(spark: SparkSession, path: str) -> dict[str, str]:
    """Lower-cased alias to canonical name, the last of several; half-blank rows go, and a missing or empty table gives the fixed few."""
    if not exists(spark, path):
        return dict(ALIASES)
    d = read_csv(spark, path).select(F.lower(F.trim("alias")).alias("a"), F.trim("canonical").alias("c"), "row_idx").filter("coalesce(a, '') <> '' and coalesce(c, '') <> ''")
    last = d.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("row_idx")))).filter("_r = 1")
    return {r.a: r.c for r in last.orderBy("row_idx").collect()} or dict(ALIASES)


def feed_hits(feeds: DataFrame) -> DataFrame:
    """Relevant items (source, title, url, snippet, published) of feeds (source, xml); stray ampersands are repaired first, items without title or link go."""
    whole = F.regexp_replace("xml", r"&(?!(?:amp|lt|gt|quot|apos|#\d+|#x[0-9a-fA-F]+);)", "&amp;")
    item = "struct<title: string, link: string, description: string, pubDate: string>"
    items = F.from_xml(whole, f"channel struct<item: array<{item}>>")["channel"]["item"]
    snippet = F.regexp_replace(F.coalesce("i.description", F.lit("")), "\r", "")
    d = feeds.select("source", F.explode(items).alias("i")).filter("coalesce(i.title, '') <> '' and coalesce(i.link, '') <> ''").filter(is_relevant(F.col("i.title"), snippet))
    return d.select("source", F.col("i.title").alias("title"), F.col("i.link").alias("url"), F.substring(snippet, 1, 500).alias("snippet"), F.coalesce("i.pubDate", F.lit("")).alias("published"))


def decoded_link(wrapped: Column) -> Column:
    """The address inside an old-style wrapped link's id, null for a new-style one or anything else."""
    code = F.translate(wrapped, "-_", "+/")
    code = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    bare = F.regexp_replace(F.regexp_replace(F.hex(F.try_to_binary(code, F.lit("base64"))), "^081322", ""), "D20100\\z", "")
    size = F.conv(F.substring(bare, 1, 2), 16, 10).cast("int")
    text = F.decode(F.unhex(F.when(size >= 128, F.substr(bare, F.lit(5), size * 2)).otherwise(F.substr(bare, F.lit(3), size * 2))), "ISO-8859-1")
    return F.when(text.startswith("http"), text)


def budget(state: DataFrame, month: str, cap: int = 1000) -> DataFrame:
    """The one-row search budget (month, searches_used, monthly_cap) as of a month: another month starts at zero, no row at all as well."""
    one = state.agg(F.first("month").alias("m"), F.first("searches_used").alias("u"), F.first("monthly_cap").alias("c"))
    return one.select(F.lit(month).alias("month"), F.when(F.coalesce("m", F.lit(month)) == month, F.coalesce("u", F.lit(0))).otherwise(0).alias("searches_used"), F.coalesce("c", F.lit(cap)).alias("monthly_cap"))


def write_report(df: DataFrame, path: str) -> None:
    """A run's report as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_ledger(df: DataFrame, path: str, mode: str = "errorifexists", raw: bool = False) -> None:
    """The known columns first, nulls blank, no carriage returns; raw adds the others in their order."""
    extra = [c for c in df.columns if c not in COLUMNS and c != "row_idx" and not c.endswith("_raw")] if raw else []
    d = df.select(*(F.regexp_replace(F.col(c).cast("string"), "\r", "").alias(c) for c in [*COLUMNS, *extra]))
    d.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", "").option("emptyValue", "").csv(path)


def append_ledger(df: DataFrame, path: str) -> None:
    write_ledger(df, path, mode="append")


def write_snapshot(df: DataFrame, root: str, snapshot: str) -> None:
    df.write.mode("overwrite").parquet(f"{root}/snapshot={snapshot}")


def read_snapshot(spark: SparkSession, root: str, snapshot: str) -> DataFrame:
    return spark.read.parquet(f"{root}/snapshot={snapshot}")


def read_snapshots(spark: SparkSession, root: str) -> DataFrame:
    """All versions with their name in `snapshot`, always text; a filter on it prunes to that version's files."""
    d = spark.read.option("basePath", root).parquet(root)
    return d.withColumn("snapshot", F.col("snapshot").cast("string"))


def distinct_pairs(df: DataFrame) -> DataFrame:
    """Order-free keys of (event_id_a, event_id_b); half-blank rows go."""
    a, b = F.trim("event_id_a"), F.trim("event_id_b")
    return df.filter((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")).select(F.array_join(F.array_sort(F.array(a, b)), " + ").alias("pair")).distinct()


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.option("header", True).csv(path)
    n = F.regexp_replace("retrenchments", "[^0-9]", "").try_cast("bigint")
    return d.select(F.trim("quarter").alias("quarter"), n.alias("official")).filter("coalesce(quarter, '') <> '' and official is not null")


def read_json_rows(spark: SparkSession, path: str, inside: str | None = None) -> DataFrame:
    """A JSON array of rows, or the array under a key."""
    d = spark.read.option("multiLine", True).json(path)
    return d.select(F.explode(inside).alias("r")).select("r.*") if inside else d


def read_decisions(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A table of curated decisions, all text and trimmed; one without a required column raises, a missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in required))
    d = read_csv(spark, path)
    if missing := [c for c in required if c not in d.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return d.select(*(F.trim(c).alias(c) if c != "row_idx" else F.col(c) for c in d.columns))


def read_allowed_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(a, b): the neighbouring keys, shorter first, that a JSON array of items with a and b says are no one company; a missing file allows none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "a string, b string")
    return read_json_rows(spark, path).select("a", "b").filter("a is not null and b is not null").distinct()


def first_source(rows: DataFrame, by: str, rank: str) -> DataFrame:
    """Of several providers' rows per query, those of the first provider that has any."""
    best = rows.groupBy(by).agg(F.min(rank).alias(rank))
    return rows.join(best, [by, rank], "left_semi")
