"""Recognising repeats: keys, windows over them, and joins with what is known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import Aliases, gn_fingerprint, normalize_url, title_fingerprint, with_company_key
from ledgerloom.operators.components import stage
from ledgerloom.operators.names import company_names


def first_by(df: DataFrame, key: Column, order: str = "row_idx") -> DataFrame:
    """The first row of each key; rows with a blank key all stay."""
    k = F.coalesce(key, F.lit(""))
    d = df.withColumn("_k", F.when(k == "", F.concat(F.lit("row:"), F.col(order).cast("string"))).otherwise(F.concat(F.lit("key:"), k)))
    return d.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy(order))).filter("_r = 1").drop("_k", "_r")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Search hits (row_idx, title, url): blank and repeated addresses go, then repeated title fingerprints."""
    return first_by(first_by(hits.filter(F.coalesce("url", F.lit("")) != ""), F.col("url")), title_fingerprint(F.col("title")))


def dedup_rejected(rejected: DataFrame) -> DataFrame:
    return first_by(rejected, normalize_url(F.col("source_link")))


def keyed(e: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Entries with the four keys of the index."""
    k = F.col("k_")
    return with_company_key(e, "k_", aliases=aliases).withColumns({"url_key": normalize_url(F.col("source_link")), "gn_key": gn_fingerprint(F.col("notes")), "date_key": F.concat(k, F.lit("||"), "date_announced"), "month_key": F.concat(k, F.lit("|"), F.substring("date_announced", 1, 7))}).drop("k_")


def flag(df: DataFrame, key: str, known: list[DataFrame], name: str, when: Column | None = None) -> DataFrame:
    """df with whether its key is among those of the known tables."""
    keys = known[0].select(key)
    for k in known[1:]:
        keys = keys.unionByName(k.select(key))
    keys = keys.filter(F.coalesce(F.col(key), F.lit("")) != "").distinct().withColumn(name, F.lit(True))
    hit = F.coalesce(name, F.lit(False))
    return df.join(keys, key, "left").withColumn(name, hit & when if when is not None else hit)


def check_candidates(candidates: DataFrame, ledger: DataFrame, queue: DataFrame, rejected: DataFrame, aliases: Aliases = None) -> DataFrame:
    """verdict of each candidate: duplicate by address (all tables), title fingerprint (queue, rejected) or company and
    date for wrapped news links (all tables); potential-duplicate by company and month (ledger, queue); else new."""
    own = ["company", "date_announced", "source_link", "notes"]
    known = None
    for part, x in (("ledger", ledger), ("queue", queue), ("rejected", rejected)):
        x = x.select(*own, F.lit(part).alias("part"))
        known = x if known is None else known.unionByName(x)
    names = company_names(known.select("company"), candidates.select("company"), aliases=aliases)
    # the keys of all known rows, worked out in one pass and written once
    known = stage(keyed(known, names).select("part", "url_key", "gn_key", "date_key", "month_key"), "known")
    of = lambda *parts: [known.filter(F.col("part").isin(*parts))]
    c = flag(keyed(candidates, names), "url_key", of("ledger", "queue", "rejected"), "by_url")
    c = flag(c, "gn_key", of("queue", "rejected"), "by_gn")
    c = flag(c, "date_key", of("ledger", "queue", "rejected"), "by_date", F.coalesce("source_link", F.lit("")).contains("news.google.com"))
    c = flag(c, "month_key", of("ledger", "queue"), "by_month")
    return c.withColumn("verdict", F.when(F.col("by_url") | F.col("by_gn") | F.col("by_date"), "duplicate").when(F.col("by_month"), "potential-duplicate").otherwise("new"))


def ingest(checked: DataFrame, skipped: int = 0) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, counters): the first candidate of each company and date that is no duplicate."""
    fresh = checked.filter("verdict <> 'duplicate'")
    fresh = fresh.withColumn("_r", F.row_number().over(Window.partitionBy("date_key").orderBy("row_idx"))).filter("_r = 1").drop("_r")
    counts = checked.agg(F.count("*").alias("n")).join(fresh.agg(F.count("*").alias("added"), F.count_if(F.col("verdict") == "potential-duplicate").alias("potential")))
    return fresh, counts.select("added", (F.col("n") - F.col("added") + skipped).alias("duplicates"), "potential")


def patch_kth(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """Each result claims the next unclaimed row of its key: k-th meets k-th."""
    w = Window.partitionBy(*keys).orderBy("row_idx")
    left, right = rows.withColumn("k", F.row_number().over(w)), results.withColumn("k", F.row_number().over(w)).withColumnRenamed("row_idx", "result_idx")
    return left.join(right, [*keys, "k"], "left").drop("k")


def new_warnings(current: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    return current.join(baseline.select(key).distinct(), key, "left_anti")
