"""Event roll-ups: rows of one event count once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import event_key, iso_date, row_quality


def is_confirmed() -> Column:
    return F.col("status").isin("confirmed", "reference")


def with_event(entries: DataFrame) -> DataFrame:
    return entries.withColumn("event", event_key(*(F.col(c) for c in ("event_id", "company", "date_announced", "source_link", "row_idx"))))


def event_rollup(entries: DataFrame) -> DataFrame:
    """One row per event: confirmed if any row is, the largest figures, dates, and the earliest row's company and industry."""
    first = F.struct("date_announced", "row_idx")
    return with_event(entries).groupBy("event").agg(
        F.bool_or(is_confirmed()).alias("confirmed"), F.max("jobs_cut_sg").alias("jobs_sg"), F.max("jobs_cut_global").alias("jobs_global"), F.min("date_announced").alias("first_date"),
        F.max(F.coalesce(F.nullif("date_reported", F.lit("")), "date_announced")).alias("last_reported"), F.min_by("company", first).alias("company"), F.min_by("industry", first).alias("industry"),
        F.min_by("row_idx", first).alias("first_idx"), F.count("*").alias("n_rows"),
    )


def headline(events: DataFrame) -> DataFrame:
    ok = F.col("confirmed")
    return events.agg(
        F.coalesce(F.sum(F.when(ok, F.coalesce("jobs_sg", F.lit(0.0)))), F.lit(0.0)).alias("total_jobs"), F.count_if(ok & F.col("jobs_sg").isNull()).alias("undisclosed"), F.count_if(ok).alias("confirmed_events"),
        F.count_if(~ok).alias("rumored_events"), F.count_distinct(F.nullif(F.lower("company"), F.lit(""))).alias("companies"), F.max("last_reported").alias("latest"),
    )


def monthly(events: DataFrame) -> DataFrame:
    ok, day = F.col("confirmed"), iso_date(F.col("first_date"))
    return events.filter(day.isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.sum(F.when(ok, F.coalesce("jobs_sg", F.lit(0.0))).otherwise(0.0)).alias("jobs"), F.count_if(ok).alias("n_confirmed"), F.count_if(~ok).alias("n_rumored")
    ).orderBy("month")


def by_industry(events: DataFrame) -> DataFrame:
    return events.filter("confirmed").groupBy(F.coalesce(F.nullif("industry", F.lit("")), F.lit("Other")).alias("industry")).agg(
        F.sum(F.coalesce("jobs_sg", F.lit(0.0))).alias("jobs"), F.count("*").alias("n_events"), F.min("first_idx").alias("first_idx")
    ).orderBy(F.desc("jobs"), "first_idx")


def quarter_of(month: str) -> Column:
    m = F.regexp_extract(month, r"^\d{4}-(0[1-9]|1[0-2])\z", 1)
    return F.when(m != "", F.concat(F.substring(month, 1, 4), F.lit("-Q"), F.ceil(m.try_cast("int") / 3).cast("string")))


def quarterly_benchmark(months: DataFrame, official: DataFrame) -> DataFrame:
    """Official (quarter, official) figures with what was tracked and its share; untracked quarters give 0."""
    tracked = months.withColumn("quarter", quarter_of("month")).filter("quarter is not null").groupBy("quarter").agg(F.sum("jobs").alias("tracked"))
    got = F.coalesce("tracked", F.lit(0.0))
    return official.join(tracked, "quarter", "left").select("quarter", "official", got.alias("tracked"), F.when(F.col("official") > 0, F.round(got / F.col("official") * 100, 6)).otherwise(0.0).alias("pct")).orderBy("quarter")


def ranked_rows(entries: DataFrame, *order: object) -> DataFrame:
    return with_event(entries).withColumn("rank", F.row_number().over(Window.partitionBy("event").orderBy(*order)))


def canonical_rows(entries: DataFrame) -> DataFrame:
    """Per event the row of best quality, then first in the file."""
    return ranked_rows(entries.withColumn("quality", row_quality()), F.desc("quality"), "row_idx").filter("rank = 1").drop("rank")


def grouped_events(entries: DataFrame) -> DataFrame:
    """The earliest row of each event (then best quality), promoted and filled from its follow-ups, which are nested."""
    e = ranked_rows(entries.withColumn("quality", row_quality()), "date_announced", F.desc("quality"), "row_idx")
    row = F.struct("rank", "row_idx", "date_announced", "source_link", "status")
    return e.groupBy("event").agg(
        F.min_by("row_idx", "rank").alias("row_idx"), F.min_by("company", "rank").alias("company"), F.min("date_announced").alias("date_announced"),
        F.when(F.bool_or(is_confirmed()), F.when(F.min_by("status", "rank").isin("confirmed", "reference"), F.min_by("status", "rank")).otherwise("confirmed")).otherwise(F.min_by("status", "rank")).alias("status"),
        F.max("jobs_cut_sg").alias("jobs_cut_sg"), F.max("jobs_cut_global").alias("jobs_cut_global"),
        F.array_sort(F.filter(F.collect_list(row), lambda r: r["rank"] > 1)).alias("follow_ups"),
    ).orderBy(F.desc("date_announced"), "row_idx")
