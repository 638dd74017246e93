"""Filters, facets and orders that a reader of the ledger chooses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import iso_date


def apply_filters(e: DataFrame, search: str = "", industry: str = "all", status: str = "all", year: str = "all", months: int | None = None, today: str | None = None) -> DataFrame:
    """Rows that pass every filter: text in company, industry or notes; industry; status; year; at most `months` back, from the first of the month. Undated rows pass the last one."""
    d, text = e, search.strip().lower()
    if text:
        has = lambda c: F.lower(F.coalesce(F.col(c), F.lit(""))).contains(text)
        d = d.filter(has("company") | has("industry") | has("notes"))
    for column, value in (("industry", industry), ("status", status)):
        d = d.filter(F.col(column) == value) if value != "all" else d
    d = d.filter(F.col("date_announced").startswith(f"{year}-")) if year != "all" else d
    if months is not None:
        since = F.add_months(F.trunc(F.lit(today).cast("date"), "MM"), -months)
        d = d.filter(F.coalesce(iso_date(F.col("date_announced")) >= since, F.lit(True)))
    return d


def age_in_days(today: str) -> Column:
    return F.coalesce(F.datediff(F.lit(today).cast("date"), iso_date(F.col("date_announced"))), F.lit(0))


def stale_rumors(e: DataFrame, today: str, days: int = 30, every: bool = False) -> DataFrame:
    """Rumors of that age or more, or all of them, with age; a date that can't be read is of today."""
    d = e.filter("status = 'rumored'").withColumn("age", age_in_days(today))
    return d if every else d.filter(F.col("age") >= days)


def facets(e: DataFrame) -> DataFrame:
    """(year, rows, latest) by falling year."""
    return e.filter(iso_date(F.col("date_announced")).isNotNull()).groupBy(F.substring("date_announced", 1, 4).cast("int").alias("year")).agg(F.count("*").alias("n_rows"), F.max("date_announced").alias("latest")).orderBy(F.desc("year"))


def sorted_by(e: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Rows by a chosen column, blanks last, ties in file order."""
    c = F.nullif(F.col(column), F.lit("")) if dict(e.dtypes)[column] == "string" else F.col(column)
    return e.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), "row_idx")


def follow_up_totals(grouped: DataFrame) -> DataFrame:
    """Events with follow-ups, and how many follow-ups in all, of `grouped_events`."""
    n = F.size("follow_ups")
    return grouped.agg(F.count_if(n > 0).alias("events"), F.coalesce(F.sum(n), F.lit(0)).alias("follow_ups"))


def rotated(queries: list[str], core: list[str], today: str, most: int) -> list[str]:
    """The day's queries: the core, then the others from a place that moves on by one a day, cut at what is left of the budget."""
    from datetime import date

    at = date.fromisoformat(today).timetuple().tm_yday % len(queries) if queries else 0
    return [*core, *queries[at:], *queries[:at]][: max(0, most)]


def tallies(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
