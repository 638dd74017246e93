"""Projections between hits, candidates, verdicts and ledger rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.text import INDUSTRIES, ISO, Aliases, event_id_for, guess_company, jobs_number, map_industry, normalize_company, parse_date, title_fingerprint, wayback_url, with_company_key
from ledgerloom.operators.components import stage

#: Rows of a name that are shuffled to one task at most, if it has no more than a thousandth of all.
HOT_ROWS = 100_000
REVIEW_ONLY = ["review_id", "candidate_urls", "snippet"]


def blank(c: Column | str) -> Column:
    """The text, null where it is blank: what an `or` passes over."""
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(""))


def hit_to_review(hits: DataFrame, today: str, stamp: str, id_prefix: str | None = None, notes_prefix: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """Candidates of search hits (row_idx, title, url, snippet, published)."""
    title, snippet = F.coalesce(blank("title"), F.col("url")), F.coalesce("snippet", F.lit(""))
    date = F.coalesce(parse_date(F.col("published")), F.lit(today))
    mark = F.concat(F.lit("[gn:"), title_fingerprint(title), F.lit("]"))
    return hits.select(
        "row_idx", F.concat_ws("-", F.lit(id_prefix), F.lit(stamp), F.col("row_idx").cast("string")).alias("review_id"), guess_company(title, aliases).alias("company"), date.alias("date_announced"), date.alias("date_reported"),
        jobs_number(F.concat(title, F.lit(". "), snippet)).cast("double").alias("jobs_cut_sg"), F.lit(None).cast("double").alias("jobs_cut_global"), F.lit(None).cast("double").alias("pct_workforce"), F.lit("Other").alias("industry"),
        F.col("url").alias("source_link"), F.concat_ws(" ", F.lit(notes_prefix), mark).alias("notes"), F.lit("rumored").alias("status"), F.lit("").alias("event_id"), F.col("url").alias("candidate_urls"), F.substring(snippet, 1, 300).alias("snippet"),
    )


def event_to_review(events: DataFrame, today: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """Candidates of a source's events (row_idx, id, company, industry, announcement_date, created_date, affected, is_exact, source_name, source_url, notes)."""
    announced = parse_date(F.col("announcement_date"))
    reported = F.coalesce(announced, parse_date(F.col("created_date")), F.lit(today))
    link = F.coalesce(blank(F.trim("source_url")), F.concat(F.lit("https://layoffsg.com/feed?event="), F.col("id").cast("string")))
    own = blank(F.trim("notes"))
    origin = F.concat_ws("; ", F.concat(F.lit("via "), blank("source_name")), F.when(~F.col("is_exact"), "estimate").when(F.col("is_exact"), "exact count"), own)
    notes = F.concat(F.lit("From layoffsg.com"), F.when(origin != "", F.concat(F.lit(" ("), origin, F.lit(")"))).otherwise(""), F.lit(" [lsg:"), F.col("id").cast("string"), F.lit("]"))
    return events.select(
        "row_idx", F.concat_ws("-", F.lit("layoffsg"), F.col("id").cast("string"), F.col("row_idx").cast("string")).alias("review_id"), normalize_company(F.coalesce("company", F.lit("")), aliases).alias("company"),
        F.coalesce(announced, reported).alias("date_announced"), reported.alias("date_reported"), F.floor(F.col("affected") + 0.5).cast("double").alias("jobs_cut_sg"), F.lit(None).cast("double").alias("jobs_cut_global"),
        F.lit(None).cast("double").alias("pct_workforce"), map_industry(F.col("industry")).alias("industry"), link.alias("source_link"), notes.alias("notes"), F.lit("rumored").alias("status"), F.lit("").alias("event_id"),
        link.alias("candidate_urls"), F.substring(F.coalesce(own, origin), 1, 300).alias("snippet"),
    )


def source_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first event (row_idx, id, company) of each id with a company, one row of counts: skipped)."""
    from ledgerloom.operators.dedup import first_by

    named = events.filter(F.col("id").isNotNull() & (F.trim(F.coalesce("company", F.lit(""))) != ""))
    kept = first_by(named, F.col("id").cast("string"))
    return kept, events.agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("kept"))).select((F.col("n") - F.col("kept")).alias("skipped"))


def to_entry(rows: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Ledger rows of triaged candidates (rule struct, final_verdict, reason): rule, then row, then what follows from them.

    Rules are read once, and only rows without an event of their own look for their company's key. A rule gives one name to
    any number of rows: names of more than HOT_ROWS rows, and of a thousandth of all, are broadcast, so that their rows stay
    where they are; only the others are shuffled.
    """
    industry = F.coalesce(blank("rule.industry"), blank("industry"), F.lit("Other"))
    settled = F.col("final_verdict").isin("rejected", "queue")
    notes = F.coalesce("rule.notes", "notes", F.lit(""))
    d = rows.select(
        "row_idx", F.coalesce("rule.company", "company").alias("company"), "date_announced", F.coalesce("date_reported", "date_announced").alias("date_reported"), *(F.col(c).cast("double").alias(c) for c in ("jobs_cut_sg", "jobs_cut_global", "pct_workforce")),
        F.when(industry.isin(INDUSTRIES), industry).otherwise("Other").alias("industry"), "source_link", F.when((F.col("final_verdict") == "rejected") & (notes == ""), F.col("reason")).otherwise(notes).alias("notes"),
        F.when(settled, F.coalesce(blank("status"), F.lit("rumored"))).otherwise(F.col("final_verdict")).alias("status"), blank("event_id").alias("event_id"),
    )
    d = stage(d, "entries")
    name = F.coalesce("company", F.lit("")).alias("_company")
    unnamed = d.filter("event_id is null")
    names = stage(with_company_key(unnamed.groupBy(name).agg(F.count("*").alias("_n")), "_k", "_company", aliases), "entry-names")
    hot = F.col("_n") > max(HOT_ROWS, (names.agg(F.sum("_n")).first()[0] or 0) / 1000)
    many, few = F.broadcast(names.filter(hot)), names.filter(~hot)
    unnamed = unnamed.withColumn("_company", name)
    keyed = unnamed.join(many, "_company").unionByName(unnamed.join(F.broadcast(names.filter(hot).select("_company")), "_company", "left_anti").join(few, "_company"))
    return d.filter("event_id is not null").unionByName(keyed.withColumn("event_id", event_id_for(F.col("_k"), F.col("date_announced"))).select(d.columns))


def golden_to_entry(cases: DataFrame) -> DataFrame:
    """Entries of evaluation cases: one figure, dealt to the local or the global side."""
    wide = F.coalesce(F.col("global_figure"), F.lit(False))
    return cases.select(
        "row_idx", "company", "date_announced", F.col("date_announced").alias("date_reported"), F.when(~wide, F.col("jobs_cut")).cast("double").alias("jobs_cut_sg"), F.when(wide, F.col("jobs_cut")).cast("double").alias("jobs_cut_global"),
        F.col("pct_workforce").cast("double").alias("pct_workforce"), F.lit("Other").alias("industry"), "source_link", "notes", F.lit("confirmed").alias("status"), F.lit("").alias("event_id"),
    )


def with_defaults(verdicts: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdicts (row_idx, company, dates, figures) filled from their entries; dates that are not ISO give way."""
    own, given = verdicts.alias("v"), entries.alias("e")
    date = lambda c: F.when(F.col(f"v.{c}").rlike(ISO), F.col(f"v.{c}")).otherwise(F.col(f"e.{c}")).alias(c)
    figures = [F.coalesce(f"v.{c}", f"e.{c}").alias(c) for c in ("jobs_cut_sg", "jobs_cut_global", "pct_workforce")]
    return own.join(given, "row_idx").select("row_idx", F.coalesce(blank("v.company"), F.col("e.company")).alias("company"), date("date_announced"), date("date_reported"), *figures)


def result_rows(rumors: DataFrame, checked_at: str) -> DataFrame:
    """Recheck results of rumors with new_status, headcount, evidence_url, note; a confirmed head count is named in the note."""
    count = F.when((F.col("new_status") == "confirmed") & F.col("headcount").isNotNull(), F.concat(F.lit(" (~"), F.col("headcount").cast("long").cast("string"), F.lit(" Singapore jobs)"))).otherwise("")
    return rumors.select("row_idx", "company", "date_announced", F.col("status").alias("current_status"), "new_status", F.coalesce("evidence_url", F.lit("")).alias("evidence_url"), F.trim(F.concat(F.coalesce("note", F.lit("")), count)).alias("evidence_note"), F.lit(checked_at).alias("checked_at"))


def without_review(rows: DataFrame) -> DataFrame:
    return rows.drop(*REVIEW_ONLY)


def archive_links(entries: DataFrame, stamp: str, statuses: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """(row_idx, source_link, archived): rows to archive, in order: with an address, not archived yet, of these statuses.

    The rows that an offset skips are found by row_idx alone and taken out; an offset on all rows would gather them in one task.
    """
    link = F.coalesce("source_link", F.lit(""))
    d = entries.filter((link != "") & ~link.contains("web.archive.org") & F.col("status").isin(statuses))
    if offset:
        d = d.join(d.select("row_idx").orderBy("row_idx").limit(offset), "row_idx", "left_anti")
    d = d.orderBy("row_idx")
    d = d.limit(limit) if limit is not None else d
    return d.select("row_idx", "source_link", wayback_url(F.lit(stamp), F.col("source_link")).alias("archived"))
