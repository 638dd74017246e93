"""What a model is asked about a row, as text. The wording is fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(c: Column) -> Column:
    """A figure as it is read: whole ones without decimals."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def line(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value)


def hints_text(primary: Column, listed: Column) -> Column:
    """Lines on the known events: primary and the items of listed are structs (event_id, company, date_announced); blank without any."""
    first = F.concat(
        F.lit("This appears to be follow-up coverage of event "), primary["event_id"], F.lit(" ("), primary["company"], F.lit(", "), primary["date_announced"],
        F.lit("). Return that exact event_id unless the article clearly describes a separate, later round of cuts (then return null)."),
    )
    head = F.when(F.size(listed) > 0, F.lit("Existing events for this company (return one of these event_ids verbatim if this is follow-up coverage, else null):"))
    items = F.transform(listed, lambda h: F.concat(F.lit("  - "), h["event_id"], F.lit(" ("), h["date_announced"], F.lit(")")))
    return F.array_join(F.concat(F.array_compact(F.array(F.when(primary.isNotNull(), first), head)), items), "\n")


def user_prompt(hints: Column | None = None) -> Column:
    """The question about a row (company, date_announced, source_link, figures, notes); lines without a value are left out."""
    some = lambda c: F.nullif(F.coalesce(c, F.lit("")), F.lit(""))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    lines = [
        line("Title/Company: ", text("company")), line("Date: ", text("date_announced")), line("Source URL: ", text("source_link")),
        line("Jobs cut SG (scraped): ", number_text(F.col("jobs_cut_sg"))), line("Jobs cut global (scraped): ", number_text(F.col("jobs_cut_global"))),
        line("% workforce (scraped): ", number_text(F.col("pct_workforce"))), line("Notes/snippet: ", some(F.col("notes"))),
    ]
    return F.array_join(F.array_compact(F.array(*lines, *([some(hints)] if hints is not None else []))), "\n")
