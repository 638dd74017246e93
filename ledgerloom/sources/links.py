"""Wrapped news links: decoded offline, else by what was fetched for them; what is left is told apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.sources.ledger_files import decoded_link

#: The host of wrapped links, and the names under which a fetched answer holds the address.
HOST = "news.google.com"
ENTRY, CALL, ANSWER = "wrb.fr", "Fbv4je", "garturlres"


def wrapped_id(link: Column) -> Column:
    """The id of a wrapped link, null for any other address."""
    ours = F.lower(F.try_parse_url(link, F.lit("HOST"))) == HOST
    return F.when(ours, F.nullif(F.regexp_extract(F.try_parse_url(link, F.lit("PATH")), r"/articles/([^/]+)", 1), F.lit("")))


def json_prefix(text: Column) -> Column:
    """The text up to the bracket that closes its first top-level array or object, null if none does.

    One pass over the characters; brackets within strings, and quotes behind a backslash, don't count.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, c: Column) -> Column:
        turn = F.when(s["quoted"], 0).when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        quote = (c == '"') & ~s["escaped"]
        at = s["at"] + 1
        moved = F.struct(
            (s["depth"] + turn).alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & ~s["escaped"] & (c == "\\")).alias("escaped"),
            at.alias("at"), F.when((turn == -1) & (s["depth"] == 1), at).otherwise(0).alias("end"),
        )
        return F.when(s["end"] > 0, s).otherwise(moved)

    end = F.aggregate(F.split(text, ""), start, step)["end"]
    return F.when(end > 0, F.substr(text, F.lit(1), end))


def fetched_address(response: Column) -> Column:
    """The address in a fetched answer: a guard, a length, then arrays of which one names the call; null if it is not of that form."""
    body = F.regexp_replace(F.regexp_replace(response, r"^\)\]\}'\s*", ""), r"^\d+\s*", "")
    entries = F.from_json(json_prefix(body), "array<array<string>>")
    ours = F.get(F.filter(entries, lambda e: (F.get(e, F.lit(0)) == ENTRY) & (F.get(e, F.lit(1)) == CALL)), F.lit(0))
    inner = F.from_json(F.get(ours, F.lit(2)), "array<string>")
    return F.when(F.get(inner, F.lit(0)) == ANSWER, F.get(inner, F.lit(1)))


def landed_links(answers: DataFrame) -> DataFrame:
    """(wrapped, address) of answers (wrapped, response): one a link, those that can't be read left out."""
    read = answers.select("wrapped", fetched_address(F.col("response")).alias("address")).filter("address is not null")
    return read.groupBy("wrapped").agg(F.min("address").alias("address"))


def resolve_links(rows: DataFrame, landed: DataFrame | None = None, link: str = "source_link") -> DataFrame:
    """rows with canonical_url and resolved: plain addresses as they are, wrapped ones decoded offline, else from landed (wrapped id, address), else as they are and unresolved."""
    d = rows.withColumn("_id", wrapped_id(F.col(link)))
    d = d.withColumn("_address", decoded_link(F.col("_id")))
    if landed is not None:
        d = d.join(landed.select(F.col("wrapped").alias("_id"), F.col("address").alias("_landed")), "_id", "left")
        d = d.withColumn("_address", F.coalesce("_address", "_landed")).drop("_landed")
    return d.withColumns({"canonical_url": F.coalesce("_address", F.col(link)), "resolved": F.col("_id").isNull() | F.col("_address").isNotNull()}).drop("_id", "_address")


def links_to_fetch(rows: DataFrame, landed: DataFrame, link: str = "source_link") -> DataFrame:
    """(wrapped) ids that neither decode offline nor have landed yet: what a next fetch has to ask for, once each."""
    ids = rows.select(wrapped_id(F.col(link)).alias("wrapped")).filter("wrapped is not null").distinct()
    return ids.filter(decoded_link(F.col("wrapped")).isNull()).join(landed.select("wrapped"), "wrapped", "left_anti")
