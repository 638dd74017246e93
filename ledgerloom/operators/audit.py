"""The assembled audit: every integrity rule in one frame of findings, hard errors apart from advisories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import Aliases, gn_fingerprint, iso_date, normalize_url, with_company_key
from ledgerloom.operators.components import stage
from ledgerloom.operators.integrity import STOPWORDS, advisory_types, cross_name_pairs, event_or_row, name_splits, pair_kinds, rejected_keys, same_company, validate_rows

#: Findings of these types block; all others advise.
HARD = ["same-day-same-event"]
#: Of these types a report shows a few examples each.
PER_ROW = ["unarchived-confirmed", "contradictory-verdict", "global-figure", "vague-company", "cross-file-contradiction"]
FINDING = ["type", "event_ids", "rows", "identity", "message"]
#: Where a report says that aliases and allowed neighbours are kept. The texts of all findings below are fixed values.
PLACES = ("the aliases", "the allowed neighbours")


def pair_key(a: str, b: str) -> Column:
    return F.array_join(F.array_sort(F.array(a, b)), " + ")


def text_of(*parts: Column | str) -> Column:
    """The parts one after another; strings are text, null is blank."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def rows_text(rows: Column) -> Column:
    n = F.size(rows)
    return F.when(n <= 3, text_of("rows ", F.array_join(rows.cast("array<string>"), ", "))).otherwise(text_of("rows ", F.get(rows, F.lit(0)), " + ", n - 1, " others"))


def names_text(names: Column) -> Column:
    n, quoted = F.size(names), F.transform(names, lambda c: F.concat(F.lit('"'), c, F.lit('"')))
    return F.when(n <= 3, F.array_join(quoted, " / ")).otherwise(text_of(F.array_join(F.slice(quoted, 1, 3), " / "), " + ", n - 3, " more names"))


def indexed(entries: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Entries with what all rules share, worked out and written once: key, event, date, address key and identity."""
    e = with_company_key(entries, "k", aliases=aliases).withColumns({"event": event_or_row(), "d": iso_date(F.col("date_announced")), "url": normalize_url(F.col("source_link")), "gn": gn_fingerprint(F.col("notes"))})
    e = e.withColumn("identity", F.coalesce(F.nullif("url", F.lit("")), text_of(F.col("k"), "@", F.col("date_announced"))))
    return stage(e, "indexed")


def pair_warnings(e: DataFrame, findings: DataFrame, distinct_pairs: DataFrame | None) -> DataFrame:
    """One warning per type and pair of events of findings (type, row_a, row_b, event_a, event_b, company_a, company_b, d_a, gap, tokens)."""
    order = F.struct("d_a", "row_a", "row_b")
    both = lambda a, b: F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array(a, b)))))
    g = findings.withColumn("identity", pair_key("event_a", "event_b"))
    if distinct_pairs is not None:
        g = g.join(distinct_pairs.select(F.col("pair").alias("identity")).distinct(), "identity", "left_anti")
    g = g.groupBy("type", "identity").agg(
        both(F.col("row_a") + 1, F.col("row_b") + 1).alias("rows"), both("company_a", "company_b").alias("names"), F.min("gap").alias("gap"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tokens")))).alias("tokens"), F.min_by("event_a", order).alias("one"), F.min_by("event_b", order).alias("two"),
    )
    since = e.groupBy("event").agg(F.min(F.coalesce("date_announced", F.lit(""))).alias("since"))
    for x in ("one", "two"):
        g = g.join(since.select(F.col("event").alias(x), F.col("since").alias(f"{x}_since")), x)
    turn = (F.col("type") != "superseded-rumor") & (F.col("one_since") > F.col("two_since"))
    side = lambda a, b: F.when(turn, F.col(b)).otherwise(F.col(a))
    g = g.withColumns({"first": side("one", "two"), "first_since": side("one_since", "two_since"), "second": side("two", "one"), "second_since": side("two_since", "one_since")})
    one, two = (text_of(F.col(x), " (from ", F.col(f"{x}_since"), ")") for x in ("first", "second"))
    names, where, gap = names_text(F.col("names")), rows_text(F.col("rows")), F.col("gap")
    message = (
        F.when(F.col("type") == "duplicate", text_of("Duplicate: ", names, " on the same date under two event_ids — ", one, " vs ", two, "; ", where))
        .when(F.col("type") == "double-count", text_of("Possible double-count: ", names, " confirmed under two event_ids — ", one, " vs ", two, ", closest rows ", gap, "d apart; ", where))
        .when(F.col("type") == "superseded-rumor", text_of("Superseded rumor: ", names, " rumored ", one, " precedes confirmed ", two, " by ", gap, "d; ", where))
        .otherwise(text_of("Possible same event under different names: ", names, " share distinctive token(s) [", F.array_join("tokens", ", "), "] — ", one, " vs ", two, ", ", gap, "d apart; ", where))
    )
    return g.select("type", F.array("first", "second").alias("event_ids"), "rows", "identity", message.alias("message"))


def row_warnings(e: DataFrame, today: str) -> DataFrame:
    c, when = F.col("company"), F.col("date_announced")
    message = (
        F.when(F.col("type") == "future-date", text_of('Future date: "', c, '" dated ', when, f" (after {today})"))
        .when(F.col("type") == "vague-company", text_of('Vague company for confirmed entry: "', c, '" — name a specific company or downgrade'))
        .when(F.col("type") == "contradictory-verdict", text_of('Confirmed but notes hedge: "', c, '" (', when, ') — "', F.substring("notes", 1, 90), '"'))
        .when(F.col("type") == "global-figure", text_of('Global figure in jobs_cut_sg: "', c, '" jobs_cut_sg=', F.col("jobs_cut_sg").cast("decimal(38,0)"), " reads as worldwide — move to jobs_cut_global"))
        .otherwise(text_of('Unrecognised source for confirmed entry: "', c, '" (', when, ") — ", F.col("source_link")))
    )
    found = e.withColumn("type", F.explode(advisory_types(today)))
    return found.select("type", F.array("event").alias("event_ids"), F.array(F.col("row_idx") + 1).alias("rows"), "identity", message.alias("message"))


def source_warnings(e: DataFrame) -> DataFrame:
    g = e.filter("url <> ''").groupBy("url").agg(F.array_sort(F.collect_set("event")).alias("event_ids"), F.array_sort(F.collect_list(F.col("row_idx") + 1)).alias("rows")).filter(F.size("rows") > 1)
    return g.select(F.lit("duplicate-source").alias("type"), "event_ids", "rows", F.col("url").alias("identity"), text_of("Same article cited by ", F.size("rows"), " rows (", rows_text(F.col("rows")), "): ", F.col("url")).alias("message"))


def split_warnings(e: DataFrame, allowed: DataFrame | None, places: tuple[str, str] = PLACES) -> DataFrame:
    """Neighbouring keys that look like one company; `allowed` holds the pairs (a, b) that are not. The text says in which places aliases and allowed pairs are kept."""
    pairs = name_splits(e.select("k"), "k", allowed)
    members = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("k")).join(e.select("k", "event", "row_idx"), "k")
    g = members.groupBy("a", "b").agg(F.array_sort(F.collect_set("event")).alias("event_ids"), F.array_sort(F.collect_list(F.col("row_idx") + 1)).alias("rows"))
    text = text_of('Company keys "', F.col("a"), '" and "', F.col("b"), f'" look like one company under two names — add an alias to {places[0]}, or an entry with a reason to {places[1]} if they are distinct')
    return g.select(F.lit("name-split").alias("type"), "event_ids", "rows", F.concat_ws(" + ", "a", "b").alias("identity"), text.alias("message"))


def same_day_errors(cross: DataFrame) -> DataFrame:
    """Each pair of rows of one day, industry and rare token; not to be suppressed."""
    text = text_of("Same-day, same-industry entries share distinctive company token(s) [", F.array_join("tokens", ", "), ']: "', F.col("company_a"), '" and "', F.col("company_b"), '" both on ', F.col("d_a"), " — if this is one event, give both rows the same event_id; if they are genuinely different companies, add an alias/exclusion so this token stops matching")
    d = cross.filter("gap = 0")
    return d.select(F.lit("same-day-same-event").alias("type"), F.array("event_a", "event_b").alias("event_ids"), F.array(F.col("row_a") + 1, F.col("row_b") + 1).alias("rows"), pair_key("event_a", "event_b").alias("identity"), text.alias("message"))


def cross_file_warnings(e: DataFrame, rejected: DataFrame) -> DataFrame:
    """Active rows whose address, else title fingerprint, was rejected (other than as a duplicate)."""
    urls, marks = rejected_keys(rejected)
    d = e.join(urls, "url", "left").join(marks, "gn", "left").filter(F.coalesce("by_url", "by_gn").isNotNull())
    by = F.when(F.col("by_url").isNotNull(), "source URL").otherwise("gn-fingerprint")
    text = text_of('"', F.col("company"), '" (', F.col("date_announced"), ", ", F.col("status"), ") shares its ", by, " with rejected row ", F.coalesce("by_url", "by_gn") + 1, " — same event kept and rejected")
    return d.select(F.lit("cross-file-contradiction").alias("type"), F.array("event").alias("event_ids"), F.array(F.col("row_idx") + 1).alias("rows"), "identity", text.alias("message"))


def check_integrity(entries: DataFrame, today: str, distinct_pairs: DataFrame | None = None, allowed: DataFrame | None = None, rejected: DataFrame | None = None, stopwords: list[str] = STOPWORDS, aliases: Aliases = None) -> DataFrame:
    """(type, event_ids, rows, identity, message, hard) of every rule over the ledger.

    distinct_pairs (pair) suppresses pair findings of two events, but not same-day ones; allowed (a, b) suppresses
    neighbouring names; rejected adds contradictions with that table.
    """
    e = indexed(entries, aliases)
    cross = stage(cross_name_pairs(e, stopwords), "cross")
    own = pair_kinds(same_company(e)).withColumn("tokens", F.array().cast("array<string>"))
    later = cross.filter("gap > 0").withColumn("type", F.lit("possible-same-event"))
    names = ["type", "row_a", "row_b", "event_a", "event_b", "company_a", "company_b", "d_a", "gap", "tokens"]
    found = pair_warnings(e, own.select(names).unionByName(later.select(names)), distinct_pairs)
    for part in (same_day_errors(cross), split_warnings(e, allowed), source_warnings(e), row_warnings(e, today), *([cross_file_warnings(e, rejected)] if rejected is not None else [])):
        found = found.unionByName(part)
    return found.withColumn("hard", F.col("type").isin(HARD))


def analyze(entries: DataFrame, today: str, **how: object) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(field errors, hard findings, warnings)."""
    found = stage(check_integrity(entries, today, **how), "findings")
    return validate_rows(entries), found.filter("hard"), found.filter("not hard")


def fingerprint() -> Column:
    return F.concat_ws(" :: ", "type", "identity")


def regression(current: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings new since the baseline, findings resolved since), by fingerprint, multiplicity kept."""
    c, b = current.withColumn("fingerprint", fingerprint()), baseline.withColumn("fingerprint", fingerprint())
    return c.join(b.select("fingerprint").distinct(), "fingerprint", "left_anti"), b.join(c.select("fingerprint").distinct(), "fingerprint", "left_anti")


def summary(findings: DataFrame) -> DataFrame:
    """(type, n) by falling count."""
    return findings.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def examples(findings: DataFrame, most: int = 5) -> DataFrame:
    """Findings as a report shows them: of per-row types the first few, of others all.

    Only per-row types are ranked, and cut in every task before the shuffle; the others stay where they are.
    """
    findings, per_row = stage(findings, "findings"), F.coalesce(F.col("type").isin(PER_ROW), F.lit(False))
    turn = F.row_number().over(Window.partitionBy("type").orderBy(F.get("rows", F.lit(0)), "identity"))
    first = findings.filter(per_row).withColumn("_r", turn).filter(F.col("_r") <= most).drop("_r")
    return findings.filter(~per_row).unionByName(first)


def event_stats(entries: DataFrame) -> DataFrame:
    """Rows, events, and events with a row that is confirmed as such."""
    e = event_or_row()
    return entries.agg(F.count("*").alias("rows"), F.count_distinct(e).alias("events"), F.count_distinct(F.when(F.col("status") == "confirmed", e)).alias("confirmed_events"))
