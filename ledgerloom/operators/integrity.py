"""Integrity rules over the ledger, and between ledger and rejected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import INDUSTRIES, ISO, Aliases, gn_fingerprint, iso_date, normalize_url, with_company_key
from ledgerloom.operators.components import stage

STATUSES = ["rumored", "confirmed", "reference", "denied", "expired"]
#: Wording that the row rules look for, and hosts that need no archive.
VAGUE = r"(?i)not specified|not named|unnamed|undisclosed|\bname not\b|\(name|firm\)|manager\)?\z|company\)\z|^(?:a|an|another)\s+(?:\w+\s+)*(?:bank|firm|company|startup|business|retailer|mnc|multinational|tech\s+firm|lender|insurer)\z"
HEDGE = r"(?i)\bplans? to\b|\bexpected to\b|\bmay (?:lay|cut)\b|not confirmed|unconfirmed|appears future|date appears future|potential duplicate|likely the article|future plan|ambiguity|not clear(?:ly)?"
GLOBAL = r"(?i)\bglobal(?:ly)?\b|worldwide|across (?:divisions|the group)|sg office potentially|sites?\s+in\s+.+\s+and\s+|multiple (?:countries|markets|regions|sites)"
REPUTABLE = [
    "straitstimes.com", "channelnewsasia.com", "businesstimes.com.sg", "todayonline.com", "mothership.sg", "vulcanpost.com", "reuters.com", "bloomberg.com", "ft.com", "theonlinecitizen.com", "asiaone.com",
    "hrsea.economictimes.indiatimes.com", "fintechnews.sg", "stomp.sg", "ntuc.org.sg", "webintravel.com", "sg.finance.yahoo.com", "36kr.com", "news.google.com", "citywire.com", "law.asia",
]
#: Words that recur across unrelated events and names.
STOPWORDS = """singapore singaporean singaporeans company companies staff employee employees worker workers jobs role roles layoff layoffs retrench retrenched retrenchment
 cuts cut cutting closure close closing closed shut shuts cease ceased ceases business businesses report reported reports article confirmed rumored event events loss losses losing
 affected affecting operations office offices store stores outlet outlets workforce headcount restructuring reorganising announced announces announce plans planned future implying
 implies imply result resulting results source credible news coffee shop shops stall stalls vendor vendors canteen restaurant eatery hawker lease operator operators vacate renew
 renewal month months located nexus classified rules given their that this with from have been will more than over also into part amid about were told move moving forced making
 per not and the unnamed undisclosed specified provided identifiable snippet bank banks group holding holdings global international platforms technologies technology services
 solutions capital ventures labs studios digital mobile house centre center asia pacific financial systems media partners industries patisserie cafe studio""".split()
SUPERSEDED_DAYS, DOUBLE_DAYS, SAME_EVENT_DAYS = 30, 31, 21
ARCHIVES = ["web.archive.org", "archive.ph", "archive.is"]


def any_of(c: Column, parts: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, parts)), lambda p: c.contains(p))


def event_or_row(event_id: str = "event_id") -> Column:
    return F.coalesce(F.nullif(F.trim(F.col(event_id)), F.lit("")), F.concat(F.lit("row-"), (F.col("row_idx") + 1).cast("string")))


def validate_rows(e: DataFrame, industries: list[str] | None = None) -> DataFrame:
    """(row, field) of each failed field check, rows from 1."""
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    no = lambda c: F.coalesce(c, F.lit(True))
    checks = {
        "company": blank("company"), "date_announced": no(~F.col("date_announced").rlike(ISO)), "date_reported": ~blank("date_reported") & ~F.col("date_reported").rlike(ISO), "jobs_cut_sg": F.col("jobs_cut_sg") < 0,
        "jobs_cut_global": F.col("jobs_cut_global") < 0, "pct_workforce": (F.col("pct_workforce") < 0) | (F.col("pct_workforce") > 100), "industry": ~blank("industry") & ~F.col("industry").isin(industries or INDUSTRIES),
        "status": no(~F.col("status").isin(STATUSES)), "source_link": blank("source_link"), "event_id": blank("event_id"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(f)) for f, c in checks.items())))
    return e.select((F.col("row_idx") + 1).alias("row"), F.explode(found).alias("field"))


def advisory_types(today: str) -> Column:
    """The row advisories that an entry raises: future date, vague company, hedged or global wording, unarchived source."""
    sure, notes, link = F.col("status") == "confirmed", F.coalesce("notes", F.lit("")), F.coalesce("source_link", F.lit(""))
    rules = {
        "future-date": F.col("date_announced").rlike(ISO) & (F.col("date_announced") > today), "vague-company": sure & F.col("company").rlike(VAGUE), "contradictory-verdict": sure & notes.rlike(HEDGE),
        "global-figure": sure & (F.col("jobs_cut_sg") >= 1000) & notes.rlike(GLOBAL), "unarchived-confirmed": sure & ~((link != "") & any_of(link, ARCHIVES + REPUTABLE)),
    }
    return F.array_compact(F.array(*(F.when(c, F.lit(t)) for t, c in rules.items())))


def advisories(e: DataFrame, today: str) -> DataFrame:
    """(row, type) of the row advisories."""
    return e.select((F.col("row_idx") + 1).alias("row"), F.explode(advisory_types(today)).alias("type"))


def with_keys(e: DataFrame, aliases: Aliases = None) -> DataFrame:
    """Entries with k, event and d, as the pair rules need them."""
    return with_company_key(e, "k", aliases=aliases).withColumns({"event": event_or_row(), "d": iso_date(F.col("date_announced"))})


SIDES = ["row", "event", "status", "company", "d"]


def same_company(e: DataFrame, days: int = DOUBLE_DAYS) -> DataFrame:
    """Pairs, the earlier side first, of rows (row_idx, k, event, status, company, d) of one company with different events, at most `days` apart, with gap.

    Dates are bucketed by `days`, so the join stays an equi-join on company and neighbouring buckets.
    """
    n = e.filter("d is not null").select("k", F.col("row_idx").alias("row"), "event", "status", "company", "d")
    bucket = F.floor(F.unix_date("d") / (days + 1))
    a = n.select("k", bucket.alias("bucket"), *(F.col(c).alias(f"{c}_a") for c in SIDES))
    b = n.select("k", F.explode(F.array(bucket, bucket - 1)).alias("bucket"), *(F.col(c).alias(f"{c}_b") for c in SIDES))
    later = F.struct("d_b", "row_b") > F.struct("d_a", "row_a")
    return a.join(b, ["k", "bucket"]).filter(later & (F.col("event_a") != F.col("event_b"))).withColumn("gap", F.datediff("d_b", "d_a")).filter(F.col("gap") <= days)


def pair_kinds(pairs: DataFrame) -> DataFrame:
    """pairs with a row per type of finding: duplicate, double-count, superseded-rumor."""
    both = (F.col("status_a") == "confirmed") & (F.col("status_b") == "confirmed")
    kinds = F.array_compact(F.array(
        F.when(F.col("gap") == 0, F.lit("duplicate")), F.when(both & F.col("gap").between(1, DOUBLE_DAYS), F.lit("double-count")),
        F.when((F.col("status_a") == "rumored") & (F.col("status_b") == "confirmed") & (F.col("gap") <= SUPERSEDED_DAYS), F.lit("superseded-rumor")),
    ))
    return pairs.withColumn("type", F.explode(kinds))


def same_company_pairs(e: DataFrame, aliases: Aliases = None) -> DataFrame:
    """(type, row_a, row_b, event_a, event_b, gap) of the findings among rows of one company."""
    return pair_kinds(same_company(with_keys(e, aliases))).select("type", "row_a", "row_b", "event_a", "event_b", "gap")


def pair_groups(pairs: DataFrame) -> DataFrame:
    """One finding per type and pair of events: rows (from 1, joined) and the smallest gap."""
    pair = F.array_join(F.array_sort(F.array("event_a", "event_b")), " + ")
    rows = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(F.col("row_a") + 1, F.col("row_b") + 1)))))
    return pairs.groupBy("type", pair.alias("pair")).agg(F.array_join(rows.cast("array<string>"), ",").alias("rows"), F.min("gap").alias("gap"))


def significant_tokens(c: Column, stopwords: list[str]) -> Column:
    """Distinct runs of a-z of four letters or more that are no stopwords."""
    # words are looked up one by one: to take an array from another, Spark would hash all stopwords again for every row
    found = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+")
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) >= 4) & ~w.isin(stopwords) if stopwords else F.length(w) >= 4))


def cross_name_pairs(e: DataFrame, stopwords: list[str] = STOPWORDS, days: int = SAME_EVENT_DAYS, rare: int = 5) -> DataFrame:
    """Pairs, by row, of rows (row_idx, k, event, status, company, industry, d) of one industry, different company and event, near in time, that share a token of at most `rare` rows; with gap and tokens.

    Tokens are counted over all rows; too common ones are dropped before the join, so a token pairs at most `rare` rows.
    """
    n = e.select(F.col("row_idx").alias("row"), "k", "event", "status", "company", "industry", "d", F.explode(significant_tokens(F.col("company"), stopwords)).alias("token"))
    seen = n.groupBy("token").agg(F.count("*").alias("df")).filter(F.col("df").between(2, rare)).select("token")
    n = n.join(seen, "token").filter("status is distinct from 'reference' and d is not null")
    a, b = (n.select("token", "industry", *(F.col(c).alias(f"{c}_{s}") for c in [*SIDES, "k"])) for s in "ab")
    p = a.join(b, ["token", "industry"]).filter("row_a < row_b and k_a <> k_b and event_a <> event_b").withColumn("gap", F.abs(F.datediff("d_a", "d_b"))).filter(F.col("gap") <= days)
    return p.groupBy("row_a", "row_b", "event_a", "event_b", "company_a", "company_b", "d_a", "gap").agg(F.array_sort(F.collect_set("token")).alias("tokens"))


def cross_name(e: DataFrame, stopwords: list[str] = STOPWORDS, aliases: Aliases = None) -> DataFrame:
    """(row_a, row_b, gap, tokens joined, type) of the findings across names."""
    kind = F.when(F.col("gap") == 0, "same-day-same-event").otherwise("possible-same-event")
    return cross_name_pairs(stage(with_keys(e, aliases), "keyed"), stopwords).select("row_a", "row_b", "gap", F.array_join("tokens", ",").alias("tokens"), kind.alias("type"))


def name_splits(keys: DataFrame, key: str = "k", allowed: DataFrame | None = None) -> DataFrame:
    """(a, b): keys next to each other in order, where b goes on from a with a space. Ordered within the first word, which such keys share."""
    d = keys.select(key).distinct().withColumn("_w", F.substring_index(key, " ", 1))
    n = d.withColumn("b", F.lead(key).over(Window.partitionBy("_w").orderBy(key))).select(F.col(key).alias("a"), "b").filter((F.length("a") >= 4) & F.expr("startswith(b, a || ' ')"))
    return n.join(allowed, ["a", "b"], "left_anti") if allowed is not None else n


def duplicate_sources(e: DataFrame) -> DataFrame:
    """(url, n_rows, rows) of addresses cited by two rows or more."""
    n = e.filter("source_link <> ''").select("row_idx", F.explode(F.array(normalize_url(F.col("source_link")))).alias("url")).filter("url <> ''")
    rows = F.array_join(F.array_sort(F.collect_list(F.col("row_idx") + 1)).cast("array<string>"), ",")
    return n.groupBy("url").agg(F.count("*").alias("n_rows"), rows.alias("rows")).filter("n_rows > 1")


def rejected_keys(rejected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(url, by_url) and (gn, by_gn): the first rejected row of each key, but for rows rejected as duplicates."""
    r = rejected.filter(~F.coalesce("notes", F.lit("")).rlike("(?i)duplicate"))
    urls = r.groupBy(normalize_url(F.col("source_link")).alias("url")).agg(F.min("row_idx").alias("by_url")).filter("url <> ''")
    return urls, r.groupBy(gn_fingerprint(F.col("notes")).alias("gn")).agg(F.min("row_idx").alias("by_gn")).filter("gn is not null")


def cross_file(active: DataFrame, rejected: DataFrame) -> DataFrame:
    """(row, rejected_row): active rows whose address, else title fingerprint, was rejected (other than as a duplicate); the first rejected row wins."""
    urls, marks = rejected_keys(rejected)
    a = active.select("row_idx", normalize_url(F.col("source_link")).alias("url"), gn_fingerprint(F.col("notes")).alias("gn"))
    return a.join(urls, "url", "left").join(marks, "gn", "left").select((F.col("row_idx") + 1).alias("row"), (F.coalesce("by_url", "by_gn") + 1).alias("rejected_row")).filter("rejected_row is not null")


def stale_pairs(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """(pair, event_id): events that pairs (`a + b`) name and no entry has."""
    named = pairs.select("pair", F.explode(F.split("pair", r" \+ ")).alias("event_id"))
    return named.join(entries.select(F.trim("event_id").alias("event_id")), "event_id", "left_anti").select("pair", "event_id")
