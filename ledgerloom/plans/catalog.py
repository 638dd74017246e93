"""Ledger queries over the given tables, and the same results in SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import prompts as M
from ledgerloom.functions import text as X
from ledgerloom.functions.rules import EVENT_RULES, REJECTED_KINDS
from ledgerloom.operators import audit as A
from ledgerloom.operators import classify as C
from ledgerloom.operators import dedup as D
from ledgerloom.operators import events as E
from ledgerloom.operators import integrity as V
from ledgerloom.operators import guards as U
from ledgerloom.operators import history as Y
from ledgerloom.operators import hints as H
from ledgerloom.operators import linking as G
from ledgerloom.operators import projections as P
from ledgerloom.operators import selection as S
from ledgerloom.operators import triage_run as T
from ledgerloom.operators.components import shared_dir, stage
from ledgerloom.operators.names import company_names
from ledgerloom.plans.entry_view import entries, oracle_entry
from ledgerloom.session import table
from ledgerloom.sources import links as K

TODAY = "1999-06-15"
RULES = [("(the|and) .{0,40} of ", "confirmed"), (" que ", "rumored"), (" und ", "confirmed")]
REJECT = ["license", "rights reserved", "est "]
#: Names that share a token with three or five other rows, for the rules across names; a third of the rows keeps its own.
LETTERS = "translate(CAST(CAST(floor({}) AS BIGINT) AS STRING), '0123456789', 'qwertyuiop')"
BRAND = "CASE WHEN row_idx % 3 = 0 THEN company ELSE 'Brand tok' || " + LETTERS.format("row_idx / CASE WHEN CAST(floor(row_idx / 24) AS BIGINT) % 2 = 0 THEN 4 ELSE 6 END") + " || CASE WHEN CAST(floor(row_idx / 24) AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END || ' uu' || " + LETTERS.format("row_idx") + " END"
DISTINCT = "SELECT DISTINCT least(a, b) || ' + ' || greatest(a, b) AS pair FROM (SELECT event_id AS a, lag(event_id) OVER (PARTITION BY substring(event_id, 1, 9) ORDER BY date_announced, row_idx) AS b, row_idx FROM {e}) AS x WHERE a <> '' AND b <> '' AND a <> b AND row_idx % 2 = 0"
ALLOWED = "SELECT DISTINCT lower(c_name) AS a, lower(c_name) || ' group' AS b FROM {customer} WHERE c_custkey % 10 = 5"
HEADLINE = "CASE WHEN row_idx % 4 = 0 THEN 'ExxonMobil to cut jobs' WHEN row_idx % 4 = 1 THEN 'Heineken to shed staff' WHEN row_idx % 12 = 2 THEN 'Nokia ' || company WHEN row_idx % 12 = 6 THEN 'Opinion: ' || company ELSE company || ' news' END"
#: Aliases of every other customer's names: as they stand, with an ending, and (found without it) with a bracket.
HOUSES = "SELECT lower(c_name) || ending AS alias, 'House ' || CAST(CAST(floor(c_custkey / 4) AS BIGINT) AS STRING) AS canonical FROM {customer}, (SELECT '' AS ending UNION ALL SELECT ' pte ltd') AS x WHERE c_custkey % 2 = 0"
MERGES = "SELECT DISTINCT 'cust-' || CAST(c_custkey AS STRING) AS from_event_id, 'cust-' || CAST(c_custkey + 7 AS STRING) AS to_event_id FROM {customer} WHERE c_custkey % 21 < 14"


def parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The entry view dealt to candidates, ledger, queue and rejected."""
    e = entries(spark, sf_dir)
    return [e.filter(F.col("row_idx") % 4 == k) for k in (0, 1, 2, 3)]


def q_event_rollup(s: SparkSession, d: str) -> DataFrame:
    return E.event_rollup(entries(s, d)).drop("first_idx")


def q_headline(s: SparkSession, d: str) -> DataFrame:
    return E.headline(E.event_rollup(entries(s, d)))


def q_monthly(s: SparkSession, d: str) -> DataFrame:
    return E.monthly(E.event_rollup(entries(s, d)))


def q_industry(s: SparkSession, d: str) -> DataFrame:
    return E.by_industry(E.event_rollup(entries(s, d))).drop("first_idx")


def q_quarterly_benchmark(s: SparkSession, d: str) -> DataFrame:
    month = F.date_format("l_shipdate", "yyyy-MM")
    official = table(s, d, "lineitem").select(E.quarter_of(month).alias("quarter"), "l_quantity").groupBy("quarter").agg(F.sum("l_quantity").alias("official"))
    return E.quarterly_benchmark(E.monthly(E.event_rollup(entries(s, d))), official)


def q_row_quality(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d).select("row_idx", X.row_quality().alias("quality"))


def q_canonical_row(s: SparkSession, d: str) -> DataFrame:
    return E.canonical_rows(entries(s, d)).select("event", "row_idx", "quality")


def q_grouped_events(s: SparkSession, d: str) -> DataFrame:
    g = E.grouped_events(entries(s, d))
    return g.select("event", "row_idx", "company", "date_announced", "status", "jobs_cut_sg", "jobs_cut_global", F.size("follow_ups").alias("n_follow_ups"))


def q_filters(s: SparkSession, d: str) -> DataFrame:
    return S.apply_filters(entries(s, d), search=" Global ", status="confirmed", months=30, today=TODAY).select("row_idx", "company", "date_announced", "notes")


def q_filters_year(s: SparkSession, d: str) -> DataFrame:
    return S.apply_filters(entries(s, d), industry="BUILDING", year="1995").select("row_idx", "company", "date_announced")


def q_stale(s: SparkSession, d: str) -> DataFrame:
    return S.stale_rumors(entries(s, d), TODAY).select("row_idx", "age")


def q_facets(s: SparkSession, d: str) -> DataFrame:
    return S.facets(entries(s, d))


def q_follow_ups(s: SparkSession, d: str) -> DataFrame:
    return S.follow_up_totals(E.grouped_events(entries(s, d)))


def q_event_stats(s: SparkSession, d: str) -> DataFrame:
    return A.event_stats(entries(s, d))


def q_topk(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d).orderBy(F.desc("date_announced"), "row_idx").offset(20).limit(50).select("row_idx", "date_announced", "event_id")


def q_url_keys(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d).select("row_idx", X.normalize_url(F.col("source_link")).alias("url_key"))


def q_rejected_dedup(s: SparkSession, d: str) -> DataFrame:
    return D.dedup_rejected(entries(s, d)).select("row_idx", "source_link")


def q_title_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", X.title_fingerprint(F.col("text")).alias("fingerprint"))


def q_hit_dedup(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "documents").select(F.col("doc_id").alias("row_idx"), F.col("text").alias("title"), F.expr("'u' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING)").alias("url"))
    return D.dedupe_hits(hits).select("row_idx", "url")


def q_company_key(s: SparkSession, d: str) -> DataFrame:
    return X.with_company_key(entries(s, d)).select("row_idx", "k", X.event_id_for(F.col("k"), F.col("date_announced")).alias("slug"), X.month_base(F.col("event_id")).alias("base"))


def q_dedup_index(s: SparkSession, d: str) -> DataFrame:
    return D.check_candidates(*parts(s, d)).select("row_idx", "by_url", "by_gn", "by_month", "verdict")


def houses(s: SparkSession, d: str) -> DataFrame:
    return s.sql(HOUSES, customer=table(s, d, "customer"))


def q_alias_keys(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    return X.with_company_key(e, "k", aliases=company_names(e.select("company"), aliases=houses(s, d))).select("row_idx", "k")


def q_alias_dedup(s: SparkSession, d: str) -> DataFrame:
    return D.check_candidates(*parts(s, d), aliases=houses(s, d)).select("row_idx", "by_month", "verdict")


def q_dedup_dates(s: SparkSession, d: str) -> DataFrame:
    """A third of all rows has wrapped news links, which company and date can settle."""
    link = F.expr("CASE WHEN row_idx % 3 = 0 THEN 'https://news.google.com/rss/articles/' || CAST(row_idx AS STRING) ELSE source_link END")
    return D.check_candidates(*(p.withColumn("source_link", link) for p in parts(s, d))).select("row_idx", "by_date", "verdict")


def q_ingest(s: SparkSession, d: str) -> DataFrame:
    return D.ingest(D.check_candidates(*parts(s, d)), skipped=2)[1]


def q_ingest_rows(s: SparkSession, d: str) -> DataFrame:
    return D.ingest(D.check_candidates(*parts(s, d)))[0].select("row_idx", "verdict")


def q_islands_21(s: SparkSession, d: str) -> DataFrame:
    n = X.with_company_key(entries(s, d)).select("row_idx", "k", X.iso_date(F.col("date_announced")).alias("day"))
    return G.islands(n, "k", "day").select("row_idx", "k", "island")


def named(e: DataFrame) -> DataFrame:
    """Companies whose first words tell them apart, which headlines can be searched for."""
    return e.withColumn("company", F.expr(NAMED))


def q_clusters(s: SparkSession, d: str) -> DataFrame:
    return G.cluster(named(entries(s, d)))


def q_node_keys(s: SparkSession, d: str) -> DataFrame:
    e = named(entries(s, d))
    return G.node_keys(e, G.telling(G.company_tokens(e.select("company", "row_idx"), {})))


def q_company_tokens(s: SparkSession, d: str) -> DataFrame:
    return G.company_tokens(named(entries(s, d)).select("company", "row_idx"), {}).select("key", "variant")


def q_same_company_pairs(s: SparkSession, d: str) -> DataFrame:
    return V.same_company_pairs(entries(s, d))


def q_pair_groups(s: SparkSession, d: str) -> DataFrame:
    return V.pair_groups(V.same_company_pairs(entries(s, d)))


def q_cross_name(s: SparkSession, d: str) -> DataFrame:
    return V.cross_name(entries(s, d).withColumn("company", F.expr(BRAND)))


def audited(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).withColumn("company", F.expr(BRAND)).withColumn("jobs_cut_sg", F.col("jobs_cut_sg") * 10)
    ledger, rejected = e.filter("row_idx % 4 <> 3"), e.filter("row_idx % 4 = 3")
    return A.check_integrity(ledger, TODAY, s.sql(DISTINCT, e=ledger), s.sql(ALLOWED, customer=table(s, d, "customer")), rejected)


def q_check_integrity(s: SparkSession, d: str) -> DataFrame:
    text = lambda c, by: F.array_join(F.col(c).cast("array<string>"), by).alias(c)
    return audited(s, d).select("type", text("event_ids", "|"), text("rows", ","), "identity", "hard")


def q_finding_messages(s: SparkSession, d: str) -> DataFrame:
    return audited(s, d).select("type", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"), "message")


def q_integrity_summary(s: SparkSession, d: str) -> DataFrame:
    return A.summary(audited(s, d))


#: The ledger as it was, with rows announced before a day, and as it is, without rows that have been taken out since.
PAST, NOW = "date_announced < '1997-06-01'", "row_idx % 40 <> 20"


def versions(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame | None]:
    """The audit of the ledger, and that of its past version, read back from where versions are kept."""
    e = entries(s, d).withColumn("company", F.expr(BRAND)).withColumn("jobs_cut_sg", F.col("jobs_cut_sg") * 10)
    root = shared_dir(s, "versions")
    for name, rows in (("past", e.filter(PAST)), ("now", e.filter(NOW))):
        ledger = rows.filter("row_idx % 4 <> 3")
        Y.save_version(root, name, ledger, rows.filter("row_idx % 4 = 3"), s.sql(DISTINCT, e=ledger))
    allowed = s.sql(ALLOWED, customer=table(s, d, "customer"))
    return Y.findings_at(s, root, "now", TODAY, allowed), Y.findings_at(s, root, "past", TODAY, allowed)


def q_regression(s: SparkSession, d: str) -> DataFrame:
    """Every finding of the whole audit that is new since the past version or resolved since."""
    new, gone, _ = Y.since(*versions(s, d))
    side = lambda x, n: x.select(F.lit(n).alias("side"), "type", F.array_join("event_ids", "|").alias("event_ids"), F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"), "identity")
    return side(new, "new").unionByName(side(gone, "resolved"))


def q_regression_counts(s: SparkSession, d: str) -> DataFrame:
    return Y.since(*versions(s, d))[2]


def q_name_split(s: SparkSession, d: str) -> DataFrame:
    names = table(s, d, "part").select(F.explode(F.array(F.substring_index(F.lower("p_name"), " ", 1), F.lower("p_name"))).alias("k"))
    return V.name_splits(names)


def q_validate_rows(s: SparkSession, d: str) -> DataFrame:
    return V.validate_rows(entries(s, d), ["BUILDING", "MACHINERY", "FURNITURE"])


def q_validate_fields(s: SparkSession, d: str) -> DataFrame:
    """Every check of a field fires on some rows."""
    bad = {"company": "'  '", "date_announced": "'soon'", "date_reported": "'1999-1-1'", "jobs_cut_sg": "-1.0D", "jobs_cut_global": "-2.0D", "pct_workforce": "-3.0D", "industry": "'Unknown'", "status": "'odd'", "source_link": "NULL", "event_id": "' '"}
    e = entries(s, d)
    e = e.withColumns({c: F.expr(f"CASE WHEN row_idx % 11 = {i} THEN {v} ELSE {c} END") for i, (c, v) in enumerate(bad.items())})
    return V.validate_rows(e, ["BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "HOUSEHOLD"])


def q_tallies(s: SparkSession, d: str) -> DataFrame:
    return S.tallies(entries(s, d), "status")


def q_finding_examples(s: SparkSession, d: str) -> DataFrame:
    return A.examples(audited(s, d)).groupBy("type").agg(F.count("*").alias("n"), F.max(F.get("rows", F.lit(0))).alias("last"))


def q_advisories(s: SparkSession, d: str) -> DataFrame:
    return V.advisories(entries(s, d).withColumn("jobs_cut_sg", F.col("jobs_cut_sg") * 10), TODAY)


def q_duplicate_sources(s: SparkSession, d: str) -> DataFrame:
    return V.duplicate_sources(entries(s, d))


def q_cross_file(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    return V.cross_file(e.filter("row_idx % 4 < 2"), e.filter("row_idx % 4 >= 2"))


def q_merge_chain(s: SparkSession, d: str) -> DataFrame:
    return G.resolve_merges(s.sql(MERGES, customer=table(s, d, "customer")))


def q_patch_kth(s: SparkSession, d: str) -> DataFrame:
    e = X.with_company_key(entries(s, d), "k_").withColumn("month", F.substring("date_announced", 1, 4))
    rows, results = e.filter("row_idx % 3 <> 0").select("row_idx", "k_", "month"), e.filter("row_idx % 3 = 0").select("row_idx", "k_", "month")
    return D.patch_kth(rows, results, ["k_", "month"]).select("row_idx", "result_idx")


def q_new_warnings(s: SparkSession, d: str) -> DataFrame:
    w = V.advisories(entries(s, d), TODAY).withColumn("fingerprint", F.expr("type || ' :: ' || CAST(CAST(floor(row / 3) AS BIGINT) AS STRING)"))
    return D.new_warnings(w.filter("row % 2 = 0"), w.filter("row % 2 = 1")).select("fingerprint", "row")


def q_window_groups(s: SparkSession, d: str) -> DataFrame:
    return G.window_groups(entries(s, d))


def q_dedup_by_deletion(s: SparkSession, d: str) -> DataFrame:
    return G.dedup_by_deletion(entries(s, d)).select("row_idx", "event_id")


def q_link_events(s: SparkSession, d: str) -> DataFrame:
    """With merges of some customers' events into their next month's, and pairs that must stay apart."""
    e = entries(s, d)
    merges = e.filter("event_id <> '' and row_idx % 40 = 0").groupBy(F.substring_index("event_id", "-", 2).alias("c")).agg(F.min("event_id").alias("from_event_id"), F.max("event_id").alias("to_event_id")).filter("from_event_id <> to_event_id")
    pairs = s.sql(DISTINCT, e=e).filter("pmod(xxhash64(pair), 50) = 0").select(F.split("pair", r" \+ ").alias("p")).select(F.get("p", F.lit(0)).alias("a"), F.get("p", F.lit(1)).alias("b"))
    return G.link_events(e, merges.select("from_event_id", "to_event_id"), pairs)


def q_linked(s: SparkSession, d: str) -> DataFrame:
    return G.link_events(entries(s, d))


def headlines(s: SparkSession, d: str) -> DataFrame:
    return entries(s, d).withColumn("company", F.expr(HEADLINE)).withColumn("industry", F.lit("Retail"))


def q_triage(s: SparkSession, d: str) -> DataFrame:
    return C.triage(headlines(s, d), ["Opinion:", "labour market"]).select("row_idx", "verdict", F.col("rule.company").alias("rule_company"), "reason")


def q_to_entry(s: SparkSession, d: str) -> DataFrame:
    t = C.triage(headlines(s, d), ["Opinion:"]).withColumn("final_verdict", F.col("verdict"))
    return P.to_entry(t).select("row_idx", "company", "industry", "notes", "status", "event_id", "date_reported")


def q_month_guard(s: SparkSession, d: str) -> DataFrame:
    t = stage(C.triage(headlines(s, d), ["Opinion:"]).select("row_idx", "date_announced", F.col("verdict").alias("final_verdict"), F.coalesce("rule.company", "company").alias("named")), "triaged")
    t = X.with_company_key(t, "k", "named")
    return C.month_guard(t, F.concat("k", F.lit("|"), F.substring("date_announced", 1, 7))).select("row_idx", "final_verdict")


BATCH = "CASE row_idx % 28 WHEN 0 THEN 'ExxonMobil to cut jobs' WHEN 4 THEN 'Nokia ' || company WHEN 8 THEN 'Opinion: ' || company WHEN 12 THEN 'Heineken to shed ' || CAST(row_idx % 9 AS STRING) ELSE company || ' news' END"


def q_triage_run(s: SparkSession, d: str) -> DataFrame:
    """A quarter of the entries as a batch against the others; addresses of their own, so that companies and dates decide."""
    e = entries(s, d).withColumns({"company": F.expr(NAMED), "notes": F.lit(""), "source_link": F.expr("'http://s.sg/' || CAST(row_idx AS STRING)")})
    batch = e.filter("row_idx % 4 = 0").withColumn("company", F.expr(BATCH))
    return T.triage_run(batch, e.filter("row_idx % 4 <> 0"), ["Opinion:"]).select("row_idx", "final_verdict", "reason", "company", "industry", "notes", "status", "event_id")


def q_rejected_kinds(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).withColumn("notes", F.expr("notes || CASE row_idx % 5 WHEN 1 THEN ' hiring now' WHEN 2 THEN ' no Singapore nexus' WHEN 3 THEN ' tracker' ELSE '' END")).withColumn("company", F.expr(HEADLINE))
    return e.select("row_idx", C.rejected_kind().alias("kind"), C.polluted_accept().alias("polluted"))


def hinted(s: SparkSession, d: str, aliases: X.Aliases = None) -> DataFrame:
    e = entries(s, d)
    ledger, own = e.filter("row_idx % 4 <> 0"), e.filter("row_idx % 4 = 0")
    clusters = e.select("row_idx", F.when(F.col("row_idx") % 4 == 0, "candidate").otherwise("anchor").alias("kind"), F.concat("industry", F.substring("date_announced", 1, 10)).alias("cluster"))
    return H.select_hints(own, ledger, clusters, aliases=aliases).select("row_idx", "primary_event_id", F.array_join("listed", "|").alias("listed"))


def q_event_hints(s: SparkSession, d: str) -> DataFrame:
    return hinted(s, d)


def q_alias_hints(s: SparkSession, d: str) -> DataFrame:
    return hinted(s, d, houses(s, d))


def q_align_events(s: SparkSession, d: str) -> DataFrame:
    rows = entries(s, d).select("row_idx", F.concat("industry", F.substring("date_announced", 1, 7)).alias("cluster"), F.when(F.col("row_idx") % 300 == 0, "anchor").otherwise("candidate").alias("kind"), X.row_quality().alias("score"), "date_announced", (F.col("status") != "reference").alias("accepted"), "event_id")
    return H.align_events(rows).select("row_idx", "new_event_id")


def q_apply_results(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    results = e.filter("row_idx % 3 = 0").withColumn("date_announced", F.concat(F.lit(" "), F.substring("date_announced", 1, 10))).withColumn("new_status", F.expr("CASE row_idx % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'denied' WHEN 2 THEN 'expired' ELSE 'rumored' END")).withColumn("evidence_url", F.col("source_link"))
    return U.apply_results(e.withColumn("notes", F.lit("seen")), results).select("row_idx", "status", "notes", "result_idx")


def q_archive_links(s: SparkSession, d: str) -> DataFrame:
    return P.archive_links(entries(s, d), "20260101000000", ["confirmed", "reference"], offset=5)


def q_golden_entries(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).select("row_idx", "company", "date_announced", "pct_workforce", "source_link", "notes", F.coalesce("jobs_cut_sg", "jobs_cut_global").alias("jobs_cut"), (F.col("row_idx") % 2 == 0).alias("global_figure"))
    return P.golden_to_entry(e).select("row_idx", "jobs_cut_sg", "jobs_cut_global", "status", "event_id")


def q_result_rows(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d).filter("status = 'rumored'").withColumns({"new_status": F.expr("CASE WHEN row_idx % 2 = 0 THEN 'confirmed' ELSE 'denied' END"), "headcount": F.col("jobs_cut_sg"), "evidence_url": F.col("source_link"), "note": F.col("notes")})
    return P.result_rows(e, TODAY).select("row_idx", "new_status", "evidence_url", "evidence_note")


def q_with_defaults(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    v = e.select("row_idx", F.expr("CASE WHEN row_idx % 2 = 0 THEN '' ELSE 'Given' END").alias("company"), F.expr("CASE WHEN row_idx % 3 = 0 THEN 'soon' ELSE '2026-01-02' END").alias("date_announced"), F.lit("").alias("date_reported"), F.expr("CASE WHEN row_idx % 5 = 1 THEN 7.0D END").alias("jobs_cut_sg"), F.lit(None).cast("double").alias("jobs_cut_global"), F.lit(0.0).alias("pct_workforce"))
    return P.with_defaults(v, e)


def q_hit_to_review(s: SparkSession, d: str) -> DataFrame:
    hits = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("row_idx"), F.expr("'Firm ' || CAST(doc_id AS STRING) || ' Ltd cut ' || CAST(doc_id AS STRING) || ' jobs, say people - Paper'").alias("title"), F.concat(F.lit("http://p/"), F.col("doc_id").cast("string")).alias("url"), F.col("text").alias("snippet"), F.expr("CASE WHEN doc_id % 3 = 0 THEN '5 May 2026' WHEN doc_id % 3 = 1 THEN '2026-04-03' ELSE 'nonsense' END").alias("published"))
    return P.hit_to_review(hits, "2026-06-01", "t", "x", "via").select("row_idx", "review_id", "company", "date_announced", "jobs_cut_sg", "notes", "snippet")


def wrapped(s: SparkSession, d: str) -> DataFrame:
    """Entries whose addresses stand as they are, wrapped in an id that holds them, or behind an id that says nothing, by turns."""
    e = entries(s, d).filter("source_link <> ''")
    url = F.col("source_link")
    old = F.base64(F.concat(F.unhex(F.lit("081322")), F.unhex(F.lpad(F.hex(F.length(url)), 2, "0")), F.encode(url, "ISO-8859-1"), F.unhex(F.lit("D20100"))))
    link = lambda i: F.concat(F.lit("https://news.google.com/rss/articles/"), i, F.lit("?oc=5"))
    fresh = F.concat(F.lit("CBMiK"), F.col("row_idx").cast("string"))
    turn = F.col("row_idx") % 4
    kept = F.rtrim(F.translate(old, "+/", "-_"), F.lit("="))
    return e.withColumns({"plain": url, "fresh": fresh, "source_link": F.when(turn == 0, url).when(turn == 1, link(kept)).otherwise(link(fresh))})


def q_resolved_links(s: SparkSession, d: str) -> DataFrame:
    """Of the ids that say nothing, every other one has been fetched."""
    e = wrapped(s, d)
    inner = F.concat(F.lit('[\\"garturlres\\",\\"'), F.col("plain"), F.lit('\\",1,\\"]}[\\"]'))
    text = F.concat(F.lit(")]}'\n\n123\n[[\"di\",7],[\"wrb.fr\",\"Fbv4je\",\""), inner, F.lit('",null,null,null,"generic"]]\n25\n[["e",4]]'))
    landed = K.landed_links(e.filter("row_idx % 4 = 2").select(F.col("fresh").alias("wrapped"), text.alias("response")))
    return K.resolve_links(e, landed).select("row_idx", "canonical_url", "resolved")


def q_prompts(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    hint = lambda n: F.struct(F.concat("event_id", F.lit(n)).alias("event_id"), "company", "date_announced")
    listed = F.when(F.col("row_idx") % 2 == 0, F.array(hint("-b"), hint("-c"))).otherwise(F.array().cast("array<struct<event_id:string,company:string,date_announced:string>>"))
    text = M.hints_text(F.when(F.col("row_idx") % 3 == 0, hint("-a")), listed)
    return e.select("row_idx", M.user_prompt(text).alias("prompt"))


def q_stale_pairs(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    return V.stale_pairs(s.sql(DISTINCT, e=e), e.filter("row_idx % 3 <> 0"))


def q_recheck(s: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    status = F.expr("CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'still-rumored' WHEN 2 THEN 'denied' WHEN 3 THEN 'expired' ELSE 'maybe' END")
    raw = F.concat(F.lit('{"new_status":"'), status, F.lit('","evidence_url":'), F.when(n % 3 == 0, F.lit("7")).otherwise(F.concat(F.lit('"http://e/'), n.cast("string"), F.lit('"'))), F.lit(',"headcount":'), F.when(n % 2 == 0, n.cast("string")).otherwise(F.lit('"5"')), F.lit("}"))
    return table(s, d, "events").select("event_id", *C.parse_recheck(F.when(n % 11 == 0, F.lit("[broken")).otherwise(raw)))


def q_source_checks(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    return e.select("row_idx", X.is_relevant(F.col("notes"), F.expr("CASE WHEN row_idx % 3 = 0 THEN 'Retrenchment at a firm' ELSE 'x' END")).alias("relevant"), X.host_is_excluded(F.col("source_link"), ["site7.example.com", "reuters.com"]).alias("excluded"))


def q_labels(s: SparkSession, d: str) -> DataFrame:
    m = E.monthly(E.event_rollup(entries(s, d)))
    return m.select("month", X.month_label(F.col("month")).alias("label"), X.quarter_heading(E.quarter_of("month")).alias("heading"))


def q_tier_metrics(s: SparkSession, d: str) -> DataFrame:
    pick = lambda c: F.expr(f"CASE {c} WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rumored' ELSE 'rejected' END")
    rows = table(s, d, "events").select(pick("event_id % 3").alias("expected_verdict"), pick("CAST(floor(event_id / 2) AS BIGINT) % 3").alias("verdict"), (F.col("event_id") % 5 == 0).alias("global_figure"), F.expr("CASE event_id % 4 WHEN 0 THEN 'singapore' WHEN 1 THEN 'global' WHEN 2 THEN 'partial' END").alias("headcount_scope"), F.expr("CASE WHEN event_id % 2 = 0 THEN 'singapore' END").alias("expected_scope"))
    r = lambda c: F.round(c, 9).alias(c)
    return C.tier_metrics(rows).select("cases", r("verdict_accuracy"), r("accept_accuracy"), "tier_cases", r("tier_match"), "over_confident", "under_confident", "global_cases", "scope_leaks", "scope_recognised", "scope_labelled", "scope_exact")


def q_extract_figures(s: SparkSession, d: str) -> DataFrame:
    n, c = F.col("row_idx"), lambda x: x.cast("string")
    text = F.when(n % 4 == 0, F.concat(F.lit("Firm cut "), c(n % 3000), F.lit(" jobs"))).when(n % 4 == 1, F.concat(F.lit("to reduce its workforce by 1,"), c(100 + n % 800))).when(n % 4 == 2, F.concat(F.lit("laid off "), c(n % 100), F.lit(".5% of its staff"))).otherwise(F.lit("nothing"))
    return entries(s, d).select("row_idx", X.jobs_number(text).alias("jobs"), X.share_number(text).alias("pct"))


def q_classify(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents").withColumnRenamed("doc_id", "row_idx")
    return C.pre_classify(docs, F.col("text"), RULES, REJECT).select("row_idx", "verdict")


def q_resolve_clusters(s: SparkSession, d: str) -> DataFrame:
    e = entries(s, d)
    rows = e.select("row_idx", F.concat("industry", F.substring("date_announced", 1, 7)).alias("cluster"), F.when(F.col("row_idx") % 50 == 0, "anchor").otherwise("candidate").alias("kind"), X.row_quality().alias("score"), "date_announced", F.col("status").alias("verdict"), F.when(F.col("row_idx") % 13 == 0, "manual").otherwise("rule").alias("route"))
    return C.resolve_clusters(rows).select("row_idx", "final_verdict")


def q_json_verdict(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    raw = F.when(F.col("event_id") % 10 < 8, F.concat(F.lit('{"verdict":"'), F.when(F.col("event_id") % 3 == 0, "confirmed").when(F.col("event_id") % 3 == 1, "rumored").otherwise("maybe"), F.lit('","jobs":'), F.when(F.col("event_id") % 2 == 0, F.lit('"5"')).otherwise((F.col("event_id") % 77).cast("string")), F.lit("}"))).otherwise(raw)
    return table(s, d, "events").select("event_id", *C.parse_verdict(raw, ["confirmed", "rumored"], [], ["jobs"]))


def q_eval_metrics(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "labels").join(table(s, d, "documents"), "doc_id").withColumn("guess", F.when(F.col("text").rlike(r"[#$%&|]|!!"), 0).otherwise(1))
    return C.confusion(rows, "quality", "guess", "lang").select("lang", "tp", "fp", "fn", "tn", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


def q_stratified(s: SparkSession, d: str) -> DataFrame:
    return C.stratified(table(s, d, "documents").select("doc_id", "lang"), "lang", "doc_id", 40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k[2:]: f for k, f in list(globals().items()) if k.startswith("q_")}


def sql_fold(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(strip_accents({c}), '\\s&\\s', ' and ', 'g'), '\\s+', ' ', 'g'))"


def sql_bare(c: str) -> str:
    return f"regexp_replace({sql_fold(c)}, '\\s*\\([^)]*\\)\\s*$', '')"


def sql_key(c: str) -> str:
    c = sql_bare(c)
    for x in X.SUFFIXES:
        c = f"regexp_replace({c}, '\\s+{x.replace('.', '[.]')}$', '', 'i')"
    for x in X.DESCRIPTORS:
        c = f"trim(regexp_replace({c}, '\\s+{x}$', '', 'i'))"
    return f"lower(trim(regexp_replace({c}, '[,;.]$', '')))"


def sql_url(c: str) -> str:
    c = f"regexp_replace({c}, '^https?://web\\.archive\\.org/web/\\d+/', '')"
    c = f"lower(regexp_replace(regexp_replace({c}, '[?#].*$', ''), '/+$', ''))"
    for p in ("^https?://", "^www\\.", "/amp$", "\\.amp$", "/index\\.html?$", "/+$"):
        c = f"regexp_replace({c}, '{p}', '')"
    return c


QUALITY = "(CASE WHEN status = 'confirmed' THEN 3 ELSE 0 END + CASE WHEN coalesce(jobs_cut_sg, jobs_cut_global) <> 0 THEN 2 ELSE 0 END + CASE WHEN pct_workforce <> 0 THEN 1 ELSE 0 END + CASE WHEN contains(source_link, 'web.archive.org') THEN 2 ELSE 0 END + CASE WHEN source_link <> '' AND NOT contains(source_link, 'news.google.com') THEN 1 ELSE 0 END)"
GN = r"nullif(regexp_extract(notes, '\[gn:([^\]]*)\]', 1), '')"
KEY = "coalesce(nullif(trim(event_id), ''), '__row__:' || e0.company || '|' || date_announced || '|' || coalesce(nullif(source_link, ''), CAST(row_idx AS STRING)))"
EVENT = "coalesce(nullif(trim(event_id), ''), 'row-' || CAST(row_idx + 1 AS STRING))"


def with_entries(rest: str, *ctes: str, company: str = "company", where: str = "true", aliases: bool = False) -> str:
    known = f" LEFT JOIN hs x ON x.alias = lower({sql_fold('company')}) LEFT JOIN hs y ON y.alias = lower({sql_bare('company')})"
    key = f"coalesce(lower(x.canonical), lower(y.canonical), {sql_key('company')})" if aliases else sql_key("company")
    keys = f"hs AS ({HOUSES.format(customer='customer')}), n AS (SELECT DISTINCT company FROM e0), nk AS (SELECT company, {key} AS k FROM n{known * aliases})"
    e = f"ev AS ({oracle_entry()}), e0 AS (SELECT * EXCLUDE (company), {company} AS company FROM ev), {keys}, every AS (SELECT e0.*, nk.k, {KEY} AS event, {QUALITY} AS quality, {sql_url('source_link')} AS url, {GN} AS gn, CAST(date_announced AS DATE) AS d, {EVENT} AS ev FROM e0 JOIN nk ON e0.company = nk.company), e AS (SELECT * FROM every WHERE {where})"
    return "WITH RECURSIVE " + ", ".join([e, *ctes]) + " " + rest


ROLL = """r AS (SELECT event, bool_or(status IN ('confirmed', 'reference')) AS confirmed, max(jobs_cut_sg) AS jobs_sg, max(jobs_cut_global) AS jobs_global, min(date_announced) AS first_date,
 max(coalesce(nullif(date_reported, ''), date_announced)) AS last_reported, arg_min(company, row(date_announced, row_idx)) AS company, arg_min(industry, row(date_announced, row_idx)) AS industry, count(*) AS n_rows FROM e GROUP BY event)"""
MONTHS = """m AS (SELECT substring(first_date, 1, 7) AS month, sum(CASE WHEN confirmed THEN coalesce(jobs_sg, 0) ELSE 0 END) AS jobs, CAST(count_if(confirmed) AS BIGINT) AS n_confirmed, CAST(count_if(NOT confirmed) AS BIGINT) AS n_rumored FROM r GROUP BY 1)"""
CHECK = """p AS (SELECT *, row_idx % 4 AS part, k || '||' || date_announced AS dk, k || '|' || substring(date_announced, 1, 7) AS mk FROM e),
c AS (SELECT *, url <> '' AND url IN (SELECT url FROM p WHERE part > 0) AS by_url, gn IS NOT NULL AND gn IN (SELECT gn FROM p WHERE part IN (2, 3) AND gn IS NOT NULL) AS by_gn, mk IN (SELECT mk FROM p WHERE part IN (1, 2)) AS by_month FROM p WHERE part = 0),
v AS (SELECT *, CASE WHEN by_url OR by_gn THEN 'duplicate' WHEN by_month THEN 'potential-duplicate' ELSE 'new' END AS verdict FROM c)"""
PAIRS = """p AS (SELECT a.row_idx AS row_a, b.row_idx AS row_b, a.ev AS event_a, b.ev AS event_b, a.status AS sa, b.status AS sb, a.d AS d_a, CAST(b.d - a.d AS INT) AS gap FROM e a JOIN e b ON a.k = b.k AND a.ev <> b.ev AND row(b.d, b.row_idx) > row(a.d, a.row_idx) AND b.d - a.d <= 31),
t AS (SELECT 'duplicate' AS type, * FROM p WHERE gap = 0 UNION ALL SELECT 'double-count', * FROM p WHERE sa = 'confirmed' AND sb = 'confirmed' AND gap BETWEEN 1 AND 31 UNION ALL SELECT 'superseded-rumor', * FROM p WHERE sa = 'rumored' AND sb = 'confirmed' AND gap <= 30)"""
ADVICE = f"""(SELECT row_idx + 1 AS row, 'future-date' AS type FROM e WHERE date_announced > '{TODAY}' UNION ALL SELECT row_idx + 1, 'contradictory-verdict' FROM e WHERE status = 'confirmed' AND (contains(notes, 'expected to') OR contains(notes, 'potential duplicate'))
 UNION ALL SELECT row_idx + 1, 'global-figure' FROM e WHERE status = 'confirmed' AND jobs_cut_sg * SCALE >= 1000 AND contains(notes, 'global') UNION ALL SELECT row_idx + 1, 'vague-company' FROM e WHERE status = 'confirmed' AND contains(company, 'Unnamed') UNION ALL SELECT row_idx + 1, 'unarchived-confirmed' FROM e WHERE status = 'confirmed' AND NOT (contains(source_link, 'web.archive.org') OR contains(source_link, 'reuters.com')))"""
CROSS = f"""tk AS (SELECT DISTINCT row_idx, t FROM (SELECT row_idx, unnest(regexp_split_to_array(lower(company), '[^a-z]+')) AS t FROM e) WHERE length(t) >= 4 AND t NOT IN ({", ".join(f"'{w}'" for w in V.STOPWORDS)})),
rt AS (SELECT * FROM tk QUALIFY count(*) OVER (PARTITION BY t) BETWEEN 2 AND 5), q AS (SELECT e.*, t FROM e JOIN rt USING (row_idx) WHERE status <> 'reference'),
cn AS (SELECT a.row_idx AS row_a, b.row_idx AS row_b, a.ev AS event_a, b.ev AS event_b, any_value(a.d) AS d_a, any_value(abs(CAST(a.d - b.d AS INT))) AS gap, array_to_string(list_sort(list(DISTINCT a.t)), ',') AS tokens
 FROM q a JOIN q b ON a.t = b.t AND a.industry = b.industry AND a.row_idx < b.row_idx AND a.k <> b.k AND a.ev <> b.ev AND abs(CAST(a.d - b.d AS INT)) <= 21 GROUP BY ALL)"""
AUDIT = f"""dp AS ({DISTINCT.format(e="e")}), al AS ({ALLOWED.format(customer="customer")}), rj AS (SELECT * FROM every WHERE row_idx % 4 = 3 AND NOT contains(lower(notes), 'duplicate')),
f AS (SELECT type, row_a, row_b, event_a, event_b, d_a, gap FROM t UNION ALL SELECT 'possible-same-event', row_a, row_b, event_a, event_b, d_a, gap FROM cn WHERE gap > 0),
g AS (SELECT type, least(event_a, event_b) || ' + ' || greatest(event_a, event_b) AS identity, list_sort(list_distinct(flatten(list([row_a + 1, row_b + 1])))) AS rows, arg_min(event_a, row(d_a, row_a, row_b)) AS one, arg_min(event_b, row(d_a, row_a, row_b)) AS two FROM f GROUP BY 1, 2),
since AS (SELECT ev, min(date_announced) AS s FROM e GROUP BY ev), ks AS (SELECT k AS a, lead(k) OVER (ORDER BY k) AS b FROM (SELECT DISTINCT k FROM e)), sp AS (SELECT a, b FROM ks WHERE length(a) >= 4 AND starts_with(b, a || ' ') AND NOT EXISTS (SELECT 1 FROM al WHERE al.a = ks.a AND al.b = ks.b)),
adv AS (SELECT row_idx, type FROM {ADVICE.replace("SCALE", "10").replace("row_idx + 1 AS row", "row_idx").replace("row_idx + 1", "row_idx")}),
w AS (SELECT type, CASE WHEN type <> 'superseded-rumor' AND s1.s > s2.s THEN two || '|' || one ELSE one || '|' || two END AS event_ids, array_to_string(rows, ',') AS rows, identity FROM g JOIN since s1 ON s1.ev = one JOIN since s2 ON s2.ev = two WHERE NOT EXISTS (SELECT 1 FROM dp WHERE pair = identity)
 UNION ALL SELECT 'same-day-same-event', event_a || '|' || event_b, CAST(row_a + 1 AS STRING) || ',' || CAST(row_b + 1 AS STRING), least(event_a, event_b) || ' + ' || greatest(event_a, event_b) FROM cn WHERE gap = 0
 UNION ALL SELECT 'name-split', array_to_string(list_sort(list(DISTINCT ev)), '|'), array_to_string(list_sort(list(row_idx + 1)), ','), a || ' + ' || b FROM sp JOIN e ON e.k IN (a, b) GROUP BY a, b
 UNION ALL SELECT 'duplicate-source', array_to_string(list_sort(list(DISTINCT ev)), '|'), array_to_string(list_sort(list(row_idx + 1)), ','), url FROM e WHERE url <> '' GROUP BY url HAVING count(*) > 1
 UNION ALL SELECT type, ev, CAST(row_idx + 1 AS STRING), coalesce(nullif(url, ''), k || '@' || date_announced) FROM adv JOIN e USING (row_idx)
 UNION ALL SELECT 'cross-file-contradiction', ev, CAST(row_idx + 1 AS STRING), coalesce(nullif(url, ''), k || '@' || date_announced) FROM e WHERE (url <> '' AND url IN (SELECT url FROM rj)) OR gn IN (SELECT gn FROM rj WHERE gn IS NOT NULL))"""
#: The same findings with their texts.
ROWS_TEXT = "CASE WHEN len(rows) <= 3 THEN 'rows ' || array_to_string(rows, ', ') ELSE 'rows ' || rows[1] || ' + ' || (len(rows) - 1) || ' others' END"
NAMES_TEXT = """CASE WHEN len(names) <= 3 THEN '"' || array_to_string(names, '" / "') || '"' ELSE '"' || array_to_string(names[:3], '" / "') || '" + ' || (len(names) - 3) || ' more names' END"""
MESSAGES = f"""mf AS (SELECT f.*, ea.company AS ca, eb.company AS cb, cn.tokens AS tk FROM f JOIN e ea ON ea.row_idx = f.row_a JOIN e eb ON eb.row_idx = f.row_b LEFT JOIN cn ON f.type = 'possible-same-event' AND cn.row_a = f.row_a AND cn.row_b = f.row_b),
mg AS (SELECT type, least(event_a, event_b) || ' + ' || greatest(event_a, event_b) AS identity, list_sort(list_distinct(flatten(list([row_a + 1, row_b + 1])))) AS rows, list_sort(list_distinct(flatten(list([ca, cb])))) AS names, min(gap) AS gap,
 array_to_string(list_sort(list_distinct(flatten(list(string_split(coalesce(tk, ''), ','))))), ', ') AS toks, arg_min(event_a, row(d_a, row_a, row_b)) AS one, arg_min(event_b, row(d_a, row_a, row_b)) AS two FROM mf GROUP BY 1, 2),
mh AS (SELECT mg.*, one || ' (from ' || s1.s || ')' AS o, two || ' (from ' || s2.s || ')' AS t, type <> 'superseded-rumor' AND s1.s > s2.s AS turn FROM mg JOIN since s1 ON s1.ev = one JOIN since s2 ON s2.ev = two WHERE NOT EXISTS (SELECT 1 FROM dp WHERE pair = identity)),
mi AS (SELECT *, CASE WHEN turn THEN t ELSE o END AS fst, CASE WHEN turn THEN o ELSE t END AS snd, {NAMES_TEXT} AS nt, {ROWS_TEXT} AS rt FROM mh),
ru AS (SELECT url, min(row_idx) AS i FROM rj WHERE url <> '' GROUP BY url), rg AS (SELECT gn, min(row_idx) AS i FROM rj WHERE gn IS NOT NULL GROUP BY gn),
md AS (SELECT list_sort(list(row_idx + 1)) AS rows, url FROM e WHERE url <> '' GROUP BY url HAVING count(*) > 1),
msg AS (SELECT type, array_to_string(rows, ',') AS rows, CASE type WHEN 'duplicate' THEN 'Duplicate: ' || nt || ' on the same date under two event_ids — ' || fst || ' vs ' || snd || '; ' || rt
  WHEN 'double-count' THEN 'Possible double-count: ' || nt || ' confirmed under two event_ids — ' || fst || ' vs ' || snd || ', closest rows ' || gap || 'd apart; ' || rt
  WHEN 'superseded-rumor' THEN 'Superseded rumor: ' || nt || ' rumored ' || fst || ' precedes confirmed ' || snd || ' by ' || gap || 'd; ' || rt
  ELSE 'Possible same event under different names: ' || nt || ' share distinctive token(s) [' || toks || '] — ' || fst || ' vs ' || snd || ', ' || gap || 'd apart; ' || rt END AS message FROM mi
 UNION ALL SELECT 'same-day-same-event', CAST(row_a + 1 AS STRING) || ',' || CAST(row_b + 1 AS STRING), 'Same-day, same-industry entries share distinctive company token(s) [' || replace(tokens, ',', ', ') || ']: "' || ea.company || '" and "' || eb.company || '" both on ' || ea.date_announced || ' — if this is one event, give both rows the same event_id; if they are genuinely different companies, add an alias/exclusion so this token stops matching'
  FROM cn JOIN e ea ON ea.row_idx = row_a JOIN e eb ON eb.row_idx = row_b WHERE gap = 0
 UNION ALL SELECT 'name-split', array_to_string(list_sort(list(row_idx + 1)), ','), 'Company keys "' || a || '" and "' || b || '" look like one company under two names — add an alias to the aliases, or an entry with a reason to the allowed neighbours if they are distinct' FROM sp JOIN e ON e.k IN (a, b) GROUP BY a, b
 UNION ALL SELECT 'duplicate-source', array_to_string(rows, ','), 'Same article cited by ' || len(rows) || ' rows (' || {ROWS_TEXT} || '): ' || url FROM md
 UNION ALL SELECT type, CAST(row_idx + 1 AS STRING), CASE type WHEN 'future-date' THEN 'Future date: "' || company || '" dated ' || date_announced || ' (after {TODAY})'
  WHEN 'vague-company' THEN 'Vague company for confirmed entry: "' || company || '" — name a specific company or downgrade'
  WHEN 'contradictory-verdict' THEN 'Confirmed but notes hedge: "' || company || '" (' || date_announced || ') — "' || substring(notes, 1, 90) || '"'
  WHEN 'global-figure' THEN 'Global figure in jobs_cut_sg: "' || company || '" jobs_cut_sg=' || CAST(jobs_cut_sg * 10 AS BIGINT) || ' reads as worldwide — move to jobs_cut_global'
  ELSE 'Unrecognised source for confirmed entry: "' || company || '" (' || date_announced || ') — ' || source_link END FROM adv JOIN e USING (row_idx)
 UNION ALL SELECT 'cross-file-contradiction', CAST(row_idx + 1 AS STRING), '"' || company || '" (' || date_announced || ', ' || status || ') shares its ' || CASE WHEN ru.i IS NOT NULL THEN 'source URL' ELSE 'gn-fingerprint' END || ' with rejected row ' || (coalesce(ru.i, rg.i) + 1) || ' — same event kept and rejected'
  FROM e LEFT JOIN ru ON e.url = ru.url LEFT JOIN rg ON e.gn = rg.gn WHERE coalesce(ru.i, rg.i) IS NOT NULL)"""
RULE = lambda i: "CASE " + " ".join("WHEN regexp_matches(mt, '{}', 'i') THEN {}".format(r[0].replace("'", "''"), "NULL" if r[i] is None else "'" + r[i].replace("'", "''") + "'") for r in EVENT_RULES) + " END"
NAMED = "translate(regexp_replace(company, 'Customer#0*', 'Co'), '0123456789', 'qwertyuiop')"
GENERIC = ", ".join(f"'{w}'" for w in X.GENERIC)
TOKENS = f"""sl AS (SELECT trim(regexp_replace(regexp_replace(k, '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS s, min(row_idx) AS ord FROM e GROUP BY 1), fs AS (SELECT *, split_part(s, ' ', 1) AS w FROM sl),
vt AS (SELECT * FROM (SELECT replace(s, ' ', '-') AS key, ord, unnest(list_distinct([s, replace(s, ' ', ''), replace(s, ' ', '-')] || CASE WHEN length(w) >= 5 AND w NOT IN ({GENERIC}) THEN [w] ELSE [] END)) AS variant FROM fs) WHERE key NOT IN ({GENERIC}) AND variant NOT IN ({GENERIC}) AND variant <> '')"""
MATCH = f"h AS (SELECT * EXCLUDE (company), {HEADLINE} AS company FROM e), m AS (SELECT *, company || ' ' || regexp_replace(regexp_replace(regexp_replace(source_link, '^https?://[^/]+', ''), '[?#].*$', ''), '[-_/.]', ' ', 'g') AS mt FROM h), v AS (SELECT *, {RULE(1)} AS rc, {RULE(2)} AS ri, {RULE(3)} AS rv, {RULE(4)} AS rn FROM m), z AS (SELECT *, coalesce(rv, CASE WHEN contains(lower(mt), 'opinion:') THEN 'rejected' ELSE 'queue' END) AS verdict FROM v)"
TITLE = r"array_to_string(string_split(trim(regexp_replace(regexp_replace(lower(regexp_replace(coalesce(text, ''), ' [-–] [^-–\n]+$', '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')[1:6], ' ')"

HINTS = ("SELECT c.row_idx, nullif(pr.ev0, '') AS primary_event_id, coalesce(l.listed, '') AS listed FROM c LEFT JOIN pr ON pr.cl = c.cl LEFT JOIN l USING (row_idx)",
        "c AS (SELECT row_idx, k, industry || date_announced AS cl FROM e WHERE row_idx % 4 = 0), a AS (SELECT row_idx, k, event_id, industry || date_announced AS cl FROM e WHERE row_idx % 4 <> 0), pr AS (SELECT cl, arg_min(event_id, row_idx) AS ev0 FROM a GROUP BY cl)",
        "o AS (SELECT c.row_idx, i.event_id, 0 AS src, i.spot FROM c JOIN (SELECT k, event_id, min(row_idx) AS spot FROM a WHERE event_id <> '' GROUP BY ALL) i ON c.k = i.k UNION ALL SELECT c.row_idx, i.event_id, 1, i.spot FROM c JOIN (SELECT cl, event_id, min(row_idx) AS spot FROM a WHERE event_id <> '' GROUP BY ALL) i ON c.cl = i.cl)",
        "o2 AS (SELECT o.row_idx, event_id, min(row(src, spot)) AS t FROM o JOIN c ON o.row_idx = c.row_idx LEFT JOIN pr ON pr.cl = c.cl WHERE event_id IS DISTINCT FROM pr.ev0 GROUP BY ALL)", "o3 AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY t, event_id) AS r FROM o2)", "l AS (SELECT row_idx, string_agg(event_id, '|' ORDER BY r) AS listed FROM o3 WHERE r <= 12 GROUP BY row_idx)")
NODES = ("ti AS (SELECT DISTINCT company, ' ' || trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM e)", "mt AS (SELECT company, key, min(row(strpos(t, ' ' || variant || ' '), ord)) AS spot FROM ti JOIN vt ON contains(t, ' ' || variant || ' ') GROUP BY ALL)",
        "pk AS (SELECT company, CASE WHEN count(*) >= 3 THEN '__aggregator__' ELSE arg_min(key, spot) END AS key FROM mt GROUP BY company)")
#: Each company's rows in file order, with the groups that are open so far.
WINDOWS = (
    "o AS (SELECT row_idx, k, d, row_number() OVER (PARTITION BY k ORDER BY row_idx) AS n FROM e)",
    """w(k, n, row_idx, grp, open) AS (
  SELECT k, n, row_idx, row_idx, [{'g': row_idx, 'd': d}] FROM o WHERE n = 1
  UNION ALL
  SELECT k, n, row_idx, coalesce(hit, row_idx), CASE WHEN hit IS NULL THEN list_append(open, {'g': row_idx, 'd': d}) ELSE list_transform(open, lambda x: CASE WHEN x.g = hit THEN {'g': x.g, 'd': greatest(x.d, d)} ELSE x END) END
  FROM (SELECT o.*, open, list_filter(open, lambda x: abs(x.d - o.d) <= 7)[1].g AS hit FROM w JOIN o ON o.k = w.k AND o.n = w.n + 1))""",
)
#: The smallest row that each row reaches over edges eg (a, b).
COMPONENTS = (
    "bi AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg)",
    """cc(id, comp) USING KEY (id) AS (SELECT row_idx, row_idx FROM e
  UNION SELECT bi.a, min(v.comp) FROM cc v JOIN bi ON bi.b = v.id JOIN recurring.cc u ON u.id = bi.a WHERE v.comp < u.comp GROUP BY bi.a)""",
)
#: The findings of the ledger as it is and as it was.
CHANGED = "WITH " + ", ".join(
    f"{name} AS MATERIALIZED ({with_entries('SELECT type, identity, event_ids, rows FROM w', PAIRS, CROSS, AUDIT.replace('FROM every', f'FROM every WHERE {when} AND true').replace('AND true WHERE', 'AND'), company=BRAND, where=f'row_idx % 4 <> 3 AND {when}')})"
    for name, when in (("now", NOW), ("past", PAST))
)

ORACLES: dict[str, str] = {
    "event_rollup": with_entries("SELECT * FROM r", ROLL),
    "headline": with_entries("SELECT coalesce(sum(CASE WHEN confirmed THEN coalesce(jobs_sg, 0) END), 0) AS total_jobs, CAST(count_if(confirmed AND jobs_sg IS NULL) AS BIGINT) AS undisclosed, CAST(count_if(confirmed) AS BIGINT) AS confirmed_events, CAST(count_if(NOT confirmed) AS BIGINT) AS rumored_events, count(DISTINCT nullif(lower(company), '')) AS companies, max(last_reported) AS latest FROM r", ROLL),
    "monthly": with_entries("SELECT * FROM m", ROLL, MONTHS),
    "industry": with_entries("SELECT coalesce(nullif(industry, ''), 'Other') AS industry, sum(coalesce(jobs_sg, 0)) AS jobs, count(*) AS n_events FROM r WHERE confirmed GROUP BY 1", ROLL),
    "quarterly_benchmark": with_entries("SELECT o.quarter, o.official, coalesce(t.tracked, 0) AS tracked, CASE WHEN o.official > 0 THEN round(coalesce(t.tracked, 0) / o.official * 100, 6) ELSE 0 END AS pct FROM o LEFT JOIN t ON o.quarter = t.quarter", ROLL, MONTHS,
        "t AS (SELECT substring(month, 1, 4) || '-Q' || CAST(CAST(ceil(CAST(substring(month, 6, 2) AS INT) / 3) AS INT) AS STRING) AS quarter, sum(jobs) AS tracked FROM m GROUP BY 1)", "o AS (SELECT CAST(year(l_shipdate) AS STRING) || '-Q' || CAST(quarter(l_shipdate) AS STRING) AS quarter, sum(l_quantity) AS official FROM lineitem GROUP BY 1)"),
    "row_quality": with_entries("SELECT row_idx, quality FROM e"),
    "canonical_row": with_entries("SELECT event, row_idx, quality FROM e QUALIFY row_number() OVER (PARTITION BY event ORDER BY quality DESC, row_idx) = 1"),
    "grouped_events": with_entries("SELECT event, row_idx, company, date_announced, CASE WHEN any_c AND status NOT IN ('confirmed', 'reference') THEN 'confirmed' ELSE status END AS status, jobs_cut_sg, jobs_cut_global, CAST(n - 1 AS INT) AS n_follow_ups FROM g",
        "g AS (SELECT event, row_idx, company, date_announced, status, bool_or(status IN ('confirmed', 'reference')) OVER w AS any_c, max(jobs_cut_sg) OVER w AS jobs_cut_sg, max(jobs_cut_global) OVER w AS jobs_cut_global, count(*) OVER w AS n FROM e WINDOW w AS (PARTITION BY event) QUALIFY row_number() OVER (PARTITION BY event ORDER BY date_announced, quality DESC, row_idx) = 1)"),
    "filters": with_entries("SELECT row_idx, company, date_announced, notes FROM e WHERE (contains(lower(company), 'global') OR contains(lower(industry), 'global') OR contains(lower(notes), 'global')) AND status = 'confirmed' AND date_announced >= '1996-12-01'"),
    "stale": with_entries(f"SELECT row_idx, CAST(DATE '{TODAY}' - d AS INT) AS age FROM e WHERE status = 'rumored' AND DATE '{TODAY}' - d >= 30"),
    "topk": with_entries("SELECT row_idx, date_announced, event_id FROM e ORDER BY date_announced DESC, row_idx LIMIT 50 OFFSET 20"),
    "url_keys": with_entries("SELECT row_idx, url AS url_key FROM e"),
    "rejected_dedup": with_entries("SELECT row_idx, source_link FROM e QUALIFY url = '' OR row_number() OVER (PARTITION BY url ORDER BY row_idx) = 1"),
    "title_fingerprint": f"SELECT doc_id, {TITLE} AS fingerprint FROM documents",
    "hit_dedup": f"WITH h AS (SELECT doc_id AS row_idx, 'u' || CAST(CAST(floor(doc_id / 2) AS BIGINT) AS STRING) AS url, {TITLE} AS f FROM documents), a AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY url ORDER BY row_idx) = 1) SELECT row_idx, url FROM a QUALIFY f = '' OR row_number() OVER (PARTITION BY f ORDER BY row_idx) = 1",
    "company_key": with_entries(r"SELECT row_idx, k, regexp_replace(regexp_replace(k, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substring(date_announced, 1, 7) AS slug, nullif(regexp_extract(event_id, '^(.+?-\d{4}-(?:0[1-9]|1[0-2]))(?:-([a-z][a-z0-9-]*))?$', 1), '') AS base FROM e"),
    "dedup_index": with_entries("SELECT row_idx, by_url, by_gn, by_month, verdict FROM v", CHECK),
    "ingest": with_entries("SELECT count(*) AS added, (SELECT count(*) FROM v) - count(*) + 2 AS duplicates, CAST(count_if(verdict = 'potential-duplicate') AS BIGINT) AS potential FROM f", CHECK, "f AS (SELECT * FROM v WHERE verdict <> 'duplicate' QUALIFY row_number() OVER (PARTITION BY dk ORDER BY row_idx) = 1)"),
    "islands_21": with_entries("SELECT row_idx, k, CAST(sum(n) OVER (PARTITION BY k ORDER BY d, row_idx) AS BIGINT) AS island FROM i", "i AS (SELECT row_idx, k, d, CASE WHEN d - lag(d) OVER (PARTITION BY k ORDER BY d, row_idx) <= 21 THEN 0 ELSE 1 END AS n FROM e)"),
    "same_company_pairs": with_entries("SELECT type, row_a, row_b, event_a, event_b, gap FROM t", PAIRS),
    "pair_groups": with_entries("SELECT type, least(event_a, event_b) || ' + ' || greatest(event_a, event_b) AS pair, array_to_string(list_sort(list_distinct(flatten(list([row_a + 1, row_b + 1])))), ',') AS rows, min(gap) AS gap FROM t GROUP BY 1, 2", PAIRS),
    "cross_name": with_entries("SELECT row_a, row_b, gap, tokens, CASE WHEN gap = 0 THEN 'same-day-same-event' ELSE 'possible-same-event' END AS type FROM cn", CROSS, company=BRAND),
    "name_split": "WITH k AS (SELECT DISTINCT k FROM (SELECT lower(p_name) AS k FROM part UNION ALL SELECT string_split(lower(p_name), ' ')[1] FROM part)), n AS (SELECT k AS a, lead(k) OVER (ORDER BY k) AS b FROM k) SELECT a, b FROM n WHERE length(a) >= 4 AND starts_with(b, a || ' ')",
    "validate_rows": with_entries("SELECT row_idx + 1 AS row, 'pct_workforce' AS field FROM e WHERE pct_workforce > 100 UNION ALL SELECT row_idx + 1, 'industry' FROM e WHERE industry NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE') UNION ALL SELECT row_idx + 1, 'source_link' FROM e WHERE source_link = '' UNION ALL SELECT row_idx + 1, 'event_id' FROM e WHERE event_id = ''"),
    "advisories": with_entries(f"SELECT * FROM {ADVICE.replace('SCALE', '10')}"),
    "duplicate_sources": with_entries("SELECT url, count(*) AS n_rows, array_to_string(list_sort(list(row_idx + 1)), ',') AS rows FROM e WHERE url <> '' GROUP BY url HAVING count(*) > 1"),
    "cross_file": with_entries("SELECT a.row_idx + 1 AS row, coalesce(u.i, g.i) + 1 AS rejected_row FROM e a LEFT JOIN (SELECT url, min(row_idx) AS i FROM r WHERE url <> '' GROUP BY url) u ON a.url = u.url LEFT JOIN (SELECT gn, min(row_idx) AS i FROM r WHERE gn IS NOT NULL GROUP BY gn) g ON a.gn = g.gn WHERE a.row_idx % 4 < 2 AND coalesce(u.i, g.i) IS NOT NULL", "r AS (SELECT * FROM e WHERE row_idx % 4 >= 2 AND NOT contains(notes, 'duplicate'))"),
    "merge_chain": f"WITH RECURSIVE m AS ({MERGES.format(customer='customer')}), w AS (SELECT from_event_id, to_event_id AS target, 1 AS depth FROM m UNION ALL SELECT w.from_event_id, m.to_event_id, w.depth + 1 FROM w JOIN m ON w.target = m.from_event_id) SELECT from_event_id, target, depth FROM w QUALIFY row_number() OVER (PARTITION BY from_event_id ORDER BY depth DESC) = 1",
    "patch_kth": with_entries("SELECT a.row_idx, b.row_idx AS result_idx FROM x a LEFT JOIN y b ON a.k = b.k AND a.m = b.m AND a.n = b.n", "x AS (SELECT row_idx, k, substring(date_announced, 1, 4) AS m, row_number() OVER (PARTITION BY k, substring(date_announced, 1, 4) ORDER BY row_idx) AS n FROM e WHERE row_idx % 3 <> 0)", "y AS (SELECT row_idx, k, substring(date_announced, 1, 4) AS m, row_number() OVER (PARTITION BY k, substring(date_announced, 1, 4) ORDER BY row_idx) AS n FROM e WHERE row_idx % 3 = 0)"),
    "new_warnings": with_entries("SELECT fingerprint, row FROM f WHERE row % 2 = 0 AND fingerprint NOT IN (SELECT fingerprint FROM f WHERE row % 2 = 1)", f"f AS (SELECT type || ' :: ' || CAST(CAST(floor(row / 3) AS BIGINT) AS STRING) AS fingerprint, row FROM {ADVICE.replace('SCALE', '1')})"),
    "extract_figures": with_entries("SELECT row_idx, CASE row_idx % 4 WHEN 0 THEN row_idx % 3000 WHEN 1 THEN 1100 + row_idx % 800 END AS jobs, CASE row_idx % 4 WHEN 2 THEN CAST(row_idx % 100 AS DOUBLE) + 0.5 END AS pct FROM e"),
    "classify": r"SELECT doc_id AS row_idx, CASE WHEN regexp_matches(text, '(the|and) .{0,40} of ') THEN 'confirmed' WHEN contains(text, ' que ') THEN 'rumored' WHEN contains(text, ' und ') THEN 'confirmed' WHEN contains(text, 'license') OR contains(text, 'rights reserved') OR contains(text, 'est ') THEN 'rejected' ELSE 'queue' END AS verdict FROM documents",
    "resolve_clusters": with_entries("SELECT row_idx, CASE WHEN row_idx % 50 = 0 OR row_idx % 13 = 0 OR n = 1 OR (NOT anchored AND rk = 1) THEN status ELSE 'rejected' END AS final_verdict FROM c", "c AS (SELECT row_idx, status, count(*) OVER w AS n, bool_or(row_idx % 50 = 0) OVER w AS anchored, row_number() OVER (PARTITION BY industry, substring(date_announced, 1, 7) ORDER BY quality DESC, date_announced, row_idx) AS rk FROM e WINDOW w AS (PARTITION BY industry, substring(date_announced, 1, 7)))"),
    "json_verdict": "SELECT event_id, CASE WHEN event_id % 10 < 8 THEN CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rumored' END END AS verdict, CASE WHEN event_id % 10 < 8 AND event_id % 2 = 1 THEN CAST(event_id % 77 AS DOUBLE) END AS jobs FROM events",
    "eval_metrics": "WITH r AS (SELECT lang, quality, CASE WHEN regexp_matches(text, '[#$%&|]|!!') THEN 0 ELSE 1 END AS g FROM labels JOIN documents USING (doc_id)), c AS (SELECT lang, CAST(count_if(quality = 1 AND g = 1) AS BIGINT) AS tp, CAST(count_if(quality = 0 AND g = 1) AS BIGINT) AS fp, CAST(count_if(quality = 1 AND g = 0) AS BIGINT) AS fn, CAST(count_if(quality = 0 AND g = 0) AS BIGINT) AS tn FROM r GROUP BY lang), p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c) SELECT lang, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 9) AS f1, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy FROM p",
    "filters_year": with_entries("SELECT row_idx, company, date_announced FROM e WHERE industry = 'BUILDING' AND starts_with(date_announced, '1995-')"),
    "facets": with_entries("SELECT year(d)::INT AS year, count(*) AS n_rows, max(date_announced) AS latest FROM e GROUP BY 1"),
    "follow_ups": with_entries("SELECT count(*) AS events, sum(n - 1)::BIGINT AS follow_ups FROM (SELECT count(*) AS n FROM e GROUP BY event) WHERE n > 1"),
    "event_stats": with_entries("SELECT count(*) AS rows, count(DISTINCT ev) AS events, count(DISTINCT CASE WHEN status = 'confirmed' THEN ev END) AS confirmed_events FROM e"),
    "ingest_rows": with_entries("SELECT row_idx, verdict FROM v WHERE verdict <> 'duplicate' QUALIFY row_number() OVER (PARTITION BY dk ORDER BY row_idx) = 1", CHECK),
    "node_keys": with_entries("SELECT row_idx, coalesce(key, k) AS key FROM e LEFT JOIN pk USING (company)", TOKENS, *NODES, company=NAMED),
    "company_tokens": with_entries("SELECT key, variant FROM vt", TOKENS, company=NAMED),
    "check_integrity": with_entries("SELECT *, type = 'same-day-same-event' AS hard FROM w", PAIRS, CROSS, AUDIT, company=BRAND, where="row_idx % 4 <> 3"),
    "dedup_dates": with_entries("SELECT row_idx, by_date, CASE WHEN by_url OR by_gn OR by_date THEN 'duplicate' WHEN by_month THEN 'potential-duplicate' ELSE 'new' END AS verdict FROM (SELECT *, row_idx % 3 = 0 AND dk IN (SELECT dk FROM p WHERE part > 0) AS by_date FROM c) AS x", CHECK.replace("AS mk FROM e)", "AS mk FROM (SELECT * REPLACE (CASE WHEN row_idx % 3 = 0 THEN 'wrapped' || row_idx ELSE url END AS url) FROM e) AS y)")),
    "validate_fields": with_entries("SELECT row_idx + 1 AS row, field FROM (SELECT row_idx, ['company', 'date_announced', 'date_reported', 'jobs_cut_sg', 'jobs_cut_global', 'pct_workforce', 'industry', 'status', 'source_link', 'event_id'][row_idx % 11 + 1] AS field FROM e) AS x WHERE field IS NOT NULL UNION ALL SELECT row_idx + 1, 'pct_workforce' FROM e WHERE pct_workforce > 100 AND row_idx % 11 <> 5 UNION ALL SELECT row_idx + 1, 'source_link' FROM e WHERE source_link = '' AND row_idx % 11 <> 8 UNION ALL SELECT row_idx + 1, 'event_id' FROM e WHERE event_id = '' AND row_idx % 11 <> 9"),
    "tallies": with_entries("SELECT status, count(*) AS n FROM e GROUP BY status"),
    "finding_examples": with_entries(f"SELECT type, count(*) AS n, max(r) AS last FROM (SELECT type, r, row_number() OVER (PARTITION BY type ORDER BY r, identity) AS k FROM (SELECT type, identity, CAST(split_part(rows, ',', 1) AS BIGINT) AS r FROM w) AS x) AS y WHERE k <= 5 OR type NOT IN ({', '.join(repr(t) for t in A.PER_ROW)}) GROUP BY type", PAIRS, CROSS, AUDIT, company=BRAND, where="row_idx % 4 <> 3"),
    "finding_messages": with_entries("SELECT * FROM msg", PAIRS, CROSS, AUDIT, MESSAGES, company=BRAND, where="row_idx % 4 <> 3"),
    "integrity_summary": with_entries("SELECT type, count(*) AS n FROM w GROUP BY type", PAIRS, CROSS, AUDIT, company=BRAND, where="row_idx % 4 <> 3"),
    "regression": f"{CHANGED} SELECT 'new' AS side, * FROM now ANTI JOIN past USING (type, identity) UNION ALL SELECT 'resolved', * FROM past ANTI JOIN now USING (type, identity)",
    "regression_counts": f"{CHANGED} SELECT (SELECT count(*) FROM past) AS \"then\", (SELECT count(*) FROM now) AS now, (SELECT count(*) FROM now ANTI JOIN past USING (type, identity)) AS new, (SELECT count(*) FROM past ANTI JOIN now USING (type, identity)) AS resolved",
    "alias_keys": with_entries("SELECT row_idx, k FROM e", aliases=True),
    "alias_dedup": with_entries("SELECT row_idx, by_month, verdict FROM v", CHECK, aliases=True),
    "alias_hints": with_entries(*HINTS, aliases=True),
    "window_groups": with_entries("SELECT row_idx, grp AS group_idx FROM w", *WINDOWS),
    "dedup_by_deletion": with_entries("SELECT row_idx, event_id FROM e JOIN w USING (row_idx) QUALIFY row_number() OVER (PARTITION BY grp ORDER BY quality DESC, row_idx) = 1", *WINDOWS),
    "linked": with_entries("SELECT row_idx, event_id, coalesce(nullif(first_value(event_id) OVER (PARTITION BY comp ORDER BY quality DESC, row_idx), ''), event_id) AS new_event_id FROM e JOIN cc ON id = row_idx", *WINDOWS,
        r"mb AS (SELECT row_idx, url, k || '|' || nullif(regexp_extract(event_id, '^(.+?-\d{4}-(?:0[1-9]|1[0-2]))(?:-([a-z][a-z0-9-]*))?$', 1), '') AS month FROM e)",
        "eg AS (SELECT row_idx AS a, grp AS b FROM w UNION SELECT row_idx, min(row_idx) OVER (PARTITION BY url) FROM mb WHERE url <> '' UNION SELECT row_idx, min(row_idx) OVER (PARTITION BY month) FROM mb WHERE month IS NOT NULL)", *COMPONENTS),
    "clusters": with_entries("SELECT row_idx, comp AS cluster FROM e JOIN cc ON id = row_idx", TOKENS, *NODES,
        "ck AS (SELECT row_idx, d, gn, nullif(lower(source_link), '') AS link, coalesce(key, k) AS ckey FROM e LEFT JOIN pk USING (company)), gp AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY ckey ORDER BY d, row_idx) <= 21 THEN 0 ELSE 1 END AS nw FROM ck WHERE ckey <> '__aggregator__'), il AS (SELECT *, sum(nw) OVER (PARTITION BY ckey ORDER BY d, row_idx) AS island FROM gp)",
        "eg AS (SELECT row_idx AS a, min(row_idx) OVER (PARTITION BY ckey, island) AS b FROM il UNION SELECT row_idx, min(row_idx) OVER (PARTITION BY gn) FROM ck WHERE gn IS NOT NULL UNION SELECT row_idx, min(row_idx) OVER (PARTITION BY link) FROM ck WHERE link IS NOT NULL)", *COMPONENTS, company=NAMED),
    "stratified": "WITH r AS (SELECT doc_id, lang, md5(doc_id || ':1234') AS o, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':1234'), doc_id) AS r, (SELECT count(DISTINCT lang) + count(DISTINCT CASE WHEN lang IS NULL THEN 1 END) FROM documents) AS kinds FROM documents) SELECT doc_id, lang FROM r WHERE r <= 40 ORDER BY r <= greatest(1, 40 // greatest(1, kinds)) DESC, o, doc_id LIMIT 40",
    "triage": with_entries("SELECT row_idx, verdict, rc AS rule_company, CASE WHEN rc IS NOT NULL THEN 'event rule' WHEN verdict = 'rejected' THEN 'commentary, statistics or policy' ELSE 'unclassified' END AS reason FROM z", MATCH),
    "to_entry": with_entries("SELECT row_idx, coalesce(rc, company) AS company, coalesce(ri, 'Retail') AS industry, CASE WHEN verdict = 'rejected' AND coalesce(rn, notes) = '' THEN 'commentary, statistics or policy' ELSE coalesce(rn, notes) END AS notes, CASE WHEN verdict IN ('rejected', 'queue') THEN status ELSE verdict END AS status, CASE WHEN event_id <> '' THEN event_id ELSE regexp_replace(regexp_replace(kk, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || substring(date_announced, 1, 7) END AS event_id, date_reported FROM y", MATCH, f"y AS (SELECT *, {sql_key('coalesce(rc, company)')} AS kk FROM z)"),
    "month_guard": with_entries("SELECT row_idx, CASE WHEN hot AND row_number() OVER (PARTITION BY hot, kk, substring(date_announced, 1, 7) ORDER BY row_idx) > 1 THEN 'rejected' ELSE verdict END AS final_verdict FROM y", MATCH, f"y AS (SELECT *, verdict IN ('confirmed', 'rumored') AS hot, {sql_key('coalesce(rc, company)')} AS kk FROM z)"),
    "triage_run": with_entries("SELECT row_idx, CASE WHEN late THEN 'rejected' ELSE v2 END AS final_verdict, CASE WHEN late THEN 'Duplicate (same canonical ' || nm || ', ' || mo || ') already added this run' ELSE r2 END AS reason, CASE WHEN late THEN company ELSE nm END AS company, coalesce(CASE WHEN NOT late THEN ri2 END, 'Other') AS industry, coalesce(CASE WHEN NOT late THEN rn2 END, CASE WHEN late THEN 'Duplicate (same canonical ' || nm || ', ' || mo || ') already added this run' WHEN v2 = 'rejected' THEN r2 ELSE '' END) AS notes, CASE WHEN late OR v2 IN ('rejected', 'queue') THEN status ELSE v2 END AS status, CASE WHEN event_id <> '' THEN event_id ELSE regexp_replace(regexp_replace(CASE WHEN late THEN k1 ELSE kk END, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') || '-' || mo END AS event_id FROM z3", TOKENS,
        f"bt AS (SELECT * REPLACE ({BATCH} AS company) FROM every WHERE row_idx % 4 = 0), bn AS (SELECT DISTINCT company FROM bt), bk AS (SELECT company, {sql_key('company')} AS k1 FROM bn)",
        f"cm AS (SELECT bt.*, k1, company || '  ' || row_idx AS mt FROM bt JOIN bk USING (company)), v AS (SELECT *, {RULE(1)} AS rc, {RULE(2)} AS ri, {RULE(3)} AS rv, {RULE(4)} AS rn FROM cm)",
        "z AS (SELECT *, coalesce(rv, CASE WHEN contains(lower(mt), 'opinion:') THEN 'rejected' ELSE 'queue' END) AS verdict, CASE WHEN rv IS NOT NULL THEN 'event rule' WHEN contains(lower(mt), 'opinion:') THEN 'commentary, statistics or policy' ELSE 'unclassified' END AS reason FROM v)",
        "nd AS (SELECT row_idx, true AS cand, company, k1 AS k, d, date_announced FROM z UNION ALL SELECT row_idx, false, company, k, d, date_announced FROM e), ti AS (SELECT DISTINCT company, ' ' || trim(regexp_replace(lower(company), '[^a-z0-9]+', ' ', 'g')) || ' ' AS t FROM nd)",
        "mx AS (SELECT company, key, min(row(strpos(t, ' ' || variant || ' '), ord)) AS spot FROM ti JOIN vt ON contains(t, ' ' || variant || ' ') GROUP BY ALL), pk AS (SELECT company, CASE WHEN count(*) < 3 THEN arg_min(key, spot) ELSE '__aggregator__' END AS key FROM mx GROUP BY company)",
        "ck AS (SELECT nd.*, coalesce(key, CASE WHEN length(k) >= 3 THEN k END) AS ckey FROM nd LEFT JOIN pk USING (company)), gp AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY ckey ORDER BY d, cand, row_idx) <= 21 THEN 0 ELSE 1 END AS nw FROM ck WHERE ckey <> '__aggregator__'), il AS (SELECT *, sum(nw) OVER (PARTITION BY ckey ORDER BY d, cand, row_idx) AS island FROM gp)",
        "sc AS (SELECT row_idx, (CASE WHEN coalesce(jobs_cut_sg, jobs_cut_global) <> 0 THEN 2 ELSE 0 END + 1) * 10 + CASE WHEN rv IS NOT NULL THEN 1000 ELSE 0 END + 1 AS score FROM z)",
        "cl AS (SELECT ckey, island, arg_min(company || ' (' || date_announced || ')', row_idx) FILTER (NOT cand) AS anchor, arg_min(row_idx, row(-score, d, row_idx)) FILTER (cand) AS best FROM il LEFT JOIN (SELECT row_idx, score, true AS cand FROM sc) s USING (row_idx, cand) GROUP BY ALL)",
        "z1 AS (SELECT z.*, anchor, best, anchor IS NOT NULL AS by_a, anchor IS NULL AND best IS NOT NULL AND best <> z.row_idx AND verdict <> 'rejected' AS by_m FROM z LEFT JOIN il ON il.cand AND il.row_idx = z.row_idx LEFT JOIN cl ON cl.ckey = il.ckey AND cl.island = il.island)",
        f"z2 AS (SELECT *, CASE WHEN by_a OR by_m THEN 'rejected' ELSE verdict END AS v2, CASE WHEN by_a THEN 'Duplicate of existing ' || anchor WHEN by_m THEN 'Intra-batch duplicate of row ' || best ELSE reason END AS r2, CASE WHEN NOT (by_a OR by_m) THEN ri END AS ri2, CASE WHEN NOT (by_a OR by_m) THEN rn END AS rn2, CASE WHEN by_a OR by_m THEN company ELSE coalesce(rc, company) END AS nm, substring(date_announced, 1, 7) AS mo FROM z1), zk AS (SELECT *, {sql_key('nm')} AS kk FROM z2)",
        "z3 AS (SELECT *, v2 IN ('confirmed', 'rumored') AND row_number() OVER (PARTITION BY v2 IN ('confirmed', 'rumored'), kk, mo ORDER BY row_idx) > 1 AS late FROM zk)", company=NAMED, where="row_idx % 4 <> 0"),
    "rejected_kinds": with_entries("SELECT row_idx, coalesce(kind, 'other') AS kind, contains(company, 'Unnamed') OR (status = 'confirmed' AND (contains(notes, 'expected to') OR contains(notes, 'potential duplicate'))) AS polluted FROM z", f"h AS (SELECT * REPLACE ({HEADLINE} AS company, notes || CASE row_idx % 5 WHEN 1 THEN ' hiring now' WHEN 2 THEN ' no Singapore nexus' WHEN 3 THEN ' tracker' ELSE '' END AS notes) FROM e)",
        "z AS (SELECT *, CASE " + " ".join(f"WHEN regexp_matches({' || chr(32) || '.join(c)}, '{p}', 'i') THEN '{n}'" for n, p, c in REJECTED_KINDS) + " END AS kind FROM h)"),
    "event_hints": with_entries(*HINTS),
    "align_events": with_entries("SELECT row_idx, CASE WHEN NOT anchored AND status <> 'reference' AND lead_id IS NOT NULL THEN lead_id ELSE event_id END AS new_event_id FROM b", "a AS (SELECT *, industry || substring(date_announced, 1, 7) AS cl FROM e)", "r AS (SELECT *, bool_or(row_idx % 300 = 0) OVER (PARTITION BY cl) AS anchored, row_number() OVER (PARTITION BY cl ORDER BY quality DESC, date_announced, row_idx) AS rk FROM a)", "b AS (SELECT *, max(CASE WHEN rk = 1 AND status <> 'reference' THEN event_id END) OVER (PARTITION BY cl) AS lead_id FROM r)"),
    "apply_results": with_entries("SELECT a.row_idx, coalesce(b.ns, a.status) AS status, CASE WHEN b.i IS NULL OR b.source_link = '' THEN 'seen' ELSE 'seen | Evidence: ' || b.source_link END AS notes, b.i AS result_idx FROM x1 a LEFT JOIN y1 b ON a.k = b.k AND a.date_announced = b.date_announced AND a.n = b.n",
        "x1 AS (SELECT row_idx, status, k, date_announced, row_number() OVER (PARTITION BY k, date_announced ORDER BY row_idx) AS n FROM e)", "y1 AS (SELECT row_idx AS i, source_link, k, date_announced, CASE row_idx % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'denied' ELSE 'expired' END AS ns, row_number() OVER (PARTITION BY k, date_announced ORDER BY row_idx) AS n FROM e WHERE row_idx % 3 = 0 AND row_idx % 4 <> 3)"),
    "archive_links": with_entries("SELECT row_idx, source_link, 'https://web.archive.org/web/20260101000000/' || source_link AS archived FROM e WHERE source_link <> '' AND NOT contains(source_link, 'web.archive.org') AND status IN ('confirmed', 'reference') ORDER BY row_idx OFFSET 5"),
    "golden_entries": with_entries("SELECT row_idx, CASE WHEN row_idx % 2 = 1 THEN coalesce(jobs_cut_sg, jobs_cut_global) END AS jobs_cut_sg, CASE WHEN row_idx % 2 = 0 THEN coalesce(jobs_cut_sg, jobs_cut_global) END AS jobs_cut_global, 'confirmed' AS status, '' AS event_id FROM e"),
    "result_rows": with_entries("SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN 'confirmed' ELSE 'denied' END AS new_status, source_link AS evidence_url, trim(notes || CASE WHEN row_idx % 2 = 0 AND jobs_cut_sg IS NOT NULL THEN ' (~' || CAST(CAST(jobs_cut_sg AS BIGINT) AS STRING) || ' Singapore jobs)' ELSE '' END) AS evidence_note FROM e WHERE status = 'rumored'"),
    "with_defaults": with_entries("SELECT row_idx, CASE WHEN row_idx % 2 = 0 THEN company ELSE 'Given' END AS company, CASE WHEN row_idx % 3 = 0 THEN date_announced ELSE '2026-01-02' END AS date_announced, date_reported, CASE WHEN row_idx % 5 = 1 THEN 7.0 ELSE jobs_cut_sg END::DOUBLE AS jobs_cut_sg, jobs_cut_global, 0.0::DOUBLE AS pct_workforce FROM e"),
    "hit_to_review": "SELECT doc_id AS row_idx, 'x-t-' || doc_id AS review_id, 'Firm ' || doc_id AS company, CASE doc_id % 3 WHEN 0 THEN '2026-05-05' WHEN 1 THEN '2026-04-03' ELSE '2026-06-01' END AS date_announced, doc_id::DOUBLE AS jobs_cut_sg, 'via [gn:firm ' || doc_id || ' ltd cut ' || doc_id || ' jobs]' AS notes, substring(text, 1, 300) AS snippet FROM documents WHERE text IS NOT NULL",
    "resolved_links": with_entries("SELECT row_idx, CASE WHEN row_idx % 4 < 3 THEN source_link ELSE 'https://news.google.com/rss/articles/CBMiK' || row_idx || '?oc=5' END AS canonical_url, row_idx % 4 < 3 AS resolved FROM e WHERE source_link <> ''"),
    "prompts": with_entries("SELECT row_idx, concat_ws(chr(10), 'Title/Company: ' || company, 'Date: ' || date_announced, 'Source URL: ' || source_link, 'Jobs cut SG (scraped): ' || jobs_cut_sg::BIGINT, 'Jobs cut global (scraped): ' || jobs_cut_global::BIGINT, '% workforce (scraped): ' || pct_workforce::BIGINT, 'Notes/snippet: ' || nullif(notes, ''), "
        "CASE WHEN row_idx % 3 = 0 THEN 'This appears to be follow-up coverage of event ' || event_id || '-a (' || company || ', ' || date_announced || '). Return that exact event_id unless the article clearly describes a separate, later round of cuts (then return null).' END, "
        "CASE WHEN row_idx % 2 = 0 THEN 'Existing events for this company (return one of these event_ids verbatim if this is follow-up coverage, else null):' || chr(10) || '  - ' || event_id || '-b (' || date_announced || ')' || chr(10) || '  - ' || event_id || '-c (' || date_announced || ')' END) AS prompt FROM e"),
    "stale_pairs": with_entries("SELECT pair, event_id FROM (SELECT pair, unnest(string_split(pair, ' + ')) AS event_id FROM dp) AS x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE y.event_id = x.event_id AND y.row_idx % 3 <> 0)", f"dp AS ({DISTINCT.format(e='e')})"),
    "recheck": "SELECT event_id, st AS new_status, CASE WHEN st IS NOT NULL THEN CASE WHEN event_id % 3 = 0 THEN '' ELSE 'http://e/' || event_id END END AS evidence_url, CASE WHEN st IS NOT NULL THEN '' END AS note, CASE WHEN st IS NOT NULL AND event_id % 2 = 0 THEN event_id::DOUBLE END AS headcount FROM (SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN CASE event_id % 5 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'still-rumored' WHEN 2 THEN 'denied' WHEN 3 THEN 'expired' END END AS st FROM events)",
    "source_checks": with_entries("SELECT row_idx, contains(lower(notes), 'headcount') OR row_idx % 3 = 0 AS relevant, regexp_matches(lower(source_link), '^https?://(www[.])?([a-z0-9.]+[.])?(site7[.]example[.]com|reuters[.]com)/') AS excluded FROM e"),
    "labels": with_entries("SELECT month, strftime(CAST(month || '-01' AS DATE), '%b') || ' ' || substring(month, 3, 2) AS label, 'Q' || CAST(ceil(CAST(substring(month, 6, 2) AS INT) / 3) AS INT) || ' ' || substring(month, 1, 4) AS heading FROM m", ROLL, MONTHS),
    "tier_metrics": "WITH r AS (SELECT CASE event_id % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rumored' ELSE 'rejected' END AS x, CASE CAST(floor(event_id / 2) AS BIGINT) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rumored' ELSE 'rejected' END AS v, event_id % 5 = 0 AS g, CASE event_id % 4 WHEN 0 THEN 'singapore' WHEN 1 THEN 'global' WHEN 2 THEN 'partial' END AS h, CASE WHEN event_id % 2 = 0 THEN 'singapore' END AS s FROM events) SELECT count(*) AS cases, round(count(*) FILTER (x = v) / count(*), 9) AS verdict_accuracy, round(count(*) FILTER ((x <> 'rejected') = (v <> 'rejected')) / count(*), 9) AS accept_accuracy, count(*) FILTER (x <> 'rejected' AND v <> 'rejected') AS tier_cases, round(count(*) FILTER (x <> 'rejected' AND x = v) / count(*) FILTER (x <> 'rejected' AND v <> 'rejected'), 9) AS tier_match, count(*) FILTER (x = 'rumored' AND v = 'confirmed') AS over_confident, count(*) FILTER (x = 'confirmed' AND v = 'rumored') AS under_confident, count(*) FILTER (g) AS global_cases, count(*) FILTER (g AND v = 'confirmed' AND h = 'singapore') AS scope_leaks, count(*) FILTER (g AND h IN ('global', 'partial')) AS scope_recognised, count(s) AS scope_labelled, count(*) FILTER (s = h) AS scope_exact FROM r",
}
