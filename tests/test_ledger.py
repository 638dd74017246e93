import datetime
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import audit as A
from ledgerloom.operators import classify as C
from ledgerloom.operators import dedup as D
from ledgerloom.operators import events as E
from ledgerloom.operators import integrity as V
from ledgerloom.operators import guards as U
from ledgerloom.operators import hints as H
from ledgerloom.operators import linking as G
from ledgerloom.operators import projections as P
from ledgerloom.operators import selection as S
from ledgerloom.operators import triage_run as T
from ledgerloom.operators.components import connected_components, stage
from ledgerloom.operators.names import company_names
from ledgerloom.sources import ledger_files as L
from ledgerloom.streaming.ingest import ingest_stream

SCHEMA = "row_idx long, company string, date_announced string, date_reported string, jobs_cut_sg double, jobs_cut_global double, pct_workforce double, industry string, source_link string, notes string, status string, event_id string"


def rows(spark, *changes):
    base = {"company": "Orbit", "date_announced": "2026-05-01", "date_reported": "", "jobs_cut_sg": None, "jobs_cut_global": None, "pct_workforce": None, "industry": "Tech", "source_link": "", "notes": "", "status": "confirmed", "event_id": "orbit-2026-05"}
    return spark.createDataFrame([tuple({"row_idx": i, **base, **c}[k.split()[0]] for k in SCHEMA.split(", ")) for i, c in enumerate(changes)], SCHEMA)


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_largest_figure_counts_once(spark):
    h = E.headline(E.event_rollup(rows(spark, {"jobs_cut_sg": 100.0}, {"jobs_cut_sg": 250.0}, {"event_id": "x", "jobs_cut_global": 1000.0}))).first()
    assert (h.total_jobs, h.undisclosed, h.confirmed_events) == (250.0, 1, 2)


def test_month_of_earliest_row(spark):
    m = E.monthly(E.event_rollup(rows(spark, {"date_announced": "2026-05-20"}, {"date_announced": "2026-06-02"}))).collect()
    assert [r.month for r in m] == ["2026-05"]


@pytest.mark.parametrize(
    "raw, key",
    [("Meta Platforms", "meta"), ("Heineken Asia Pacific", "heineken"), ("Flor Pâtisserie", "flor"), ("Őrség Bar & Grill", "orseg"), ("Cafe", "cafe"), ("Jetstar Asia", "jetstar asia"), ("Nova Pte Ltd", "nova"), ("Nova Group Singapore", "nova group"), ("Nova (Asia)", "nova"), ("Café  Nova, Inc.", "cafe nova,".rstrip(",")), ("  ", ""), ("H&M", "h&m"), ("A & B Ltd", "a and b")],
)
def test_company_key(spark, raw, key):
    assert one(spark, X.company_key(F.lit(raw))) == key


@pytest.mark.parametrize(
    "url, key",
    [("http://www.site.sg/a/", "site.sg/a"), ("https://site.sg/a?x=1#y", "site.sg/a"), ("https://web.archive.org/web/20260101/https://site.sg/A", "site.sg/a"), ("site.sg/amp/a", "site.sg/a"), ("site.sg/a.amp", "site.sg/a"), ("site.sg/a/index.html", "site.sg/a"), (None, "")],
)
def test_normalize_url(spark, url, key):
    assert one(spark, X.normalize_url(F.lit(url).cast("string"))) == key


def test_month_base(spark):
    assert one(spark, X.month_base(F.lit("nova-2026-07-second"))) == "nova-2026-07"
    assert one(spark, X.month_base(F.lit("nova-2026-07-15"))) is None
    assert one(spark, X.month_base(F.lit("nova-2026-13"))) is None


def test_figures(spark):
    assert one(spark, X.jobs_number(F.lit("It laid off 1,200 staff"))) == 1200
    assert one(spark, X.share_number(F.lit("cutting about 12.5% of staff"))) == 12.5
    assert one(spark, X.jobs_number(F.lit("no figure"))) is None


def test_sliding_groups(spark):
    days = ["2026-05-01", "2026-05-07", "2026-05-13", "2026-05-25", ""]
    assert [g for _, g in sorted(map(tuple, G.window_groups(rows(spark, *({"date_announced": d} for d in days))).collect()))] == [0, 0, 0, 3, 4]


def test_groups_in_file_order_match_a_sequential_model(spark):
    rng, changes = random.Random(4), []
    for _ in range(300):
        changes.append({"company": rng.choice("ABC"), "date_announced": str(datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(90)))})
    groups, want = {}, []
    for i, c in enumerate(changes):
        d = datetime.date.fromisoformat(c["date_announced"])
        for g in groups.setdefault(c["company"], []):
            if abs((d - g[0]).days) <= 7:
                g[0] = max(g[0], d)
                break
        else:
            g = [d, i]
            groups[c["company"]].append(g)
        want.append((i, g[1]))
    assert sorted(map(tuple, G.window_groups(rows(spark, *changes)).collect())) == want


def test_links_and_veto(spark):
    e = rows(spark, {"event_id": "a", "source_link": "http://s.sg/x"}, {"event_id": "b", "company": "Other", "source_link": "https://www.s.sg/x/"}, {"event_id": "c", "date_announced": "2027-01-01"})
    linked = {r.row_idx: r.new_event_id for r in G.link_events(e).collect()}
    assert linked[0] == linked[1] and linked[2] == "c"
    apart = {r.row_idx: r.new_event_id for r in G.link_events(e, distinct=[("a", "b")]).collect()}
    assert (apart[0], apart[1]) == ("a", "b")


def test_merge_chains(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "c")], "from_event_id string, to_event_id string")
    assert {(r[0], r[1], r[2]) for r in G.resolve_merges(m).collect()} == {("a", "c", 2), ("b", "c", 1), ("x", "c", 1)}
    for bad in ([("a", "b"), ("b", "a")], [("a", "a")], [("a", "b"), ("a", "c")], [("", "b")]):
        with pytest.raises(ValueError):
            G.resolve_merges(spark.createDataFrame(bad, "from_event_id string, to_event_id string"))


def test_clusters(spark):
    e = rows(spark, {}, {"date_announced": "2026-05-20"}, {"date_announced": "2026-08-01"}, {"company": "Z", "notes": "[gn:t]"}, {"company": "Y", "notes": "[gn:t]", "date_announced": ""})
    assert [c for _, c in sorted(map(tuple, G.cluster(e).collect()))] == [0, 0, 2, 3, 3]


def test_clusters_leave_aggregators_and_unknown_companies_alone(spark):
    e = rows(spark, {"company": "Orbit cuts jobs"}, {"company": "Orbit, Quasar and Nebula shed staff"}, {"company": "Orbit, Quasar and Nebula shed staff"}, {"company": ""}, {"company": ""}, {"company": "x", "source_link": "http://n.sg/2026/quasar-job-cuts"}, {"company": "Quasar"})
    names = rows(spark, {"company": "Orbit"}, {"company": "Quasar"}, {"company": "Nebula"})
    tokens = G.telling(G.company_tokens(names.select("company", "row_idx")))
    keys = dict(map(tuple, G.node_keys(e, tokens).collect()))
    assert [keys[i] for i in range(7)] == ["orbit", G.AGGREGATOR, G.AGGREGATOR, f"{G.UNKNOWN}3", f"{G.UNKNOWN}4", "quasar", "quasar"]
    assert [c for _, c in sorted(map(tuple, G.cluster(e, tokens=tokens).collect()))] == [0, 1, 2, 3, 4, 5, 5]


def test_clusters_match_a_sequential_model(spark):
    rng = random.Random(3)
    changes = [{"company": f"Firm{rng.choice('abcdefgh')} Ltd", "date_announced": str(datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(200))), "notes": f"[gn:{rng.randrange(150)}]" if rng.random() < 0.2 else "", "source_link": f"http://s/{rng.randrange(400)}" if rng.random() < 0.3 else ""} for _ in range(250)]
    own = list(range(250))

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    for i, a in enumerate(changes):
        for j, b in enumerate(changes[:i]):
            near = a["company"] == b["company"] and abs((datetime.date.fromisoformat(a["date_announced"]) - datetime.date.fromisoformat(b["date_announced"])).days) <= 21
            if near or (a["notes"] and a["notes"] == b["notes"]) or (a["source_link"] and a["source_link"] == b["source_link"]):
                x, y = sorted((find(i), find(j)))
                own[y] = x
    assert sorted(map(tuple, G.cluster(rows(spark, *changes)).collect())) == [(i, find(i)) for i in range(250)]


def test_vetoed_links_match_a_sequential_model(spark):
    rng = random.Random(9)
    changes = [{"company": f"C{rng.randrange(12)}", "date_announced": str(datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(60))), "source_link": f"http://s.sg/{rng.randrange(50)}" if rng.random() < 0.5 else "", "event_id": f"e{rng.randrange(40)}-2026-0{rng.randrange(1, 4)}"} for _ in range(120)]
    ids = sorted({c["event_id"] for c in changes})
    pairs = [tuple(rng.sample(ids, 2)) for _ in range(25)]
    foes = {frozenset(p) for p in pairs}
    groups, own, members = dict(map(tuple, G.window_groups(rows(spark, *changes), distinct=pairs).collect())), list(range(120)), {i: {i} for i in range(120)}

    def find(i):
        while own[i] != i:
            i = own[i]
        return i

    edges = [(i, groups[i]) for i in range(120)]
    for key in (lambda c: c["source_link"], lambda c: c["company"].lower() + "|" + c["event_id"]):
        first = {}
        for i, c in enumerate(changes):
            if key(c):
                edges.append((i, first.setdefault(key(c), i)))
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        if x != y and not any(frozenset((changes[p]["event_id"], changes[q]["event_id"])) in foes for p in members[x] for q in members[y]):
            own[y] = x
            members[x] |= members.pop(y)
    best = {r: min(m, key=lambda i: (-(3 + (changes[i]["source_link"] != "")), i)) for r, m in members.items()}
    got = {r.row_idx: r.new_event_id for r in G.link_events(rows(spark, *changes), distinct=pairs).collect()}
    assert got == {i: changes[best[find(i)]]["event_id"] for i in range(120)}


def test_merge_assertions(spark):
    m = G.resolve_merges(spark.createDataFrame([("a", "b")], "from_event_id string, to_event_id string"))
    G.assert_merges(m, rows(spark, {"event_id": "b"}))
    with pytest.raises(ValueError):
        G.assert_merges(m, rows(spark, {"event_id": "c"}))
    with pytest.raises(ValueError):
        G.assert_merges(m, rows(spark, {"event_id": "b"}), spark.createDataFrame([("a + b",)], "pair string"))


def test_deletion_keeps_the_best_row_of_a_window(spark):
    e = rows(spark, {}, {"date_announced": "2026-05-03", "jobs_cut_sg": 5.0}, {"date_announced": "2026-06-03"})
    assert sorted(r.row_idx for r in G.dedup_by_deletion(e).collect()) == [1, 2]


def test_share_of_zero_adds_nothing(spark):
    q = [r[0] for r in rows(spark, {"pct_workforce": 0.0}, {"pct_workforce": 5.0}).orderBy("row_idx").select(X.row_quality()).collect()]
    assert q == [3, 4]


@pytest.mark.parametrize(
    "raw, day",
    [("2026-05-04", "2026-05-04"), (" 2026-05-04 ", "2026-05-04"), ("4 May 2026", "2026-05-04"), ("May 4, 2026", "2026-05-04"), ("14 september 2026", "2026-09-14"), ("Tue, 05 May 2026 23:30:00 GMT", "2026-05-05"), ("2026-05-04T23:30:00Z", "2026-05-04"), ("2026-05-04T23:30:00-02:00", "2026-05-05"), ("soon", None), ("", None)],
)
def test_parse_date(spark, raw, day):
    assert one(spark, X.parse_date(F.lit(raw))) == day


def test_small_functions(spark):
    assert one(spark, X.guess_company(F.lit("Nova Pte Ltd lays off 20"))) == "Nova" and one(spark, X.guess_company(F.lit("cuts at Nova"))) == "Cuts At Nova"
    assert one(spark, X.append_evidence(F.lit("a"), F.lit("u"))) == "a | Evidence: u" and one(spark, X.append_evidence(F.lit("see u"), F.lit("u"))) == "see u" and one(spark, X.append_evidence(F.lit(None).cast("string"), F.lit("u"))) == "Evidence: u"
    assert one(spark, X.map_industry(F.lit("information_technology"))) == "Tech" and one(spark, X.map_industry(F.lit(""))) == "Other"
    assert one(spark, X.normalize_industry(F.lit("the retail trade"))) == "Retail"
    assert S.rotated(["a", "b", "c"], ["k"], "2026-01-02", 3) == ["k", "c", "a"]


def finding_types(spark, *changes, **how):
    return sorted((r.type, r.identity) for r in A.check_integrity(rows(spark, *changes), "2026-12-31", **how).collect() if r.type not in ("unarchived-confirmed",))


def test_audit_windows_and_suppression(spark):
    rumor = {"status": "rumored", "date_announced": "2026-01-01", "event_id": "a"}
    for day, n in (("2026-01-31", 1), ("2026-02-01", 0)):
        assert len(finding_types(spark, rumor, {"date_announced": day, "event_id": "b"})) == n
    same = [{"event_id": "a"}, {"event_id": "b"}]
    assert finding_types(spark, *same) == [("duplicate", "a + b")]
    assert finding_types(spark, *same, distinct_pairs=spark.createDataFrame([("a + b",)], "pair string")) == []


def test_audit_tokens_are_counted_over_all_rows(spark):
    def of(n, last):
        return finding_types(spark, *({"company": f"Zephyr {'abcdefgh'[i] * 4}", "event_id": f"e{i}", "date_announced": "2026-05-01" if i < 2 else f"2020-0{i}-01", "status": last if i == n - 1 else "confirmed"} for i in range(n)))

    assert of(5, "reference") == [("same-day-same-event", "e0 + e1")] and of(6, "reference") == []


def test_audit_messages_and_hard_errors(spark):
    e = rows(spark, {"company": "Uber", "event_id": "a"}, {"company": "Uber Technologies", "event_id": "b"}, {"company": "Unnamed firm", "event_id": "c", "date_announced": "2027-01-01", "notes": "plans to cut globally", "jobs_cut_sg": 2000.0})
    got = {(r.type, r.hard): r.message for r in A.check_integrity(e, "2026-12-31").collect()}
    assert got["same-day-same-event", True].startswith("Same-day, same-industry entries share distinctive company token(s) [uber]: \"Uber\" and \"Uber Technologies\" both on 2026-05-01")
    assert got["future-date", False] == 'Future date: "Unnamed firm" dated 2027-01-01 (after 2026-12-31)'
    assert got["global-figure", False] == 'Global figure in jobs_cut_sg: "Unnamed firm" jobs_cut_sg=2000 reads as worldwide — move to jobs_cut_global'
    assert ("name-split", False) in got and ("vague-company", False) in got and ("contradictory-verdict", False) in got
    errors, hard, warnings = A.analyze(e, "2026-12-31")
    assert hard.count() == 1 and warnings.count() == len(got) - 1 + 2 and errors.filter("field = 'source_link'").count() == 3
    twice = finding_types(spark, {"company": "Orbit", "event_id": "a"}, {"company": "ORBIT", "event_id": "b", "date_announced": "2026-04-20"})
    assert twice == [("double-count", "a + b")]


def test_guards_hold_back_what_adds_findings(spark):
    ledger = rows(spark, {"event_id": "a", "source_link": "https://reuters.com/1"})
    audit = lambda d: A.check_integrity(d, "2026-12-31")
    new = rows(spark, {}, {"event_id": "b", "source_link": "https://reuters.com/2"}, {"event_id": "c", "company": "Nova", "source_link": "https://reuters.com/3"}).filter("row_idx > 0")
    kept, held = U.screen_batch(ledger, new, audit)
    assert [r.row_idx for r in kept.collect()] == [2] and [(r.row_idx, r.added) for r in held.collect()] == [(1, ["duplicate :: a + b"])]


def test_results_are_taken_back_where_they_add_findings(spark):
    ledger = rows(spark, {"status": "rumored", "event_id": "a", "source_link": "https://reuters.com/1"}, {"status": "rumored", "event_id": "b", "company": "Nova", "notes": "plans to cut", "source_link": "https://reuters.com/2"})
    results = spark.createDataFrame([(0, "Orbit Ltd", " 2026-05-01", "confirmed", "http://e"), (1, "Nova", "2026-05-01", "confirmed", "http://f"), (2, "None", "2026-05-01", "denied", "")], "row_idx long, company string, date_announced string, new_status string, evidence_url string")
    out, undone = U.apply_results_safely(ledger, results, lambda d: A.check_integrity(d, "2026-12-31"))
    got = {r.row_idx: (r.status, r.notes) for r in out.collect()}
    assert undone == [1] and got == {0: ("confirmed", "Evidence: http://e"), 1: ("rumored", "plans to cut")}


def test_hinted_ids_are_taken_word_for_word(spark):
    hints = spark.createDataFrame([(0, "p", ["a"]), (1, None, [])], "row_idx long, primary_event_id string, listed array<string>")
    v = spark.createDataFrame([(0, " a "), (1, "b"), (2, None)], "row_idx long, proposed string")
    assert {r.row_idx: (r.event_id, r.discarded_event_id) for r in H.pick_hinted(v, hints).collect()} == {0: ("a", None), 1: (None, "b"), 2: (None, None)}


def test_source_events(spark):
    e = spark.createDataFrame([(0, "7", "Nova Pte Ltd", "it", "4 May 2026", None, 10.5, True, "Paper", " ", "note"), (1, "7", "Nova", None, None, None, None, None, None, None, None), (2, "8", " ", None, None, None, None, None, None, None, None)], "row_idx long, id string, company string, industry string, announcement_date string, created_date string, affected double, is_exact boolean, source_name string, source_url string, notes string")
    kept, counts = P.source_events(e)
    r = P.event_to_review(kept, "2026-06-01").first()
    assert counts.first().skipped == 2 and (r.company, r.date_announced, r.jobs_cut_sg, r.industry, r.source_link) == ("Nova", "2026-05-04", 11.0, "Tech", "https://layoffsg.com/feed?event=7")
    assert r.notes == "From layoffsg.com (via Paper; exact count; note) [lsg:7]" and "review_id" not in P.without_review(kept).columns


def test_canonical_score_and_pool(spark):
    d = spark.createDataFrame([(100.0, "http://a", True, False), (None, "https://news.google.com/x", False, True)], "jobs_cut double, source_link string, rule_matched boolean, broken_url boolean")
    assert sorted(r[0] for r in d.select(C.canonical_score()).collect()) == [0, 1031]
    assert C.reject_pool(rows(spark, {"source_link": "x"}, {"source_link": ""}, {"source_link": "x", "notes": "Duplicate of y"})).count() == 1


def test_components_match_union_find(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)]
    own = {x: x for p in pairs for x in p}

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        own[y] = x
    got = dict(map(tuple, connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(got.get(x, x) == find(x) for x in own)


def test_double_count_edge_days(spark):
    for day, n in (("2026-02-01", 1), ("2026-02-02", 0)):
        e = rows(spark, {"date_announced": "2026-01-01"}, {"date_announced": day, "event_id": "z"})
        assert V.same_company_pairs(e).count() == n


def test_field_checks(spark):
    e = rows(spark, {"company": " ", "pct_workforce": 120.0, "status": "gone", "date_announced": "2026-5-1", "event_id": "", "source_link": "x"})
    assert {r.field for r in V.validate_rows(e).collect()} == {"company", "pct_workforce", "status", "date_announced", "event_id"}


def test_hits(spark):
    h = spark.createDataFrame([(0, "One two - A", "u"), (1, "x", "u"), (2, "One, two", "v"), (3, "Three", "w"), (4, "Four", "")], "row_idx long, title string, url string")
    assert sorted(r.row_idx for r in D.dedupe_hits(h).collect()) == [0, 3]


def test_csv_round_trip(spark, tmp_path):
    e = rows(spark, {"notes": 'a "quoted"\nline, with comma', "jobs_cut_sg": 5.0})
    L.write_ledger(e, str(tmp_path / "l"))
    got = L.read_ledger(spark, str(tmp_path / "l")).first()
    assert (got.notes, got.jobs_cut_sg) == ('a "quoted"\nline, with comma', 5.0)
    assert L.read_ledger(spark, str(tmp_path / "none")).count() == 0


def test_streaming_ingest(spark, tmp_path):
    rows(spark, {"source_link": "http://s.sg/1"}, {"source_link": "http://s.sg/1", "event_id": "q"}, {"company": "New", "source_link": "http://s.sg/2"}).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], SCHEMA)
    for _ in range(2):
        ingest_stream(stream, empty, empty, str(tmp_path / "queue"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "queue")).count() == 2


def test_rows_are_numbered_over_files(spark, tmp_path):
    e = rows(spark, *({"event_id": f"e{i}"} for i in range(30))).repartition(5)
    L.write_ledger(e, str(tmp_path / "l"))
    got = L.read_ledger(spark, str(tmp_path / "l"))
    assert sorted(r.row_idx for r in got.collect()) == list(range(30))
    L.append_ledger(rows(spark, {"event_id": "x"}), str(tmp_path / "l"))
    assert L.read_ledger(spark, str(tmp_path / "l"), raw=True).count() == 31


def test_ledger_text(spark):
    got = L.parse_ledger(spark, "company,jobs_cut_sg,date_announced\r\nNova,12,2026-01-01\rOrbit,many,2026-01-02\n\n").orderBy("row_idx").collect()
    assert [(r.company, r.jobs_cut_sg, r.jobs_cut_sg_raw, r.row_idx) for r in got] == [("Nova", 12.0, "12", 0), ("Orbit", None, "many", 1)]


def test_aliases(spark, tmp_path):
    (tmp_path / "a.csv").write_text("alias,canonical,note\nDBS Bank,One,\ndbs bank,DBS,\n,x,\nGrab Holdings ,Grab,\n")
    known = L.read_aliases(spark, str(tmp_path / "a.csv"))
    assert known == {"dbs bank": "DBS", "grab holdings": "Grab"} and L.read_aliases(spark, str(tmp_path / "none")) == X.ALIASES
    e = rows(spark, {"company": "DBS Bank (Singapore)"}, {"company": "Grab  Holdings"}, {"company": "DBS Bank India"})
    assert [r.k for r in X.with_company_key(e, aliases=known).orderBy("row_idx").collect()] == ["dbs", "grab", "dbs bank india"]


def test_feeds_and_links(spark):
    import base64

    xml = "<rss><channel><item><title>R&D firm cuts jobs</title><link>http://a</link><pubDate>now</pubDate></item><item><title>Sport</title><link>http://b</link></item><item><title>layoff</title></item></channel></rss>"
    got = L.feed_hits(spark.createDataFrame([("s", xml)], "source string, xml string")).collect()
    assert [tuple(r) for r in got] == [("s", "R&D firm cuts jobs", "http://a", "", "now")]
    pack = lambda url, head: base64.urlsafe_b64encode(b"\x08\x13\x22" + head + url.encode() + b"\xd2\x01\x00").decode().rstrip("=")
    short, long = "http://news.sg/a", "https://news.sg/" + "b" * 120
    ids = [pack(short, bytes([len(short)])), pack(long, bytes([128 + len(long) % 128, 1])), pack("AU_yqLabc", bytes([9])), "??", None]
    out = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, x string").orderBy("i").select(L.decoded_link(F.col("x"))).collect()]
    assert out[0] == short and out[1].startswith(long) and out[2:] == [None, None, None]


def test_budget_turns_over(spark):
    state = spark.createDataFrame([("2026-05", 7, 50)], "month string, searches_used int, monthly_cap int")
    assert tuple(L.budget(state, "2026-05").first()) == ("2026-05", 7, 50) and tuple(L.budget(state, "2026-06").first()) == ("2026-06", 0, 50)
    assert tuple(L.budget(state.limit(0), "2026-06").first()) == ("2026-06", 0, 1000)


def test_hints_meet_lists_not_events(spark):
    """5000 candidates and 5000 events of one company and cluster: what the joins make stays near the candidates."""
    n = 5000
    ledger = spark.range(n).select(F.col("id").alias("row_idx"), F.lit("Nova Ltd").alias("company"), F.lit("2026-05-01").alias("date_announced"), F.concat(F.lit("e"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("event_id"))
    own = spark.range(n, 2 * n).select(F.col("id").alias("row_idx"), F.lit("NOVA").alias("company"))
    clusters = ledger.select("row_idx", F.lit("anchor").alias("kind"), F.lit("c").alias("cluster")).unionByName(own.select("row_idx", F.lit("candidate").alias("kind"), F.lit("c").alias("cluster")))
    h = H.select_hints(own, ledger, clusters)
    plan = h._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4  # cut before and after the shuffle, for companies and for clusters
    got = h.collect()
    assert len(got) == n and {(r.primary_event_id, tuple(r.listed)) for r in got} == {("e00000", tuple(f"e{i:05d}" for i in range(1, 13)))}


def test_hints_match_a_sequential_model(spark):
    rng = random.Random(12)
    ledger = [(i, f"C{rng.randrange(4)}", "2026-05-01", rng.choice(["", *(f"e{j:02d}" for j in range(60))])) for i in range(150)]
    own = [(1000 + i, f"C{rng.randrange(6)}") for i in range(40)]
    clusters = [("anchor", i, f"k{rng.randrange(5)}") for i, *_ in ledger if rng.random() < 0.6] + [("candidate", i, f"k{rng.randrange(7)}") for i, _ in own if rng.random() < 0.8]
    near, want = {}, {}
    at = {(kind, i): c for kind, i, c in clusters}
    for i, _, _, e in ledger:
        if ("anchor", i) in at:
            near.setdefault(at["anchor", i], []).append(e)
    for i, company in own:
        same = near.get(at.get(("candidate", i)), [])
        first = same[0] if same else None
        every = dict.fromkeys([e for _, c, _, e in ledger if c == company and e] + [e for e in same if e])
        want[i] = (first or None, [e for e in every if e != first][:12])
    frame = lambda data, schema: spark.createDataFrame(data, schema).repartition(3)
    got = H.select_hints(frame(own, "row_idx long, company string"), frame(ledger, "row_idx long, company string, date_announced string, event_id string"), frame(clusters, "kind string, row_idx long, cluster string"))
    assert {r.row_idx: (r.primary_event_id, r.listed) for r in got.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_groups_with_vetoes_match_a_sequential_model(spark, seed):
    """Dates in random file order, some blank, some no dates, and pairs of events that must not meet."""
    rng, changes = random.Random(seed), []
    for _ in range(260):
        day = rng.choice(["", "soon", *[str(datetime.date(2026, 1, 1) + datetime.timedelta(rng.randrange(120)))] * 8])
        changes.append({"company": rng.choice(["A Ltd", "a", "B", ""]), "date_announced": day, "event_id": f"e{rng.randrange(12)}"})
    pairs = [(f"e{a}", f"e{b}") for a, b in (rng.sample(range(12), 2) for _ in range(10))]
    foes = {frozenset(p) for p in pairs}
    number = lambda t: datetime.date.fromisoformat(t).toordinal() if t[:1] == "2" else None
    groups, want = {}, []
    for i, c in enumerate(changes):
        t = c["date_announced"]
        for g in groups.setdefault(c["company"].removesuffix(" Ltd").lower(), []):
            near = (not t and not g[0]) or (t and g[0] and number(t) and number(g[0]) and abs(number(t) - number(g[0])) <= 7)
            if near and not any(frozenset((c["event_id"], e)) in foes for e in g[2]):
                g[2].add(c["event_id"])
                g[0] = max(g[0], t) if t and g[0] else g[0]
                break
        else:
            g = [t, i, {c["event_id"]}]
            groups[c["company"].removesuffix(" Ltd").lower()].append(g)
        want.append((i, g[1]))
    e = rows(spark, *changes).repartition(5)
    assert sorted(map(tuple, G.window_groups(e, distinct=pairs).collect())) == want
    apart = spark.createDataFrame(pairs, "a string, b string")
    assert sorted(map(tuple, G.window_groups(e, distinct=apart).collect())) == want


def test_pieces_of_one_company_go_to_many_tasks(spark):
    days = spark.range(400).select(F.col("id").alias("row_idx"), F.lit("Nova").alias("company"), F.date_add(F.lit("1990-01-01"), (F.col("id") * 9).cast("int")).cast("string").alias("date_announced"), F.lit("e").alias("event_id"))
    out = G.window_groups(days).withColumn("task", F.spark_partition_id())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together again
    try:
        got = out.collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.row_idx == r.group_idx for r in got) and len({r.task for r in got}) > 1


ALIASED = {"yeo's": "Yeo Hiap Seng", "nova labs": "Orbit"}


def test_aliases_decide_everywhere(spark):
    table = spark.createDataFrame([("Yeo's ", "Yeo Hiap Seng"), ("nova labs", " Orbit"), ("", "x"), ("y", None)], "alias string, canonical string")
    ledger = rows(spark, {"company": "Yeo Hiap Seng", "event_id": "yhs", "source_link": "http://a/1"}, {"company": "Orbit Pte Ltd", "event_id": "orb", "source_link": "http://a/2"})
    own = rows(spark, {"company": "Yeo’s", "date_announced": "2026-05-09", "source_link": "http://a/3"}, {"company": "Nova Labs (SG)", "date_announced": "2026-05-09", "source_link": "http://a/4"}).withColumn("row_idx", F.col("row_idx") + 10)
    nothing = ledger.limit(0)
    for aliases, second in ((None, "new"), ({}, "new"), (ALIASED, "potential-duplicate"), (table, "potential-duplicate"), (company_names(ledger.select("company"), own.select("company"), aliases=table), "potential-duplicate")):
        got = {r.row_idx: r.verdict for r in D.check_candidates(own, ledger, nothing, nothing, aliases).collect()}
        assert got == {10: "new" if aliases == {} else "potential-duplicate", 11: second}
    none = spark.createDataFrame([], "kind string, row_idx long, cluster string")
    assert {r.row_idx: r.listed for r in H.select_hints(own, ledger, none, aliases=table).collect()} == {10: ["yhs"], 11: ["orb"]}
    both = ledger.unionByName(own.withColumn("date_announced", F.lit("2026-05-02")))
    first = {r.row_idx: r.group_idx for r in G.window_groups(both, aliases=table).collect()}
    assert first == {0: 0, 1: 1, 10: 0, 11: 1}
    linked = {r.row_idx: r.new_event_id for r in G.link_events(both.withColumn("event_id", F.coalesce(F.nullif("event_id", F.lit("")), F.lit("new"))), aliases=ALIASED).collect()}
    assert linked == {0: "yhs", 1: "orb", 10: "yhs", 11: "orb"}
    kept = {r.row_idx for r in G.dedup_by_deletion(both, aliases=ALIASED).collect()}
    assert kept == {0, 1}
    results = own.select(F.col("row_idx"), F.lit("Yeo Hiap Seng").alias("company"), "date_announced", F.lit("denied").alias("new_status"), F.lit("").alias("evidence_url")).limit(1)
    assert [r.status for r in U.apply_results(own, results, table).filter("row_idx = 10").collect()] == ["denied"]
    variants = {(r.key, r.variant) for r in G.company_tokens(ledger.select("company", "row_idx"), ALIASED).collect()}
    assert {("yeo-hiap-seng", "yeo s"), ("orbit", "nova labs")} <= variants


def one_by_one(ledger, rejected, candidates, audit):
    """The batch screened as a list: every candidate in turn against everything let in so far."""
    sides = lambda own: (ledger.unionByName(candidates.filter(F.col("row_idx").isin(own) & (F.col("target") == "ledger")).select(ledger.columns)), rejected.unionByName(candidates.filter(F.col("row_idx").isin(own) & (F.col("target") == "rejected")).select(ledger.columns)))
    marks = lambda own: {f"{r.type} :: {r.identity}" for r in audit(*sides(own)).collect()}
    ids = sorted(r.row_idx for r in candidates.select("row_idx").collect())
    current, kept, held = marks([]), [], {}
    if marks(ids) <= current:
        return ids, {}
    for i in ids:
        trial = marks([*kept, i])
        if trial <= current:
            kept, current = [*kept, i], trial
        else:
            held[i] = sorted(trial - current)
    return kept, held


def test_screening_matches_one_candidate_after_another(spark):
    rng = random.Random(1)
    words = ["Quasar", "Nebula", "Pulsar", "Comet", "Zenith", "Meteor"]

    def row(i):
        name = " ".join(rng.sample(words, 2)) if rng.random() < 0.7 else rng.choice(words)
        return {"company": f"{name} {'abcdefghij'[i % 10] * 3}", "event_id": rng.choice(["", f"e{rng.randrange(15)}"]), "date_announced": str(datetime.date(2026, 3, 1) + datetime.timedelta(rng.randrange(90))), "source_link": f"https://reuters.com/{rng.randrange(25)}", "notes": rng.choice(["", f"[gn:{rng.randrange(9)}]"]), "status": rng.choice(["confirmed", "rumored"])}

    every = rows(spark, *(row(i) for i in range(41))).withColumn("target", F.expr("CASE WHEN row_idx % 4 = 3 THEN 'rejected' ELSE 'ledger' END")).repartition(3)
    every = stage(every, "rows")
    ledger, rejected = every.filter("row_idx < 26").drop("target"), every.filter("row_idx between 26 and 33").drop("target")
    candidates = every.filter("row_idx > 33")
    audit = lambda d, r: A.check_integrity(d, "2026-12-31", rejected=r)
    kept, held = U.screen_batch(ledger, candidates, audit, rejected)
    want_kept, want_held = one_by_one(ledger, rejected, candidates, audit)
    assert (sorted(r.row_idx for r in kept.collect()), {r.row_idx: r.added for r in held.collect()}) == (want_kept, want_held)
    assert want_held and want_kept


def test_a_batch_that_adds_nothing_is_kept_whole(spark):
    ledger = rows(spark, {"event_id": "a", "source_link": "https://reuters.com/1"})
    new = rows(spark, {}, {"event_id": "a", "source_link": "https://reuters.com/2"}).filter("row_idx > 0")
    kept, held = U.screen_batch(ledger, new, lambda d: A.check_integrity(d, "2026-12-31"))
    assert [r.row_idx for r in kept.collect()] == [1] and held.count() == 0
    kept, held = U.screen_batch(ledger, new.limit(0), lambda d: A.check_integrity(d, "2026-12-31"))
    assert kept.count() == held.count() == 0


def test_rules_match_letters_in_either_case(spark):
    rule = spark.createDataFrame([("NESTLÉ’S PLANS to cut",), ("nothing here",)], "t string").select(C.event_rule(F.col("t"))["company"].alias("c"))
    assert [r.c for r in rule.collect()] == ["Nestlé", None]
    d = rows(spark, *({"company": f"Firm {i}"} for i in range(3)))
    plan = C.triage(d, ["opinion:"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3  # the text of a row is made once, not once a rule


def test_triage_run_deals_every_row_once(spark):
    ledger = rows(spark, {"company": "Quasar", "date_announced": "2026-05-01", "source_link": "http://l/1"}).withColumn("event_id", F.lit("q"))
    batch = rows(
        spark, {"company": "Quasar sheds staff", "source_link": "http://b/1", "date_announced": "2026-05-09"}, {"company": "Heineken to cut", "source_link": "http://b/2"}, {"company": "Heineken to cut more", "source_link": "http://b/3", "date_announced": "2026-05-28"},
        {"company": "Opinion: jobs", "source_link": "http://b/4"}, {"company": "Nebula news", "source_link": "http://b/5", "jobs_cut_sg": 5.0}, {"company": "Nebula news", "source_link": "http://b/6"}, {"company": "Sony Pictures Entertainment", "source_link": "http://b/5"},
    ).withColumn("event_id", F.lit(""))
    run = T.triage_run(batch, ledger, ["opinion:"], overrides=spark.createDataFrame([(5, "confirmed")], "row_idx long, override string"))
    out = {k: sorted(r.row_idx for r in v.collect()) for k, v in T.dealt(run).items()}
    assert out == {"confirmed": [5], "rumored": [1, 6], "rejected": [0, 2, 3, 4], "queue": []}
    why = {r.row_idx: r.reason for r in run.collect()}
    assert why[0] == "Duplicate of existing Quasar (2026-05-01)" and why[4] == "Intra-batch duplicate of row 6" and why[2].startswith("Duplicate (same canonical Heineken, 2026-05)")
    assert T.triage_run(batch.limit(0), ledger, []).count() == 0 and T.triage_run(batch, ledger.limit(0), []).count() == 7
