import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import prompts as M
from ledgerloom.operators import history as Y
from ledgerloom.operators import integrity as V
from ledgerloom.operators import selection as S
from ledgerloom.sources import ledger_files as L
from ledgerloom.sources import links as K
from tests.test_ledger import rows


def put(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_benchmark_keeps_whole_numbers(spark, tmp_path):
    path = put(tmp_path, "b.csv", 'quarter,retrenchments\n2025-Q1,"3,590"\n 2025-Q2 ,3540\n,12\n2025-Q3,n/a\n')
    assert sorted(map(tuple, L.read_benchmark(spark, path).collect())) == [("2025-Q1", 3590), ("2025-Q2", 3540)]


def test_decisions_need_their_columns(spark, tmp_path):
    path = put(tmp_path, "m.csv", "from_event_id,to_event_id,note\n a ,b,x\n")
    assert [(r.from_event_id, r.to_event_id) for r in L.read_decisions(spark, path, ["from_event_id", "to_event_id"]).collect()] == [("a", "b")]
    with pytest.raises(ValueError, match="event_id_a"):
        L.read_decisions(spark, path, ["event_id_a"])
    assert L.read_decisions(spark, str(tmp_path / "none.csv"), ["a"]).columns == ["a"]


def test_json_tables(spark, tmp_path):
    pairs = put(tmp_path, "n.json", json.dumps([{"a": "x", "b": "x y", "why": "w"}, {"a": "x", "b": "x y"}, {"a": None, "b": "z"}]))
    assert [tuple(r) for r in L.read_allowed_neighbours(spark, pairs).collect()] == [("x", "x y")]
    assert L.read_allowed_neighbours(spark, str(tmp_path / "none.json")).count() == 0
    golden = put(tmp_path, "g.json", json.dumps({"cases": [{"id": 1, "verdict": "confirmed"}, {"id": 2, "verdict": None}]}))
    assert sorted(r.id for r in L.read_json_rows(spark, golden, "cases").collect()) == [1, 2]
    queue = put(tmp_path, "q.json", json.dumps([{"company": "Nova\nLtd", "jobs_cut_sg": 5}, {"company": None}]))
    assert sorted((r.company or "", r.jobs_cut_sg) for r in L.read_json_rows(spark, queue).collect()) == [("", None), ("Nova\nLtd", 5)]


def test_report_is_read_back(spark, tmp_path):
    L.write_report(spark.createDataFrame([(1, "a"), (2, None)], "n int, t string"), str(tmp_path / "r"))
    assert sorted((r.n, r.t or "") for r in spark.read.json(str(tmp_path / "r")).collect()) == [(1, "a"), (2, "")]


def test_first_provider_that_has_any(spark):
    d = spark.createDataFrame([("q", 2, "b"), ("q", 1, "a"), ("q", 1, "c"), ("r", 3, "d")], "q string, rank int, url string")
    assert sorted(r.url for r in L.first_source(d, "q", "rank").collect()) == ["a", "c", "d"]


def test_versions_prune_and_compare(spark, tmp_path):
    root = f"file://{tmp_path}"
    old = rows(spark, {"event_id": "a", "source_link": "http://x/1"}, {"company": "Nova", "event_id": "b", "source_link": "https://reuters.com/1"})
    new = rows(spark, {"event_id": "a", "source_link": "https://reuters.com/0"}, {"company": "Nova", "event_id": "b", "source_link": "http://x/2"}, {"company": "Nova", "event_id": "c", "source_link": "https://reuters.com/3"})
    Y.save_version(root, "2026-01", old)
    Y.save_version(root, "2026-02", new, rejected=new.limit(0), distinct_pairs=spark.createDataFrame([("b + c",)], "pair string"))
    plan = Y.version(spark, root, "entries", "2026-01")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    assert Y.findings_at(spark, root, "none", "2026-12-31") is None and Y.version(spark, root, "rejected", "2026-01") is None
    past, now = (Y.findings_at(spark, root, v, "2026-12-31") for v in ("2026-01", "2026-02"))
    fresh, gone, counts = Y.since(now, past)
    assert [r.identity for r in fresh.collect()] == ["x/2"] and [r.identity for r in gone.collect()] == ["x/1"]
    assert tuple(counts.first()) == (1, 1, 1, 1)
    assert tuple(Y.since(now, None)[2].first()) == (0, 1, 1, 0)


def test_pairs_that_name_no_event(spark):
    pairs = spark.createDataFrame([("a + b",), ("b + z",)], "pair string")
    assert [tuple(r) for r in V.stale_pairs(pairs, rows(spark, {"event_id": " a"}, {"event_id": "b"})).collect()] == [("b + z", "z")]


def test_sorting_and_tallies(spark):
    d = rows(spark, {"company": "b", "jobs_cut_sg": 5.0}, {"company": ""}, {"company": "a", "jobs_cut_sg": 9.0}, {"company": "b"})
    assert [r.row_idx for r in S.sorted_by(d, "company").collect()] == [2, 0, 3, 1]
    assert [r.row_idx for r in S.sorted_by(d, "jobs_cut_sg", descending=True).collect()] == [2, 0, 1, 3]
    assert [tuple(r) for r in S.tallies(d, "company").collect()] == [("b", 2), ("", 1), ("a", 1)]


@pytest.mark.parametrize("text, want", [("[1,[2]]]x", "[1,[2]]"), ('{"a":"]}\\\\"} t', '{"a":"]}\\\\"}'), ('["\\\\\\"]"] 5 []', '["\\\\\\"]"]'), ("[1,2", None), ("plain", None), ("", None), ("x [1]", "x [1]")])
def test_json_prefix(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(K.json_prefix(F.col("t"))).first()[0] == want


def test_links_are_told_apart(spark):
    base = "https://news.google.com/rss/articles/"
    d = spark.createDataFrame([(0, "http://a/1"), (1, f"{base}CBMiA?x=1"), (2, f"{base}CBMiB"), (3, "https://news.google.com/topics/x"), (4, None), (5, "not a link")], "row_idx long, source_link string")
    body = ")]}'\n\n99\n" + json.dumps([["wrb.fr", "Fbv4je", json.dumps(["garturlres", "http://a/2"]), None]]) + "\n12\n[[]]"
    landed = K.landed_links(spark.createDataFrame([("CBMiA", body), ("CBMiA", body), ("CBMiC", "no answer"), ("CBMiD", None)], "wrapped string, response string"))
    got = {r.row_idx: (r.canonical_url, r.resolved) for r in K.resolve_links(d, landed).collect()}
    assert got == {0: ("http://a/1", True), 1: ("http://a/2", True), 2: (f"{base}CBMiB", False), 3: ("https://news.google.com/topics/x", True), 4: (None, True), 5: ("not a link", True)}
    assert [r.wrapped for r in K.links_to_fetch(d, landed).collect()] == ["CBMiB"]


def test_prompts_leave_blank_lines_out(spark):
    d = rows(spark, {"company": "Nova", "jobs_cut_sg": 12.5, "notes": ""}, {"jobs_cut_global": 7.0, "notes": "n", "source_link": "http://a"})
    none = F.lit(None).cast("struct<event_id:string,company:string,date_announced:string>")
    empty = F.array().cast("array<struct<event_id:string,company:string,date_announced:string>>")
    got = [r.p for r in d.orderBy("row_idx").select(M.user_prompt(M.hints_text(none, empty)).alias("p")).collect()]
    assert got == ["Title/Company: Nova\nDate: 2026-05-01\nSource URL: \nJobs cut SG (scraped): 12.5", "Title/Company: Orbit\nDate: 2026-05-01\nSource URL: http://a\nJobs cut global (scraped): 7\nNotes/snippet: n"]
