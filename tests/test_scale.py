"""Work that must not gather in the driver or in one task, and results that it leaves as they are."""

import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.functions import text as X
from ledgerloom.operators import audit as A
from ledgerloom.operators import integrity as V
from ledgerloom.operators import projections as P
from ledgerloom.operators.components import stage
from ledgerloom.operators.names import company_names
from tests.test_ledger import rows


def test_staged_rows_are_not_broadcast_by_the_size_of_their_file(spark, capsys):
    staged = stage(spark.range(400_000).select("id", F.lit("x" * 90).alias("text")), "rows")
    staged.join(spark.range(0, 4_000_000_000, 3), "id").explain()
    assert "SortMergeJoin" in capsys.readouterr().out


def test_an_offset_does_not_gather_all_rows_in_one_task(spark):
    e = rows(spark, *({"source_link": f"http://s.sg/{i}"} for i in range(40))).repartition(8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = P.archive_links(e, "2026", ["confirmed"], offset=5)
        assert out.rdd.getNumPartitions() > 1
        assert [r.row_idx for r in out.collect()] == list(range(5, 40))
        assert [r.row_idx for r in P.archive_links(e, "2026", ["confirmed"], 5, 3).collect()] == [5, 6, 7]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_examples_rank_only_what_a_report_cuts(spark):
    found = [("vague-company", [i], f"v{i}") for i in range(9)] + [("duplicate", [i], f"d{i}") for i in range(50)] + [(None, [1], "n")]
    d = spark.createDataFrame(found, "type string, rows array<int>, identity string").repartition(6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = A.examples(d)
        kept = out.filter("type <> 'vague-company'").groupBy(F.spark_partition_id()).count().count()
        assert kept > 1
        assert sorted(r.identity for r in out.collect()) == sorted([f"v{i}" for i in range(5)] + [f"d{i}" for i in range(50)] + ["n"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_a_name_of_many_rows_stays_where_it_is(spark, monkeypatch):
    monkeypatch.setattr(P, "HOT_ROWS", 3)
    e = rows(spark, *({"company": c, "event_id": v} for c in ("Ion Ltd", "Big Ltd", None) for v in ("", "x", None)), *({"company": "Big Ltd", "event_id": ""} for _ in range(20)))
    e = e.withColumns({"rule": F.lit(None).cast("struct<company:string,industry:string,verdict:string,notes:string>"), "final_verdict": F.lit("queue"), "reason": F.lit("r")})
    out = {r.row_idx: r.event_id for r in P.to_entry(e).collect()}
    want = {"Ion Ltd": "ion-2026-05", "Big Ltd": "big-2026-05", None: "event-2026-05"}
    assert out == {r.row_idx: r.event_id or want[r.company] for r in e.collect()}


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keys_by_fixed_aliases_move_no_rows(spark):
    """rows are keyed where they stand, each step once."""
    e = spark.range(50).selectExpr("id AS row_idx", "concat('Cafe ', id, ' Pte Ltd') AS company")
    for aliases in (None, {}, {"acme": "Zed"}, company_names(e.select("company"))):
        keyed = X.with_company_key(e, aliases=aliases)
        plan = optimized(keyed)
        assert "Join" not in plan and "Aggregate [" not in plan
        assert plan.count("initcap(") == 1 and plan.count("without_marks(") == 1
        assert [r.k for r in keyed.orderBy("row_idx").limit(2).collect()] == ["cafe 0", "cafe 1"]


def test_keys_of_odd_letters(spark):
    """Letters that are told alone, and those that Python sees, give what decomposition gives."""
    marked = ["Pâtisserie", "Ệ ấ", "한글", "が", "क़", "áְ֑", "̈́x", "\U0001d15e", "Ångström", "K", "", None]
    texts = marked + [f"a{chr(n)}֑{chr(n)}" for n in range(0x80, 0xD800, 7)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.unmarked(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == X.without_marks(pd.Series(texts, dtype=object)).tolist()


def test_endings_go_in_order(spark):
    names = {"Acme Group Bank": "acme group", "Acme Bank Group": "acme", "Acme Cafe Ltd": "acme", "Acme Ltd Cafe": "acme ltd", "Acme PTE LTD.": "acme", "Acme Ltd Ltd": "acme ltd", "Ltd": "ltd", "Acme Asia Pacific": "acme", "Acme & Co Bar & Grill,": "acme and co bar and grill"}
    rows = X.with_company_key(spark.createDataFrame([(n,) for n in names], "company string")).collect()
    assert {r.company: r.k for r in rows} == names


def test_token_rule_hashes_no_stopwords_per_row(spark):
    """F12 and the audit: stopwords are looked up, not taken away as an array."""
    d = spark.createDataFrame([("Brand Acme acme holdings xy",), (None,)], "c string").select(V.significant_tokens(F.col("c"), V.STOPWORDS).alias("t"), V.significant_tokens(F.col("c"), []).alias("u"))
    assert "array_except" not in optimized(d)
    assert [tuple(r) for r in d.collect()] == [(["brand", "acme"], ["brand", "acme", "holdings"]), ([], [])]
