"""Linking rows to events: clusters, sliding groups, vetoed unions and merge chains."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from datetime import date
from heapq import merge

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.text import GENERIC, Aliases, Names, gn_fingerprint, iso_date, month_base, normalize_url, row_quality, strip_chain, with_company_key
from ledgerloom.operators.components import connected_components, stage
from ledgerloom.operators.names import alias_rows, company_names

LINK_DAYS, CLUSTER_DAYS = 7, 21
AGGREGATOR, UNKNOWN = "__aggregator__", "__unknown__:"


def islands(rows: DataFrame, key: str, day: str, days: int = CLUSTER_DAYS) -> DataFrame:
    """rows with `island`: per key, numbered runs whose consecutive dates lie within `days`; no date, no island.

    Runs are found among a key's distinct dates, which no number of rows on a date can swell, and joined back.
    """
    return rows.join(runs_of(rows, key, day, days), [key, day])


def runs_of(rows: DataFrame, key: str, day: str, days: int = CLUSTER_DAYS) -> DataFrame:
    """(key, day, island) of the distinct dates of each key."""
    w = Window.partitionBy(key).orderBy(day)
    runs = rows.filter(F.col(day).isNotNull() & F.col(key).isNotNull()).select(key, day).distinct()
    runs = runs.withColumn("_new", F.coalesce(F.datediff(day, F.lag(day).over(w)) > days, F.lit(True)).cast("int"))
    return runs.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def slug_of(c: Column) -> Column:
    return F.trim(strip_chain(F.lower(c), (r"[^a-z0-9\s]", " "), (r"\s+", " ")))


def company_tokens(names: DataFrame, aliases: Aliases = None) -> DataFrame:
    """(key, variant, ord): the spellings under which each company is looked for; keys of aliases come first, then names (company, row_idx) in order.

    A key is the slug of the canonical name. Its variants are the slugs of the name and its aliases, also joined and
    hyphenated, and a first word of five letters or more; words that name no company are no variants.
    """
    listed = alias_rows(names.sparkSession, aliases).select("row_idx", "company", "alias")
    every = listed.withColumn("source", F.lit(0)).unionByName(names.filter("coalesce(company, '') <> ''").groupBy("company").agg(F.min("row_idx").alias("row_idx")).select("row_idx", "company", F.lit(None).cast("string").alias("alias"), F.lit(1).alias("source")))
    keys = company_names(every.select("company"), aliases=aliases.aliases if isinstance(aliases, Names) else aliases)
    named = with_company_key(every, "name", aliases=keys).withColumn("norm", slug_of(F.col("name")))
    key = F.regexp_replace("norm", " ", "-")
    first = F.substring_index("slug", " ", 1)
    forms = F.array(F.col("slug"), F.regexp_replace("slug", " ", ""), F.regexp_replace("slug", " ", "-"), F.when((F.length(first) >= 5) & ~first.isin(GENERIC), first))
    slugs = named.filter("norm <> ''").select(key.alias("key"), "source", "row_idx", F.explode(F.array_compact(F.array("norm", slug_of(F.col("alias"))))).alias("slug"))
    found = slugs.select("key", "source", "row_idx", F.explode(F.array_compact(forms)).alias("variant"))
    found = found.filter((F.col("variant") != "") & ~F.col("variant").isin(GENERIC) & ~F.col("key").isin(GENERIC))
    return found.groupBy("key", "variant").agg(F.min(F.struct("source", "row_idx")).alias("ord"))


def telling(tokens: DataFrame) -> DataFrame:
    """tokens with three companies a variant at most: that many make an aggregator of whatever names it, and more would only swell the join."""
    return tokens.withColumn("_r", F.row_number().over(Window.partitionBy("variant").orderBy("ord", "key"))).filter("_r <= 3").drop("_r")


def surfaces(company: Column, url: Column) -> tuple[Column, Column]:
    """The words that a node is searched in: its headline's, and those with its address's path."""
    words = lambda c: F.filter(F.split(c, " +"), lambda w: w != "")
    title = F.regexp_replace(F.lower(F.coalesce(company, F.lit(""))), "[^a-z0-9]+", " ")
    path = strip_chain(F.lower(F.coalesce(url, F.lit(""))), (r"^https?://[^/]+", ""), (r"(?s)[?#].*\z", ""), (r"[-_/.]+", " "), (r"(?U)\s+", " "))
    return words(title), words(F.concat(title, F.lit(" "), path))


def node_keys(nodes: DataFrame, tokens: DataFrame, aliases: Aliases = None) -> DataFrame:
    """(row_idx, key) of nodes (row_idx, company, source_link): the company that is named first in the headline, else in headline and path.

    Three or more companies make an aggregator. Without any the company key counts, if it has three letters, else the
    node is unknown. Runs of words are joined with the variants, so a text costs its words times the longest variant's. Each
    distinct headline is searched once, however many nodes have it, and the paths of those nodes only whose headline names none.
    """
    tokens = stage(tokens, "tokens")
    longest = tokens.agg(F.max(F.size(F.split("variant", " ")))).first()[0] or 1

    def named(texts: DataFrame, words: Column) -> DataFrame:
        """(id, found): the company that the words of a text (id, ...) name first, or the mark of an aggregator."""
        n = texts.select("id", words.alias("words")).select("id", "words", F.posexplode("words").alias("pos", "word"))
        grams = n.select("id", "pos", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("words") - F.col("pos"))), lambda k: F.array_join(F.slice("words", F.col("pos") + 1, k), " "))).alias("variant"))
        hits = grams.join(tokens, "variant").groupBy("id", "key").agg(F.min(F.struct("pos", "ord")).alias("at"))
        return hits.groupBy("id").agg(F.when(F.count("*") >= 3, AGGREGATOR).otherwise(F.min_by("key", "at")).alias("found"))

    title, full = surfaces(F.col("company"), F.col("source_link"))
    headlines = nodes.select(F.coalesce("company", F.lit("")).alias("company")).distinct()
    by_title = named(headlines.withColumn("id", F.col("company")), title).withColumnRenamed("id", "_title")
    keyed = with_company_key(nodes.select("row_idx", "company", "source_link"), "k", aliases=aliases)
    keyed = stage(keyed.join(by_title, F.coalesce("company", F.lit("")) == F.col("_title"), "left").drop("_title"), "titled")
    by_path = named(keyed.filter("found is null").withColumn("id", F.col("row_idx")), full).withColumnsRenamed({"id": "row_idx", "found": "_path"})
    own = F.when(F.length("k") >= 3, F.col("k")).otherwise(F.concat(F.lit(UNKNOWN), F.col("row_idx").cast("string")))
    return keyed.join(by_path, "row_idx", "left").select("row_idx", F.coalesce("found", "_path", own).alias("key"))


def cluster(nodes: DataFrame, days: int = CLUSTER_DAYS, tokens: DataFrame | None = None, aliases: Aliases = None) -> DataFrame:
    """(row_idx, cluster) of nodes: same company within `days`, same title fingerprint, or same address; linked through any of them.

    tokens default to those of the nodes' own names. Aggregators and unknown companies have no company edges.
    """
    tokens = tokens if tokens is not None else company_tokens(nodes.select("company", "row_idx"), aliases)
    keys = node_keys(nodes, telling(tokens), aliases)
    n = nodes.join(keys, "row_idx").select("row_idx", F.when(~(F.col("key").startswith(UNKNOWN) | (F.col("key") == AGGREGATOR)), F.col("key")).alias("k"), iso_date(F.col("date_announced")).alias("d"), gn_fingerprint(F.col("notes")).alias("gn"), F.nullif(F.lower("source_link"), F.lit("")).alias("url"))
    n = stage(n, "nodes")
    dated = stage(islands(n, "k", "d", days).select("row_idx", "k", "island"), "islands")
    own = dated.groupBy("k", "island").agg(F.min("row_idx").alias("island_idx"))
    n = n.join(dated.join(own, ["k", "island"]).select("row_idx", "island_idx"), "row_idx", "left")
    n = stage(n.select("row_idx", F.coalesce("island_idx", "row_idx").alias("island_idx"), "gn", "url"), "islanders")
    comps = connected_components(between(n, "island_idx", "gn").unionByName(between(n, "island_idx", "url")))
    return n.join(comps, n["island_idx"] == comps["node"], "left").select("row_idx", F.coalesce("component", "island_idx").alias("cluster"))


def between(rows: DataFrame, group: str, key: str) -> DataFrame:
    """(a, b): an edge from each group of a key to the first group of it, where a key has several; null keys have none.

    Groups named by their smallest row stand for their rows, so that components follow from far fewer edges than rows.
    """
    kept = rows.select(F.col(group).alias("a"), key).filter(F.col(key).isNotNull()).distinct()
    first = kept.groupBy(key).agg(F.min("a").alias("b"), F.count("*").alias("n")).filter("n > 1").select(key, "b")
    return kept.join(first, key).select("a", "b").filter("a <> b")


def to_first(rows: DataFrame, *key: str) -> DataFrame:
    """(a, b): an edge from each row to the first one of its key; null keys have none.

    The first rows come from a combining count and are joined back, one a key, so a key with many rows is neither sorted nor held.
    """
    kept = rows.select("row_idx", *key).filter(" and ".join(f"{k} is not null" for k in key))
    return kept.join(kept.groupBy(*key).agg(F.min("row_idx").alias("b")), list(key)).select(F.col("row_idx").alias("a"), "b")


def day_number(text: str | None) -> int | None:
    try:
        return date.fromisoformat(text).toordinal() if text and len(text) == 10 else None
    except ValueError:
        return None


#: Pairs of events that must never meet: a frame (a, b), or a short list.
Distinct = DataFrame | list[tuple[str, str]] | None


def pair_frame(rows: DataFrame, distinct: Distinct) -> DataFrame | None:
    """The pairs as a frame; none at all is None."""
    if isinstance(distinct, list):
        return rows.sparkSession.createDataFrame([tuple(p) for p in distinct], "a string, b string") if distinct else None
    return distinct


def foes_of(distinct: DataFrame) -> DataFrame:
    """(event_id, foes): per event those that it must never meet, of pairs (a, b)."""
    both = distinct.select("a", "b").unionByName(distinct.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.groupBy(F.col("a").alias("event_id")).agg(F.collect_set("b").alias("foes"))


def with_foes(rows: DataFrame, distinct: DataFrame | None) -> DataFrame:
    if distinct is None:
        return rows.withColumn("foes", F.lit(None).cast("array<string>"))
    return rows.join(foes_of(distinct), "event_id", "left")


class OpenGroups:
    """The groups of one company and piece: found by the day of their anchor, in the order they were opened.

    A day's groups are a sorted list; the first group that may take a row is the least of the lists of the days around
    it, so a row looks at 2 * days + 1 lists and at groups that veto it, whatever the number of groups.
    """

    def __init__(self, days: int) -> None:
        self.days, self.at = days, {}
        self.anchor: list[int | None] = []
        self.foes: list[set[str] | None] = []
        self.first: list[int] = []

    def take(self, day: int | None, event: str | None, foes: list[str] | None, row: int, joins: bool = True) -> int:
        """The first row of the group that takes the row; day None means undated. A row that doesn't join opens a group that none joins."""
        near = (None,) if day is None else range(day - self.days, day + self.days + 1)
        lists = [self.at[d] for d in near if d in self.at] if joins else []
        for g in lists[0] if len(lists) == 1 else merge(*lists):
            if self.foes[g] is None or event not in self.foes[g]:
                break
        else:
            g = len(self.first)
            self.first.append(row)
            self.anchor.append(day)
            self.foes.append(None)
            if joins:
                self.at.setdefault(day, []).append(g)
        if foes is not None and len(foes):
            self.foes[g] = (self.foes[g] or set()).union(foes)
        if day is not None and joins and day > self.anchor[g]:
            own = self.at[self.anchor[g]]
            own.pop(bisect_left(own, g))
            if not own:
                del self.at[self.anchor[g]]
            insort(self.at.setdefault(day, []), g)
            self.anchor[g] = day
        return self.first[g]


def window_groups(entries: DataFrame, days: int = LINK_DAYS, distinct: Distinct = None, aliases: Aliases = None) -> DataFrame:
    """(row_idx, group_idx): per company, in file order, each row joins the first group that takes it, else starts one.

    A group takes a row within `days` of its anchor, which only moves forward; undated rows meet undated ones; a date that
    is none stays alone; distinct events (a, b) never meet. group_idx is the row_idx of the group's first row.

    A company's dates are cut where more than `days` lie between two neighbours: an anchor is always a date of its group, so
    no group reaches over such a gap in whatever order the rows come. Each piece is a pass of its own, and one company
    spreads over as many tasks as it has pieces; a pass holds the open groups of one piece, not its rows.
    """
    rows = with_company_key(entries.select("company", "row_idx", "date_announced", "event_id"), "k", aliases=aliases)
    rows = with_foes(rows, pair_frame(entries, distinct)).select("k", "row_idx", F.nullif("date_announced", F.lit("")).alias("text"), "event_id", "foes")
    rows = stage(rows.withColumn("day", iso_date(F.col("text"))), "dated")
    rows = rows.join(runs_of(rows, "k", "day", days), ["k", "day"], "left").withColumn("piece", F.coalesce("island", F.lit(-1).cast("long")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, groups = None, OpenGroups(days)
        for b in batches:
            out = []
            for k, piece, idx, text, event, foes in b[["k", "piece", "row_idx", "text", "event_id", "foes"]].itertuples(index=False):
                if (k, piece) != at:
                    at, groups = (k, piece), OpenGroups(days)
                day = day_number(text)
                out.append((idx, groups.take(day, event, foes, idx, joins=day is not None or not text)))
            yield pd.DataFrame(out, columns=["row_idx", "group_idx"])

    keyed = rows.select("k", "piece", "row_idx", "text", "event_id", "foes")
    return keyed.repartition("k", "piece").sortWithinPartitions("k", "piece", "row_idx").mapInPandas(run, "row_idx long, group_idx long")


def resolve_merges(merges: DataFrame, max_depth: int = 50) -> DataFrame:
    """(from_event_id, target, depth) at the end of each chain of (from_event_id, to_event_id); blank, self, conflicting and cyclic merges raise."""
    m = merges.select(F.trim("from_event_id").alias("f"), F.trim("to_event_id").alias("t")).distinct()
    if m.filter("coalesce(f, '') = '' or coalesce(t, '') = '' or f = t").limit(1).count():
        raise ValueError("a merge is blank or names itself")
    if m.groupBy("f").count().filter("count > 1").limit(1).count():
        raise ValueError("an event is merged into two targets")
    done = stage(m.select("f", "t", F.lit(1).alias("depth")), "merges")
    for _ in range(max_depth):
        nxt = done.alias("x").join(done.alias("y"), F.col("x.t") == F.col("y.f"), "left")
        if nxt.filter(F.col("x.f") == F.col("y.t")).limit(1).count():
            raise ValueError("merges form a cycle")
        if not nxt.filter("y.f is not null").limit(1).count():
            return done.select(F.col("f").alias("from_event_id"), F.col("t").alias("target"), "depth")
        done = stage(nxt.select("x.f", F.coalesce("y.t", "x.t").alias("t"), (F.col("x.depth") + F.coalesce("y.depth", F.lit(0))).alias("depth")), "merges")
    raise ValueError("merges form a cycle")


def assert_merges(resolved: DataFrame, entries: DataFrame, distinct: DataFrame | None = None) -> None:
    """Raises if a resolved merge contradicts a distinct pair (pair), or its target has no entry."""
    if distinct is not None:
        pair = F.array_join(F.array_sort(F.array("from_event_id", "target")), " + ")
        if r := resolved.withColumn("pair", pair).join(distinct, "pair", "left_semi").first():
            raise ValueError(f"merge of {r.from_event_id} into {r.target} contradicts the distinct events")
    if r := resolved.join(entries.select(F.col("event_id").alias("target")), "target", "left_anti").first():
        raise ValueError(f"merge target {r.target} of {r.from_event_id} has no entry")


def link_changes(linked: DataFrame) -> DataFrame:
    """The rows of `link_events` whose event changes."""
    return linked.filter("event_id is distinct from new_event_id")


def dedup_by_deletion(entries: DataFrame, days: int = LINK_DAYS, aliases: Aliases = None) -> DataFrame:
    """The best row, then the first, of each company window; the others go."""
    best = F.min_by("row_idx", F.struct((-row_quality()).alias("q"), "row_idx")).alias("row_idx")
    kept = entries.join(window_groups(entries, days, aliases=aliases), "row_idx").groupBy("group_idx").agg(best).select("row_idx")
    return entries.join(kept, "row_idx", "left_semi")


def link_events(entries: DataFrame, merges: DataFrame | None = None, distinct: Distinct = None, aliases: Aliases = None) -> DataFrame:
    """(row_idx, event_id, new_event_id): every row adopts the id of its group's canonical row.

    Groups are joined where rows share a company window, an address, or company and month base. Distinct events (a, b)
    veto a join; then the groups of a component that holds both sides of a pair are joined one edge at a time, in file
    order. A company window has no such pair within, and its edges come first, so each is one node of that pass.
    """
    e, distinct = entries, pair_frame(entries, distinct)
    if merges is not None:
        r = resolve_merges(merges)
        assert_merges(r, entries, None if distinct is None else distinct.select(F.array_join(F.array_sort(F.array("a", "b")), " + ").alias("pair")))
        e = e.join(r, e["event_id"] == r["from_event_id"], "left").withColumn("event_id", F.coalesce("target", "event_id")).drop("from_event_id", "target", "depth")
    names = company_names(entries.select("company"), aliases=aliases)
    groups = window_groups(e, distinct=distinct, aliases=names)
    month = F.concat("k", F.lit("|"), month_base(F.col("event_id")))
    n = with_company_key(e, "k", aliases=names).join(groups, "row_idx")
    n = stage(n.select("row_idx", "event_id", "group_idx", row_quality().alias("quality"), F.nullif(normalize_url(F.col("source_link")), F.lit("")).alias("url"), month.alias("month")), "linked")
    comps = connected_components(between(n, "group_idx", "url").unionByName(between(n, "group_idx", "month")))
    n = n.join(comps, n["group_idx"] == comps["node"], "left").withColumn("root", F.coalesce("component", "group_idx")).drop("node", "component")
    if distinct is not None:
        n = stage(n, "rooted")
        at = n.select("root", "event_id").distinct()
        pairs = distinct.select(F.col("a").alias("event_id"), "b").distinct()
        cut = at.join(pairs, "event_id").select("root", F.col("b").alias("event_id")).join(at, ["root", "event_id"], "left_semi").select("root").distinct()
        mine = with_foes(n.join(stage(cut, "cut"), "root", "left_semi").select("root", "row_idx", "group_idx", "event_id", "url", "month"), distinct)
        mine = stage(mine, "cut-rows")
        nodes = mine.groupBy("root", "group_idx").agg(F.collect_set("event_id").alias("ids"), F.array_distinct(F.flatten(F.collect_set(F.coalesce("foes", F.array().cast("array<string>"))))).alias("foes"))
        side = lambda c: mine.select(F.col("row_idx").alias(c), F.col("group_idx").alias(f"group_{c}"), *([F.col("root").alias("link_root")] if c == "a" else []))
        edges = to_first(mine, "url").withColumn("kind", F.lit(1)).unionByName(to_first(mine, "month").withColumn("kind", F.lit(2)))
        links = edges.join(side("a"), "a").join(side("b"), "b").filter("group_a <> group_b")
        links = links.groupBy("link_root", "group_a", "group_b").agg(F.min(F.struct("kind", "a", "b")).alias("turn"))
        parts = nodes.groupBy("root").cogroup(links.select("link_root", "group_a", "group_b", "turn.*").groupBy("link_root")).applyInPandas(_united, "group_idx long, part long")
        n = n.join(parts, "group_idx", "left").withColumn("root", F.coalesce("part", "root")).drop("part")
    best = n.groupBy("root").agg(F.min_by("event_id", F.struct((-F.col("quality")).alias("q"), "row_idx")).alias("canonical"))
    return n.join(best, "root").select("row_idx", "event_id", F.coalesce(F.nullif(F.trim("canonical"), F.lit("")), "event_id").alias("new_event_id"))


def _united(key: tuple, nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    """Groups joined edge by edge where no pair of distinct events would meet; a part is named by its smallest group."""
    own = {g: g for g in nodes["group_idx"]}
    ids = {g: set(x) for g, x in zip(nodes["group_idx"], nodes["ids"], strict=True)}
    foes = {g: set(x) for g, x in zip(nodes["group_idx"], nodes["foes"], strict=True)}

    def find(g: int) -> int:
        while own[g] != g:
            own[g] = g = own[own[g]]
        return g

    for _, _, _, a, b in sorted(links[["kind", "a", "b", "group_a", "group_b"]].itertuples(index=False)):
        x, y = sorted((find(a), find(b)))
        if x != y and ids[x].isdisjoint(foes[y]):
            own[y] = x
            # the smaller side moves
            for kind in (ids, foes):
                small, large = sorted((kind[x], kind.pop(y)), key=len)
                large |= small
                kind[x] = large
    return pd.DataFrame({"group_idx": nodes["group_idx"], "part": [find(g) for g in nodes["group_idx"]]})
