"""A Merkle manifest of a table: a tree per source, a tree over their roots, and a proof for every row.

Leaves get their place by a range sort and prefix sums, runs of `width` consecutive nodes become their parents
level by level, and proofs come by pointer jumping: every inner node holds the segment of sibling runs on the way
to an ancestor; each self-join appends the ancestor's own segment and takes over its ancestor, so the distance
doubles until all have met the root.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage

#: Fields of a leaf in their order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Ancestors that are broadcast to their descendants at most; more are joined. From four levels up they are fewer than one in 4096 nodes.
BROADCAST_ROWS, FAR = 100_000, 4
#: Key of the tree over the sources' roots; a source's own key is never empty.
TOP = ""


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 byte count, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf(text: str | Column = "text") -> Column:
    return F.sha2(F.concat(*(field(F.col(c) if c != "text" or isinstance(text, str) else text) for c in FIELDS)), 256)


def placed(rows: DataFrame, keys: list[str], tree: str) -> DataFrame:
    """rows with `idx`, their place from 0 within `tree` by the other keys: sorted over ranges of all keys, numbered there, and raised by what earlier ranges hold of the tree."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n = TaskContext.get().partitionId(), None, 0
        for b in batches:
            own = b.column(tree).to_pylist()
            at = np.empty(len(own), np.int64)
            for i, t in enumerate(own):
                n = n + 1 if t == last else 0
                at[i], last = n, t
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(own), part)), pa.array(at)], names=[*b.schema.names, "part", "at"])

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    out = stage(ranged.mapInArrow(number, f"{schema}, part long, at long"), "places")
    # a tree that goes on from an earlier range is the first of its own, so there are no more such rows than ranges
    held = out.groupBy(tree, "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = held.withColumn("base", before).filter("base is not null").select(tree, "part", "base")
    return out.join(F.broadcast(base), [tree, "part"], "left").withColumn("idx", F.col("at") + F.coalesce("base", F.lit(0))).drop("part", "at", "base")


def grown(nodes: DataFrame, width: int, keep: list[str]) -> tuple[list[DataFrame], DataFrame]:
    """(levels, tops) over nodes of tree, idx, digest: a level holds the runs that became parents, with their digest, the children's
    digests one after another, and at the first level the children with what `keep` names. A tree's last node alone is its top.
    """
    levels, tops, current, first = [], [], nodes, True
    while True:
        own = ["idx", "digest", *(keep if first else [])]
        runs = current.groupBy("tree", F.expr(f"idx div {width}").alias("up")).agg(F.array_sort(F.collect_list(F.struct(*own))).alias("kids"))
        alone = (F.col("up") == 0) & (F.size("kids") == 1)
        runs = stage(runs.withColumn("alone", alone).withColumn("digest", F.sha2(F.array_join(F.col("kids.digest"), ""), 256)), "runs")
        tops.append(runs.filter("alone").select("tree", F.col("kids")[0]["digest"].alias("digest"), F.lit(len(levels)).alias("level")))
        levels.append(runs)
        current, first = runs.filter("not alone").select("tree", F.col("up").alias("idx"), "digest"), False
        if current.isEmpty():
            return levels, reduce(DataFrame.unionByName, tops)


def node(tree: str | Column, level: int | Column, idx: str | Column) -> Column:
    """The name of an inner node: numbers first, so no tree's name can be taken for another's."""
    return F.concat_ws(":", F.lit(level) if isinstance(level, int) else level, F.col(idx) if isinstance(idx, str) else idx, F.col(tree) if isinstance(tree, str) else tree)


def children(runs: DataFrame, level: int, shift: str) -> DataFrame:
    """A row per child of the runs at a level: its number, its parent, and the segment between the two."""
    kids = F.unhex(F.array_join(F.col("kids.digest"), ""))
    step = F.struct(F.col("at").cast("int").alias("at"), kids.alias("kids"))
    each = runs.filter("not alone").select("tree", "up", "kids", F.posexplode("kids.idx").alias("at", "idx"))
    return each.select("tree", "idx", node("tree", level + 1, shift).alias("anc"), F.array(step).alias("path"))


def jumped(nodes: DataFrame) -> DataFrame:
    """(node, path) to the root for nodes of node, anc (null for the root) and path."""
    distance = 1
    while True:
        open_ = nodes.filter("anc is not null")
        wanted = open_.select("anc").distinct()
        n = wanted.count()
        if not n:
            return nodes.select("node", "path")
        far = nodes.select(F.col("node").alias("anc"), F.col("anc").alias("next"), F.col("path").alias("more"))
        if distance >= FAR and n <= BROADCAST_ROWS:
            far = F.broadcast(far.join(F.broadcast(wanted), "anc", "left_semi"))
        met = open_.join(far, "anc").select("node", F.col("next").alias("anc"), F.concat("path", "more").alias("path"))
        nodes = stage(met.unionByName(nodes.filter("anc is null")), "paths")
        distance *= 2


def merkle_proofs(docs: DataFrame, tampered: Column | None = None, width: int = 16, row: str | None = None) -> DataFrame:
    """A row per row of docs: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, proof (and `row`, if named).

    Digests are lowercase hex sha256. A leaf covers doc_id, source, lang, n_chars and text; nulls differ from blanks. Per
    source (null is one of its own and comes first) leaves ascend by doc_id, null first, then by digest; rows alike in both
    are interchangeable. Every run of `width` nodes, the last as long as it is, becomes the digest of their digests, until one
    is left; sources' roots, by name in UTF-8 order, become the root likewise, and a lone node is its own root. `proof` is the
    siblings from the leaf's run to the root, a struct (at, kids: all digests of the run in binary) a level. `tampered` replaces the
    text in the leaf that is folded with the original siblings (default: the text itself). An empty table gives no rows.
    """
    key = F.concat(F.lit("="), F.col("source").cast("string"))
    extra = [F.col(row).alias("row")] if row else [F.lit(None).cast("long").alias("row")]
    rows = docs.select("doc_id", F.coalesce(key, F.lit("-")).alias("tree"), leaf().alias("digest"), (leaf(tampered) if tampered is not None else leaf()).alias("folded"), *extra)
    rows = stage(rows.withColumn("turn", F.monotonically_increasing_id()), "leaves")
    kept = ["doc_id", "folded", "row"]
    levels, tops = grown(placed(rows, ["tree", "doc_id", "digest", "turn"], "tree").drop("turn"), width, kept)
    tops = stage(tops, "tops")
    ranked = placed(tops.withColumn("all", F.lit(TOP)), ["all", "tree"], "all").select(F.col("all").alias("tree"), "idx", "digest", F.col("tree").alias("own"), "level")
    upper, roots = grown(ranked, width, ["own", "level"])
    root = roots.first()
    root = root.digest if root else None

    # inner nodes of sources, the sources' roots, inner nodes of the tree above
    parts = [children(runs, k, "up").withColumn("node", node("tree", k, "idx")) for k, runs in enumerate(levels) if k]
    step = F.struct(F.col("at").cast("int").alias("at"), F.unhex(F.array_join(F.col("kids.digest"), "")).alias("kids"))
    above = upper[0].select("tree", "up", "kids", "alone", F.posexplode("kids").alias("at", "kid"))
    anc = F.when(~F.col("alone"), node("tree", 1, "up"))
    path = F.when(F.col("alone"), F.array().cast("array<struct<at:int,kids:binary>>")).otherwise(F.array(step))
    parts.append(above.select(node(F.col("kid.own"), F.col("kid.level"), F.lit(0)).alias("node"), anc.alias("anc"), path.alias("path")))
    for k, runs in enumerate(upper):
        if k:
            parts.append(children(runs, k, "up").withColumn("node", node("tree", k, "idx")))
    tip = upper[-1].filter("alone").select(node("tree", len(upper) - 1, F.lit(0)).alias("node"), F.lit(None).cast("string").alias("anc"), F.array().cast("array<struct<at:int,kids:binary>>").alias("path"))
    if len(upper) > 1:
        parts.append(tip)
    paths = jumped(stage(reduce(DataFrame.unionByName, (p.select("node", "anc", "path") for p in parts)), "paths"))

    runs = levels[0].withColumn("node", node("tree", F.when(F.col("alone"), 0).otherwise(1), F.when(F.col("alone"), F.lit(0)).otherwise(F.col("up"))))
    first = F.unhex(F.array_join(F.col("kids.digest"), ""))
    each = runs.join(paths, "node").select("tree", "path", "alone", first.alias("first"), F.posexplode("kids").alias("at", "kid"))
    own = F.struct(F.col("at").cast("int").alias("at"), F.col("first").alias("kids"))
    each = each.withColumn("proof", F.when(F.col("alone"), F.col("path")).otherwise(F.concat(F.array(own), F.col("path"))))
    left = lambda s: F.lower(F.hex(F.substring(s["kids"], F.lit(1), 32 * s["at"])))
    right = lambda s: F.lower(F.hex(F.substring(s["kids"], 32 * s["at"] + 33, F.octet_length(s["kids"]))))
    folded = F.aggregate("proof", F.col("kid.folded"), lambda h, s: F.sha2(F.concat(left(s), h, right(s)), 256))
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(left(s), right(s))), "")
    out = each.join(_subroots(tops), "tree").select(
        F.col("kid.doc_id").alias("doc_id"), F.col("kid.digest").alias("leaf"), "subroot", F.lit(root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"), "proof", F.col("kid.row").alias("row")
    )
    out = out.withColumn("verified", F.col("folded_root") == F.col("root"))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "proof", *([F.col("row").alias(row)] if row else []))


def _subroots(tops: DataFrame) -> DataFrame:
    """Broadcast while they are few, so that a hot source's leaves stay where they are."""
    named = tops.select("tree", F.col("digest").alias("subroot"))
    return F.broadcast(named) if tops.count() <= BROADCAST_ROWS else named


def changed_text() -> Column:
    """The text in lower case (A-Z alone) where 5 divides the unsigned crc32 of the decimal doc_id."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


#: The same in SQL; crc32 is worked out bit by bit over the digits.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT *, CASE WHEN source IS NULL THEN '-' ELSE '=' || source END AS tree, row_number() OVER () AS rid,
    CASE WHEN xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda h, b: list_reduce(list_prepend(xor(h, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 5 = 0
      THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS other
  FROM documents),
f AS (SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM d),
leaves AS (SELECT doc_id, tree, rid, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS folded FROM f),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS idx FROM leaves),
low(tree, level, idx, digest, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL SELECT tree, min(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (min(n) + 15) // 16 FROM low WHERE n > 1 GROUP BY tree, idx // 16),
subs AS (SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS idx FROM low WHERE n = 1),
high(level, idx, digest, n) AS (
  SELECT 0, idx, digest, count(*) OVER () FROM subs
  UNION ALL SELECT min(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (min(n) + 15) // 16 FROM high WHERE n > 1 GROUP BY idx // 16),
runs AS (
  SELECT tree, level, idx // 16 AS up, list(digest ORDER BY idx) AS kids FROM low WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT '', level, idx // 16, list(digest ORDER BY idx) FROM high WHERE n > 1 GROUP BY ALL),
climb(rid, own, tree, level, idx, h, sibs) AS (
  SELECT rid, tree, tree, 0, idx, folded, '' FROM placed
  UNION ALL
  SELECT c.rid, c.own, CASE WHEN r.up IS NULL THEN '' ELSE c.tree END, CASE WHEN r.up IS NULL THEN 0 ELSE c.level + 1 END, CASE WHEN r.up IS NULL THEN s.idx ELSE r.up END,
    CASE WHEN r.up IS NULL THEN c.h ELSE sha256(array_to_string(kids[:c.idx % 16], '') || c.h || array_to_string(kids[c.idx % 16 + 2:], '')) END,
    CASE WHEN r.up IS NULL THEN c.sibs ELSE c.sibs || array_to_string(kids[:c.idx % 16], '') || array_to_string(kids[c.idx % 16 + 2:], '') END
  FROM climb c LEFT JOIN runs r ON r.tree = c.tree AND r.level = c.level AND r.up = c.idx // 16 LEFT JOIN subs s ON s.tree = c.tree
  WHERE r.up IS NOT NULL OR c.tree <> ''),
tops AS (SELECT DISTINCT ON (rid) rid, h, sibs FROM climb WHERE tree = '' ORDER BY rid, level DESC),
root AS (SELECT digest FROM high WHERE n = 1)
SELECT doc_id, leaf, subs.digest AS subroot, root.digest AS root, sha256(sibs) AS proof_sha256, h AS folded_root, h = root.digest AS verified
FROM placed JOIN tops USING (rid) JOIN subs USING (tree), root
"""
