"""Mixing sources to target weights by the cube method.

Sources get targets by weight, capped at so many times their own size. A source's documents are each taken
a whole number of times, and once more with the same fractional probability. The flight phase of the cube
method decides those: probabilities move along the null space of the balancing constraints (documents and
words), until one of them reaches 0 or 1. Blocks of a source fly apart in parallel and leave two or a few
documents undecided each; these fly again together, level by level. The landing keeps to the words that are
due and drops the number of documents. Large documents fly first, so mostly small ones are left to land.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import stage, word_pattern

BLOCK = 512
EPS = 1e-9


def targets(sizes: DataFrame, most: int = 3, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) of a (source, size) table, one row per source.

    Sources by code point, null last, weigh in turn. Capping and resharing by weight comes to one factor for
    all uncapped sources; they are the ones with the largest room per weight, so a running sum over the
    sources finds it. The table has one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (order % len(weights) + 1).cast("int")).cast("double"))
    s = s.withColumn("room", most * F.col("source_size") / F.col("weight"))
    by_room = Window.orderBy("room", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    capped = F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))
    free = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    s = s.withColumn("factor", (F.sum("source_size").over(every) - capped) / free)
    # the first source whose share fits its room settles the factor
    s = s.withColumn("factor", F.min(F.when(F.col("factor") <= F.col("room"), F.struct("room", "factor"))).over(every)["factor"])
    target = F.least(F.col("weight") * F.col("factor"), (most * F.col("source_size")).cast("double"))
    return s.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def fly(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """Move units' probabilities to 0 or 1, keeping their expected number and total size; largest units first.

    A unit moves against all that are left, by amounts linear in their sizes, which is a direction in the
    null space of both constraints; each move ends with a unit at 0 or 1. At most two units, and such as no
    others can balance, stay undecided; none after landing.
    """
    p, open_ = chances.astype(float), np.flatnonzero((chances > EPS) & (chances < 1 - EPS))
    stuck: list[int] = []
    while len(open_) > 2:
        i, rest = open_[0], open_[1:]
        s, n = sizes[rest], len(rest)
        s1, det = s.sum(), n * (s * s).sum() - s.sum() ** 2
        if det > 1e-9 * max(1.0, s1 * s1):
            slope = (s1 - n * sizes[i]) / det
            d = -(1 + slope * s1) / n + slope * s
        elif s1 > 0:
            d = np.full(n, -sizes[i] / s1)
        elif sizes[i] > 0:
            stuck.append(i)
            open_ = rest
            continue
        else:
            d = np.full(n, -1 / n)
        d[np.abs(d) < 1e-15] = 0.0
        v, q = np.append(1.0, d), p[open_]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(v > 0, (1 - q) / v, np.where(v < 0, -q / v, np.inf)))
            down = np.min(np.where(v > 0, q / v, np.where(v < 0, (q - 1) / v, np.inf)))
        q = q + v * (up if rng.random() * (up + down) < down else -down)
        p[open_] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    if land:
        last = np.array(sorted([*stuck, *open_]), np.int64)
        due = float((p[last] * sizes[last]).sum())
        for k, i in enumerate(last):
            left = float(sizes[last[k:]].sum())
            p[i] = float(rng.random() < (min(1.0, max(0.0, due / left)) if left else p[i]))
            due -= p[i] * sizes[i]
    return p


def fly_in_chunks(sizes: np.ndarray, chances: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """`fly` for any number of units: chunks of BLOCK fly apart, what they leave flies again, so work grows with the number of units, not its square."""
    p = chances.astype(float)
    while True:
        left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
        if len(left) <= BLOCK:
            break
        for lo in range(0, len(left), BLOCK):
            own = left[lo : lo + BLOCK]
            p[own] = fly(sizes[own], p[own], rng, False)
        if ((p > EPS) & (p < 1 - EPS)).sum() == len(left):
            break
    return fly(sizes, p, rng, land)


def mix_sources(docs: DataFrame, most: int = 3, seed: int = 7, row: str | None = None) -> DataFrame:
    """A row per document: doc_id, source, size, source_size, target, copies, taken (and `row`, if named).

    size is the number of words (null text: none), taken is size times copies, and copies is at most `most`.
    Null is a source of its own. A source without words is taken zero times; repeated rows are decided one
    by one; an empty table gives no rows; other columns are not read. A row is drawn by its doc_id, text and source,
    null or not, so the same table gives the same draws in any layout; rows alike in all three are interchangeable.
    """
    units = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(word_pattern)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("mark"), (F.col(row) if row else F.lit(None).cast("long")).alias("row"),
    )
    units = stage(units, "sizes")
    counts = units.groupBy("source").agg(F.count("*").alias("n"))
    shares = targets(units, most).alias("t").join(counts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.*", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    ratio = F.when(F.abs(ratio - F.round(ratio)) < EPS, F.round(ratio)).otherwise(ratio)
    shares = stage(shares.withColumn("whole", F.floor(ratio)).withColumn("chance", ratio - F.floor(ratio)).withColumn("name", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))), "shares").alias("s")
    most_blocks = shares.agg(F.max("blocks")).first()[0] or 1
    drawn = F.xxhash64("u.mark", "u.size", F.lit(seed))
    flying = units.alias("u").join(shares, F.col("u.source").eqNullSafe(F.col("s.source"))).select(
        "u.doc_id", "u.row", "u.source", "u.size", "source_size", "target", "whole", "chance", "name", F.pmod(drawn, "blocks").alias("block"), F.col("blocks"), drawn.alias("turn")
    )
    keep = [c for c in flying.columns]
    done = [flying.filter("chance = 0")]
    flying = flying.filter("chance > 0")

    def flight(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(["size", "turn", "doc_id"], ascending=[False, True, True])
        rng = np.random.default_rng([seed, int(g["block"].iloc[0]), *g["name"].iloc[0].encode()])
        return g.assign(chance=fly_in_chunks(g["size"].to_numpy(float), g["chance"].to_numpy(float), rng, bool(g["blocks"].iloc[0] <= 1)))

    schema = flying.schema
    while True:
        out = stage(flying.groupBy("name", "block").applyInPandas(flight, schema), "flight")
        if most_blocks <= 1:
            done.append(out)
            break
        done.append(out.filter("chance = 0 or chance = 1"))
        flying = out.filter("chance > 0 and chance < 1").withColumn("block", F.expr(f"block div {BLOCK // 2}")).withColumn("blocks", F.ceil(F.col("blocks") / (BLOCK // 2))).select(keep)
        most_blocks = -(-most_blocks // (BLOCK // 2))
    all_done = done[0]
    for d in done[1:]:
        all_done = all_done.unionByName(d)
    copies = F.round(F.col("whole") + F.col("chance")).cast("long")
    out = all_done.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"), "row")
    return out.withColumnRenamed("row", row) if row else out.drop("row")
