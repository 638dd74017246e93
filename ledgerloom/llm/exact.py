"""Exact deduplication by an exchange of Golomb-coded fingerprints.

Each task sorts the hashes of its texts without white space and sends every owner one compressed list; the
bitmaps that come back name the suspects. Only suspects' texts are shuffled, grouped by their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import join_counted, stage
from ledgerloom.llm.exchange import owner_starts, owners_for, repeated, sent

#: Fixed value: what does not count in a comparison.
BLANKS = " \t\n\x0b\f\r"
SENDER = 1 << 17
BIG = (1 << 63) - 1


def exact_dedup(docs: DataFrame, hash_bits: int = 48, broadcast_hashes: int = 1_000_000, row: str | None = None) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256 (and `row`, if named).

    Texts are equal when identical without ASCII white space; null counts as empty, so empty, blank and null
    texts form one group. Of equal texts the one with the most code points stays, then the smallest doc_id
    (null last), then one of the repeated rows. An empty table gives no rows; other columns are not read.
    `broadcast_hashes` bounds the hash sets that are broadcast to find the suspects; larger ones are joined. A group of
    copies of any size stays where its rows are: what is kept of it is broadcast to them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    bare = F.translate(text, BLANKS, "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col(row).cast("long") if row else F.lit(None).cast("long")).alias("row"), F.length(text).alias("n_chars"), bare.alias("bare")).select(
        "doc_id", "row", "n_chars", F.unhex(F.sha2("bare", 256)).alias("sha"), F.shiftrightunsigned(F.xxhash64("bare"), 64 - hash_bits).alias("key")
    )
    total = docs.count()
    owners = owners_for(docs, total)
    starts = owner_starts(owners, hash_bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, held, n = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            keys, back, counts = np.unique(t.column("key").to_numpy().astype(np.uint64), return_inverse=True, return_counts=True)
            own = np.searchsorted(starts, keys, "right") - 1
            rank = np.arange(len(keys)) - np.searchsorted(own, own)
            sender, m = (part << 20) + turn, len(back)
            t = t.append_column("sender", pa.array(np.full(m, sender))).append_column("owner", pa.array(own[back])).append_column("rank", pa.array(rank[back]))
            t = t.append_column("rid", pa.array((sender << 18) + np.arange(m)))
            for c, kind in (("n", pa.int64()), ("coded", pa.binary()), ("twice", pa.binary())):
                t = t.append_column(c, pa.nulls(m, kind))
            t = pa.table([c.combine_chunks() for c in t.columns], names=t.column_names)
            yield from t.to_batches()
            blobs = list(sent(keys, counts, starts))
            cols = {"owner": [b[0] for b in blobs], "n": [b[1] for b in blobs], "coded": [b[2] for b in blobs], "twice": [b[3] for b in blobs], "sender": [sender] * len(blobs)}
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(blobs), f.type) for f in t.schema], names=t.schema.names)

        for whole in batches:
            # a sender's rows are numbered in 18 bits, whatever the size of batches
            for lo in range(0, whole.num_rows, SENDER):
                b = whole.slice(lo, SENDER)
                held.append(b)
                n += b.num_rows
                if n >= SENDER:
                    yield from flush()
                    turn, held, n = turn + 1, [], 0
        if n:
            yield from flush()

    out = stage(rows.mapInArrow(send, "doc_id long, row long, n_chars int, sha binary, key long, sender long, owner long, rank long, rid long, n long, coded binary, twice binary"), "fingerprints")
    bits = repeated(out.filter("coded is not null").select("sender", "owner", "coded", "twice", F.lit(None).cast("binary").alias("check")))
    flag = F.coalesce(F.getbit(F.expr("get(bits, int(rank div 64))"), F.expr("int(rank % 64)")) == 1, F.lit(False))
    seen = out.filter("coded is null").select("doc_id", "row", "n_chars", "sha", "key", "sender", "owner", "rank", "rid")
    seen = stage(seen.join(bits, ["sender", "owner"], "left").select("doc_id", "row", "n_chars", "sha", "key", "rid", flag.alias("suspect")), "suspects")

    keys = seen.filter("suspect").select("key").distinct()
    fetched = docs.select(bare.alias("bare")).withColumn("key", F.shiftrightunsigned(F.xxhash64("bare"), 64 - hash_bits))
    keys_n = keys.count()
    suspects = fetched.join(F.broadcast(keys) if keys_n <= broadcast_hashes else keys, "key", "left_semi")
    verified = suspects.groupBy("key", "bare").agg(F.count("*").alias("copies")).filter("copies > 1").select(F.unhex(F.sha2("bare", 256)).alias("sha"), "copies")
    best = F.max(F.struct("n_chars", (-F.coalesce("doc_id", F.lit(BIG))).alias("low"), (-F.col("rid")).alias("rid"))).alias("best")
    groups = seen.filter("suspect").groupBy("sha").agg(best).join(verified, "sha")
    groups = groups.select("sha", "copies", F.expr(f"nullif(-best.low, {BIG})").alias("keep_id"), (-F.col("best.rid")).alias("keep_rid"))
    groups = stage(groups, "groups")
    extra = [row] if row else []
    hexed = F.lower(F.hex("sha")).alias("text_sha256")
    base = seen.withColumnRenamed("row", row or "row")
    alone = base.filter("not suspect").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed, *extra)
    named = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", *extra]
    mates = join_counted(base.filter("suspect"), groups.withColumn("n", F.col("copies")), "sha", "n", total)
    mates = mates.select("doc_id", "keep_id", F.col("copies").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), hexed, *extra)
    # suspects by a fingerprint that others share by chance; as rare as that is, they may well lie on the rows of broadcast keys
    chance = base.filter("suspect").join(groups.select("sha") if keys_n > broadcast_hashes else F.broadcast(groups.select("sha")), "sha", "left_anti")
    chance = chance.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), hexed, *extra)
    shared = mates.unionByName(chance).select(named)
    return alone.unionByName(shared)
