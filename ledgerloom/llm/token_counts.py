"""Token counts by a compiled tokenizer; long texts are counted in chunks by many tasks.

What a chunk does to the machine is a map from the state in which it is entered to the state and the count at its
end. White space takes every state to the starting one, so the map needs no table over states: before the chunk's
first white space stands a head, whose effect waits for the state it is entered in, then a count that holds for
every entry, then a tail, which leaves the state it has begun. Two maps compose to one of the same form, and
composing is associative; a prefix sum over the chunks that hold white space says which tails and heads meet, so
all meeting places of all texts are run at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import numbered, slices
from ledgerloom.llm.token_machine import machine

#: White space that leads every state to the starting one.
BLANK = re.compile(r"[ \t\n\r]")
#: Bytes of text that a machine is given at once.
SLICE = 4_000_000


def chunk_map(text: str, count) -> tuple[str, int, str, bool]:
    """(head, count, tail, whether the chunk holds white space); without any, all of it is head."""
    first = BLANK.search(text)
    if not first:
        return text, 0, "", False
    last = max(map(text.rfind, " \t\n\r"))
    return text[: first.start()], count(text[first.start() : last]), text[last + 1 :], True


def in_slices(column: pa.Array) -> Iterator[pa.Array]:
    for lo, hi in slices(pc.binary_length(column).to_pylist(), SLICE):
        yield column.slice(lo, hi - lo)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, chunk_chars: int = 65_536) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes (of UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null text counts as empty: no bytes, no tokens. Repeated rows, and rows whose doc_id is null or repeats, are counted
    each by itself; an empty table gives no rows; other columns are not read. A text of at most `chunk_chars` bytes is one
    chunk, counted where it is read, without a shuffle. Longer ones are written once, cut there, and their chunks dealt
    over all tasks; a stretch without white space meets again in one task, whatever its length.
    """
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text").cast("long")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [machine(tokenizer).count_column(x) for x in in_slices(b.column("text"))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(np.concatenate(n or [np.zeros(0, np.int64)]))], names=["doc_id", "n_bytes", "n_tokens"])

    whole = rows.withColumn("n_bytes", size).filter(F.col("n_bytes") <= chunk_chars).mapInArrow(counted, f"doc_id {kind}, n_bytes long, n_tokens long")
    pieces, row = numbered(rows.filter(size > chunk_chars))
    long = pieces.select("doc_id", size.alias("n_bytes"), row).join(_chunked(pieces, row, tokenizer, chunk_chars), row).drop(row)
    return whole.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def _chunked(pieces: DataFrame, row: str, tokenizer: str, chunk_chars: int) -> DataFrame:
    """(row, n_tokens) of long texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = text.as_py()
                for k, lo in enumerate(range(0, len(t), chunk_chars)):
                    yield pa.RecordBatch.from_pydict({row: pa.array([r], pa.int64()), "seq": pa.array([k], pa.int64()), "text": pa.array([t[lo : lo + chunk_chars]], pa.string())})

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(tokenizer)
        for b in batches:
            made = [chunk_map(t.as_py(), lambda x: int(m.count_column(pa.array([x], pa.string()))[0])) for t in b.column("text")]
            heads, counts, tails, solid = zip(*made, strict=True) if made else ([], [], [], [])
            yield pa.RecordBatch.from_pydict({row: b.column(row), "seq": b.column("seq"), "head": pa.array(heads, pa.string()), "n": pa.array(counts, pa.int64()), "tail": pa.array(tails, pa.string()), "blank": pa.array(map(int, solid), pa.int64())})

    def joints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [machine(tokenizer).count_column(x) for x in in_slices(b.column("text"))]
            yield pa.RecordBatch.from_pydict({row: b.column(row), "n": pc.add(b.column("n"), pa.array(np.concatenate(n or [np.zeros(0, np.int64)])))})

    key = f"`{row}`"
    chunks = pieces.select(row, "text").mapInArrow(cut, f"{key} long, seq long, text string").repartition(row, "seq")
    mapped = chunks.mapInArrow(maps, f"{key} long, seq long, head string, n long, tail string, blank long")
    # the meeting places before a chunk's head: as many as chunks with white space stand before it
    before = F.sum("blank").over(Window.partitionBy(row).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("blank")
    scanned = mapped.withColumn("joint", before)
    part = lambda joint, side, text, n: F.struct(joint.cast("long").alias("joint"), F.lit(side).alias("side"), text.alias("text"), n.cast("long").alias("n"))
    own = F.array(part(F.lit(-1), 0, F.lit(""), F.col("n")), part(F.col("joint"), 1, F.col("head"), F.lit(0)), part(F.col("joint") + F.col("blank"), 2, F.col("tail"), F.lit(0)))
    parts = scanned.select(row, "seq", F.explode(F.filter(own, lambda x: (x["text"] != "") | (x["joint"] < 0))).alias("part"))
    met = parts.groupBy(row, F.col("part.joint").alias("joint")).agg(F.array_sort(F.collect_list(F.struct("seq", "part.side", "part.text"))).alias("own"), F.sum("part.n").alias("n"))
    run = met.select(row, "n", F.array_join(F.transform("own", lambda x: x["text"]), "").alias("text")).mapInArrow(joints, f"{key} long, n long")
    return run.groupBy(row).agg(F.sum("n").alias("n_tokens"))
