"""Token-ID output: flat unsigned integer shards with 64-bit document offsets, memory-mapped by readers.

A folder holds, per range of documents in ascending doc_id order and under a name of its own,
  ids-NAME.bin      all ids of its documents, little-endian unsigned 16 or 32 bits (the vocabulary decides)
  offsets-NAME.bin  documents + 1 little-endian signed 64-bit offsets into that shard, in ids
  docs-NAME.bin     the doc_ids, little-endian signed 64-bit (null: the smallest value)
and index.json, which lists the shards in order with their base: the ids and documents before them, from a
prefix sum over the shards. A document's global start is its shard's base plus its offset.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import create, filesystem, slices
from ledgerloom.llm.encoding import encoder

NULL_ID = -(1 << 63)
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, range_bytes: int = 1 << 28) -> dict:
    """Encode the whole text of every row and write the shards; returns the index.

    Rows are range-partitioned and sorted by doc_id (null first), ties by a hash of the text, so shards follow each
    other in ascending order and rows that share a doc_id can lie in several. Null text counts as empty and yields
    the end id alone; repeated rows are all written; an empty table yields an index without shards; only doc_id and
    text are read. A task takes about `range_bytes` of text and writes as it goes, 4 MB of text at a time; one row
    per shard comes to the driver. File names hold a mark of the attempt, and the index lists those of finished tasks.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, total, docs_seen = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0
        name = f"{part:05d}-{uuid.uuid4().hex}"
        with ExitStack() as open_files:
            files: dict[str, pa.NativeFile] = {}
            for b in batches:
                column = b.column("text").fill_null("")
                for lo, hi in slices(pc.binary_length(column).to_pylist(), 4_000_000):
                    if not files:
                        files = {k: open_files.enter_context(create(f"{folder}/{k}-{name}.bin")) for k in ("ids", "offsets", "docs")}
                        files["offsets"].write(np.zeros(1, "<i8").tobytes())
                    ids, n = enc.encode_column(column.slice(lo, hi - lo), end_id)
                    files["ids"].write(ids.tobytes())
                    files["offsets"].write((total + np.cumsum(n)).astype("<i8").tobytes())
                    files["docs"].write(b.column("doc_id").slice(lo, hi - lo).cast(pa.int64()).fill_null(NULL_ID).to_numpy().astype("<i8").tobytes())
                    total, docs_seen = total + len(ids), docs_seen + hi - lo
        if docs_seen:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "name": pa.array([name]), "docs": pa.array([docs_seen], pa.int64()), "ids": pa.array([total], pa.int64())})

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("turn")).repartitionByRange(ranges, "doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    shards, base, first = [], 0, 0
    for r in sorted(rows.mapInArrow(write, "part long, name string, docs long, ids long").collect()):
        shards.append({"name": r.name, "docs": r.docs, "ids": r.ids, "base": base, "first": first})
        base, first = base + r.ids, first + r.docs
    index = {"dtype": encoder(tokenizer).dtype.str, "documents": first, "ids": base, "end_id": end_id, "shards": shards}
    with create(f"{folder}/index.json") as out:
        out.write(json.dumps(index).encode())
    return index


class TokenFiles:
    """Reader: maps a shard's files and gives the ids of any document of it."""

    def __init__(self, folder: str, name: str, dtype: str) -> None:
        self.dtype = np.dtype(dtype)
        self.offsets, self.docs = (self._map(f"{folder}/{k}-{name}.bin", "<i8") for k in ("offsets", "docs"))
        self.ids = self._map(f"{folder}/ids-{name}.bin", dtype)

    @staticmethod
    def _map(uri: str, dtype: str) -> np.ndarray:
        fs, path = filesystem(uri)
        if fs.type_name == "local":
            return np.memmap(path, dtype, "r")
        with fs.open_input_file(path) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    def __len__(self) -> int:
        return len(self.docs)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.ids[self.offsets[i] : self.offsets[i + 1]]


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as unsigned 32 bits). A task maps a shard."""
    fs, path = filesystem(f"{folder}/index.json")
    with fs.open_input_stream(path) as f:
        index = json.loads(f.read())
    dtype = index["dtype"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                shard = TokenFiles(folder, name, dtype)
                for lo, hi in slices(np.diff(shard.offsets).tolist(), 2_000_000):
                    edge = shard.offsets[lo : hi + 1]
                    wide, at = memoryview(shard.ids[edge[0] : edge[-1]].astype("<u4")).cast("B"), (4 * (edge - edge[0])).tolist()
                    doc = shard.docs[lo:hi]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc, pa.int64(), mask=doc == NULL_ID), pa.array(edge[:-1] + base), pa.array(np.diff(edge)), pa.array([zlib.crc32(wide[x:y]) for x, y in zip(at, at[1:], strict=False)], pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    shards = spark.createDataFrame([(s["name"], s["base"]) for s in index["shards"]], "name string, base long")
    return shards.repartition(max(1, len(index["shards"])), "name").mapInArrow(digest, DIGEST)
