"""Substring deduplication by recompression.

Words get 64-bit names. In rounds, every pair of neighbours whose left name falls in one half of the names
and whose right name in the other is renamed as one symbol, and runs of an equal left-over symbol as
another; a symbol's name is a hash of its parts' names, so the same pair or run is named alike everywhere
without a dictionary. With every symbol goes the span of words that its existence depends on: equal texts
around a passage give it equal symbols wherever that span lies within the passage.

Each window of consecutive words is thus represented by the highest symbol whose span it holds, the same
symbol at the same place in every copy of the window. Spark rounds exchange these symbols (with the words of
their span) between all chunks of the corpus; windows whose symbol is shared are verified by 128 bits of hash
of all their words in a second exchange, and the words of verified windows are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import mix, stage, texts_of
from ledgerloom.llm.exchange import BLOBS, answers, grouped, marked, owner_starts, owners_for, repeated, sent

ODD, ROUNDS = 0x9E3779B97F4A7C15, 5
BASES = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
CHUNK = 2_000_000


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Chunk:
    """The words of some documents, one after another, with rolling hashes over them."""

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.words = [t.split() for t in texts]
        self.window = window
        n = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(n)
        self.begins = self.ends - n
        coded = pa.array([w for ws in self.words for w in ws], pa.binary()).dictionary_encode()
        both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, coded.dictionary.to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
        at = coded.indices.to_numpy() if len(coded) else np.zeros(0, np.int64)
        self.names = both[at, 1]
        self.others = both[at, 0]
        self.doc = np.repeat(np.arange(len(texts)), n)
        self.lanes: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def span_hash(self, lo: np.ndarray, hi: np.ndarray, lane: int = 0) -> np.ndarray:
        """Of words lo to hi (exclusive): equal word sequences have equal hashes wherever they lie. The two lanes hash independently."""
        if lane not in self.lanes:
            base, names = BASES[lane], (self.names, self.others)[lane]
            prefix = np.append(np.uint64(0), np.cumsum(names * powers(base, len(names))[:-1], dtype=np.uint64))
            self.lanes[lane] = prefix, powers(pow(base, -1, 1 << 64), len(names))
        prefix, back = self.lanes[lane]
        return (prefix[hi] - prefix[lo]) * back[lo]

    def starts(self) -> np.ndarray:
        """Where windows start."""
        at = np.arange(len(self.names))
        return at[at + self.window <= self.ends[self.doc]]

    def levels(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per round: names, and the words [lo, hi) that each symbol depends on."""
        name, doc = self.names, self.doc
        lo = np.arange(len(name))
        hi = lo + 1
        out = [(name, lo, hi)]
        for r in range(ROUNDS if len(name) else 0):
            right = (mix(name + np.uint64(r * ODD % (1 << 64))) >> np.uint64(63)).astype(bool)
            same = doc[1:] == doc[:-1]
            pair = same & ~right[:-1] & right[1:]
            first, second = np.append(pair, False), np.append(False, pair)
            alone = ~first & ~second
            again = same & alone[1:] & alone[:-1] & (name[1:] == name[:-1])
            heads = np.flatnonzero(~(second | np.append(False, again)))
            last = np.append(heads[1:], len(name)) - 1
            before = np.where(np.append(False, same), np.append(0, lo[:-1]), self.begins[doc] - 1)
            after = np.where(np.append(same, False), np.append(hi[1:], 0), self.ends[doc] + 1)
            # an equal neighbour that a pair has taken: the pair's other half matters too
            alike = same & (name[1:] == name[:-1]) & ~again
            before = np.where(np.append(False, alike), np.append(0, before[:-1]), before)
            after = np.where(np.append(alike, False), np.append(after[1:], 0), after)
            paired = first[heads]
            count = (last - heads + 1).astype(np.uint64)
            made = np.where(paired, mix(name[heads] * np.uint64(3) + mix(name[last])), np.where(count > 1, mix(name[heads] + count * np.uint64(ODD)), name[heads]))
            lo, hi = np.where(paired, lo[heads], before[heads]), np.where(paired, hi[last], after[last])
            name, doc = made, doc[heads]
            out.append((name, lo, hi))
        return out

    def anchors(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the symbols that represent windows, and for each window the index of its key."""
        found, of, made = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
        keys = []
        for level, (name, lo, hi) in reversed(list(enumerate(self.levels()))):
            if not len(of):
                break
            a, b = np.searchsorted(lo, starts[of]), np.searchsorted(hi, starts[of] + self.window, "right")
            has = b > a
            a, b, mine = a[has], b[has], of[has]
            of = of[~has]
            if not len(a):
                continue
            rank = mix(name + np.uint64(level * ODD % (1 << 64)))
            table, span = [np.arange(len(name))], int((b - a).max())
            while 1 << len(table) <= span:
                t, step = table[-1], 1 << (len(table) - 1)
                x, y = t[: len(t) - step], t[step:]
                table.append(np.where(rank[x] <= rank[y], x, y))
            k = np.log2(b - a).astype(np.int64)
            pick = np.empty(len(a), np.int64)
            for d in range(len(table)):
                at = np.flatnonzero(k == d)
                x, y = table[d][a[at]], table[d][b[at] - (1 << d)]
                pick[at] = np.where(rank[x] <= rank[y], x, y)
            own, back = np.unique(pick, return_inverse=True)
            keys.append(mix(self.span_hash(lo[own], hi[own]) ^ rank[own]))
            found[mine] = back + made
            made += len(own)
        return np.concatenate(keys) if keys else np.zeros(0, np.uint64), found

    def covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in windows that start there."""
        edge = np.zeros(len(self.names) + 1, np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


def remove_repeats(docs: DataFrame, window: int = 35, with_text: bool = False) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text, if asked for).

    A word is removed if a window that covers it has the same words as a window that starts anywhere else, the
    same document included; windows are judged on the input, so every copy goes. Null text has no words;
    documents shorter than a window keep all; an empty table gives no rows; repeated rows are each other's
    copies; only doc_id and text are read. Windows are held equal if two independent 64-bit hashes of all their
    words, 128 bits together, agree. A chunk of about 2 MB of text, or one longer document, is in memory at a time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, turn, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

        def flush() -> pa.RecordBatch:
            sender = (part << 24) + turn
            return pa.RecordBatch.from_arrays(
                [pa.array([sender]), pa.array([ids], pa.list_(pa.int64())), pa.array([list(map(len, texts))], pa.list_(pa.int64())), pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()), pa.array([size])],
                names=["sender", "ids", "sizes", "packed", "bytes"],
            )

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                ids.append(i)
                texts.append(t)
                size += len(t)
                if size >= CHUNK or len(ids) >= 50_000:
                    yield flush()
                    turn, ids, texts, size = turn + 1, [], [], 0
        if ids:
            yield flush()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                raw, at = zstandard.decompress(r["packed"]), np.append(0, np.cumsum(np.array(r["sizes"], np.int64))).tolist()
                r["texts"] = [raw[x:y] for x, y in zip(at, at[1:], strict=False)]
                yield r

    def blobs(sender: int, keys: np.ndarray, counts: np.ndarray, starts: np.ndarray, checks: np.ndarray | None = None) -> list[dict]:
        return [{"sender": sender, "owner": o, "n": n, "coded": c, "twice": t, "check": x, "held": None} for o, n, c, t, x in sent(keys, counts, starts, checks)]

    held = pa.schema([("sender", pa.int64()), ("owner", pa.int64()), ("n", pa.int64()), ("coded", pa.binary()), ("twice", pa.binary()), ("check", pa.binary()), ("held", pa.binary())])

    chunks = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, "sender long, ids array<long>, sizes array<long>, packed binary, bytes long"), "chunks")
    total = chunks.agg(F.sum("bytes")).first()[0] or 0
    starts = owner_starts(owners_for(docs, total // 6), 64)

    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            chunk = Chunk(r["texts"], window)
            keys, counts = np.unique(chunk.anchors(chunk.starts())[0], return_counts=True)
            yield pa.RecordBatch.from_pylist(blobs(r["sender"], keys, counts, starts), schema=held)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            chunk = Chunk(r["texts"], window)
            at = chunk.starts()
            own, of = chunk.anchors(at)
            keys, back, counts = np.unique(own, return_inverse=True, return_counts=True)
            shared = marked(keys, starts, r["answers"]) | (counts > 1)
            at = at[shared[back][of]] if len(at) else at
            keys, checks, _, counts = grouped(chunk.span_hash(at, at + window), chunk.span_hash(at, at + window, 1))
            bits = np.zeros(len(chunk.names), np.uint8)
            bits[at] = 1
            kept = {"sender": r["sender"], "held": zstandard.compress(np.packbits(bits).tobytes(), 3)}
            yield pa.RecordBatch.from_pylist([*blobs(r["sender"], keys, counts, starts, checks), kept], schema=held)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in rows(batches):
            chunk = Chunk(r["texts"], window)
            at = np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(r["held"]), np.uint8), count=len(chunk.names))) if len(chunk.names) else np.zeros(0, np.int64)
            keys, _, back, counts = grouped(chunk.span_hash(at, at + window), chunk.span_hash(at, at + window, 1))
            gone = chunk.covered(at[(marked(keys, starts, r["answers"]) | (counts > 1))[back]])
            n, out, texts = [], [], []
            for ws, lo, hi in zip(chunk.words, chunk.begins, chunk.ends, strict=True):
                bad = gone[lo:hi]
                kept = b" ".join(w for w, x in zip(ws, bad.tolist(), strict=True) if not x) if bad.any() else b" ".join(ws)
                n.append(int(bad.sum()))
                out.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if with_text else None)
            cols = [pa.array(r["ids"], pa.int64()), pa.array(chunk.ends - chunk.begins), pa.array(n, pa.int64()), pa.array(out, pa.string())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    sends = BLOBS + ", held binary"
    first = repeated(stage(chunks.mapInArrow(symbols, sends), "symbols"))
    second = stage(chunks.join(answers(first), "sender", "left").mapInArrow(windows, sends), "windows")
    told = answers(repeated(second.filter("coded is not null")))
    known = second.filter("held is not null").select("sender", "held").join(told, "sender", "left")
    return chunks.join(known, "sender").mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
