"""Encoding by public tokenizer files, with the parts of a text remembered."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; idle threads of the library would spin

from tokenizers import Tokenizer  # noqa: E402

#: Kinds of UTF-8 bytes: what may stand beside a cut (letters, digits, signs), a space, a line end, and all others, which are never cut from.
LETTER, DIGIT, SIGN, SPACE, LINE, OTHER = range(1, 7)
KIND = np.full(256, OTHER, np.uint8)
for chars, kind in ((range(0x41, 0x5B), LETTER), (range(0x61, 0x7B), LETTER), (range(0x30, 0x3A), DIGIT), (b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", SIGN), (b" ", SPACE), (b"\n", LINE)):
    KIND[list(chars)] = kind


def cut_texts(texts: pa.Array, lower: bool) -> tuple[pa.Array, np.ndarray]:
    """The parts of all texts one after another, with A-Z in lower case if asked for, and the number of parts before each text and in all."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = np.append(KIND[raw], OTHER)
    # two-byte letters of Latin: C3 and what follows it, but for the two signs among them
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = LETTER
    if lower:
        raw = np.where((raw >= 0x41) & (raw <= 0x5A), raw | 0x20, raw).astype(np.uint8)
    edge = np.zeros(len(raw) + 1, bool)
    edge[ends] = True
    solid = kind <= SIGN
    before, here = kind[:-2], kind[1:-1]
    alone = np.zeros(len(raw) + 1, bool)  # line ends between solid characters of one text
    if len(raw) > 2:
        alone[1:-2] = (here[:-1] == LINE) & solid[:-3] & solid[2:-1] & ~edge[1:-2] & ~edge[2:-1]
    at = edge.copy()
    if len(raw) > 1:
        at[1:-1] |= (solid[:-2] & ((here == SPACE) | (solid[1:-1] & (before != here)))) | alone[1:-1] | alone[:-2]
    starts = np.flatnonzero(at)
    offsets = starts.astype(np.int32)
    pieces = pa.Array.from_buffers(pa.string(), max(0, len(starts) - 1), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
    return pieces, np.searchsorted(starts, ends)


class Encoder:
    """Whole-text encoding that equals Tokenizer.encode(text, add_special_tokens=False).

    Both supported kinds of vocabulary split a text by one pattern before they merge anything, and merge within
    its matches only. The pattern has a match end between letters, digits and signs, before a space behind one of
    these, and around a single line end between them; a text is cut there (nowhere beside other characters, an
    apostrophe among them), and each distinct part is encoded once per worker. Texts that hold a special token's
    string, and other kinds of tokenizer, are encoded whole. Of parts, the last `remember` to 2 * `remember` in use are kept.
    """

    def __init__(self, path: str, remember: int = 150_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, self.specials = spec.get("pre_tokenizer") or {}, [x["content"] for x in spec.get("added_tokens", [])]
        normal = spec.get("normalizer") or {}
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        spaced = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not normal
        words = pre.get("type") == "Sequence" and pre["pretokenizers"][0].get("behavior") == "Removed" and spec["model"].get("end_of_word_suffix")
        self.by_part = bool(spaced or words)
        self.lower = "Lowercase" in [normal.get("type"), *(x["type"] for x in normal.get("normalizers", []))]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.remember = remember

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def parts(self, texts: list[str]) -> list[bytes]:
        """Ids of each part, most of them remembered."""
        if len(self.known) > self.remember:
            self.older, self.known = self.known, {}
        known, older, code = self.known, self.older, self.dtype.char
        new = []
        for p in texts:
            if p not in known:
                if p in older:
                    known[p] = older[p]
                else:
                    new.append(p)
        for lo in range(0, len(new), 20_000):
            own = new[lo : lo + 20_000]
            for p, e in zip(own, self.tokenizer.encode_batch_fast(own, add_special_tokens=False), strict=True):
                known[p] = array(code, e.ids).tobytes()
        return list(map(known.__getitem__, texts))

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        return cut_texts(texts, self.lower)

    def encode_column(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column one after another, each followed by end_id if given, and how many each has. Null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not len(texts):
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        whole = np.full(len(texts), not self.by_part)
        if self.by_part:
            for s in self.specials:
                whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
            pieces, cut = self.cut(texts)
            coded = pieces.dictionary_encode()
            codes = coded.indices.to_numpy().astype(np.int64)
            table = self.parts(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        else:
            codes, cut, table = np.arange(len(texts)), np.arange(len(texts) + 1), [b""] * len(texts)
        apart = np.flatnonzero(whole)
        if len(apart):
            codes[np.repeat(whole, np.diff(cut))] = len(table)
            codes[cut[apart]] = len(table) + 1 + np.arange(len(apart))
            table += [b"", *self.whole(texts.take(pa.array(apart)).to_pylist())]
        if end_id is not None:
            codes = np.insert(codes, cut[1:], len(table))
            cut = cut + np.arange(len(cut))
            table.append(np.array([end_id], self.dtype).tobytes())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // self.dtype.itemsize
        flat, n = np.frombuffer(b"".join(table), self.dtype), sizes[codes]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.repeat((np.cumsum(sizes) - sizes)[codes] - ends[:-1], n) + np.arange(ends[-1])]
        return ids, np.diff(ends[cut])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of self.dtype."""
        ids, n = self.encode_column(pa.array(texts, pa.string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(n)[:-1])] if texts else []


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process; what it remembers serves all its tasks."""
    return Encoder(path)
