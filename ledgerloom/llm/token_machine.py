"""A merge tokenizer compiled to a deterministic transducer whose transitions carry emitted-token counts.

The outer machine follows the split pattern: a match is a contraction, a run of letters, one digit or a run of
signs; white space belongs to none. The inner one follows the merges within a match. What a merge tokenizer makes
of a text is the one sequence of tokens in which each neighbouring pair is stable, that is, no merge ever joins
across it; so the last token of every prefix is known from the last tokens of shorter prefixes, and those that can
still matter reach back no further than the longest token. A state therefore holds the longest end of the match
that may begin a longer token, and the last token and the count at each position from which one may still begin,
all counts against the newest. States are made when they are first reached and numbered; a transition on a character gives the next
state and how many tokens more (or fewer, as a longer token takes shorter ones back) the text has now.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ledgerloom.llm.encoding import cut_texts

from tokenizers import Tokenizer

#: Fixed value: the split pattern that the outer machine follows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What may follow an apostrophe: a letter that ends a contraction, or one that needs its second.
SHORT, LONG = "stmd", {"r": "e", "v": "e", "l": "l"}
LETTER, DIGIT, SIGN, BLANK = "letter", "digit", "sign", "blank"
NEVER = 1 << 60
#: The inner state in which a match begins: no text before it, and one position, without a token.
ROOT = (b"", ((0, None, 0),))


class Merges:
    """Vocabulary and merges, over bytes; tokens are bytes with a mark for the end of a match."""

    def __init__(self, model: dict, byte_of: dict[str, int]) -> None:
        end = model["end_of_word_suffix"]
        rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.made = {a + b: (a, b, i) for (a, b), i in rank.items()}
        if len(self.made) != len(rank) or any(x in self.made and self.made[x][2] > i for (a, b), i in rank.items() for x in (a, b)):
            raise ValueError("a token is made in several ways, or before its parts")
        raw = lambda t: bytes(byte_of[c] for c in t)
        self.inner, self.last, self.starts, self.rank = {}, {}, {b""}, rank
        for t in model["vocab"]:
            word = t[: -len(end)] if t.endswith(end) and t != end else t
            if all(c in byte_of for c in word) and (t in self.made or len(word) == 1):
                key = raw(word)
                (self.last if len(word) < len(t) else self.inner)[key] = t
                self.starts.update(key[:i] for i in range(1, len(key)))
        if any(bytes([b]) not in side for b in range(256) for side in (self.inner, self.last)):
            raise ValueError("a byte has no token")

    @cache  # noqa: B019  as many as the vocabulary has tokens
    def spine(self, token: str, right: bool) -> list[tuple[str, int]]:
        """The parts of a token that at some time stood at its right (left) edge, with the rank of the merge that took each up."""
        out, until = [], NEVER
        while True:
            out.append((token, until))
            if token not in self.made:
                return out
            a, b, until = self.made[token]
            token = b if right else a

    @lru_cache(maxsize=1 << 17)  # noqa: B019
    def stable(self, a: str, b: str) -> bool:
        """Whether no merge joins a part at the edge of a with one at the edge of b while both stand there; of equal merges the left one goes first."""
        for x, until_x in self.spine(a, True):
            for y, until_y in self.spine(b, False):
                m = self.rank.get((x, y), NEVER)
                if m < until_x and m <= until_y and m < NEVER:
                    return False
        return True


class TokenMachine:
    """Counts tokens as the library would without special tokens of its own; special strings within a text count as one.

    Characters are normalised and put into classes by the library's own normaliser and pattern; tokens come from the
    transducer alone. `most` bounds the transitions that are kept, and the stretches whose counts are kept; what goes
    beyond is compiled anew when it comes up again.
    """

    def __init__(self, path: str, most: int = 250_000) -> None:
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        parts = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        model = spec["model"]
        if split[0].get("pattern", {}).get("Regex") != PATTERN or parts != ["NFC", "Replace", "Lowercase"] or model["type"] != "BPE" or not model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a lower-casing merge tokenizer with the fixed split pattern")
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            raise ValueError("special strings that take white space or need word borders are not supported")
        self.specials = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.specials)) or r"(?!)")
        self.merges = Merges(model, byte_letters())
        self.kinds: dict[str, str] = {}
        self.most, self.known, self.older = most, {}, {}
        self.forget()

    def forget(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.step: dict[tuple[int, str], tuple[int, int]] = {}
        self.ends: dict[int, int] = {}
        self.start = self.state("start", ROOT, b"")

    def state(self, mode: str, inner: tuple, pending: bytes) -> int:
        """The number of a state: what the outer machine is in, the inner state, and a byte that waits to hear whether it is the match's last."""
        key = (mode, inner, pending)
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
        return self.number[key]

    def token(self, inner: tuple, byte: bytes, side: dict[bytes, str]) -> tuple[str, int]:
        """The last token once a byte has followed, and the count then against the count before."""
        text = inner[0] + byte
        for i, before, n in inner[1]:
            t = side.get(text[i:])
            if t is not None and (before is None or self.merges.stable(before, t)):
                return t, n + 1
        raise ValueError(f"no token ends {text!r}")

    def follow(self, inner: tuple, byte: bytes) -> tuple[tuple, int]:
        t, more = self.token(inner, byte, self.merges.inner)
        text, starts = inner[0] + byte, self.merges.starts
        live = [x for x in inner[1] if text[x[0] :] in starts]
        drop = live[0][0] if live else len(text)
        return (text[drop:], (*((i - drop, before, n - more) for i, before, n in live), (len(text) - drop, t, 0))), more

    def finish(self, inner: tuple, pending: bytes) -> int:
        """Tokens more than before once the match has ended with the waiting byte."""
        return self.token(inner, pending, self.merges.last)[1] if pending else 0

    def kind(self, ch: str) -> str:
        """The class of a character of normalised text, as the library's pattern has it."""
        if ch not in self.kinds:
            pieces = len(self.library.pre_tokenizer.pre_tokenize_str(f"a{ch}{ch}a"))
            self.kinds[ch] = {1: LETTER, 2: BLANK, 3: SIGN, 4: DIGIT}[pieces]
        return self.kinds[ch]

    def compile(self, state: int, ch: str) -> tuple[int, int]:
        """The transition of a state on a character."""
        mode, inner, pending = self.states[state]
        kind, code = self.kind(ch), ch.encode()

        def on(mode: str, inner: tuple, pending: bytes) -> tuple[int, int]:
            more = 0
            for i in range(len(code)):
                if pending:
                    inner, n = self.follow(inner, pending)
                    more += n
                pending = code[i : i + 1]
            return self.state(mode, inner, pending), more

        def ended(at: tuple[int, int]) -> tuple[int, int]:
            """The match ends with this character."""
            _, inner, pending = self.states[at[0]]
            return self.start, at[1] + self.finish(inner, pending)

        if mode in LONG:  # an apostrophe and the first letter of what may be a contraction
            if ch == LONG[mode]:
                after, more = self.compile(self.state("held", inner, pending), mode)
                _, inner, pending = self.states[after]
                again = ended(on("held", inner, pending))
                return again[0], more + again[1]
            more = self.finish(inner, pending)
            word = self.state(LETTER, ROOT, mode.encode())
            after = self.compile(word, ch)
            return after[0], more + after[1]
        if mode == "held":  # within a contraction, whatever follows belongs to it
            return on("held", inner, pending)
        if mode == "'" and ch in LONG:
            return self.state(ch, inner, pending), 0
        if mode == "'" and ch in SHORT:
            return ended(on("held", inner, pending))
        if kind == SIGN and mode in (SIGN, "'") or kind == LETTER and mode == LETTER:
            return on(SIGN if kind == SIGN else LETTER, inner, pending)
        more = self.finish(inner, pending)
        if kind == BLANK:
            return self.start, more
        after = ended(on("held", ROOT, b"")) if kind == DIGIT else on("'" if ch == "'" else kind, ROOT, b"")
        return after[0], more + after[1]

    def end(self, state: int) -> int:
        """Tokens more at the end of the text."""
        mode, inner, pending = self.states[state]
        more = self.finish(inner, pending)
        return more + self.finish(ROOT, mode.encode()) if mode in LONG else more

    def run(self, text: str) -> int:
        """Tokens of a text that holds no special string: one transition a character."""
        if len(self.step) > self.most:
            self.forget()
        text = text.lower() if text.isascii() else self.library.normalizer.normalize_str(text)
        step, state, total = self.step, self.start, 0
        for ch in text:
            at = step.get((state, ch))
            if at is None:
                at = step[state, ch] = self.compile(state, ch)
            state, total = at[0], total + at[1]
        if state not in self.ends:
            self.ends[state] = self.end(state)
        return total + self.ends[state]

    def counts(self, stretches: Iterable[str]) -> list[int]:
        """Tokens of stretches that begin and end in the starting state; those of recent ones are kept as transitions of a whole stretch."""
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known, older, out = self.known, self.older, []
        for s in stretches:
            n = known.get(s)
            if n is None:
                n = known[s] = older[s] if s in older else self.run(s)
            out.append(n)
        return out

    def count_column(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each whole text of a string column; null counts as empty."""
        texts = texts.fill_null("") if texts.null_count else texts
        if not len(texts):
            return np.zeros(0, np.int64)
        special = np.zeros(len(texts), bool)
        for s in self.specials:
            special |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        out = self._plain(texts) if not special.all() else np.zeros(len(texts), np.int64)
        for i in np.flatnonzero(special):
            between = self.special.split(texts[i].as_py())
            out[i] = len(between) - 1 + self._plain(pa.array(between, pa.string())).sum()
        return out

    def _plain(self, texts: pa.Array) -> np.ndarray:
        pieces, cut = cut_texts(texts, lower=True)
        coded = pieces.dictionary_encode()
        each = np.array(self.counts(coded.dictionary.to_pylist()), np.int64)[coded.indices.to_numpy()] if len(pieces) else np.zeros(0, np.int64)
        return np.diff(np.append(0, np.cumsum(each))[cut])


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else the next letter from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def machine(path: str) -> TokenMachine:
    """One machine per worker process."""
    return TokenMachine(path)
