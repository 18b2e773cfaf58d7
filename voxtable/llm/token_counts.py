"""Token counts by prefix dynamic programming over byte-level merges.

For every prefix of a text the exact number of tokens is kept, as if that prefix were
encoded alone. The longest prefix within a token budget, the cost of a cut and the count of
the whole text are then look-ups; nothing is encoded again.

A text falls into units (blanks and the run after them) whose tokens do not depend on each
other. Inside a unit the last token of each prefix determines the next: one pass gives the
counts of all its prefixes. Units repeat, so a bounded memo holds their counts.

Defined results: a null or empty text has no bytes and no tokens. Special strings inside a
text are one token each, as in the library's default; prefixes that end inside one count it
as ordinary text. Repeated rows and null ids are carried as they are. Counts need not grow
with the prefix: a longer prefix may take fewer tokens, and budgets are answered for the
longest prefix that fits. Extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.merges import Pairs, Recent

LIMIT = 1024
# Units whose counts are remembered, and their most characters: what is longer seldom comes again.
UNIT_ENTRIES, UNIT_CHARS = 250_000, 64
_SPACE = "\t-\r \x85\xa0  -     　"
# Blanks and the run after them; letters and digits end before ASCII punctuation.
_UNIT = re.compile(rf"[{_SPACE}]*[^\W_]+(?=[!-/:-@\[-`{{-~])|[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
# The split of the vocabulary's library, inside a run without blanks.
_RUN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^ \p{L}\p{N}]+")
# A unit that is one pre-token.
_WORD = regex.compile(r" ?\p{L}+| ?\p{N}+")
_LONG_CONTRACTIONS = ("'re", "'ve", "'ll")


def _alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _alphabet()
        raw = lambda piece: "".join(chr(letters[c]) for c in piece)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        # Numbered in the order of the merges, after the 256 bytes.
        number = {chr(b): b for b in range(256)}
        halves, joined = {}, {}
        for a, b in merges:
            left, right = number[raw(a)], number[raw(b)]
            halves[number.setdefault(raw(a + b), 256 + len(halves))] = left, right
            joined[left << 24 | right] = number[raw(a + b)]
        self.fits = Pairs(joined, [halves.get(k) for k in range(len(number))])
        self.tokens = ahocorasick.Automaton()
        for token, k in number.items():
            self.tokens.add_word(token, (k, len(token)))
        self.tokens.make_automaton()
        self.pieces = Recent(self._piece)
        self.units = Recent(self._unit, UNIT_ENTRIES)

    def _piece(self, piece: str) -> list[int]:
        """Tokens of every prefix (in code points) of one pre-token."""
        data = piece.encode().decode("latin-1")
        fits = self.fits.memo
        # By the last byte of a prefix; the place before the first byte is the spare last one.
        last: list = [None] * (len(data) + 1)
        counts = [0] * (len(data) + 1)
        done = -1  # ends come in order, the longest token of an end first
        for end, (token, size) in self.tokens.iter(data):
            if end > done:
                start = end - size
                if start < 0 or fits[last[start] | token]:
                    last[end] = token << 24
                    counts[end] = counts[start] + 1
                    done = end
        counts.pop()
        if len(data) == len(piece):
            return counts
        return [n for n, follower in zip(counts, [*data[1:], "."]) if ord(follower) & 0xC0 != 0x80]

    def _unit(self, unit: str) -> bytes:
        """Tokens of every prefix of a unit, as 32-bit numbers."""
        if _WORD.fullmatch(unit):
            return array("i", self._piece(unit)).tobytes()  # one pre-token, which is remembered as a unit
        core = unit.lstrip(_BLANKS)
        blanks = unit[: len(unit) - len(core)]
        counts, done = [], 0
        if core and blanks != " ":
            counts = list(self.pieces[blanks]) if blanks else []
            if len(blanks) > 1:
                done = self.pieces[blanks[:-1]][-1]
            if blanks[-1:] == " ":
                counts.pop()
                core = " " + core
            elif blanks:
                done += self.pieces[blanks[-1]][-1]
        elif core:
            core = unit
        else:
            counts = self.pieces[blanks]
        for run in _RUN.findall(core):
            part = self.pieces[run]
            if run in _LONG_CONTRACTIONS:
                part = [part[0], self.pieces["'"][-1] + self.pieces[run[1]][-1], part[2]]
            if counts and run[0] == " " and blanks != " ":
                # The space alone ends a run of blanks and is counted with them.
                counts = [*counts, self.pieces[blanks][-1], *(done + n for n in part[1:])]
            else:
                counts = [*counts, *(done + n for n in part)] if done or counts else part
            done += part[-1]
        return array("i", counts).tobytes()

    def counts(self, text: str) -> np.ndarray:
        """counts(text)[i]: tokens of text[:i + 1]."""
        if not any(s in text for s in self.special):
            return self._plain(text) if text else np.zeros(0, np.int32)
        out, base, at = [], 0, 0
        for segment in re.split("|".join(map(re.escape, self.special)), text):
            if at:
                base += 1
                out[-1][-1] = base
            name = next((s for s in self.special if text.startswith(s, at + len(segment))), "")
            part = self._plain(segment + name) + base if segment or name else np.zeros(0, np.int32)
            base = int(self._plain(segment)[-1]) + base if segment else base
            if segment:
                part[len(segment) - 1] = base
            out.append(part)
            at += len(segment + name)
        return np.concatenate(out)

    def _plain(self, text: str) -> np.ndarray:
        memo, units = self.units, _UNIT.findall(text)
        parts = [memo[u] if len(u) <= UNIT_CHARS else self._unit(u) for u in units]
        flat = np.frombuffer(b"".join(parts), np.int32)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        ends = np.cumsum(sizes)
        totals = flat[ends - 1]
        return flat + np.repeat((np.cumsum(totals) - totals).astype(np.int32), sizes)


_BLANKS = "".join(chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@lru_cache(2)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: ``counts``, whose entry i is the exact number of tokens of its first i + 1 characters."""

    def run(texts):
        return [pa.array([counter(path).counts(t) for t in texts], pa.list_(pa.int32()))]

    return cx.text_map(docs, text_col, run, "counts array<int>", [id_col], strings=True)


def tokens_of_prefix(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters; past the end: of the whole text."""
    at = F.least(n_chars.cast("int"), F.size(counts))
    return F.when(at > 0, F.element_at(counts, at)).otherwise(F.lit(0))


def chars_within(counts: Column, budget: Column) -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens."""
    numbered = F.transform(counts, lambda n, i: F.when(n <= budget, i + 1).otherwise(F.lit(0)))
    return F.coalesce(F.array_max(numbered), F.lit(0)).cast("long")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: bytes, tokens, whether it exceeds ``limit``, and the longest prefix within it."""

    def run(texts):
        count = counter(path).counts
        sizes, tokens, fitting = [], [], []
        for text in texts:
            counts = count(text)
            sizes.append(len(text.encode()))
            tokens.append(int(counts[-1]) if len(counts) else 0)
            within = np.flatnonzero(counts <= limit)
            fitting.append(int(within[-1]) + 1 if len(within) else 0)
        return [pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(fitting, pa.int64())]

    return cx.text_map(docs, text_col, run, "n_bytes long, n_tokens long, over_limit boolean, chars_in_limit long", [id_col], strings=True)
