"""SentencePiece encoding and decoding by one pass of a Viterbi search over matched pieces.

An Aho-Corasick automaton over all pieces reads a text once; at each position its output
links list every piece that ends there, and each relaxes the best way to reach the position.
For a unigram model the best way has the highest sum of scores. For a model of merges the
best way is the one whose last piece the merges leave beside the piece before it: that piece
is unique, and the pieces found are exactly those of the library.

The model's text has a space mark before it and in place of every space. Where no piece of
the model reaches over a place (before a mark, mostly before punctuation), a text falls into
units that are searched on their own and kept in a bounded memo; a model with marks inside
pieces is run on whole texts.

Defined results: a null or empty text has no ids. A character that no piece covers gives its
UTF-8 bytes as byte pieces, or the unknown id if the model has none. Decoding gives the text
back, except that a literal space mark becomes a space and unknown characters become the
model's stand-in. Repeated rows and null ids are carried as they are; extra columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voxtable.llm import columnar as cx
from voxtable.llm.merges import Neighbours, Recent

MARK = "▁"
# What an unknown character costs below the worst piece of a unigram model.
UNKNOWN_PENALTY = 10.0
_UNREACHED = (-1, -1)


class PieceCoder:
    def __init__(self, pieces: list[str], scores: list[float], normal: list[bool], unknown: int = 0, merges: bool = True):
        self.unknown, self.merges = unknown, merges
        self.bytes = {i: int(p[3:5], 16) for i, p in enumerate(pieces) if not normal[i] and re.fullmatch("<0x[0-9A-F]{2}>", p)}
        self.byte_ids = {b: i for i, b in self.bytes.items()}
        self.usable = {p: i for i, p in enumerate(pieces) if normal[i]}
        self.scores = scores
        self.floor = min([scores[i] for i in self.usable.values()], default=0.0) - UNKNOWN_PENALTY
        self.surface = [bytes([self.bytes[i]]) if i in self.bytes else p.replace(MARK, " ").encode() if normal[i] else b"" for i, p in enumerate(pieces)]
        self.surface[unknown] = " ⁇ ".encode()
        # Characters that no piece has after a letter or digit: a place between the two is a cut.
        pairs = {(a, b) for p in self.usable for a, b in zip(p, p[1:])}
        apart = {c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "_"} - {b for a, b in pairs if a.isalnum()}
        word = f"{MARK}*[^\\W_]+(?=[{''.join(map(re.escape, sorted(apart)))}])|" if apart else ""
        whole = any(b == MARK != a for a, b in pairs)
        self.split = re.compile(".+" if whole else f"{word}{MARK}*[^{MARK}]+|{MARK}+", re.DOTALL).findall
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        # Merges are made from the best score down; basic symbols come before them all.
        order = sorted((i for p, i in self.usable.items() if len(p) > 1), key=lambda i: (-scores[i], i)) if merges else []
        self.number = {p: k for k, p in enumerate(p for p in self.usable if len(p) == 1)} if merges else {}
        first = self.first_merge = len(self.number)
        self.number |= {pieces[i]: first + k for k, i in enumerate(order)}
        self.names = list(self.number)
        halves = [self._halves(k) for k in range(len(self.names))]
        self.fits = Neighbours(lambda a, b: self.number.get(self.names[a] + self.names[b]), halves.__getitem__)
        for p, i in self.usable.items():
            k = self.number.get(p, 0)
            if not merges or halves[k] != _UNREACHED:
                self.automaton.add_word(p, (i, k, len(p), scores[i], k << 24))
        if len(self.automaton):
            self.automaton.make_automaton()
        self.units = Recent(self._unit)

    @classmethod
    def load(cls, path: str, merges: bool | None = None) -> "PieceCoder":
        """Read a model file; by default whole-number scores mean a model of merges."""
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        scores = [model.get_score(i) for i in ids]
        normal = [not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in ids]
        if merges is None:
            merges = all(float(s).is_integer() for s, n in zip(scores, normal) if n)
        return cls([model.id_to_piece(i) for i in ids], scores, normal, model.unk_id(), merges)

    def _halves(self, k: int) -> tuple[int, int] | None:
        """The last merge that makes piece ``k``; None for a single character."""
        if k < self.first_merge:
            return None
        names, found = list(self.names[k]), None
        while len(names) > 1:
            options = [(self.number[a + b], i) for i, (a, b) in enumerate(zip(names, names[1:])) if a + b in self.number]
            if not options:
                # A piece that its own merges do not reach never comes up.
                return _UNREACHED
            made, i = min(options)
            found = (self.number.get(names[i], -1), self.number.get(names[i + 1], -1))
            names[i : i + 2] = [self.names[made]]
        return found

    def _unit(self, unit: str) -> bytes:
        return array("i", self._merged(unit) if self.merges else self._best(unit)).tobytes()

    def _merged(self, text: str) -> list[int]:
        fits = self.fits.memo
        # The last piece of each prefix, by its last character; None where a lone character ends, and
        # in the spare last place, which stands for the start.
        last: list = [None] * (len(text) + 1)
        for end, found in self.automaton.iter(text):
            if last[end] is None:
                before = last[end - found[2]]
                if before is None or fits[before[4] | found[1]]:
                    last[end] = found
        ids: list[int] = []
        end = len(text)
        while end:
            if found := last[end - 1]:
                ids.append(found[0])
                end -= found[2]
            else:
                end -= 1
                self._lone(ids, text[end])
        return ids[::-1]

    def _best(self, text: str) -> list[int]:
        n = len(text)
        score: list = [0.0] + [None] * n
        back: list = [None] * (n + 1)

        def lone(upto: int) -> None:
            for end in range(self._done + 1, upto + 1):
                reach = score[end - 1] + self.floor
                if score[end] is None or (back[end][1] is None and reach > score[end]):
                    score[end], back[end] = reach, (end - 1, None)
            self._done = max(self._done, upto)

        self._done = 0
        for end, (piece, _, size, gain, _) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            lone(end - 1)
            reach = score[end - size] + gain
            if score[end] is None or reach > score[end]:
                score[end], back[end] = reach, (end - size, piece)
        lone(n)
        return self._path(text, back)

    def _path(self, text: str, back: list) -> list[int]:
        ids: list[int] = []
        end = len(text)
        while end:
            start, piece = back[end]
            if piece is not None:
                ids.append(piece)
            else:
                self._lone(ids, text[start:end])
            end = start
        return ids[::-1]

    def _lone(self, ids: list, character: str) -> None:
        """Ids of a character that no piece covers, last first."""
        if self.byte_ids:
            ids.extend(self.byte_ids[b] for b in reversed(character.encode()))
        elif not (ids and ids[-1] == self.unknown):
            ids.append(self.unknown)

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        marked = MARK + text.replace(" ", MARK)
        memo = self.units
        return np.frombuffer(b"".join([memo[u] for u in self.split(marked)]), np.int32)

    def decode(self, ids) -> str:
        surface = self.surface
        text = b"".join([surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(2)
def coder(path: str) -> PieceCoder:
    return PieceCoder.load(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: its ids, how many they are and how many stand for single bytes, and whether decoding gives the text back."""

    def run(texts):
        own = coder(path)
        is_byte = np.zeros(len(own.pieces), bool)
        is_byte[list(own.bytes)] = True
        ids = [own.encode(t) for t in texts]
        back = [own.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        return [lists, cx.long_column(np.diff(ends)), cx.long_column(np.array([is_byte[x].sum() for x in ids], np.int64)), pa.array(back, pa.bool_())]

    return cx.text_map(docs, text_col, run, "ids array<int>, n_ids long, n_byte_ids long, round_trip boolean", [id_col], strings=True)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: the text that ``ids_col`` stands for; null for null ids."""
    slim = encoded.select(encoded[id_col].alias("i"), encoded[ids_col].cast("array<int>").alias("x"))

    def run(batches):
        for batch in batches:
            own = coder(path)
            texts = [None if x is None else own.decode([i for i in x if i is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["i", "text"])

    return slim.mapInArrow(run, f"i {slim.schema['i'].dataType.simpleString()}, text string").toDF(id_col, "text")
