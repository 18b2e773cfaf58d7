"""N-grams of whole texts counted inside Arrow tasks.

Spark lower-cases and splits texts, sums the counts of every term over all tasks and bounds the
vocabulary; a task here turns the texts of a block into counts per document. N-grams are packed
into whole numbers (a prefix's number times the alphabet plus the next symbol, renumbered before it
could pass 62 bits), so equal numbers are equal n-grams and one sort counts a block. What leaves a
task is one row per distinct n-gram of a block, or one sparse vector per text, never one row per
n-gram. Memory follows ``BLOCK_BYTES``, or the longest text if that is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.regexes import SPACE, WORD, java

# Bytes of text counted at once, where they are several texts; counting takes up to 250 times as much memory.
BLOCK_BYTES = 1 << 19
_BITS = 62
CELLS = "struct<indices:array<int>,values:array<double>>"


@dataclass(frozen=True)
class Cut:
    """Which n-grams: of ``word``s, of ``char``acters, or of characters inside padded words (``char_wb``)."""

    kind: str
    low: int
    high: int

    def prepared(self, text: Column) -> Column:
        """Lower case, with plain spaces where the n-grams need them."""
        low = F.lower(F.coalesce(text.cast("string"), F.lit("")))
        if self.kind == "char":
            return F.regexp_replace(low, java(r"\s\s+"), " ")
        return F.regexp_replace(low, rf"[^{WORD} ]+" if self.kind == "word" else rf"[{SPACE}&&[^ ]]", " ")


WORDS, CHARS, CHARS_WB = Cut("word", 1, 2), Cut("char", 3, 5), Cut("char_wb", 2, 6)


@dataclass
class Counted:
    """How often each text holds each n-gram: parallel arrays, by n-gram, and the n-grams' spelling."""

    doc: np.ndarray
    gram: np.ndarray
    times: np.ndarray
    terms: pa.Array


def spans(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """First item and last item + 1 of runs whose sizes sum up to ``most``, or of single larger items."""
    ends, at = np.cumsum(np.r_[0, sizes]), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield at, to
        at = to


def blocks(texts: pa.Array) -> Iterator[pa.Array]:
    for at, to in spans(pc.binary_length(texts).to_numpy(zero_copy_only=False), BLOCK_BYTES):
        yield texts.slice(at, to - at)


def _points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the text of each."""
    flat = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return flat, np.repeat(np.arange(len(texts)), pc.utf8_length(texts).to_numpy(zero_copy_only=False))


def _strings(points: np.ndarray) -> pa.Array:
    """Rows of code points as strings."""
    sizes = (1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)).sum(1)
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.LargeStringArray.from_buffers(len(points), pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int64)), pa.py_buffer(data))


def _sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and where each starts in the sorted keys."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], starts


def _grouped(codes: np.ndarray, doc: np.ndarray, times: np.ndarray | None, n_docs: int) -> tuple[np.ndarray, ...]:
    """(codes that occur, number of each entry's code, its doc, its times), entries by code and doc."""
    bits = max(1, int(n_docs - 1).bit_length())
    key = codes << bits | doc
    spare = 0 if times is None else int(times.max(initial=1)).bit_length()
    if times is None:
        key.sort()
        own, starts = _sorted_runs(key)
        counts = np.diff(np.r_[starts, len(key)])
    elif int(key.max(initial=0)).bit_length() + spare <= _BITS:
        # The times ride in the low bits, so that only whole numbers are sorted.
        key <<= spare
        key |= times
        key.sort()
        times = key & ((1 << spare) - 1)
        key >>= spare
        own, starts = _sorted_runs(key)
        counts = np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)
    else:
        order = np.argsort(key)
        own, starts = _sorted_runs(key[order])
        counts = np.add.reduceat(times[order], starts) if len(starts) else np.zeros(0, np.int64)
    high = own >> bits
    found, first = _sorted_runs(high)
    return found, np.repeat(np.arange(len(found)), np.diff(np.r_[first, len(high)])), own & ((1 << bits) - 1), counts


def _windows(symbols: np.ndarray, doc: np.ndarray, n_docs: int, alphabet: int, low: int, high: int, spell, whole: bool = False) -> Counted:
    """All windows of ``low`` to ``high`` symbols inside texts; with ``whole``, shorter texts are one window."""
    alphabet, room = max(alphabet, 1), _BITS - max(1, int(n_docs - 1).bit_length())
    left = np.searchsorted(doc, doc, "right") - np.arange(len(doc))  # symbols from here to the text's end
    start = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    at, codes, bound, tables, out, n_grams = np.arange(len(symbols)), symbols.astype(np.int64), alphabet, {}, [], 0
    for n in range(1, high + 1):
        if n > 1:
            stay = left[at] >= n
            at, codes = at[stay], codes[stay]
            if bound * alphabet >= 1 << room:
                tables[n - 1], codes = np.unique(codes, return_inverse=True)
                bound = max(1, len(tables[n - 1]))
            codes, bound = codes * alphabet + symbols[at + n - 1], bound * alphabet
        if n < low and not whole:
            continue
        pick = slice(None) if n >= low else start[at] & (left[at] == n)
        found, gram, own, times = _grouped(codes[pick], doc[at[pick]], None, n_docs)
        columns = np.empty((len(found), n), np.int64)
        for k in range(n, 0, -1):
            columns[:, k - 1] = found % alphabet if k > 1 else found
            found = found // alphabet
            if k - 1 in tables:
                found = tables[k - 1][found]
        out.append((own, gram + n_grams, times, spell(columns)))
        n_grams += len(columns)
    if not out:
        return Counted(*(np.zeros(0, np.int64) for _ in range(3)), pa.array([], pa.large_string()))
    return Counted(*(np.concatenate([o[k] for o in out]) for k in range(3)), pa.concat_arrays([o[3] for o in out]))


def _char_windows(texts: pa.Array, low: int, high: int, whole: bool = False) -> Counted:
    points, doc = _points(texts)
    seen = np.zeros(0x110000, bool)
    seen[points] = True
    letters = np.flatnonzero(seen)
    numbers = np.zeros(0x110000, np.int32)
    numbers[letters] = np.arange(len(letters))
    return _windows(numbers[points].astype(np.int64), doc, len(texts), len(letters), low, high, lambda c: _strings(letters[c].astype(np.uint32)), whole)


def _words(texts: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between spaces with ``least`` characters: number, text, and the words by number."""
    split = pc.split_pattern(texts, " ")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary
    kept = pc.utf8_length(words).to_numpy(zero_copy_only=False) >= least
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    take = kept[ids] if len(words) else np.zeros(0, bool)
    return (np.cumsum(kept) - 1)[ids[take]], doc[take], words.filter(pa.array(kept))


def counted(texts: pa.Array, cut: Cut) -> Counted:
    """N-grams of prepared texts (``Cut.prepared``)."""
    texts = texts.cast(pa.large_string())
    if cut.kind == "char":
        return _char_windows(texts, cut.low, cut.high)
    if cut.kind == "word":
        ids, doc, words = _words(texts, 2)

        def spell(columns: np.ndarray) -> pa.Array:
            parts = [words.take(pa.array(columns[:, k])) for k in range(columns.shape[1])]
            return pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))

        return _windows(ids, doc, len(texts), len(words), cut.low, cut.high, spell)
    ids, doc, words = _words(texts, 1)
    space = pa.scalar(" ", pa.large_string())
    inner = _char_windows(pc.binary_join_element_wise(space, words, space, pa.scalar("", pa.large_string())), cut.low, cut.high, True)
    # Each distinct word of the block is cut once; its n-grams are dealt to the texts that hold it.
    found, word, own, times = _grouped(ids, doc, None, len(texts))
    by_word = inner.doc << 32 | np.arange(len(inner.doc))
    by_word.sort()
    by_word &= (1 << 32) - 1
    first = np.r_[0, np.cumsum(np.bincount(inner.doc, minlength=len(words)))]
    sizes = (first[1:] - first[:-1])[found][word]
    entry = np.repeat(np.arange(len(word)), sizes)
    place = by_word[np.arange(len(entry)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[:-1][found][word], sizes)]
    grams, gram, own, times = _grouped(inner.gram[place], own[entry], times[entry] * inner.times[place], len(texts))
    return Counted(own, grams[gram], times, inner.terms)


def _counts(block: pa.Array, cut: Cut) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(term, df, cf) of a block of prepared texts."""
    got = counted(block, cut)
    n = len(got.terms)
    return got.terms.cast(pa.string()), np.bincount(got.gram, minlength=n), np.bincount(got.gram, got.times, n).astype(np.int64)


def stats(df: DataFrame, text_col: str, cut: Cut, fold_col: str | None = None) -> DataFrame:
    """(term, df, cf) of all texts, or (term, fold, df, cf): in how many texts a term is, and how often."""
    return block_stats(df, text_col, cut, fold_col).groupBy("term", *(["fold"] if fold_col else [])).agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def block_stats(df: DataFrame, text_col: str, cut: Cut, fold_col: str | None = None) -> DataFrame:
    """(term, fold, df, cf) of every block of texts, as it leaves a task."""
    keys = [F.col(fold_col).cast("int").alias("fold")] if fold_col else [F.lit(0).alias("fold")]
    slim = df.select(cut.prepared(F.col(text_col)).alias("t"), *keys)

    def run(batches):
        for batch in batches:
            folds = batch.column(1).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                for block in blocks(batch.column(0).filter(pa.array(folds == fold))):
                    term, *numbers = _counts(block, cut)
                    yield pa.RecordBatch.from_arrays([term, pa.array(np.full(len(term), fold, np.int32)), *map(pa.array, numbers)], ["term", "fold", "df", "cf"])

    return slim.mapInArrow(run, "term string, fold int, df long, cf long")


def stats_by_cut(df: DataFrame, text_col: str, each: Sequence[Cut]) -> DataFrame:
    """(cut, term, df, cf) for several cuts from one pass over the texts; ``cut`` is the place in ``each``."""
    slim = df.select(*[cut.prepared(F.col(text_col)).alias(f"t{k}") for k, cut in enumerate(each)])

    def run(batches):
        for batch in batches:
            for k, cut in enumerate(each):
                for block in blocks(batch.column(k)):
                    term, *numbers = _counts(block, cut)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(term), k, np.int32)), term, *map(pa.array, numbers)], ["cut", "term", "df", "cf"])

    return slim.mapInArrow(run, "cut int, term string, df long, cf long").groupBy("cut", "term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


@dataclass(frozen=True)
class Vocabulary:
    """The terms of one cut as they are sent to tasks, with their weights; features are numbered from ``offset``."""

    cut: Cut
    terms: pa.Array
    idf: np.ndarray
    sublinear: bool
    offset: int = 0

    @classmethod
    def of(cls, cut: Cut, terms: list[str], idf: list[float], sublinear: bool, offset: int = 0) -> "Vocabulary":
        return cls(cut, pa.array(terms, pa.large_string()), np.array(idf, np.float64), sublinear, offset)

    def entries(self, texts: pa.Array, by_term: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, times) of the known n-grams of prepared texts, by text and term or by term and text."""
        found, first = [(np.zeros(0, np.int64),) * 3], 0
        for block in blocks(texts):
            got = counted(block, self.cut)
            known = pc.fill_null(pc.index_in(got.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = known[got.gram] if len(known) else np.zeros(0, np.int64)
            kept = term >= 0
            found.append((got.doc[kept] + first, term[kept], got.times[kept]))
            first += len(block)
        doc, term, times = map(np.concatenate, zip(*found))
        order = np.argsort(term * max(len(texts), 1) + doc if by_term else doc * max(len(self.terms), 1) + term)
        return doc[order], term[order], times[order]

    def shape(self, times: np.ndarray) -> np.ndarray:
        """What counts stand for before they are weighted by term."""
        return 1 + np.log(times) if self.sublinear else times.astype(np.float64)


def vectors(df: DataFrame, cut: Cut, terms: list[str], idf: list[float], sublinear: bool, offset: int = 0) -> Callable[[Column], Column]:
    """From a text to its TF-IDF weights of unit norm, as ``CELLS``; ``terms`` are bounded and sent to the tasks once.

    Their features are numbered from ``offset``."""
    shared = df.sparkSession.sparkContext.broadcast(Vocabulary.of(cut, terms, idf, sublinear, offset))

    def block_cells(block: pa.Array) -> pa.Array:
        known = shared.value
        doc, term, times = known.entries(block)
        raw = known.shape(times) * known.idf[term]
        norm = np.sqrt(np.bincount(doc, raw * raw, len(block)))
        at = pa.array(np.r_[0, np.cumsum(np.bincount(doc, minlength=len(block)))].astype(np.int32))
        lists = pa.ListArray.from_arrays(at, pa.array((term + offset).astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(raw / norm[doc]))
        return pa.StructArray.from_arrays(lists, ["indices", "values"])

    @F.arrow_udf(CELLS)
    def cells(texts: pa.Array) -> pa.Array:
        made = [block_cells(block) for block in blocks(texts)]
        return pa.concat_arrays(made) if made else block_cells(texts)

    # Named nondeterministic so that no plan copies the call into every use of its result.
    once = cells.asNondeterministic()
    return lambda text: once(cut.prepared(text))
