"""Line dedup by winnowing over line hashes.

The unit is a line with a word, read without the blanks around it; lines without a word are
passed over. A window is a shortest stretch of lines that holds at least ``MIN_WORDS`` words,
taken forward from every line and backward from every line. Each window selects its least
line hash as fingerprint. A passage of that many words in whole lines holds a window, and
its other places hold the same one with the same fingerprint, so every such repetition is met.
Fingerprints found at one place only are put aside; at the others, windows of equal content
are joined with the first place of that content, and matches of neighbouring windows extend
each other to the whole run both ways. Of every run all places but the first are deleted.

In other words: a line goes if it lies in a stretch of lines of at least ``MIN_WORDS`` words whose
content also stands earlier, by document id (null first), then content key, then line.

Defined results: null and empty texts stay as they are. Rows alike in id and text count as
one row: none makes the other a repetition, and all get the same text. A text may lose all its
lines and is then empty; the row stays. Lines that stay keep their blanks, and lines without
a word stay. Extra columns are kept by ``without_repeats``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import counted, row_key, settled, sized

MIN_WORDS = 50


def _lines(data: np.ndarray, offsets: np.ndarray):
    """Spans without outer blanks, rows and word counts of the lines that have a word."""
    starts, ends, _ = cx.spans(cx.BLANK[data], offsets)
    first, _, rows = cx.spans(data == 10, offsets)
    line = np.searchsorted(first, starts, "right") - 1
    opens = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
    closes = np.r_[opens[1:], len(line)] - 1 if len(line) else opens
    return starts[opens], ends[closes], rows[line[opens]], closes - opens + 1


def _windows(words: np.ndarray, rows: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last line of the shortest stretches of ``least`` words from and to each line."""
    n = len(words)
    total = np.r_[0, np.cumsum(words)]
    each = np.arange(n)
    last = np.searchsorted(total, total[:-1] + least, "left") - 1
    first = np.searchsorted(total, total[1:] - least, "right") - 1
    ahead = (last < n) & (rows[np.minimum(last, n - 1)] == rows)
    back = (first >= 0) & (rows[np.maximum(first, 0)] == rows)
    pairs = np.unique(np.stack([np.r_[each[ahead], first[back]], np.r_[last[ahead], each[back]]], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _finder(least: int):
    draw = np.random.default_rng(77)
    bases = [int(draw.integers(0, (1 << 64) - 1, dtype=np.uint64)) | 1 for _ in range(2)]

    def powers(base: int, n: int) -> np.ndarray:
        steps = np.full(n, base, np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    def run(data, offsets):
        starts, ends, rows, words = _lines(data, offsets)
        n, lines = len(offsets) - 1, len(starts)
        if not lines:
            return [pa.array([[]] * n, _FOUND_TYPE)]
        one, two = (cx.hasher(seed, False)(data, starts, ends) for seed in (71, 72))
        first, last = _windows(words, rows, least)
        size = last - first + 1
        contents = []
        for key, base in zip((one, two), bases):
            sums = np.zeros(lines + 1, np.uint64)
            np.cumsum(key * powers(base, lines), out=sums[1:])
            contents.append(cx.mixed((sums[last + 1] - sums[first]) * powers(pow(base, -1, 1 << 64), lines)[first] + size.astype(np.uint64)))
        bounds = np.stack([first, last + 1], 1).ravel()
        low = np.minimum.reduceat(np.r_[one, np.uint64((1 << 64) - 1)], bounds)[::2] if len(first) else one[:0]
        # Where the least hash stands first in its window.
        spot = np.full(len(first), -1)
        for step in range(int(size.max()) if len(size) else 0):
            at = np.minimum(first + step, lines - 1)
            spot = np.where((spot < 0) & (step < size) & (one[at] == low), at, spot)
        begin = np.searchsorted(rows, np.arange(n + 1))
        cuts = np.searchsorted(first, begin).astype(np.int32)
        base_line = begin[rows[first]] if len(first) else first
        found = pa.StructArray.from_arrays(
            [cx.signed(low), pa.array((spot - base_line).astype(np.int32)), cx.signed(contents[0]), cx.signed(contents[1]),
             pa.array((first - base_line).astype(np.int32)), pa.array(size.astype(np.int32))], ["fp", "spot", "w1", "w2", "at", "n"],
        )
        return [pa.ListArray.from_arrays(pa.array(cuts), found)]

    return run


_FOUND = "array<struct<fp:bigint,spot:int,w1:bigint,w2:bigint,at:int,n:int>>"
_FOUND_TYPE = pa.list_(pa.struct([("fp", pa.int64()), ("spot", pa.int32()), ("w1", pa.int64()), ("w2", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(__k1, __k2, spans): the stretches of lines to delete, by row key."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *row_key(id_col, text_col))
    own = cx.text_map(slim, "text", _finder(min_words), f"found {_FOUND}", ["doc_id", "__k1", "__k2"])
    own = settled(own.filter(F.size("found") > 0).dropDuplicates(["__k1", "__k2"]))
    marks = own.select(F.explode(F.array_distinct(F.transform("found", lambda w: F.struct(w["fp"], w["spot"])))).alias("mark"))
    shared, n_shared = counted(marks.groupBy("mark.fp").agg(F.count("*").alias("places")).filter("places > 1").select("fp"))
    spots = own.select("doc_id", "__k1", "__k2", F.inline("found")).join(sized(shared, n_shared), "fp", "left_semi")
    place = F.struct("doc_id", "__k1", "__k2", "at")
    known, n_known = counted(spots.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("places")).filter("places > 1").select("w1", "w2", "first"))
    again = spots.join(sized(known, n_known), ["w1", "w2"]).filter(place != F.col("first"))
    return again.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("at", "n")).alias("spans"))


def _rewritten(batch: pa.RecordBatch, text_at: int, spans_at: int):
    texts, removed, lines = [], [], []
    for text, spans in zip(batch.column(text_at).to_pylist(), batch.column(spans_at).to_pylist()):
        parts = text.split("\n") if text else []
        full = [i for i, part in enumerate(parts) if part.strip(_BLANKS)]
        gone = {full[k] for s in spans or () for k in range(s["at"], s["at"] + s["n"])}
        texts.append("\n".join(p for i, p in enumerate(parts) if i not in gone) if gone else text)
        removed.append(len(gone))
        lines.append(len(full))
    return [pa.array(texts, pa.string()), pa.array(lines, pa.int64()), pa.array(removed, pa.int64())]


_BLANKS = cx.BLANKS.decode()


def _applied(docs: DataFrame, id_col: str, text_col: str, min_words: int, keep: list[str]) -> DataFrame:
    """Columns ``keep`` but the text as c0, c1, ..., then the new text, its lines and how many went."""
    spans = settled(repeats(docs, id_col, text_col, min_words))
    keep = [c for c in keep if c != text_col]
    keyed = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text_col}`").cast("string").alias("text"), *row_key(id_col, text_col))
    joined = keyed.join(spans, ["__k1", "__k2"], "left").select(*[f"c{i}" for i in range(len(keep))], "text", "spans")
    n, names = len(keep), [*(f"c{i}" for i in range(len(keep))), "text", "n_lines", "n_removed_lines"]

    def run(batches):
        for batch in batches:
            for i, j, _, _ in cx.groups(batch.column(n)):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *_rewritten(part, n, n + 1)], names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:n])
    return joined.mapInArrow(run, f"{schema}{', ' * bool(n)}text string, n_lines long, n_removed_lines long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document: text without later repeated runs, its lines, and how many went."""
    return _applied(docs, id_col, text_col, min_words, [id_col]).select(F.col("c0").alias(id_col), "n_lines", "n_removed_lines", "text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` with shortened texts; ``size_col`` follows the text's length."""
    done = _applied(docs, id_col, text_col, min_words, docs.columns)
    place = {c: F.col(f"c{i}") for i, c in enumerate(c for c in docs.columns if c != text_col)} | {text_col: F.col("text")}
    if size_col:
        place[size_col] = F.length("text").cast(docs.schema[size_col].dataType)
    return done.select(*[place[c].alias(c) for c in docs.columns])
