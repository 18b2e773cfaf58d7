"""Benchmark decontamination by winnowing.

A window is 13 consecutive words of a benchmark item, or a shorter item as a whole. Both sides
keep the least hash of short word runs (k-grams) in every window of w runs, k + w - 1 being
the window's length. Equal windows keep equal runs, so every shared window, and with it every
longer shared span, is met by a joined fingerprint. A hit is then extended: the windows that
keep the shared run are compared with the benchmark's whole windows, neighbouring matches run
on both ways, and every word inside a matching window is hit.

The benchmark's fingerprints are joined. While they are few enough, a bit map of them goes
along to the documents and spares most rows the join; beyond, all fingerprints take part.

Defined results: a null, empty or wordless text has no words and is never hit; such an item
has no window. Items with equal text are all counted. A null item id does not occur in the
list of ids. Each row of the documents gets its own result row, repeated rows the same one;
a null document id is carried. Extra columns are ignored by ``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import row_key, settled, sized, without

WINDOW = 13
# Contaminated from this share of hit words on (1 in SHARE).
SHARE = 20
# Fingerprints up to which a bit map (16 bits each at most) goes to every task.
FILTER_ROWS = 2_000_000

_FOUND = "array<struct<fp:bigint,at:int,size:int,window:bigint>>"


def _run_length(size: int) -> int:
    return (size + 1) // 2


def _least(words: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of one size its least k-gram hash, and whether it lies in one text."""
    k = _run_length(size)
    grams, whole = cx.gram_hashes(words, k, 900 + size), cx.inside(rows, size)
    n = len(whole)
    least = grams[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, grams[j : j + n], out=least)
    return least, whole


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, rows = cx.spans(cx.NOT_ALNUM[data], offsets)
    return cx.hasher(91)(data, starts, ends), rows


def index(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Windows of the benchmark: item, size, hash of the window and the fingerprints it keeps."""

    def run(data, offsets):
        words, rows = _words(data, offsets)
        n = len(offsets) - 1
        sizes = cx.per_row(rows, n)
        first = np.concatenate([[0], np.cumsum(sizes)])
        out: list[list[dict]] = [[] for _ in range(n)]
        for i in range(n):
            own = words[first[i] : first[i + 1]]
            if not len(own):
                continue
            size = min(WINDOW, len(own))
            marks, _ = _least(own, np.zeros(len(own), np.int64), size)
            windows = cx.gram_hashes(own, size, 700 + size).view(np.int64)
            out[i] = [{"size": size, "window": w, "fp": None} for w in np.unique(windows).tolist()]
            out[i] += [{"size": size, "window": None, "fp": g} for g in np.unique(marks).view(np.int64).tolist()]
        return [pa.array(out, pa.list_(pa.struct([("size", pa.int32()), ("window", pa.int64()), ("fp", pa.int64())])))]

    rows = cx.text_map(items.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text")), "text", run, "found array<struct<size:int,window:bigint,fp:bigint>>", ["item_id"])
    return rows.select("item_id", F.inline("found"))


def _bit_map(fingerprints: np.ndarray) -> np.ndarray:
    bits = max(16, int(np.ceil(np.log2(max(1, len(fingerprints)) * 16))))
    table = np.zeros(1 << bits, bool)
    table[fingerprints.view(np.uint64) >> np.uint64(64 - bits)] = True
    return np.packbits(table)


def _found(docs: DataFrame, id_col: str, text_col: str, sizes: list[int], bit_map: np.ndarray | None) -> DataFrame:
    """Per document row its words, and the windows whose kept run the map lets by."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map)

    def run(data, offsets):
        words, rows = _words(data, offsets)
        n = len(offsets) - 1
        first = np.concatenate([[0], np.cumsum(cx.per_row(rows, n))])
        parts = []
        for size in sizes:
            marks, kept = _least(words, rows, size)
            table = shared.value
            if table is not None and len(marks):
                place = marks >> np.uint64(64 - int(len(table) * 8).bit_length() + 1)
                kept = kept & (table[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            starts = np.flatnonzero(kept)
            if not len(starts):
                continue
            windows = np.zeros(len(starts), np.uint64)
            factors = np.random.default_rng(700 + size).integers(0, (1 << 64) - 1, size, dtype=np.uint64) | np.uint64(1)
            for j in range(size):
                windows += words[starts + j] * factors[j]
            parts.append((starts, marks[starts], np.full(len(starts), size), cx.mixed(windows)))
        if parts:
            starts, runs, size, windows = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(starts, kind="stable")
            starts, runs, size, windows = starts[order], runs[order], size[order], windows[order]
            ends = np.searchsorted(starts, first).astype(np.int32)
            starts = starts - first[rows[starts]]
        else:
            starts = runs = size = windows = np.zeros(0, np.uint64)
            ends = np.zeros(n + 1, np.int32)
        found = pa.StructArray.from_arrays(
            [cx.signed(np.ascontiguousarray(runs)), pa.array(starts.astype(np.int32)), pa.array(size.astype(np.int32)), cx.signed(np.ascontiguousarray(windows))],
            ["fp", "at", "size", "window"],
        )
        return [cx.long_column(np.diff(first)), pa.ListArray.from_arrays(pa.array(ends), found)]

    return cx.text_map(docs, text_col, run, f"n_words long, found {_FOUND}", [c for c in docs.columns if c != text_col])


def _covered(spans: Column) -> Column:
    """Positions inside at least one of the sorted [at, until) ranges."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["until"] - F.greatest(s["at"], acc["upto"]), F.lit(0))).cast("long").alias("n"),
        F.greatest(s["until"], acc["upto"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def _results(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, keys: list) -> DataFrame:
    spark = docs.sparkSession
    found = settled(index(items))
    marks = found.select("fp", "size").filter("fp is not null").distinct()
    windows = found.select("window", "size", "item_id").filter("window is not null").distinct()
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())
    n_marks, n_windows = marks.count(), windows.count()
    bit_map = _bit_map(np.array([r["fp"] for r in marks.collect()], np.int64)) if n_marks <= FILTER_ROWS else None
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *keys)
    own = settled(_found(slim, "doc_id", "text", sizes, bit_map).withColumn("row", F.monotonically_increasing_id()))
    hits = own.filter(F.size("found") > 0).select("row", F.inline("found"))
    hits = hits.join(sized(marks, n_marks), ["fp", "size"], "left_semi").join(sized(windows, n_windows), ["window", "size"])
    spans = F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("until")))
    found_items = F.array_sort(F.collect_set("item_id"))
    hit = hits.groupBy("row").agg(_covered(spans).alias("n_hit"), found_items.alias("items"))
    per_doc = own.drop("found").join(hit, "row", "left").drop("row")
    none = F.array().cast("array<string>")
    return per_doc.select(
        *[c for c in per_doc.columns if c not in ("n_hit", "items")],
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def overlaps(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: its words, hit words, the items met and the verdict."""
    return _results(docs, items, id_col, text_col, [])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = _results(docs, items, id_col, text_col, row_key(id_col, text_col)).filter("contaminated")
    return without(docs, bad, id_col, text_col)
