"""Whole Arrow batches of texts as byte arrays: words, spans and 64-bit span hashes with numpy.

Texts are cut into groups of bounded size, so the memory of a task follows ``GROUP_BYTES``
and its longest single text, not its partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Bytes of text handled at once; a longer single text forms a group of its own.
GROUP_BYTES = 1 << 19
# Bytes hashed at once inside a group.
HASH_BLOCK = 1 << 17

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
_MASK = (1 << 64) - 1


def separators(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[np.frombuffer(chars, np.uint8)] = True
    return flags


BLANK = separators(BLANKS)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
# After A-Z are lower-cased: all ASCII but letters and digits.
NOT_ALNUM = separators(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))[_FOLD]


class Hasher:
    """Polynomial hash over random byte values modulo 2**64, mixed at the end."""

    def __init__(self, seed: int, fold_case: bool):
        draw = np.random.default_rng(seed)
        values = draw.integers(1, _MASK, 256, dtype=np.uint64)
        self.values = values[_FOLD] if fold_case else values
        self.base = int(draw.integers(0, _MASK, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, HASH_BLOCK)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of sorted spans of ``data`` that do not overlap."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + HASH_BLOCK, "right")))
            low, high = int(starts[i]), int(ends[j - 1])
            self._powers(high - low + 1)
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum(self.values[data[low:high]] * self.up[: high - low], out=sums[1:])
            s, e = starts[i:j] - low, ends[i:j] - low
            out[i:j] = (sums[e] - sums[s]) * self.down[s] + (e - s).astype(np.uint64)
            i = j
        return mixed(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@lru_cache
def hasher(seed: int, fold_case: bool = True) -> Hasher:
    return Hasher(seed, fold_case)


def groups(column: pa.Array, limit: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a string column into (first row, end row, bytes, offsets); a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1))
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(apart: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs of bytes not in ``apart``, which never cross rows."""
    n = len(apart)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    on = ~apart
    starts = on.copy()
    starts[1:] &= apart[:-1] | edge[1:n]
    ends = on.copy()
    ends[:-1] &= apart[1:] | edge[1:n]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    counts = np.bincount(rows, weights, n)
    return counts.astype(np.int64)


def gram_hashes(words: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Hash of words[i:i+k] for every i (the last k-1 entries are missing)."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(seed).integers(0, _MASK, k, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += words[j : j + n] * factors[j]
    return mixed(total)


def inside(rows: np.ndarray, k: int) -> np.ndarray:
    """Which k-grams of a word sequence lie in one row."""
    n = len(rows) - k + 1
    return rows[:n] == rows[k - 1 :] if n > 0 else np.zeros(0, bool)


def long_column(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64, copy=False))


def signed(values: np.ndarray) -> pa.Array:
    """64-bit hashes as the signed integers Spark has."""
    return pa.array(values.view(np.int64))


def text_map(df, text_col: str, fn, fields: str, keep: list[str] | None = None, strings: bool = False):
    """Rows of ``df`` with columns computed from whole texts, in place and without a shuffle.

    ``fn(bytes, offsets)``, or with ``strings`` ``fn(list of str)``, gives one array per field
    of the DDL string ``fields``. ``keep`` names the columns to carry (default: all); an added
    column replaces one of its name.
    """
    from pyspark.sql import functions as F
    from pyspark.sql.types import StructField, StructType

    added = StructType.fromDDL(fields)
    carried = [c for c in (df.columns if keep is None else keep) if c not in added.names]
    slim = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(carried)], F.col(f"`{text_col}`").cast("string").alias("in_text"))
    schema = StructType([*slim.schema.fields[:-1], *(StructField(f"out_{i}", f.dataType) for i, f in enumerate(added))])
    names, n = schema.names, len(carried)

    def run(batches):
        for batch in batches:
            for i, j, data, offsets in groups(batch.column(n)):
                got = fn([x or "" for x in batch.column(n).slice(i, j - i).to_pylist()]) if strings else fn(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(n)), *got], names)

    return slim.mapInArrow(run, schema).toDF(*carried, *added.names)


def running(flags: np.ndarray) -> np.ndarray:
    """Counts before each position, so a span's count is a difference."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out
