"""Joins whose small side is broadcast only after its rows were counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scale import checkpointed

# Rows of a few numbers each; about 20 MB once hashed.
BROADCAST_ROWS = 150_000
# Rows of a few numbers each that one task takes on.
ROWS_PER_TASK = 50_000


def settled(df: DataFrame) -> DataFrame:
    """Written once to the shared folder, so later steps neither recompute nor lose it."""
    return checkpointed(df)


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of about ``rows`` rows in no more partitions than these rows are worth.

    Each task of a shuffle leaves files of its own, so tables of a few rows in many partitions
    cost more disk and time than their rows.
    """
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``settled`` and ``gathered``, with its number of rows."""
    kept = settled(df)
    rows = kept.count()
    return gathered(kept, rows), rows


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, whose rows of fixed width were counted, marked for broadcast if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def row_key(id_col: str, text_col: str) -> list:
    """Names a row by id and content: rows alike in both share their verdict. Never null."""
    i, t = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    return [
        F.xxhash64(F.coalesce(i, F.lit("")), F.coalesce(t, F.lit("")), i.isNull(), t.isNull()).alias("__k1"),
        F.md5(F.concat_ws("\x00", F.coalesce(i, F.lit("\x01")), F.coalesce(t, F.lit("\x01")))).substr(1, 16).alias("__k2"),
    ]


def without(docs: DataFrame, bad: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` that ``bad`` (columns __k1, __k2) does not name, columns unchanged."""
    bad, n = counted(bad.select("__k1", "__k2").distinct())
    names = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    id_name, text_name = names[docs.columns.index(id_col)], names[docs.columns.index(text_col)]
    keyed = plain.select("*", *row_key(id_name, text_name))
    return keyed.join(sized(bad, n), ["__k1", "__k2"], "left_anti").select(*names).toDF(*docs.columns)
