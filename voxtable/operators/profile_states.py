"""Profiles that add up: a stored state per batch, merged without reading old batches again.

A state has one row per column and one for the text length. Rows and missing values are exact sums;
distinct values are HyperLogLog sketches and lengths KLL sketches, both merged by Spark's own
functions, so a state's size does not depend on the rows behind it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.lexicon import LENGTH_QUANTILES
from voxtable.operators.profiling import quantile_name

# Standard errors: distinct values 1.04 / sqrt(2^lgK), about 1.6 %; ranks of lengths about 1.3 %.
LG_K, KLL_K = 12, 200
LENGTH = "length"


def profile_state(df: DataFrame, columns: Sequence[str], text_col: str | None = None) -> DataFrame:
    """(column, rows, missing, distinct_sketch, length_sketch, min, max, total), from one pass over ``df``."""
    aggs = [F.count("*").alias("__n")]
    for i, c in enumerate(columns):
        value = F.col(f"`{c}`")
        aggs += [F.count_if(value.isNull()).alias(f"m{i}"), F.hll_sketch_agg(value.cast("string"), F.lit(LG_K)).alias(f"d{i}")]
    empty = F.lit(None)
    if text_col:
        size = F.char_length(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).cast("long")
        aggs += [F.kll_sketch_agg_bigint(size, F.lit(KLL_K)).alias("k"), F.min(size).alias("lo"), F.max(size).alias("hi"), F.sum(size).alias("sum"), F.count_if(F.col(f"`{text_col}`").isNull()).alias("mt")]
    rows = [
        F.struct(F.lit(c).alias("column"), F.col("__n").alias("rows"), F.col(f"m{i}").alias("missing"), F.col(f"d{i}").alias("distinct_sketch"),
                 empty.cast("binary").alias("length_sketch"), *[empty.cast("long").alias(x) for x in ("min", "max", "total")])
        for i, c in enumerate(columns)
    ]
    if text_col:
        rows.append(F.struct(
            F.lit(LENGTH).alias("column"), F.col("__n").alias("rows"), F.col("mt").alias("missing"), empty.cast("binary").alias("distinct_sketch"),
            F.col("k").alias("length_sketch"), F.col("lo").alias("min"), F.col("hi").alias("max"), F.col("sum").alias("total"),
        ))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def merged(states: DataFrame | Sequence[DataFrame]) -> DataFrame:
    """One state from many; merging in any order and grouping gives the same sums and bounds."""
    both = states if isinstance(states, DataFrame) else reduce(DataFrame.unionByName, states)
    return both.groupBy("column").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_union_agg("distinct_sketch").alias("distinct_sketch"),
        F.kll_merge_agg_bigint("length_sketch").alias("length_sketch"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("total").alias("total"),
    )


def column_report(state: DataFrame) -> DataFrame:
    """Rows, missing values and distinct values (a missing one counts) per column."""
    unique = F.hll_sketch_estimate("distinct_sketch") + (F.col("missing") > 0).cast("long")
    return state.filter(F.col("column") != LENGTH).select("column", "rows", "missing", unique.alias("unique"))


def length_report(state: DataFrame) -> DataFrame:
    """Rows, least, greatest and mean length, exact; quantiles within the sketch's rank error."""
    quantiles = [F.kll_sketch_get_quantile_bigint("length_sketch", F.lit(float(q))).alias(quantile_name(q)) for q in LENGTH_QUANTILES]
    return state.filter((F.col("column") == LENGTH) & (F.col("rows") > 0)).select("rows", "min", "max", (F.col("total") / F.col("rows")).alias("mean"), *quantiles)
