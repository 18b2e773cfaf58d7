"""Corpus and table profiles as tidy tables.

Values are counted once per (column, value) with map-side combining; cardinality, top
values, duplicates and UNK rates are read off those counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.config import UNK
from voxtable.functions.features import spotted
from voxtable.regexes import java
from voxtable.scale import text_digest, top_k_per_group

NA = "<NA>"


def _cells(df: DataFrame, columns) -> DataFrame:
    pairs = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).select("p.column", "p.value")


def missing_table(df: DataFrame, columns=None) -> DataFrame:
    """Missing count and rate per column: one pass, then one row per column."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_count")) for c in columns]))
    out = counts.select("__n", rows.alias("r")).select("r.column", "r.missing_count", "__n")
    rate = F.coalesce(F.col("missing_count") / F.nullif(F.col("__n"), F.lit(0)), F.lit(0.0))
    return out.select("column", "missing_count", rate.alias("missing_rate")).orderBy(F.desc("missing_rate"), "column")


def value_counts(df: DataFrame, columns) -> DataFrame:
    return _cells(df, columns).groupBy("column", "value").agg(F.count("*").alias("count"))


def top_values(df: DataFrame, columns, k: int = 20, counts: DataFrame | None = None) -> DataFrame:
    """Most frequent values per column, missing shown as ``<NA>``; ties in value order."""
    counts = (counts or value_counts(df, columns)).withColumn("value", F.coalesce("value", F.lit(NA)))
    order = [F.desc("count"), F.asc("value")]
    return top_k_per_group(counts, ["column"], order, k, ["value"], "rank")


def cardinality(df: DataFrame, columns, counts: DataFrame | None = None) -> DataFrame:
    """Distinct values per column, a missing value counting as one."""
    counts = counts or value_counts(df, columns)
    return counts.groupBy("column").agg(F.count("*").alias("unique")).orderBy(F.desc("unique"), "column")


def approx_cardinality(df: DataFrame, columns, rsd: float = 0.02) -> DataFrame:
    """Sketch-based cardinality for very wide value sets; one pass, no value shuffle."""
    aggs = [
        (F.approx_count_distinct(F.col(f"`{c}`"), rsd) + F.max(F.col(f"`{c}`").isNull().cast("int"))).alias(c) for c in columns
    ]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("unique")) for c in columns]))
    return df.agg(*aggs).select(rows.alias("r")).select("r.column", "r.unique")


def unknown_rates(df: DataFrame, columns, token: str = UNK) -> DataFrame:
    rates = df.agg(*[F.avg(F.coalesce(F.col(f"`{c}`").cast("string") == token, F.lit(False)).cast("double")).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("unk_rate")) for c in columns]))
    return rates.select(rows.alias("r")).select("r.column", "r.unk_rate")


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, missing as ``<NA>``."""
    named = F.coalesce(F.col(column).cast("string"), F.lit(NA)).alias("value")
    return df.groupBy(named).agg(F.count("*").alias("count")).orderBy("value")


def duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Surplus rows per key. Long keys are grouped by digest, so texts are not shuffled."""
    parts = []
    for name, key in keys.items():
        digest = F.coalesce(text_digest(key.cast("string")), F.lit("null").cast("binary"))
        counted = df.groupBy(digest.alias("k")).agg(F.count("*").alias("c"))
        parts.append(counted.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicates")).select(F.lit(name).alias("key"), "duplicates"))
    return reduce(DataFrame.unionByName, parts)


def full_row(df: DataFrame) -> Column:
    """Whole row as one text; missing and empty cells stay different."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})


def noise_counts(df: DataFrame, text_col: str) -> DataFrame:
    """Rows in which each noise pattern occurs, in one pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def hit(name: str, pattern: str, ignore_case: bool) -> Column:
        found = text.rlike(java(pattern, ignore_case, word_inside=pattern != lx.EMAIL))
        return F.count_if(text.contains("@") & found if pattern == lx.EMAIL else found).alias(name)

    return df.select(text_col).agg(*[hit(*spec) for spec in lx.NOISE_PATTERNS])


def _histogram(df: DataFrame, value: Column, groups) -> DataFrame:
    return df.groupBy(*groups, value.alias("len")).agg(F.count("*").alias("w"))


def length_stats(df: DataFrame, text_col: str, groups=(), approximate: bool = False) -> DataFrame:
    """Minimum, maximum, mean and quantiles of the text length.

    Exact quantiles come from the length histogram, whose size is the number of different
    lengths, not the number of rows.
    """
    length = F.char_length(F.coalesce(F.col(text_col), F.lit("")))
    hist = _histogram(df, length, groups)
    quantiles = [
        (F.approx_percentile("len", q) if approximate else F.percentile("len", q, F.col("w"))).cast("double").alias(quantile_name(q))
        for q in lx.LENGTH_QUANTILES
    ]
    return hist.groupBy(*groups).agg(
        F.sum("w").alias("rows"),
        F.min("len").cast("long").alias("min"),
        F.max("len").cast("long").alias("max"),
        (F.sum(F.col("len") * F.col("w")) / F.sum("w")).alias("mean"),
        *quantiles,
    )


def quantile_name(q: float) -> str:
    return "q" + f"{q * 100:g}".replace(".", "_")


def stage_union(stages: dict[str, DataFrame]) -> DataFrame:
    """Raw and cleaned forms of a table under one ``stage`` column."""
    return reduce(DataFrame.unionByName, [df.withColumn("stage", F.lit(name)) for name, df in stages.items()])


def compare_stages(stages: dict[str, DataFrame], columns, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per stage and column: distinct non-missing values; and the top ``k`` values."""
    counts = stage_union({n: value_counts(df, columns) for n, df in stages.items()})
    unique = counts.groupBy("stage", "column").agg(F.count("value").alias("unique"))
    named = counts.withColumn("value", F.coalesce("value", F.lit(NA)))
    top = top_k_per_group(named, ["stage", "column"], [F.desc("count"), F.asc("value")], k, ["value"], "rank")
    return unique, top


def basic_stats(df: DataFrame, platform_col: str, label_col: str, text_col: str, k: int = 20) -> DataFrame:
    """Rows, duplicates, length range, platform and label counts as (section, key, value)."""

    def section(name: str, key: Column, value: Column, source: DataFrame) -> DataFrame:
        return source.select(F.lit(name).alias("section"), key.cast("string").alias("key"), value.cast("double").alias("value"))

    dup = duplicates(df, {"row": full_row(df), "text": F.col(text_col)})
    size = length_stats(df, text_col)
    stats = ["rows", "min", "max", "mean", *[quantile_name(q) for q in lx.LENGTH_QUANTILES]]
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("k"), F.col(s).cast("double").alias("v")) for s in stats])).alias("p")
    long = size.select(pairs)
    platforms = top_values(df.filter(F.col(platform_col).isNotNull()), [platform_col], k)
    labels = distribution(df, label_col)
    return reduce(DataFrame.unionByName, [
        section("duplicates", F.col("key"), F.col("duplicates"), dup),
        section("length", F.col("p.k"), F.col("p.v"), long),
        section("platform", F.col("value"), F.col("count"), platforms),
        section("label", F.col("value"), F.col("count"), labels),
    ])


def run_summary(train: DataFrame, test: DataFrame, time_col: str, extra: list[DataFrame] = ()) -> DataFrame:
    """Rows, missing rates, parse rate and columns of both tables as (split, section, key, value)."""
    parts = []
    for split, df in (("train", train), ("test", test)):
        parts.append(df.agg(F.count("*").cast("double").alias("value")).select(
            F.lit(split).alias("split"), F.lit("rows").alias("section"), F.lit("rows").alias("key"), "value"))
        miss = missing_table(df)
        parts.append(miss.select(F.lit(split).alias("split"), F.lit("missing_rate").alias("section"), F.col("column").alias("key"), F.col("missing_rate").alias("value")))
        rate = df.agg(F.coalesce(F.avg(F.col(time_col).isNotNull().cast("double")), F.lit(0.0)).alias("value"))
        parts.append(rate.select(F.lit(split).alias("split"), F.lit("datetime_parse_rate").alias("section"), F.lit(time_col).alias("key"), "value"))
    return reduce(DataFrame.unionByName, [*parts, *extra])


def script_counts(text: Column) -> dict[str, Column]:
    """Arabic letters, Latin letters and digits, each by the length its runs leave behind."""
    size = F.char_length(text)

    def count(chars: str) -> Column:
        return size - F.char_length(F.regexp_replace(text, f"{chars}+", ""))

    return {"ar": count(lx.ARABIC), "la": count(lx.LATIN), "di": count(java(r"\d"))}


def script_dominance(df: DataFrame, text_col: str, groups=(), share: float = 0.55) -> DataFrame:
    """Share of texts dominated by one script, and mean script ratios over letters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = df.select(*groups, *[c.alias(n) for n, c in script_counts(text).items()])
    letters = F.nullif(F.col("ar") + F.col("la"), F.lit(0))
    ar, la = F.col("ar") / letters, F.col("la") / letters
    return counted.groupBy(*groups).agg(
        F.count("*").alias("rows"),
        F.avg(F.coalesce(ar >= share, F.lit(False)).cast("double")).alias("pct_ar_dominant"),
        F.avg(F.coalesce(la >= share, F.lit(False)).cast("double")).alias("pct_lat_dominant"),
        F.avg(F.coalesce(ar, F.lit(0.0))).alias("mean_ar_ratio"),
        F.avg(F.coalesce(la, F.lit(0.0))).alias("mean_lat_ratio"),
    )


def intent_prevalence(df: DataFrame, text_col: str, groups=()) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(*groups, text_col).groupBy(*groups).agg(*[F.avg(spotted(text, p, i).cast("double")).alias(n) for n, p, i in lx.INTENT_FLAGS])


def unknown_platforms(df: DataFrame, platform_col: str, known: list[str]) -> DataFrame:
    """Platforms outside the known list with their rows and share of all rows."""
    counts = df.groupBy(F.col(platform_col).alias("platform")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count")).scalar()
    strange = counts.filter(~F.coalesce(F.col("platform").isin(*known), F.lit(False)))
    return strange.select("platform", "count", (F.col("count") / total).alias("rate"))
