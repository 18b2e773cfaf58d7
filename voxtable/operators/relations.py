"""How classes differ: cross-tabs, script mix, pattern rates, tokens, similarity, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.operators.profiling import script_counts
from voxtable.functions.features import spotted
from voxtable.regexes import java
from voxtable.scale import top_k_per_group


def crosstab(df: DataFrame, row_col: str, col_col: str) -> DataFrame:
    """Counts and row percentages (2 decimals) in long form, zero cells included."""
    seen = df.filter(F.col(row_col).isNotNull() & F.col(col_col).isNotNull())
    cells = seen.groupBy(row_col, col_col).agg(F.count("*").alias("count"))
    # Every row value meets every column value: one array of the few column values per row.
    columns = cells.agg(F.collect_set(col_col)).scalar()
    per_row = cells.groupBy(row_col).agg(
        F.sum("count").alias("total"), F.map_from_entries(F.collect_list(F.struct(col_col, "count"))).alias("m")
    )
    return per_row.select(row_col, "total", "m", F.explode(columns).alias(col_col)).select(
        row_col, col_col,
        F.coalesce(F.col("m")[F.col(col_col)], F.lit(0)).alias("count"),
        F.round(100.0 * F.coalesce(F.col("m")[F.col(col_col)], F.lit(0)) / F.col("total"), 2).alias("row_pct"),
    )


def length_by_class(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """n, mean, median and 90 % quantile of the length, from the per-class length histogram."""
    length = F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("len")
    hist = df.filter(F.col(label_col).isNotNull()).groupBy(label_col, length).agg(F.count("*").alias("w"))
    return hist.groupBy(label_col).agg(
        F.sum("w").alias("n"),
        (F.sum(F.col("len") * F.col("w")) / F.sum("w")).alias("mean"),
        F.percentile("len", 0.5, F.col("w")).alias("median"),
        F.percentile("len", 0.9, F.col("w")).alias("q90"),
    )


def script_mix(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """Per class: mean script fractions (empty texts left out) and shares of texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    counted = df.filter(F.col(label_col).isNotNull()).select(
        label_col, F.char_length(text).alias("len"), *[c.alias(n) for n, c in script_counts(text).items()]
    )
    size = F.nullif(F.col("len"), F.lit(0))

    def share(condition: Column) -> Column:
        return F.avg(condition.cast("double"))

    return counted.groupBy(label_col).agg(
        F.avg("len").alias("mean_len"),
        F.avg(F.col("ar") / size).alias("arabic_frac_mean"),
        F.avg(F.col("la") / size).alias("latin_frac_mean"),
        F.avg(F.col("di") / size).alias("digit_frac_mean"),
        share(F.col("ar") > F.col("la")).alias("pct_mostly_arabic"),
        share(F.col("la") > 0).alias("pct_has_latin"),
        share(F.col("ar") > 0).alias("pct_has_arabic"),
        share(F.col("di") > 0).alias("pct_has_digits"),
    )


def pattern_rates(df: DataFrame, text_col: str, label_col: str, patterns=lx.DOMAIN_PATTERNS) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    rates = [F.avg(spotted(text, p, ignore_case).cast("double")).alias(n) for n, p, ignore_case in patterns]
    kept = df.filter(F.col(label_col).isNotNull()).select(label_col, text_col)
    return kept.groupBy(label_col).agg(*rates)


def tokens(text: Column) -> Column:
    """Placeholders, Arabic runs, Latin runs (lower-cased) and digit runs, in order."""
    found = F.regexp_extract_all(text, F.lit(java(lx.TOKEN)), F.lit(0))
    return F.transform(found, lambda t: F.when(t.rlike("^[A-Za-z]+$"), F.lower(t)).otherwise(t))


def token_counts(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    """(label, token, n) for informative tokens: two characters up, no one- or two-digit numbers.

    The pair is counted map-side, so a frequent token of a large class reaches a reducer as
    one partial count per task.
    """
    words = F.explode(tokens(F.coalesce(F.col(text_col), F.lit("")))).alias("token")
    kept = df.filter(F.col(label_col).isNotNull()).select(F.col(label_col).alias("label"), words)
    kept = kept.filter((F.char_length("token") >= 2) & ~F.col("token").rlike(java(r"^\d{1,2}$")))
    return kept.groupBy("label", "token").agg(F.count("*").alias("n"))


def top_tokens(counts: DataFrame, k: int = 25) -> DataFrame:
    return top_k_per_group(counts, ["label"], [F.desc("n"), F.asc("token")], k, ["token"], "rank")


def distinctive_tokens(counts: DataFrame, k: int = 20, alpha: float = 0.01) -> DataFrame:
    """Tokens with the highest smoothed log-odds of a class against all other classes.

    Every class scores the whole vocabulary. The counts are gathered to one row per token
    (at most one entry per class), which is then expanded over the classes in place.
    """
    per_class = counts.groupBy("label").agg(F.sum("n").alias("n"))
    classes = per_class.agg(F.collect_list(F.struct("label", "n"))).scalar()
    total = counts.agg(F.sum("n")).scalar()
    by_token = counts.groupBy("token").agg(
        F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("m"), F.sum("n").alias("all")
    )
    vocabulary = counts.agg(F.count_distinct("token")).scalar()
    cells = by_token.select("token", "m", "all", F.explode(classes).alias("c")).select(
        F.col("c.label").alias("label"), "token", "all", F.coalesce(F.col("m")[F.col("c.label")], F.lit(0)).alias("a"),
        F.col("c.n").alias("n_cls"),
    )

    def logit(p: Column) -> Column:
        held = F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9))
        return F.log(held / (1 - held))

    inside = (F.col("a") + alpha) / (F.col("n_cls") + alpha * vocabulary)
    outside = (F.col("all") - F.col("a") + alpha) / (F.greatest(total - F.col("n_cls"), F.lit(1)) + alpha * vocabulary)
    # Scores that agree to nine decimals count as ties and go in token order.
    scored = cells.select("label", "token", F.round(logit(inside) - logit(outside), 9).alias("score"))
    return top_k_per_group(scored, ["label"], [F.desc("score"), F.asc("token")], k, ["token"], "rank")


def class_similarity(top: DataFrame, k: int = 20) -> DataFrame:
    """Jaccard similarity (3 decimals) of the top-k token sets of every two classes."""
    sets = top.filter(F.col("rank") <= k).select("label", "token")
    sizes = sets.groupBy("label").agg(F.count("*").alias("size"))
    index = sizes.agg(F.collect_list(F.struct("label", "size"))).scalar()
    shared = sets.join(sets.select(F.col("label").alias("other"), "token"), "token").groupBy("label", "other").agg(F.count("*").alias("common"))
    # One cell per two classes is the requested matrix; classes are few by definition.
    grid = sizes.select("label", "size", F.explode(index).alias("o")).select(
        "label", "size", F.col("o.label").alias("other"), F.col("o.size").alias("other_size")
    )
    common = F.coalesce("common", F.lit(0))
    union = F.greatest(F.col("size") + F.col("other_size") - common, F.lit(1))
    value = F.when(F.col("label") == F.col("other"), F.lit(1.0)).otherwise(F.round(common / union, 3))
    return grid.join(shared, ["label", "other"], "left").select("label", "other", value.alias("jaccard"))


def nearest_classes(similarity: DataFrame, k: int = 3) -> DataFrame:
    others = similarity.filter(F.col("label") != F.col("other"))
    return top_k_per_group(others, ["label"], [F.desc("jaccard"), F.asc("other")], k, ["other"], "rank")


def seeded_examples(
    df: DataFrame, text_col: str, label_col: str, id_col: str, n: int = 3, seed: int = 42, width: int = 260
) -> DataFrame:
    """``n`` examples per class in an order fixed by the seed."""
    shown = F.translate(F.substring(F.coalesce(F.col(text_col), F.lit("")), 1, width), "\n", " ")
    keyed = df.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.col(id_col).alias("id"), shown.alias("example"),
        F.md5(F.concat_ws("-", F.col(id_col).cast("string"), F.lit(str(seed)))).alias("__h"),
    )
    return top_k_per_group(keyed, ["label"], [F.asc("__h"), F.asc("id")], n, ["id"], "rank").drop("__h")


def first_examples(df: DataFrame, text_col: str, label_col: str, id_col: str, n: int = 3, width: int = 220) -> DataFrame:
    shown = F.substring(F.translate(F.coalesce(F.col(text_col), F.lit("")), "\n", " "), 1, width)
    keyed = df.filter(F.col(label_col).isNotNull()).select(
        F.col(label_col).alias("label"), F.col(id_col).alias("id"), shown.alias("example")
    )
    return top_k_per_group(keyed, ["label"], [F.asc("id")], n, ["id"], "rank")
