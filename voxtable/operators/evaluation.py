"""Classification metrics from (true, predicted) label counts.

Predictions are counted per pair of labels first; everything else works on that tiny table,
so any number of groups (folds, models, weights) costs one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_counts(df: DataFrame, true_col: str, pred_col: str, groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups, F.col(true_col).alias("y"), F.col(pred_col).alias("p")).agg(F.count("*").alias("n"))


def _per_label(pairs: DataFrame, labels: Sequence | None, groups: Sequence[str]) -> DataFrame:
    """(groups, label, tp, support, predicted) for the explicit labels, or for all labels seen.

    Every pair adds to its true label and to its predicted label; explicit labels that never
    occur come in as rows of zeros.
    """
    parts = F.explode(F.array(
        F.struct(F.col("y").alias("label"), F.when(F.col("y").eqNullSafe(F.col("p")), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )).alias("s")
    rows = pairs.select(*groups, parts).select(*groups, "s.*")
    if labels is not None:
        zero = [F.lit(0).cast("long").alias(c) for c in ("tp", "support", "predicted")]
        kind = dict(pairs.dtypes)["y"]
        blank = pairs.select(*groups).distinct().select(*groups, F.explode(F.array(*[F.lit(v).cast(kind) for v in labels])).alias("label"), *zero)
        rows = rows.filter(F.col("label").isin(*labels)).unionByName(blank)
    return rows.filter(F.col("label").isNotNull()).groupBy(*groups, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def per_class_report(
    df: DataFrame, true_col: str, pred_col: str, labels: Sequence | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall, F1 and support per label; undefined ratios are 0."""
    table = _per_label(pair_counts(df, true_col, pred_col, groups), labels, groups)
    return table.select(
        *groups, "label",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
        F.col("support").alias("support"),
    )


def macro_f1(
    df: DataFrame, true_col: str, pred_col: str, labels: Sequence | None = None, groups: Sequence[str] = ()
) -> DataFrame:
    """Mean F1 over the explicit labels, or over the union of true and predicted labels."""
    return per_class_report(df, true_col, pred_col, labels, groups).groupBy(*groups).agg(F.avg("f1").alias("macro_f1"))


def confusion(
    df: DataFrame, true_col: str, pred_col: str, labels: Sequence | None = None, normalize: str | None = None
) -> DataFrame:
    """Confusion cells in long form, zeros included; ``normalize`` is None, true, pred or all."""
    if normalize not in (None, "true", "pred", "all"):
        raise ValueError(f"unknown normalisation {normalize!r}")
    pairs = pair_counts(df.filter(F.col(true_col).isNotNull() & F.col(pred_col).isNotNull()), true_col, pred_col)
    kind = dict(pairs.dtypes)["y"]
    if labels is None:
        both = pairs.select(F.explode(F.array("y", "p")).alias("l"))
        axis = both.agg(F.sort_array(F.collect_set("l")).alias("axis"))
    else:
        axis = df.sparkSession.range(1).select(F.array(*[F.lit(v).cast(kind) for v in labels]).alias("axis"))
        pairs = pairs.filter(F.col("y").isin(*labels) & F.col("p").isin(*labels))
    # The result has one cell per two labels, and labels are few by definition.
    grid = axis.select("axis", F.explode("axis").alias("y")).select("y", F.explode("axis").alias("p"))
    cells = grid.join(pairs, ["y", "p"], "left").select("y", "p", F.coalesce("n", F.lit(0)).alias("n"))
    value = F.col("n").cast("double")
    if normalize == "all":
        value = _ratio(value, cells.agg(F.sum("n")).scalar())
    elif normalize:
        key = "y" if normalize == "true" else "p"
        sums = cells.groupBy(key).agg(F.sum("n").alias("t"))
        totals = sums.agg(F.map_from_entries(F.collect_list(F.struct(key, "t")))).scalar()
        value = _ratio(value, totals[F.col(key)])
    return cells.select(F.col("y").alias("true"), F.col("p").alias("pred"), value.alias("value"))


def fold_summary(df: DataFrame, true_col: str, pred_col: str, labels: Sequence | None = None) -> DataFrame:
    """Macro-F1 per fold plus mean and population deviation over folds."""
    per_fold = macro_f1(df, true_col, pred_col, labels, ["fold"])
    stats = per_fold.agg(F.avg("macro_f1").alias("mean"), F.stddev_pop("macro_f1").alias("std"))
    return per_fold.select(F.concat(F.lit("fold"), F.col("fold").cast("string")).alias("name"), F.col("macro_f1").alias("value")).unionByName(
        stats.select(F.explode(F.array(F.struct(F.lit("mean").alias("name"), F.col("mean").alias("value")), F.struct(F.lit("std").alias("name"), F.col("std").alias("value")))).alias("s")).select("s.*")
    )


def disagreement(left: DataFrame, right: DataFrame, id_col: str, pred_col: str) -> DataFrame:
    """Share of common ids on which two models differ."""
    a, b = left.select(id_col, F.col(pred_col).alias("a")), right.select(id_col, F.col(pred_col).alias("b"))
    return a.join(b, id_col).agg(F.count("*").alias("rows"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("disagreement"))
