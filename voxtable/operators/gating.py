"""Time windows per class and the sequential gate that uses them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.lexicon import GATE_CLASSES, GATE_FALLBACK, GATE_OVERRIDES
from voxtable.operators.evaluation import per_class_report


def time_windows(train: DataFrame, label_col: str, time_col: str) -> DataFrame:
    """Earliest and latest time seen per label; labels without any time have no window."""
    return (
        train.filter(F.col(label_col).isNotNull() & F.col(time_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"))
        .agg(F.min(time_col).alias("t_min"), F.max(time_col).alias("t_max"))
    )


def gate_settings(saved: dict | None = None, classes=None, fallback=None, overrides=None) -> dict:
    """Gate parameters: argument, else saved defaults, else built-in."""
    saved = saved or {}
    stored = {int(k): int(v) for k, v in (saved.get("fallback_map") or {}).items()}
    kept = [int(c) for c in (saved.get("gate_classes") or [])]
    chosen = list(dict.fromkeys(classes)) if classes else (kept or list(GATE_CLASSES))
    if fallback is None:
        fallback = saved.get("fallback_class", GATE_FALLBACK)
    return {
        "classes": chosen,
        "fallback": int(fallback),
        "overrides": dict(overrides) if overrides is not None else stored,
    }


def _key(label: Column, fold: Column | None) -> Column:
    return label.cast("string") if fold is None else F.concat_ws("|", fold.cast("string"), label.cast("string"))


def window_lookup(windows: DataFrame) -> Column:
    """All windows as one scalar map, one entry per class (and fold): no join, no row shuffle."""
    fold = F.col("fold") if "fold" in windows.columns else None
    entry = F.struct(_key(F.col("label"), fold).alias("k"), F.struct("t_min", "t_max").alias("v"))
    return windows.agg(F.map_from_entries(F.collect_list(entry))).scalar()


def gate_by_time(
    df: DataFrame, windows: DataFrame, pred_col: str, time_col: str, classes: Sequence = GATE_CLASSES,
    fallback=GATE_FALLBACK, overrides: dict | None = None, out_col: str = "pred_gated", changes_col: str = "gate_changes",
) -> DataFrame:
    """Replace predictions outside their class's window, class by class in the given order.

    A fallback that is itself gated later is tested again. Rows without a time never change.
    ``changes_col`` counts the replacements made in a row. Windows with a ``fold`` column
    apply to the rows of that fold.
    """
    overrides = GATE_OVERRIDES if overrides is None else overrides
    kind = dict(df.dtypes)[pred_col]
    fold = F.col("fold") if "fold" in windows.columns else None
    table = df.withColumns({
        "__windows": window_lookup(windows), out_col: F.col(pred_col), changes_col: F.lit(0).cast("long"),
    })
    for cls in dict.fromkeys(classes):
        window = F.col("__windows")[_key(F.lit(cls).cast(kind), fold)]
        outside = (F.col(time_col) < window["t_min"]) | (F.col(time_col) > window["t_max"])
        table = table.withColumn("__hit", F.coalesce((F.col(out_col) == F.lit(cls)) & outside, F.lit(False)))
        table = table.withColumns({
            out_col: F.when(F.col("__hit"), F.lit(overrides.get(cls, fallback)).cast(kind)).otherwise(F.col(out_col)),
            changes_col: F.col(changes_col) + F.col("__hit").cast("long"),
        })
    return table.drop("__windows", "__hit")


def fold_windows(df: DataFrame, label_col: str, time_col: str) -> DataFrame:
    """(fold, label) windows from the other folds only, from one pass of per-fold extremes."""
    extremes = (
        df.filter(F.col(time_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy("fold", F.col(label_col).alias("label"))
        .agg(F.min(time_col).alias("lo"), F.max(time_col).alias("hi"))
    )
    folds = df.select("fold").distinct().agg(F.collect_list("fold")).scalar()
    # Folds times classes entries, expanded to the few folds that may use them.
    uses = extremes.withColumnRenamed("fold", "source").withColumn("folds", folds)
    uses = uses.select("source", "label", "lo", "hi", F.explode("folds").alias("fold")).filter("source <> fold")
    return uses.groupBy("fold", "label").agg(F.min("lo").alias("t_min"), F.max("hi").alias("t_max"))


def compare_gating(gated: DataFrame, label_col: str, pred_col: str, labels: Sequence, out_col: str = "pred_gated", changes_col: str = "gate_changes") -> DataFrame:
    """Macro-F1 with and without the gate, and the number of replacements; one pass."""
    both = gated.select(
        F.col(label_col).alias("y"),
        F.explode(F.array(
            F.struct(F.lit("raw").alias("variant"), F.col(pred_col).alias("p"), F.lit(0).cast("long").alias("c")),
            F.struct(F.lit("gated").alias("variant"), F.col(out_col).alias("p"), F.col(changes_col).alias("c")),
        )).alias("v"),
    ).select("y", "v.*")
    scores = per_class_report(both, "y", "p", labels, ["variant"]).groupBy("variant").agg(F.avg("f1").alias("macro_f1"))
    changes = both.groupBy("variant").agg(F.sum("c").alias("changed"))
    return scores.join(changes, "variant")
