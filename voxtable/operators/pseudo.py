"""Pseudo-labels and submissions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.operators.categories import LabelEncoder
from voxtable.scale import top_k_per_group


class SelectionError(ValueError):
    """Nothing was selected, or predictions do not cover the template."""


def select_pseudo_labels(
    predictions: DataFrame, id_col: str, min_conf: float = 0.98, per_class_max: int = 1500, label_col: str = "label",
) -> DataFrame:
    """Confident predictions, at most ``per_class_max`` per label by confidence (0 = all)."""
    sure = predictions.filter(F.col("confidence") >= min_conf)
    if per_class_max <= 0:
        return sure
    return top_k_per_group(sure, [label_col], [F.desc("confidence"), F.asc(id_col)], per_class_max, [id_col])


def require_selected(selected: DataFrame) -> None:
    if selected.isEmpty():
        raise SelectionError("no pseudo-label reaches the confidence threshold")


def pseudo_summary(selected: DataFrame, label_col: str = "label") -> DataFrame:
    return selected.groupBy(label_col).agg(
        F.count("*").alias("rows"), F.min("confidence").alias("min_conf"),
        F.avg("confidence").alias("mean_conf"), F.max("confidence").alias("max_conf"),
    )


def with_pseudo_rows(
    folded: DataFrame, pseudo: DataFrame, encoder: LabelEncoder, min_conf: float = 0.0, weight: float = 0.5,
    label_col: str = "label",
) -> DataFrame:
    """Training rows (weight 1) plus pseudo rows (lower weight, fold 0: in every training set).

    Pseudo rows whose label the encoder does not know are left out one by one.
    """
    sure = pseudo.filter(F.coalesce("confidence", F.lit(0.0)) >= min_conf) if min_conf > 0 else pseudo
    known = encoder.encode(sure, label_col, "__id").filter("__id is not null").drop("__id")
    marked = known.withColumns({"fold": F.lit(0), "weight": F.lit(float(max(0.0, weight)))})
    columns = [*[c for c in folded.columns if c in marked.columns and c not in ("fold", "weight")], "fold", "weight"]
    return folded.withColumn("weight", F.lit(1.0)).select(*columns).unionByName(marked.select(*columns))


def fold_training_set(rows: DataFrame, fold: int) -> DataFrame:
    """Rows to fit on when ``fold`` is validated: other folds and all pseudo rows."""
    return rows.filter(F.col("fold") != fold)


def submission(template: DataFrame, predictions: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """Template ids with their predicted label, NULL where a prediction is missing."""
    found = predictions.select(id_col, F.col(target_col).cast("long").alias(target_col))
    return template.select(id_col).join(found, id_col, "left")


def complete_submission(template: DataFrame, predictions: DataFrame, id_col: str, target_col: str) -> DataFrame:
    """Same, but the job fails on the first id without a prediction."""
    joined = submission(template, predictions, id_col, target_col)
    stop = F.raise_error(F.concat(F.lit("no prediction for id "), F.col(id_col).cast("string"))).cast("long")
    return joined.withColumn(target_col, F.when(F.col(target_col).isNull(), stop).otherwise(F.col(target_col)))
