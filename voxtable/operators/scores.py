"""Score tables ``(model, row_id, label, label_pos, score)``: align, combine, decide.

Rows of one item are few (models times labels), so everything here is clustered by
``row_id``; a table partitioned by it once serves all steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class AlignmentError(ValueError):
    """A model lacks scores for a reference class."""


def missing_classes(scores: DataFrame, classes: list[int]) -> DataFrame:
    """(model, label) pairs of the reference order for which a model has no score."""
    have = scores.groupBy("model").agg(F.collect_set("label").alias("have"))
    want = F.array(*[F.lit(c).cast("long") for c in classes])
    return have.select("model", F.explode(F.array_except(want, F.col("have"))).alias("label"))


def align_classes(scores: DataFrame, classes: list[int], strict: bool = True) -> DataFrame:
    """Positions follow the reference order, other labels go; missing classes raise if strict."""
    if strict:
        absent = missing_classes(scores, classes).limit(20).collect()
        if absent:
            raise AlignmentError("missing classes: " + ", ".join(f"{r.model}:{r.label}" for r in absent))
    position = F.array_position(F.array(*[F.lit(c).cast("long") for c in classes]), F.col("label"))
    return scores.withColumn("label_pos", (position - 1).cast("int")).filter("label_pos >= 0")


def model_weights(spark, weights: dict[str, float]) -> DataFrame:
    if not weights or sum(weights.values()) <= 0:
        raise ValueError("weights must have a positive sum")
    return spark.createDataFrame([(k, float(v)) for k, v in weights.items()], "model string, weight double")


def fold_weights(models: DataFrame, run_weights: DataFrame) -> DataFrame:
    """Spread each run's weight evenly over its fold models: ``models(run, model)``."""
    sizes = models.groupBy("run").agg(F.count("*").alias("folds"))
    joined = models.join(sizes, "run").join(run_weights.select(F.col("model").alias("run"), F.col("weight").alias("w")), "run", "left")
    return joined.select("model", (F.coalesce("w", F.lit(1.0)) / F.col("folds")).alias("weight"))


def auto_weights(models: DataFrame, fold_scores: DataFrame) -> DataFrame:
    """Weight of a model is its fold score, 1.0 where none is known."""
    return models.select("model").join(fold_scores.select("model", "score"), "model", "left").select(
        "model", F.coalesce("score", F.lit(1.0)).alias("weight")
    )


# Models of one ensemble; their weights travel as literals.
MAX_MODELS = 10_000


def _weight_of(weights: DataFrame) -> Column:
    """Weight by model name; a model without one weighs 1.0, as in ``fold_weights``."""
    rows = weights.select("model", "weight").limit(MAX_MODELS + 1).collect()
    if len(rows) > MAX_MODELS:
        raise ValueError(f"more than {MAX_MODELS} models")
    if len({r.model for r in rows}) < len(rows):
        raise ValueError("a model has several weights")
    if not rows:
        return F.lit(1.0)
    known = F.create_map(*[F.lit(x) for r in rows for x in (r.model, float(r.weight))])
    return F.coalesce(F.element_at(known, F.col("model")), F.lit(1.0))


def weighted_sum(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight * score over models, per item and label."""
    return scores.groupBy("row_id", "label").agg(
        F.min("label_pos").alias("label_pos"), F.sum(_weight_of(weights) * F.col("score")).alias("score")
    )


def weighted_mean(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Weighted sum over the total weight of the models that score the item and label."""
    weight = _weight_of(weights)
    return scores.groupBy("row_id", "label").agg(
        F.min("label_pos").alias("label_pos"), (F.sum(weight * F.col("score")) / F.greatest(F.sum(weight), F.lit(1e-9))).alias("score")
    )


def softmax(scores: DataFrame, keys: tuple = ("row_id", "model")) -> DataFrame:
    """Row softmax with the maximum taken off first."""
    row = Window.partitionBy(*keys)
    shifted = scores.withColumn("__e", F.exp(F.col("score") - F.max("score").over(row)))
    return shifted.withColumn("score", F.col("__e") / F.sum("__e").over(row)).drop("__e")


def blend(left: DataFrame, right: DataFrame, left_weight: float, right_weight: float, method: str = "softmax_avg") -> DataFrame:
    """Blend two single-model score tables by averaged softmax or by summed logits."""
    if left_weight < 0 or right_weight < 0 or left_weight + right_weight <= 0:
        raise ValueError("weights must be non-negative and not both zero")
    if method not in ("softmax_avg", "logit_sum"):
        raise ValueError(f"unknown blend method {method!r}")
    cols = ["row_id", "label", "label_pos", "score"]
    both = left.select(F.lit("left").alias("model"), *cols).unionByName(right.select(F.lit("right").alias("model"), *cols))
    both = both.repartition(F.col("row_id"))
    if method == "softmax_avg":
        both = softmax(both)
    weight = F.when(F.col("model") == "left", F.lit(float(left_weight))).otherwise(F.lit(float(right_weight)))
    if method == "softmax_avg":
        weight = weight / (left_weight + right_weight)
    absent = F.raise_error(F.concat(F.lit("only one side scores item "), F.col("row_id").cast("string"))).cast("double")
    return both.groupBy("row_id", "label").agg(F.min("label_pos").alias("label_pos"), F.sum(weight * F.col("score")).alias("score"), F.count("*").alias("__n")).select(
        "row_id", "label", "label_pos", F.when(F.col("__n") == 2, F.col("score")).otherwise(absent).alias("score")
    )


def best_label(score: Column, label_pos: Column, value: Column) -> Column:
    """``value`` at the highest score; the earliest class wins ties."""
    return F.max_by(value, F.struct(score, -label_pos))


def argmax(scores: DataFrame, keys: tuple = ("row_id",)) -> DataFrame:
    """Predicted label and its score per item."""
    best = best_label(F.col("score"), F.col("label_pos"), F.struct("label", "score"))
    return scores.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.label").alias("label"), F.col("b.score").alias("confidence"))
