"""Deterministic stratified folds and holdouts, and out-of-fold prediction.

Rows are ordered inside their label by ``md5(id-seed)``, so a split depends on ids and seed
only. The rank is computed without gathering a label in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.scale import hashed_rank


class FoldError(RuntimeError):
    """Out-of-fold predictions do not cover every row exactly once."""


def assign_folds(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42, hex_digits: int = 3) -> DataFrame:
    """Add ``fold`` 1..k; fold sizes differ by at most one inside each label."""
    ranked = hashed_rank(df, label_col, id_col, seed, "__rank", hex_digits=hex_digits)
    return ranked.withColumn("fold", ((F.col("__rank") - 1) % k + 1).cast("int")).drop("__rank")


def assign_holdout(
    df: DataFrame, id_col: str, label_col: str, share: float = 0.2, seed: int = 42, hex_digits: int = 3
) -> DataFrame:
    """Add ``is_holdout``: the first round(share * n) rows of every label."""
    ranked = hashed_rank(df, label_col, id_col, seed, "__rank", "__size", hex_digits)
    return ranked.withColumn("is_holdout", F.col("__rank") <= F.round(F.col("__size") * share)).drop("__rank", "__size")


def out_of_fold(
    folded: DataFrame, k: int, train_and_score: Callable[[DataFrame, DataFrame, int], DataFrame],
    only: Iterable[int] | None = None,
) -> DataFrame:
    """Fit on the other folds, score each fold, and stack the scores with their fold.

    Two folds are fitted at a time: a fit is many small jobs, and the one's fill the pauses of the other's.
    """
    wanted = sorted(set(only) if only is not None else range(1, k + 1))

    def one(fold: int) -> DataFrame:
        train, valid = folded.filter(F.col("fold") != fold), folded.filter(F.col("fold") == fold)
        return train_and_score(train, valid, fold).withColumn("fold", F.lit(fold))

    with ThreadPoolExecutor(2) as both:
        return reduce(DataFrame.unionByName, both.map(inheritable_thread_target(folded.sparkSession)(one), wanted))


def fold_coverage(folded: DataFrame, predictions: DataFrame, id_col: str) -> DataFrame:
    """One row: rows without prediction and rows predicted more than once."""
    counts = predictions.groupBy(id_col).agg(F.count("*").alias("c"))
    return folded.select(id_col).join(counts, id_col, "left").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("c").isNull()).alias("missing"),
        F.count_if(F.col("c") > 1).alias("repeated"),
    )


def require_complete(folded: DataFrame, predictions: DataFrame, id_col: str) -> None:
    row = fold_coverage(folded, predictions, id_col).first()
    if row.missing or row.repeated:
        raise FoldError(f"{row.missing} rows without prediction, {row.repeated} predicted more than once")
