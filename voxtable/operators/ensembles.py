"""Searches over ensemble weights.

All scores of an item are gathered once into one row (models times labels entries). A grid
of weights is then tried inside the row and counted per (weights, true, predicted) before
anything is shuffled, so a sweep costs one pass whatever the number of weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtable.lexicon import GATE_CLASSES, GATE_FALLBACK, GATE_OVERRIDES
from voxtable.operators.evaluation import per_class_report
from voxtable.scale import checkpointed


def score_rows(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per item: ``cells`` = array of (label_pos, label, s) in class order.

    ``s`` holds the label's score under each model, in the order of ``models``. A cell that a
    model lacks is an error: no number could stand for it beside raw decision scores.
    """
    absent = lambda m: F.raise_error(F.concat_ws(" ", F.lit(f"model {m} lacks a score of item"), F.col("row_id"), F.lit("label"), F.col("label"))).cast("double")
    per_label = scores.groupBy("row_id", "label_pos", "label").agg(
        *[F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"m{i}") for i, m in enumerate(models)]
    )
    per_label = per_label.withColumns({f"m{i}": F.coalesce(F.col(f"m{i}"), absent(m)) for i, m in enumerate(models)})
    cell = F.struct("label_pos", "label", F.array(*[F.col(f"m{i}") for i in range(len(models))]).alias("s"))
    return per_label.groupBy("row_id").agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def softmax_cells(rows: DataFrame, n_models: int) -> DataFrame:
    """Softmax of every model's scores inside the row."""
    for i in range(n_models):
        rows = rows.withColumn("__e", F.transform("cells", lambda c: c["s"][i]))
        rows = rows.withColumn("__e", F.transform("__e", lambda v: F.exp(v - F.array_max("__e"))))
        rows = rows.withColumn(f"__p{i}", F.transform("__e", lambda v: v / F.aggregate("__e", F.lit(0.0), lambda a, b: a + b)))
    new = F.transform("cells", lambda c, k: F.struct(
        c["label_pos"].alias("label_pos"), c["label"].alias("label"), F.array(*[F.get(F.col(f"__p{i}"), k) for i in range(n_models)]).alias("s"),
    ))
    return rows.withColumn("cells", new).drop("__e", *[f"__p{i}" for i in range(n_models)])


def predict_cells(cells: Column, value) -> Column:
    """Label of the highest ``value(cell)``; the first class wins ties."""
    scored = F.transform(cells, lambda c, k: F.struct(value(c).alias("v"), (-k).alias("k"), c["label"].alias("label")))
    return F.array_max(scored)["label"]


def blend_sweep(
    rows: DataFrame, truth: DataFrame, grid: Sequence[tuple[str, float, float]], labels: Sequence[int], method: str = "softmax_avg",
) -> DataFrame:
    """Per-class F1 for every named pair of weights over two models.

    ``truth`` is (row_id, y). Returns (name, label, f1, ...); the ranking is ``rank_sweep``.
    """
    if method == "softmax_avg":
        rows = softmax_cells(rows, 2)
    tries = F.explode(F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for n, a, b in grid
    ])).alias("g")
    joined = rows.join(truth, "row_id").select("y", "cells", tries)
    scale = (F.col("g.a") + F.col("g.b")) if method == "softmax_avg" else F.lit(1.0)
    pred = predict_cells(F.col("cells"), lambda c: (F.col("g.a") * c["s"][0] + F.col("g.b") * c["s"][1]) / scale)
    return per_class_report(joined.select(F.col("g.name").alias("name"), "y", pred.alias("p")), "y", "p", labels, ["name"])


def rank_sweep(per_class: DataFrame) -> DataFrame:
    """Macro-F1 per grid point, best first."""
    return per_class.groupBy("name").agg(F.avg("f1").alias("macro_f1")).orderBy(F.desc("macro_f1"), "name")


def _gated(pred: Column, when: Column, windows: dict, classes, fallback, overrides) -> Column:
    for cls in classes:
        if cls not in windows:
            continue
        lo, hi = windows[cls]
        outside = F.coalesce((when < F.lit(lo)) | (when > F.lit(hi)), F.lit(False))
        pred = F.when((pred == cls) & outside, F.lit(overrides.get(cls, fallback)).cast("long")).otherwise(pred)
    return pred


def greedy_ensemble(
    scores: DataFrame, truth: DataFrame, models: Sequence[str], labels: Sequence[int], step: float = 0.05, max_runs: int = 6,
    windows: dict | None = None, time_col: str | None = None, classes=GATE_CLASSES, fallback=GATE_FALLBACK, overrides=None,
) -> dict:
    """Greedy weight search on out-of-fold scores.

    Starts from the best single model; each round tries every remaining model at every mix
    ``alpha * ensemble + (1 - alpha) * model`` in one job, and keeps the best if it gains more
    than 1e-9. With ``windows`` ({label: (min, max)}) predictions are gated before scoring.
    Returns the score and the normalised weights.
    """
    overrides = GATE_OVERRIDES if overrides is None else overrides
    # Read by every round, so written once to the shared folder.
    rows = checkpointed(score_rows(scores, models).join(truth, "row_id").drop("row_id"))

    def trial(grid: list[tuple[int, list[float]]]) -> dict[int, float]:
        tries = F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.array(*[F.lit(float(w)) for w in ws]).alias("w")) for i, ws in grid
        ])).alias("g")
        each = rows.select("y", "cells", *([time_col] if windows else []), tries)

        def mixed(cell):
            parts = F.zip_with(cell["s"], F.col("g.w"), lambda s, w: s * w)
            return F.aggregate(parts, F.lit(0.0), lambda a, b: a + b)

        each = each.withColumn("p", predict_cells(F.col("cells"), mixed))
        if windows:
            each = each.withColumn("p", _gated(F.col("p"), F.col(time_col), windows, classes, fallback, overrides))
        report = per_class_report(each.select(F.col("g.i").alias("i"), "y", "p"), "y", "p", labels, ["i"])
        # One row per grid point comes back.
        return {r.i: r.f for r in report.groupBy("i").agg(F.avg("f1").alias("f")).collect()}

    def first_best(found: dict[int, float]) -> int:
        return max(sorted(found), key=lambda i: found[i])

    m = len(models)
    single = trial([(j, [1.0 if k == j else 0.0 for k in range(m)]) for j in range(m)])
    start = first_best(single)
    weights, chosen, best = [1.0 if k == start else 0.0 for k in range(m)], [start], single[start]
    alphas = [min(i * step, 1.0) for i in range(int(1.0 / step + 1e-9) + 1)]
    history = [(models[start], 1.0, best)]
    while len(chosen) < min(max_runs, m):
        mixes = [
            (j, a, [a * w + ((1.0 - a) if k == j else 0.0) for k, w in enumerate(weights)])
            for j in range(m) if j not in chosen for a in alphas
        ]
        found = trial([(i, ws) for i, (_, _, ws) in enumerate(mixes)])
        top = first_best(found)
        if found[top] <= best + 1e-9:
            break
        j, alpha, weights = mixes[top]
        best = found[top]
        chosen.append(j)
        history.append((models[j], alpha, best))
    total = sum(weights)
    final = {models[k]: weights[k] / total for k in sorted(chosen, key=lambda k: (-weights[k], k))}
    return {"score": best, "weights": final, "single": {models[k]: v for k, v in single.items()}, "history": history}
