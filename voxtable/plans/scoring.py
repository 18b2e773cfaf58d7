"""Text classifiers from raw table to scores: fit, save, load elsewhere, score batches and streams.

The saved folder holds one MLlib pipeline (vocabularies, categories, scales and classifier) and the
facts a score table needs. Scoring makes each row's scores from that row alone.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.functions.binding import bind
from voxtable.operators import gating
from voxtable.operators import scores as sc
from voxtable.operators.categories import LabelEncoder, with_class_weights
from voxtable.operators.linear import LinearMargins, SoftmaxRegression, SquaredHingeSvm
from voxtable.operators.pseudo import complete_submission
from voxtable.operators.ngrams import spread_texts
from voxtable.operators.text_stages import TextTable
from voxtable.scale import settled

KINDS = {"logistic": 4.0, "svm": 0.25}
LEARNERS = {"logistic": SoftmaxRegression, "svm": SquaredHingeSvm}


@dataclass(frozen=True)
class ScoreSpec:
    name: str
    id_col: str
    label_col: str
    labels: tuple[int, ...]
    kind: str


@dataclass(frozen=True)
class TextClassifier:
    pipeline: PipelineModel
    spec: ScoreSpec

    @classmethod
    def fit(
        cls, df: DataFrame, id_col: str, label_col: str, kind: str = "logistic", c: float | None = None, max_iter: int | None = None, name: str = "model", **table_options,
    ) -> "TextClassifier":
        """``table_options`` are those of ``TextTable``; classes weigh the same in sum."""
        if kind not in KINDS:
            raise ValueError(f"unknown classifier {kind!r}")
        encoder = LabelEncoder.fit(df, label_col)
        ready = encoder.encode(with_class_weights(df, label_col), label_col)
        c = KINDS[kind] if c is None else c
        learner = LEARNERS[kind](labelCol="label_id", weightCol="weight", C=c, **({"maxIter": max_iter} if max_iter else {}))
        table = TextTable(**table_options)
        used = dict.fromkeys(["label_id", "weight", table.getOrDefault("textCol"), *table.getOrDefault("catCols"), *table.getOrDefault("numCols")])
        # Written once, in even parts: the texts are read to count their terms, and again to pack their vectors.
        ready = settled(spread_texts(ready, id_col).select(*used), "train")
        table = table.fit(ready)
        fitted = learner.fit(table.rows(ready, ["label_id", "weight"]))
        return cls(PipelineModel([table, fitted]), ScoreSpec(name, id_col, label_col, tuple(encoder.order()), kind))

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(asdict(self.spec)),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TextClassifier":
        spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
        return cls(PipelineModel.load(f"{path}/pipeline"), ScoreSpec(**{**spec, "labels": tuple(spec["labels"])}))

    def _by_class(self, df: DataFrame, keep: Sequence[str]) -> tuple[DataFrame, Column]:
        table, model = self.pipeline.stages
        if isinstance(model, LinearMargins):
            kept = [self.spec.id_col, *keep]
            return model.scored(table.rows(df, kept), kept), F.col(model.getOrDefault("rawPredictionCol"))
        return self.pipeline.transform(df), vector_to_array("probability")  # saved when MLlib fitted it

    def scores(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Long score table of raw rows, of a batch or a stream; ``keep`` columns ride along."""
        made, values = self._by_class(df, keep)
        order = F.array(*[F.lit(v).cast("long") for v in self.spec.labels])
        cells = made.select(F.lit(self.spec.name).alias("model"), F.col(self.spec.id_col).alias("row_id"), *keep, F.posexplode(values).alias("label_pos", "score"))
        return cells.select("model", "row_id", *keep, F.get(order, F.col("label_pos")).alias("label"), "label_pos", "score")

    def predictions(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """The best label of each row and its score; the first class wins ties."""
        made, values = self._by_class(df, keep)
        order = F.array(*[F.lit(v).cast("long") for v in self.spec.labels])
        best = bind(values, lambda v: bind(F.array_max(v), lambda top: F.struct((F.array_position(v, top) - 1).cast("int").alias("pos"), top.alias("score"))))
        return made.select(F.col(self.spec.id_col).alias("row_id"), *keep, best.alias("b")).select("row_id", *keep, F.get(order, F.col("b.pos")).alias("label"), F.col("b.score").alias("confidence"))


def gated_submission(
    models: Sequence[tuple[TextClassifier, float]], train: DataFrame, test: DataFrame, template: DataFrame, time_col: str, gates: dict | None = None,
) -> DataFrame:
    """From raw test rows to the rows to hand in: weighted scores of several models, best label, time gates, template.

    Windows come from the training rows' times by label; ``gates`` are settings as ``gate_settings``
    gives them. The job fails on a template id without a prediction.
    """
    spec, gates = models[0][0].spec, gates or gating.gate_settings()
    each = [m.scores(test).withColumn("model", F.lit(str(i))) for i, (m, _) in enumerate(models)]
    table = reduce(DataFrame.unionByName, each)
    weights = test.sparkSession.createDataFrame([(str(i), float(w)) for i, (_, w) in enumerate(models)], "model string, weight double")
    best = sc.argmax(sc.weighted_sum(table, weights)).select("row_id", "label")
    timed = best.join(test.select(F.col(spec.id_col).alias("row_id"), F.col(time_col).alias("__time")), "row_id")
    windows = gating.time_windows(train, spec.label_col, time_col)
    gated = gating.gate_by_time(timed, windows, "label", "__time", gates["classes"], gates["fallback"], gates["overrides"])
    found = gated.select(F.col("row_id").alias(spec.id_col), F.col("pred_gated").alias(spec.label_col))
    return complete_submission(template, found, spec.id_col, spec.label_col)
