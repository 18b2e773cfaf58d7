"""Feature vectors, classifiers and batch scoring on Spark MLlib.

Every feature block is a sparse relation ``(row_id, feature, value)``. Blocks are shifted
side by side and written once as vectors in the shared folder; folds and final fits read
that table instead of recomputing features.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassificationModel, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, OneVsRestModel,
)
from pyspark.ml.feature import HashingTF, OneHotEncoder, StringIndexer, Tokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from voxtable.config import UNK
from voxtable.operators.cuts import Vocabulary
from voxtable.operators.linear import LinearMargins, SoftmaxModel, TextRows
from voxtable.scale import Lookup, dense_ranks, scratch_path


# ---- sparse blocks ----

def _cells(df: DataFrame, id_col: str, columns) -> DataFrame:
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.coalesce(F.col(c).cast("string"), F.lit(UNK)).alias("value")) for c in columns
    ])).alias("p")
    return df.select(F.col(id_col).alias("row_id"), pairs).select("row_id", "p.col", "p.value")


@dataclass(frozen=True)
class OneHot:
    """Categories of the training table; values not seen there give no feature."""

    categories: Lookup
    columns: tuple

    @classmethod
    def fit(cls, df: DataFrame, columns):
        values = _cells(df.withColumn("__i", F.lit(0)), "__i", columns).select("col", "value").distinct()
        numbered = dense_ranks(values, ["col", "value"], "feature").withColumn("feature", F.col("feature").cast("int"))
        return cls(Lookup.settle(numbered), tuple(columns))

    @property
    def size(self) -> int:
        return self.categories.rows

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        found = self.categories.join(_cells(df, id_col, self.columns), ["col", "value"], "inner")
        return found.select("row_id", "feature", F.lit(1.0).alias("value"))


@dataclass(frozen=True)
class MaxAbs:
    """Largest absolute value per numeric column; a zero maximum scales by 1."""

    scales: DataFrame
    columns: tuple

    @classmethod
    def fit(cls, df: DataFrame, columns):
        peak = [F.max(F.abs(F.col(c).cast("double"))).alias(c) for c in columns]
        safe = [F.when(F.coalesce(F.col(c), F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col(c)).alias(c) for c in columns]
        return cls(Lookup.settle(df.agg(*peak).select(*safe)).table, tuple(columns))

    @property
    def size(self) -> int:
        return len(self.columns)

    def _scale(self):
        return self.scales.select(F.struct(*self.columns)).scalar()

    def scaled(self, df: DataFrame) -> DataFrame:
        peak = self._scale()
        return df.withColumns({c: F.col(c).cast("double") / peak[c] for c in self.columns})

    def transform(self, df: DataFrame, id_col: str) -> DataFrame:
        wide = self.scaled(df.select(id_col, *self.columns))
        entries = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(self.columns)]))
        return wide.select(F.col(id_col).alias("row_id"), entries.alias("e")).select("row_id", "e.*").filter("value <> 0")


def tfidf_block(weights: DataFrame, id_col: str) -> DataFrame:
    return weights.select(F.col(id_col).alias("row_id"), F.col("term_id").alias("feature"), F.col("weight").alias("value"))


def feature_union(blocks: list[tuple[DataFrame, int]]) -> tuple[DataFrame, int]:
    """Blocks side by side: each block's features start after those of the blocks before."""
    out, offset = None, 0
    for block, size in blocks:
        shifted = block.select("row_id", (F.col("feature") + offset).cast("int").alias("feature"), "value")
        out = shifted if out is None else out.unionByName(shifted)
        offset += size
    return out, offset


def write_vectors(rows: DataFrame, id_col: str, cells: DataFrame, size: int, path: str | None = None) -> DataFrame:
    """``rows`` with a sparse ``features`` vector, written once and read back.

    A vector column is stored as a plain struct, so building it needs no Python. Items
    without any feature get the zero vector.
    """
    spark = rows.sparkSession
    path = path or scratch_path(spark, "vectors")
    per_row = cells.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("feature", "value"))).alias("f"))
    joined = rows.join(per_row.withColumnRenamed("row_id", id_col), id_col, "left")
    empty = F.array().cast("array<struct<feature:int,value:double>>")
    filled = F.coalesce("f", empty)
    vector = F.struct(
        F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"),
        F.transform(filled, lambda e: e["feature"]).alias("indices"),
        F.transform(filled, lambda e: e["value"]).alias("values"),
    )
    table = joined.select(*rows.columns, vector.alias("features"))
    table.write.mode("overwrite").parquet(path)
    plain = [f for f in table.schema.fields if f.name != "features"]
    return spark.read.schema(StructType([*plain, StructField("features", VectorUDT())])).parquet(path)


def _joined_cells(blocks, id_col: str, offset: int) -> tuple[DataFrame, Column, int]:
    """Cells of relations by row (``__f``), those of a row once it is joined to them, and the first feature after them."""
    union, more = feature_union(blocks)
    shifted = F.struct((F.col("feature") + offset).cast("int").alias("feature"), "value")
    per_row = union.groupBy("row_id").agg(F.sort_array(F.collect_list(shifted)).alias("__f")).withColumnRenamed("row_id", id_col)
    return per_row, F.coalesce("__f", F.array().cast("array<struct<feature:int,value:double>>")), offset + more


def row_vectors(rows: DataFrame, id_col: str, keep, cells, offset: int, blocks) -> DataFrame | TextRows:
    """``rows`` with vectors as structs, where texts give their own cells: (indices, values) columns with their first feature.

    ``cells`` may be vocabularies with the text column each is for in place of columns; then the rows keep their texts,
    and learners and models make the vectors. ``blocks`` are relations whose features start at ``offset``; only those
    are joined by row.
    """
    if all(isinstance(c, Vocabulary) for c, _ in cells):
        few, size = None, offset
        if blocks:
            per_row, rest, size = _joined_cells(blocks, id_col, offset)
            rows, few = rows.join(per_row, id_col, "left"), F.struct(rest["feature"].alias("i"), rest["value"].alias("v"))
        return TextRows.of(rows, F.col(cells[0][1]), [id_col, *keep], [v for v, _ in cells], size, few)
    names = [f"__c{k}" for k in range(len(cells))]
    made, size = rows.select(id_col, *keep, *[c.alias(n) for n, (c, _) in zip(names, cells)]), offset
    # A second argument of the function would be the place in the array.
    shift = lambda by: lambda i: i + F.lit(by)
    indices = [F.transform(F.col(f"{n}.indices"), shift(by)) if by else F.col(f"{n}.indices") for n, (_, by) in zip(names, cells)]
    values = [F.col(f"{n}.values") for n in names]
    if blocks:
        per_row, rest, size = _joined_cells(blocks, id_col, offset)
        made = made.join(per_row, id_col, "left")
        indices, values = [*indices, rest["feature"]], [*values, rest["value"]]
    vector = F.struct(F.lit(0).cast("byte").alias("type"), F.lit(size).alias("size"), F.concat(*indices).alias("indices"), F.concat(*values).alias("values"))
    return made.select(id_col, *keep, vector.alias("features"))


def write_row_vectors(rows: DataFrame, id_col: str, keep, cells, offset: int, blocks) -> DataFrame:
    """``row_vectors`` written once and read back as vectors."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "vectors")
    table = row_vectors(rows, id_col, keep, cells, offset, blocks)
    table.write.parquet(path)
    plain = [f for f in table.schema.fields if f.name != "features"]
    return spark.read.schema(StructType([*plain, StructField("features", VectorUDT())])).parquet(path)


def one_hot_stages(columns, out_col: str = "onehot") -> Pipeline:
    """The same encoding as MLlib stages.

    The indexer gives unseen values the last index, and that one is dropped: zero vector.
    """
    index = StringIndexer(inputCols=list(columns), outputCols=[f"{c}__ix" for c in columns], handleInvalid="keep", stringOrderType="alphabetAsc")
    encode = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}__oh" for c in columns], dropLast=True)
    join = VectorAssembler(inputCols=encode.getOutputCols(), outputCol=out_col)
    return Pipeline(stages=[index, encode, join])


# ---- classifiers ----

def _strength(train: DataFrame, c: float, weight_col: str | None) -> float:
    """C multiplies a sum of losses, MLlib's penalty a mean: regParam = 1 / (C * total weight)."""
    total = train.agg(F.sum(weight_col) if weight_col else F.count("*")).first()[0]
    return 1.0 / (c * float(total))


def train_logistic(train: DataFrame, label_col: str, c: float = 4.0, weight_col: str | None = "weight", max_iter: int = 100):
    """Multinomial logistic regression with class weights as row weights."""
    model = LogisticRegression(
        family="multinomial", featuresCol="features", labelCol=label_col, maxIter=max_iter, standardization=False,
        regParam=_strength(train, c, weight_col),
    )
    return (model.setWeightCol(weight_col) if weight_col else model).fit(train)


def train_linear_svm(train: DataFrame, label_col: str, c: float = 0.25, weight_col: str | None = "weight", max_iter: int = 50, parallelism: int = 2):
    """One linear SVM per class; decision scores come out as ``rawPrediction``."""
    base = LinearSVC(maxIter=max_iter, standardization=False, regParam=_strength(train, c, weight_col))
    ovr = OneVsRest(classifier=base, featuresCol="features", labelCol=label_col, parallelism=parallelism)
    return (ovr.setWeightCol(weight_col) if weight_col else ovr).fit(train)


def tree_features(df: DataFrame, text_col: str, cat_cols, num_cols, text_dim: int = 256) -> PipelineModel:
    """Numbers, indexed categories and hashed words assembled for tree learners."""
    stages, inputs = [], list(num_cols)
    if cat_cols:
        stages.append(StringIndexer(inputCols=list(cat_cols), outputCols=[f"{c}__ix" for c in cat_cols], handleInvalid="keep"))
        inputs += [f"{c}__ix" for c in cat_cols]
    stages += [Tokenizer(inputCol=text_col, outputCol="__words"), HashingTF(inputCol="__words", outputCol="__tf", numFeatures=text_dim)]
    stages.append(VectorAssembler(inputCols=[*inputs, "__tf"], outputCol="features", handleInvalid="keep"))
    return Pipeline(stages=stages).fit(df)


def _trees(train: DataFrame, max_iter: int = 50, depth: int = 6, step: float = 0.1, max_bins: int | None = None) -> GBTClassifier:
    """By default there are 64 bins, or as many as the largest category block has values."""
    if max_bins is None:
        nominal = train.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
        max_bins = max([64, *(a.get("num_vals") or len(a.get("vals", ())) for a in nominal)])
    return GBTClassifier(maxIter=max_iter, maxDepth=depth, stepSize=step, seed=42, maxBins=max_bins)


def train_boosted(
    train: DataFrame, label_col: str, valid_col: str | None = None, max_iter: int = 50, depth: int = 6, step: float = 0.1,
    weight_col: str | None = None, parallelism: int = 2, max_bins: int | None = None,
):
    """One boosted tree ensemble per class; rows marked ``valid_col`` stop it early."""
    base = _trees(train, max_iter, depth, step, max_bins)
    if valid_col:
        base = base.setValidationIndicatorCol(valid_col)
    ovr = OneVsRest(classifier=base, featuresCol="features", labelCol=label_col, parallelism=parallelism)
    return (ovr.setWeightCol(weight_col) if weight_col else ovr).fit(train)


def validation_curves(model: OneVsRestModel, valid: DataFrame, label_col: str) -> list[list[float]]:
    """Loss on ``valid`` after 1, 2, ... trees, for every class against the rest."""
    curves = []
    for k, one in enumerate(model.models):
        marked = valid.withColumn(label_col, (F.col(label_col) == k).cast("double"))
        curves.append(list(one.copy({one.labelCol: label_col}).evaluateEachIteration(marked)))
    return curves


def best_iterations(folded: DataFrame, label_col: str, fold_col: str = "fold", **options) -> list[int]:
    """Trees of each class that the folds' validation curves ask for: the mean over folds of the best count.

    ``options`` are those of ``train_boosted``. Each fold is a fit on the others; the curves come
    from rows of the fold, which that fit has not seen.
    """
    folds = sorted(r[0] for r in folded.select(fold_col).distinct().collect())
    best = []
    for fold in folds:
        model = train_boosted(folded.filter(F.col(fold_col) != fold), label_col, **options)
        curves = validation_curves(model, folded.filter(F.col(fold_col) == fold), label_col)
        best.append([1 + min(range(len(c)), key=c.__getitem__) for c in curves])
    if len({len(b) for b in best}) > 1:
        raise ValueError("the folds do not hold the same classes")
    return [max(1, round(sum(b[k] for b in best) / len(best))) for k in range(len(best[0]))]


def refit_boosted(rows: DataFrame, label_col: str, iterations: list[int], weight_col: str | None = None, **options) -> OneVsRestModel:
    """One ensemble per class on all rows, each with its own number of trees."""
    models = []
    for k, n in enumerate(iterations):
        marked = rows.withColumn(label_col, (F.col(label_col) == k).cast("double"))
        base = _trees(rows, n, **options).setLabelCol(label_col).setFeaturesCol("features")
        models.append((base.setWeightCol(weight_col) if weight_col else base).fit(marked))
    return OneVsRestModel(models).setFeaturesCol("features")


# ---- scoring and persistence ----

def score_table(model, df: DataFrame | TextRows, id_col: str, labels: list[int], name: str, proba: bool) -> DataFrame:
    """Long score table: probabilities or decision scores.

    ``labels`` are the labels by class position, as ``LabelEncoder.order`` gives them.
    """
    classes = len(model.models) if isinstance(model, OneVsRestModel) else model.numClasses
    if len(labels) != classes:
        raise ValueError(f"{len(labels)} labels for a model of {classes} classes")
    if isinstance(model, SoftmaxModel) and not proba:
        model = model.margins()
    if isinstance(model, LinearMargins):
        if proba and not isinstance(model, SoftmaxModel):
            raise ValueError("margins are no probabilities")
        scored = model.scored(df, [id_col])
    else:
        scored = model.transform(df)
    if isinstance(model, LinearMargins):
        values = F.col(model.getOrDefault("rawPredictionCol"))
    elif isinstance(model, OneVsRestModel):
        raw = vector_to_array(F.col("rawPrediction"))
        # Per-class margins; as probabilities they are squashed and normalised. Boosted trees
        # are fitted to labels of -1 and 1, so half the log-odds is their margin.
        slope = 2.0 if isinstance(model.models[0], GBTClassificationModel) else 1.0
        squashed = F.transform(raw, lambda v: 1 / (1 + F.exp(-slope * v)))
        total = F.aggregate(squashed, F.lit(0.0), lambda a, b: a + b)
        values = F.transform(squashed, lambda v: v / total) if proba else raw
    else:
        values = vector_to_array(F.col("probability" if proba else "rawPrediction"))
    order = F.array(*[F.lit(v).cast("long") for v in labels])
    cells = scored.select(F.lit(name).alias("model"), F.col(id_col).alias("row_id"), F.posexplode(values).alias("label_pos", "score"))
    return cells.select("model", "row_id", F.get(order, F.col("label_pos")).alias("label"), "label_pos", "score")


def save_model(model, path: str, spec: dict) -> None:
    """Model and the spec it needs, side by side."""
    model.write().overwrite().save(f"{path}/model")
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(spec),)], "spec string").coalesce(1).write.mode("overwrite").text(f"{path}/spec")


def load_model(spark: SparkSession, path: str, kind) -> tuple[object, dict]:
    spec = json.loads(spark.read.text(f"{path}/spec").first()[0])
    return kind.load(f"{path}/model"), spec

