"""Fitted text pipelines: the same vectors as the relational features, saved, loaded, and run on streams."""

import gc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from given_tables import DATA
from voxtable.operators.linear import LinearMargins, SquaredHingeSvm
from voxtable.operators.text_stages import TextTable
from voxtable.plans.scoring import TextClassifier, gated_submission
from voxtable.plans.text_models import TextFeatures

SMALL = {"wordFeatures": 400, "charFeatures": 700}


@pytest.fixture(scope="module")
def rows(spark):
    made = spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 2200").select(
        "doc_id", "text", F.when(F.col("doc_id") % 7 > 0, F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 > 0, F.col("n_chars")).alias("n"),
        F.expr("case lang when 'de' then 3 when 'en' then 5 when 'es' then 7 else 9 end").cast("long").alias("label"),
        F.timestamp_seconds(1_700_000_000 + F.col("doc_id") * 3600).alias("at"),
    )
    odd = spark.createDataFrame([(10_001, None, None, None, 3), (10_002, "", "unseen", 5, 5)], "doc_id long, text string, source string, n long, label long")
    return made.unionByName(odd.withColumn("at", F.lit(None).cast("timestamp"))).cache()


def _by_id(df):
    return {r["doc_id"]: r["features"] for r in df.select("doc_id", "features").collect()}


@pytest.mark.parametrize("sublinear", [True, False])
def test_vectors_equal_the_relational_features(rows, sublinear):
    train = rows.filter("doc_id % 3 > 0")
    options = {"catCols": ["source"], "numCols": ["n"], "sublinear": sublinear, "withinWords": not sublinear}
    own = _by_id(TextTable(**SMALL, **options).fit(train).transform(rows))
    features = TextFeatures.fit(train, "doc_id", "text", ["source"], ["n"], 400, 700, 2, sublinear, not sublinear)
    want = _by_id(features.vectors(rows))
    assert own.keys() == want.keys() and len(own) > 30
    for k, v in own.items():
        assert v.size == want[k].size and np.array_equal(v.indices, want[k].indices) and np.allclose(v.values, want[k].values, atol=1e-12)


@pytest.fixture(scope="module")
def saved(rows, tmp_path_factory):
    folder = tmp_path_factory.mktemp("classifiers")
    train, scores = rows.filter("doc_id % 3 > 0"), {}
    for kind in ("logistic", "svm"):
        model = TextClassifier.fit(train, "doc_id", "label", kind, name=kind, max_iter=40, catCols=["source"], numCols=["n"], **SMALL)
        scores[kind] = {(r["row_id"], r["label"]): r["score"] for r in model.scores(rows).collect()}
        model.save(f"{folder}/{kind}")
        del model
    gc.collect()
    return folder, scores


@pytest.mark.parametrize("kind", ["logistic", "svm"])
def test_another_session_scores_raw_rows_alike(spark, rows, saved, kind):
    folder, scores = saved
    model = TextClassifier.load(spark.newSession(), f"{folder}/{kind}")
    assert model.spec.labels == (3, 5, 7, 9) and model.spec.kind == kind
    again = {(r["row_id"], r["label"]): r["score"] for r in model.scores(rows).collect()}
    assert again.keys() == scores[kind].keys() and max(abs(again[k] - scores[kind][k]) for k in again) < 1e-12
    seen = rows.filter("doc_id % 3 = 0 and doc_id < 10000")
    right = model.predictions(seen).join(seen.select(F.col("doc_id").alias("row_id"), F.col("label").alias("y")), "row_id")
    assert right.filter("label = y").count() > 0.8 * seen.count()


def test_streams_score_as_batches(spark, rows, saved, tmp_path):
    model = TextClassifier.load(spark, f"{saved[0]}/svm")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, made in (("scores", model.scores), ("best", model.predictions)):
        query = made(stream).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start(f"{tmp_path}/{name}")
        query.awaitTermination()
        got, want = spark.read.parquet(f"{tmp_path}/{name}"), made(rows)
        order = [c for c in want.columns if c not in ("score", "confidence")]
        assert [tuple(r) for r in got.select(want.columns).sort(order).collect()] == [tuple(r) for r in want.sort(order).collect()]


def test_raw_tickets_to_gated_submission(spark, rows, saved):
    models = [(TextClassifier.load(spark, f"{saved[0]}/{k}"), w) for k, w in (("logistic", 1.0), ("svm", 0.5))]
    train, test = rows.filter("doc_id % 3 > 0"), rows.filter("doc_id % 3 = 0")
    gates = {"classes": [7], "fallback": 9, "overrides": {}}
    early = train.filter("label <> 7 or at < '2023-11-16'")
    out = {r["doc_id"]: r["label"] for r in gated_submission(models, early, test, test.select("doc_id"), "at", gates).collect()}
    plain = {r["doc_id"]: r["label"] for r in gated_submission(models, early, test, test.select("doc_id"), "at", {**gates, "classes": []}).collect()}
    times = {r["doc_id"]: r["at"] for r in test.collect()}
    low, high = early.filter("label = 7").agg(F.min("at"), F.max("at")).first()
    assert out.keys() == plain.keys() == times.keys()
    for k, label in plain.items():
        outside = label == 7 and times[k] is not None and not low <= times[k] <= high
        assert out[k] == (9 if outside else label)
    with pytest.raises(Exception, match="no prediction for id"):
        gated_submission(models, train, test, test.select("doc_id").union(spark.createDataFrame([(77_777,)], "doc_id long")), "at", gates).collect()


def _newton(x, y, c, weight):
    """Exact minimum by Newton's method with step halving."""
    x, w = np.c_[x, np.ones(len(x))], np.zeros(x.shape[1] + 1)

    def loss(w):
        return w @ w / 2 + c * (weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum()

    for _ in range(100):
        on = 1 - y * (x @ w) > 0
        g = w - 2 * c * x.T @ (weight * y * np.maximum(0, 1 - y * (x @ w)))
        step = np.linalg.solve(np.eye(len(w)) + 2 * c * (x[on].T * weight[on]) @ x[on], g)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-8:
            t /= 2
        w = w - t * step
    return w


def test_svm_is_the_exact_minimum(spark, tmp_path):
    draw = np.random.default_rng(6)
    x, labels, weight = draw.normal(size=(300, 6)) * (draw.random((300, 6)) < 0.6), draw.integers(0, 3, 300), draw.uniform(0.5, 2, 300)
    x[:, 0] += labels
    rows = [(int(k), float(w), Vectors.sparse(6, {int(j): float(r[j]) for j in np.flatnonzero(r)}) if i % 2 else Vectors.dense(r)) for i, (k, w, r) in enumerate(zip(labels, weight, x))]
    df = spark.createDataFrame(rows, ["label_id", "weight", "features"]).repartition(4)
    model = SquaredHingeSvm(weightCol="weight", C=0.25, tol=1e-6).fit(df)
    for k in range(3):
        want = _newton(x, np.where(labels == k, 1.0, -1.0), 0.25, weight)
        assert np.allclose(model.weights[k], want, atol=1e-5)
    assert max(model.gradient_shares) <= 1e-6
    model.write().overwrite().save(f"{tmp_path}/svm")
    again = LinearMargins.load(f"{tmp_path}/svm")
    assert np.array_equal(again.weights, model.weights) and again.getOrDefault("C") == 0.25
    margins = {tuple(r["features"].toArray()): r["margins"] for r in again.transform(df).collect()}
    assert all(np.allclose(margins[tuple(r)], model.weights[:, :-1] @ r + model.weights[:, -1]) for r in x)
    with pytest.raises(ValueError, match="no rows"):
        SquaredHingeSvm().fit(df.limit(0))


def test_row_vectors_equal_the_joined_ones(rows):
    """Cells made from the texts, shifted side by side, with joined blocks after them."""
    from voxtable.operators import cuts
    from voxtable.operators import learning as ln

    features = TextFeatures.fit(rows, "doc_id", "text", ["source"], ["n"], 300, 500, 2, True, False)
    want = _by_id(features.vectors(rows))
    f = F.col("text")
    cells = [(features.word.cells(rows, cuts.WORDS)(f), 0), (features.char.cells(rows, cuts.CHARS)(f), features.word.size)]
    blocks = [(features.one_hot.transform(rows, "doc_id"), features.one_hot.size), (features.numbers.transform(rows, "doc_id"), features.numbers.size)]
    own = _by_id(ln.write_row_vectors(rows, "doc_id", ["label"], cells, features.word.size + features.char.size, blocks))
    assert own.keys() == want.keys()
    for k, v in own.items():
        assert v.size == want[k].size and np.array_equal(v.indices, want[k].indices) and np.allclose(v.values, want[k].values, atol=1e-12)


def test_svm_blocks_are_bounded_by_entries(spark, monkeypatch):
    """Long rows make small blocks; rows without entries, at the ends too, keep their place."""
    from voxtable.operators import linear

    monkeypatch.setattr(linear, "BLOCK_CELLS", 10)
    indices = pa.array([[], [0, 1, 2], [], list(range(12)), [3], []], pa.list_(pa.int32()))
    values = pa.array([[], [1.0, 2.0, 3.0], [], [0.5] * 12, [4.0], []], pa.list_(pa.float64()))
    made = list(linear._blocks(indices, values))
    assert [(at, to) for at, to, *_ in made] == [(0, 3), (3, 4), (4, 6)]
    w = np.arange(26, dtype=float).reshape(2, 13)
    margins = np.concatenate([linear._margins(w, bounds, i.astype(np.int64), v) for _, _, bounds, i, v in made], axis=1)
    rows = np.zeros((6, 12))
    for r, (i, v) in enumerate(zip(indices.to_pylist(), values.to_pylist())):
        rows[r, i] = v
    assert np.allclose(margins, w[:, :-1] @ rows.T + w[:, -1:])


def test_logistic_regression_is_the_exact_minimum(spark, tmp_path):
    """The gradient of the penalised likelihood vanishes, and MLlib, where it is left to converge, has the same probabilities."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    from voxtable.operators import learning as ln
    from voxtable.operators.linear import SoftmaxModel, SoftmaxRegression

    draw = np.random.default_rng(8)
    x, labels, weight = draw.normal(size=(240, 5)) * (draw.random((240, 5)) < 0.6), draw.integers(0, 3, 240), draw.uniform(0.5, 2, 240)
    x[:, 0] += labels
    made = [(i, int(k), float(w), Vectors.sparse(5, {int(j): float(r[j]) for j in np.flatnonzero(r)}) if i % 2 else Vectors.dense(r)) for i, (k, w, r) in enumerate(zip(labels, weight, x))]
    df = spark.createDataFrame(made, ["id", "label_id", "weight", "features"]).repartition(3)
    model = SoftmaxRegression(weightCol="weight", C=4.0, tol=1e-8).fit(df)
    margins = x @ model.weights[:, :-1].T + model.weights[:, -1]
    p = np.exp(margins) / np.exp(margins).sum(1, keepdims=True)
    pulls = weight[:, None] * (p - np.eye(3)[labels])
    assert np.allclose(model.weights[:, :-1] + 4.0 * pulls.T @ x, 0, atol=1e-4) and np.allclose(pulls.sum(0), 0, atol=1e-4)
    model.write().overwrite().save(f"{tmp_path}/logistic")
    again = SoftmaxModel.load(f"{tmp_path}/logistic")
    assert np.array_equal(again.weights, model.weights)
    got = {r["id"]: r["probabilities"] for r in again.transform(df).collect()}
    assert all(np.allclose(got[i], p[i]) for i in range(len(x)))
    mllib = LogisticRegression(
        family="multinomial", labelCol="label_id", weightCol="weight", maxIter=2000, tol=1e-14, standardization=False, regParam=1 / (4.0 * weight.sum()),
    ).fit(df)
    want = {r["id"]: r["p"] for r in mllib.transform(df).select("id", vector_to_array("probability").alias("p")).collect()}
    assert all(np.allclose(got[i], want[i], atol=1e-5) for i in want)
    raw = {(r["row_id"], r["label_pos"]): r["score"] for r in ln.score_table(again, df, "id", [0, 1, 2], "m", False).collect()}
    assert all(abs(raw[i, k] - margins[i, k]) < 1e-9 for i, k in raw) and len(raw) == 720


def test_vectors_need_no_sort_and_no_row_leaves_a_step_twice(rows):
    """Features in order with categories named against the alphabet, and one Python pass to the packed blocks."""
    train = rows.withColumn("kind", F.when(F.col("doc_id") % 2 == 0, "b").otherwise("a"))
    table = TextTable(**SMALL, catCols=["source", "kind"], numCols=["n"]).fit(train)
    made = table.sparse(train)
    assert all(list(v) == sorted(set(v)) for v in (r["i"] for r in made.select(F.col("features.indices").alias("i")).collect()))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
