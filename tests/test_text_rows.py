"""Vectors that are made from the texts where they are packed or scored."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxtable.operators import cuts, linear
from voxtable.operators import ngrams as ng
from voxtable.operators.linear import LinearMargins, SoftmaxRegression, SquaredHingeSvm
from voxtable.operators.text_stages import TextTable
from voxtable.plans.scoring import ScoreSpec, TextClassifier


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    words = ["".join(draw.choices("abcdeé", k=draw.randint(1, 6))) for _ in range(150)]
    made = [(i, " ".join(draw.choices(words[i % 3 * 40 :], k=draw.randint(3, 200))), draw.choice(["x", "y", None]), draw.choice([0, 4, -7, None]), i % 3, 1.0 + i % 2) for i in range(90)]
    made += [(90, None, None, None, 0, 1.0), (91, "", "new", 3, 1, 1.0), (92, "Öß \n\t öß", "x", None, 2, 1.0)]
    return spark.createDataFrame(made, "id long, text string, kind string, n long, label_id int, weight double").coalesce(2).cache()


@pytest.fixture(scope="module", params=[True, False])
def table(rows, request):
    own = TextTable(wordFeatures=120, charFeatures=400, catCols=["kind"], numCols=["n"], sublinear=request.param, withinWords=not request.param)
    return own.fit(rows.filter("id < 80"))


def test_blocks_of_texts_are_their_vectors_in_few_bytes(rows, table, monkeypatch):
    monkeypatch.setattr(linear, "TEXT_BYTES", 4000)
    keep = ["id", "label_id", "weight"]
    want = {r["id"]: r for r in table.transform(rows).collect()}
    packed = linear._packed(table.rows(rows.coalesce(1).sortWithinPartitions("id"), keep), "label_id", "weight").collect()
    assert len(packed) > 3 and {r["d"] for r in packed} == {table.size}
    at, factors = 0, table.rows(rows, keep).factors
    for r in packed:
        block = linear._Block.unpacked(len(r["y"]) // 4, r["lengths"], r["parts"])
        dense = np.zeros((block.rows, table.size))
        v = np.concatenate([block.levels[block.codes] if len(block.codes) else np.zeros(0), block.rest])
        features = np.repeat(block.features, block.sizes)
        np.add.at(dense, (block.segments % block.rows, features), v * block.factors[block.segments] * factors[features])
        for k, y, c in zip(range(block.rows), np.frombuffer(r["y"], "<i4"), np.frombuffer(r["c"], "<f8")):
            own = want[at + k]
            assert (y, c) == (own["label_id"], own["weight"]) and np.allclose(dense[k], own["features"].toArray(), atol=1e-12)
        at += block.rows
    assert at == 93
    monkeypatch.undo()
    whole = linear._packed(table.rows(rows.coalesce(1), keep), "label_id", "weight").collect()
    assert sum(len(r["parts"]) for r in whole) < 5 * sum(len(r["features"].indices) for r in want.values())


def test_learners_and_models_take_texts_as_they_take_vectors(rows, table):
    keep = ["label_id", "weight"]
    for learner in (SquaredHingeSvm(weightCol="weight", maxIter=4), SoftmaxRegression(weightCol="weight", maxIter=4)):
        own, want = learner.fit(table.rows(rows, keep)), learner.fit(table.transform(rows))
        assert np.allclose(own.weights, want.weights, atol=1e-6)
    model = LinearMargins(np.random.default_rng(1).normal(size=(3, table.size + 1)), [0.0] * 3)
    own, want = ({r["id"]: r["margins"] for r in model.scored(source, ["id"]).collect()} for source in (table.rows(rows, ["id"]), table.transform(rows)))
    assert own.keys() == want.keys() and all(np.allclose(own[k], want[k], atol=1e-9) for k in own)


def test_one_python_function_leads_from_texts_to_blocks_and_scores(rows, table):
    """A task then needs one worker, and no vectors pass between workers and the JVM."""
    from pyspark.ml import PipelineModel

    model = LinearMargins(np.zeros((3, table.size + 1)), [0.0] * 3)
    scores = TextClassifier(PipelineModel([table, model]), ScoreSpec("m", "id", "label_id", (0, 1, 2), "svm")).scores(rows, ["n"])
    for df in (scores, linear._packed(table.rows(rows, ["label_id", "weight"]), "label_id", "weight")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
    assert scores.count() == 3 * 93


def test_counts_by_fold_are_shuffled_once(rows):
    folded = rows.withColumn("fold", F.col("id").cast("int") % 3 + 1)
    for cut in (cuts.WORDS, cuts.CHARS):
        order = lambda df: {r["term"]: (r["df"], r["cf"], {k: (v["df"], v["cf"]) for k, v in r["folds"].items() if v["df"]}) for r in df.collect()}
        made = ng.stats_by_fold(cuts.block_stats(folded, "text", cut, "fold"), [1, 2, 3])
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert order(made) == order(ng.joined_folds(cuts.stats(folded, "text", cut, "fold")))


def test_counts_of_both_cuts_come_from_one_pass(rows):
    made = cuts.stats_by_cut(rows, "text", [cuts.WORDS, cuts.CHARS_WB])
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r["cut"], r["term"]): (r["df"], r["cf"]) for r in made.collect()}
    assert got == {(k, r["term"]): (r["df"], r["cf"]) for k, cut in enumerate((cuts.WORDS, cuts.CHARS_WB)) for r in cuts.stats(rows, "text", cut).collect()}
