"""One test for each fault that lost rows, mixed up labels or failed on large inputs."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from voxtable import streaming
from voxtable.operators import categories as cat
from voxtable.operators import ensembles as en
from voxtable.operators import learning as ln
from voxtable.operators import ngrams as ng
from voxtable.operators import scores as sc
from voxtable.operators.cleaning import LeakError, gate_no_phone, require_no_phone
from voxtable.plans import text_models as tm

SCORE = "model string, row_id long, label long, label_pos int, score double"


def test_stream_restarts_keep_all_rows(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    for start in range(3):
        spark.range(start * 10, start * 10 + 10).coalesce(1).write.mode("append").parquet(source)
        stream = streaming.read_parquet_stream(spark, source, "id long")
        streaming.write_stream(stream, sink, mark).awaitTermination()
        assert spark.read.parquet(sink).count() == 10 * (start + 1)
    with pytest.raises((TypeError, ValueError)):
        streaming.write_stream(stream, sink, "")


def _texts(spark):
    rows = [(i, f"{'red apple tart' if i % 4 == 0 else 'blue sea wave' if i % 4 == 1 else 'green leaf tree' if i % 4 == 2 else 'grey stone wall'} {i % 7}", i % 4) for i in range(48)]
    return spark.createDataFrame(rows, "id long, text string, label long")


def test_label_order_follows_the_fit(spark):
    df = _texts(spark)
    got = tm.cross_validate(df, "id", "text", "label", [3, 2, 1, 0], 2, "logistic", max_iter=20)
    best = sc.argmax(got, ("row_id", "y"))
    assert best.filter("label <> y").count() == 0
    with pytest.raises(ValueError):
        tm.cross_validate(df, "id", "text", "label", [0, 1, 2], 2, "logistic")


def _two_models(spark):
    return spark.createDataFrame([(m, 1, k, k, s) for m, a in (("a", 1.0), ("b", 3.0)) for k, s in ((0, a), (1, -a))], SCORE)


def test_model_without_a_weight_counts_once(spark):
    weights = sc.model_weights(spark, {"a": 0.5, "gone": 7.0})
    got = {r.label: r.score for r in sc.weighted_sum(_two_models(spark), weights).collect()}
    assert got == {0: 3.5, 1: -3.5}
    mean = {r.label: r.score for r in sc.weighted_mean(_two_models(spark), weights).collect()}
    assert mean == {0: 3.5 / 1.5, 1: -3.5 / 1.5}


def test_missing_cells_raise(spark):
    table = _two_models(spark)
    with pytest.raises(Exception, match="model b lacks"):
        en.score_rows(table.filter("not (model = 'b' and label = 1)"), ["a", "b"]).collect()
    a, b = table.filter("model = 'a'"), table.filter("model = 'b'")
    with pytest.raises(Exception, match="only one side"):
        sc.blend(a, b.withColumn("row_id", F.lit(2).cast("long")), 1.0, 1.0).collect()


def _numbers(spark):
    rows = [(i, f"c{i % 100}", float(i % 10), int(i % 10 > 4)) for i in range(300)]
    return spark.createDataFrame(rows, "id long, kind string, x double, label int").withColumn("text", F.lit("a"))


def test_tree_probabilities_and_any_number_of_categories(spark):
    df = _numbers(spark)
    made = ln.tree_features(df, "text", ["kind"], ["x"], text_dim=4).transform(df)
    model = ln.train_boosted(made, "label", max_iter=2, depth=2)
    scores = ln.score_table(model, made, "id", [0, 1], "trees", True)
    single = model.models[1].transform(made).select(F.col("id").alias("row_id"), F.col("probability").alias("p"))
    other = model.models[0].transform(made).select(F.col("id").alias("row_id"), F.col("probability").alias("q"))
    for r in scores.filter("label = 1").join(single, "row_id").join(other, "row_id").limit(20).collect():
        assert math.isclose(r.score, r.p[1] / (r.p[1] + r.q[1]), rel_tol=1e-9)
    with pytest.raises(ValueError):
        ln.score_table(model, made, "id", [0, 1, 2], "trees", True)


def test_report_without_grouping(spark):
    df = _numbers(spark)
    row = cat.RareGrouping.fit(df, ["kind"], min_count=1).report(df, df).first()
    assert (row.col, row.train_unique_before, row.train_unique_after, row.n_rare_train, row.n_rare_test) == ("kind", 100, 100, 0, 0)
    assert cat.RareGrouping.fit(df, ["no_such"], min_count=1).report(df, df).count() == 0


def test_most_frequent_terms_with_ties(spark):
    rows = [(f"t{i:03d}", i % 7) for i in range(200)]
    stats = spark.createDataFrame(rows, "term string, cf long")
    for k in (0, 1, 28, 29, 57, 100, 200, 500):
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:k]
        assert sorted(tuple(r) for r in ng.most_frequent(stats, k).collect()) == sorted(want)


def test_one_hot_numbers_all_columns(spark):
    df = spark.createDataFrame([(1, "b", "x"), (2, "a", "y"), (3, None, "x")], "id long, p string, q string")
    got = {(r.col, r.value): r.feature for r in ln.OneHot.fit(df, ["q", "p"]).categories.table.collect()}
    assert got == {("p", "UNK"): 0, ("p", "a"): 1, ("p", "b"): 2, ("q", "x"): 3, ("q", "y"): 4}


def test_large_lookups_are_not_broadcast(spark, monkeypatch):
    from voxtable import scale

    wide = scale.Lookup.settle(spark.range(50).select("id", F.expr("repeat('x', 1000)").alias("v")))
    assert wide.rows == 50 and 50_000 < wide.size_bytes < 60_000 and wide.small
    monkeypatch.setattr(scale, "BROADCAST_BYTES", 10_000)
    assert not wide.small and wide.join(spark.range(60), "id").count() == 60


def test_leak_errors_hold_no_text(spark):
    df = spark.createDataFrame([(7, "call 0559233222 now")], "id long, text string")
    with pytest.raises(LeakError) as found:
        require_no_phone(df, "id", "text")
    assert "7" in str(found.value) and "0559" not in str(found.value)
    with pytest.raises(Exception) as raised:
        gate_no_phone(df, "text", "id").collect()
    assert "in row 7" in str(raised.value)


def test_trees_are_full_size_and_measured_on_rows_apart(spark, monkeypatch):
    import inspect

    from given_tables import DATA
    from voxtable.catalog import models

    sizes = inspect.signature(ln.train_boosted).parameters
    assert sizes["max_iter"].default >= 50 and sizes["depth"].default >= 6
    trained, measured = [], []
    train, accurate = ln.train_boosted, models._accurate
    monkeypatch.setattr(ln, "train_boosted", lambda rows, *args: trained.append(rows) or train(rows, *args, max_iter=1, depth=1))
    monkeypatch.setattr(models, "_accurate", lambda rows, unseen: measured.append(rows.filter(unseen)) or accurate(rows, unseen))
    rows = models.trees_accuracy(spark, DATA)
    used = {r["doc_id"] for r in trained[0].select("doc_id").collect()}
    stopping = {r["doc_id"] for r in trained[0].filter("is_holdout").select("doc_id").collect()}
    apart = {r["row_id"] for r in measured[0].select("row_id").collect()}
    assert stopping and apart and not used & apart and len(used) + len(apart) == rows.count()


def test_svm_has_the_features_of_the_ticket_model(spark, monkeypatch):
    from given_tables import DATA
    from voxtable.catalog import models

    asked = {}

    class Asked(Exception):
        pass

    def fit(*args, **options):
        asked.update(options)
        raise Asked

    monkeypatch.setattr(models.TextClassifier, "fit", fit)
    with pytest.raises(Asked):
        models.linear_svm(spark, DATA)
    assert asked == {"name": "svm", "sublinear": False, "withinWords": True, "wordFeatures": 120_000, "charFeatures": 250_000}


def test_fold_vocabularies_are_the_totals_less_the_fold(spark):
    from given_tables import DATA
    from voxtable.operators import ngrams as ng
    from voxtable.operators.splits import assign_folds

    docs = assign_folds(spark.read.parquet(f"{DATA}/documents.parquet").filter("n_chars < 1500").select("doc_id", "text", "lang"), "doc_id", "lang", 3)
    docs = docs.cache()
    own = tm.FoldedTerms(docs, "doc_id", "text", ng.explode_word_terms, 2, 300, True)
    for fold in (1, 2, 3):
        train = docs.filter(F.col("fold") != fold)
        want = ng.Tfidf.fit(ng.explode_word_terms(train, "doc_id", "text"), "doc_id", ng.doc_count(train), 2, 300, True)
        got = own.outside(fold)
        order = lambda model: [tuple(r) for r in model.vocabulary.table.select("term", "term_id", "df", "cf", F.round("idf", 12)).orderBy("term").collect()]
        assert order(got) == order(want) and got.size == 300
        cut = ng.explode_word_terms(docs, "doc_id", "text")
        rows = lambda df: {(r["doc_id"], r["term"]): round(r["weight"], 12) for r in df.collect()}
        assert rows(own.weights(got)) == rows(want.transform(cut))


def test_refit_takes_the_mean_best_count_of_the_folds(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 3, i % 2, Vectors.dense([float(i % 3), float(i % 7)])) for i in range(120)], ["label_id", "fold", "features"])
    curves = iter([[[3.0, 1.0, 2.0]] * 3, [[4.0, 3.0, 2.0], [1.0, 2.0, 3.0], [2.0, 1.0, 1.0]]])
    monkeypatch.setattr(ln, "validation_curves", lambda *args: next(curves))
    counts = ln.best_iterations(rows, "label_id", max_iter=2, depth=2)
    assert counts == [round((2 + 3) / 2), round((2 + 1) / 2), 2]
    monkeypatch.undo()
    model = ln.refit_boosted(rows, "label_id", [1, 3, 2], depth=2)
    assert [m.getNumTrees for m in model.models] == [1, 3, 2]
    losses = ln.validation_curves(model, rows, "label_id")
    assert [len(c) for c in losses] == [1, 3, 2] and all(c[-1] <= c[0] for c in losses)
    assert model.transform(rows).filter("prediction = label_id").count() == 120


def test_out_of_fold_vectors_are_made_for_the_rows_at_hand(spark, monkeypatch):
    """No fold writes vectors: they are made once for the rows it fits on, once for those it scores."""
    from voxtable.operators import learning as ln
    from voxtable.plans import text_models as tm

    df = spark.createDataFrame([(i, f"{'red blue'.split()[i % 2]} word {i % 7}", i % 2) for i in range(40)], "id int, text string, label long")
    made, plain = [], ln.row_vectors
    monkeypatch.setattr(ln, "write_row_vectors", None)
    monkeypatch.setattr(ln, "row_vectors", lambda rows, *a: made.append(rows.count()) or plain(rows, *a))
    got = tm.cross_validate(df, "id", "text", "label", [0, 1], 2, "logistic", word_features=30, char_features=50).collect()
    assert made == [20, 20, 20, 20] and len(got) == 80
    assert all((r["score"] > 0.5) == (r["label"] == r["y"]) for r in got)
