import zlib

import numpy as np
import pytest

from helpers import empty_docs, odd_docs
from voxtable.llm import toxicity as q

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, q.train(docs, labels)


def test_buckets_are_the_distinct_grams():
    grams = q.Grams()
    for text in ("Hello  hello\nhello", "a", "ünïcode 😀", "x" * 100):
        got = grams(text)
        flat = f" {' '.join(text.lower().split())} "
        n_grams = {flat[i : i + n] for n in q.SIZES for i in range(len(flat) - n + 1)}
        assert len(got) == len(set(got.tolist())) and len(n_grams) * 0.95 <= len(got) <= len(n_grams)
    assert len(grams("")) == 0


def test_english_texts_held_out_are_told_apart(fitted):
    docs, labels, model = fitted
    rows = q.toxicity(docs, model).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").filter("lang = 'en'").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    seen = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r["toxic"] for r in seen]) >= 0.9
    assert np.mean([r["score"] for r in seen if r["toxic"]]) > 0.5 > 0.2 > np.mean([r["score"] for r in seen if not r["toxic"]])


def test_held_out_labels_do_not_matter(spark, fitted):
    docs, labels, model = fitted
    turned = labels.withColumn("toxic", q.F.when(q.held_out("doc_id"), 1 - q.F.col("toxic")).otherwise(q.F.col("toxic")))
    again = q.train(docs, turned)
    assert np.array_equal(again.weights, model.weights) and again.intercept == model.intercept


def test_odd_rows_and_missing_labels(spark, fitted):
    docs, labels, model = fitted
    rows = q.toxicity(odd_docs(spark, "score", "toxic", "held_out"), model).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert q.toxicity(empty_docs(spark), model).count() == 0
    none = q.train(docs, labels.limit(0))
    assert not none.weights.any() and abs(none.score(np.zeros(0, int)) - 0.5) < 1e-9
    one = q.train(docs, labels.filter("toxic = 0"))
    assert one.score(np.zeros(0, int)) < 0.05
