import itertools
import re
from collections import Counter

import numpy as np
import pytest

from helpers import empty_docs, odd_docs
from voxtable.llm import quality as q

DATA = "/root/testdata/sf0.001"


def base(text):
    """The contract's base counts, word by word."""
    text = text or ""
    spans = [m for m in re.finditer("[^\\x20\\x09-\\x0D]+", text)]
    words = [m[0] for m in spans]
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_base_counts_match_a_plain_count(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(odd_docs(spark).selectExpr("doc_id", "text", "'' lang", "'' source", "0L n_chars"))
    rows = q.quality(docs, q.Crf.blank()).collect()
    texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = Counter((i, *base(t)) for i, t in texts)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows) == want
    assert all(r["kept"] == (not r["base_failed"]) for r in rows)  # no weights: all lines are content


def test_viterbi_is_the_best_of_all_labellings():
    draw = np.random.default_rng(1)
    crf = q.Crf(draw.normal(size=q.SIZE), draw.normal(size=(2, 2)), draw.normal(size=2))
    for n in (1, 2, 5, 8):
        features = np.stack([draw.integers(0, w, n) for w in q.WIDTHS], 1)
        unary = crf.emission[features + q.SHIFTS].sum(1)
        score = lambda y: crf.start[y[0]] + sum(unary[i] for i in range(n) if y[i]) + sum(crf.transition[a, b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert crf.decode(features, np.array([0])).tolist() == list(best)


def test_gradient_matches_enumeration():
    """One long fit on a tiny set reaches marginals equal to the labels' counts, up to the penalty."""
    features = [np.zeros((2, len(q.BUCKETS)), np.int64), np.ones((3, len(q.BUCKETS)), np.int64)]
    crf = q.fit_crf(features, np.array([False, True]))
    assert crf.decode(features[0], np.array([0])).tolist() == [0, 0]
    assert crf.decode(features[1], np.array([0])).tolist() == [1, 1, 1]


@pytest.fixture(scope="module")
def fitted(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, q.train(docs, labels)


def test_good_texts_stay_and_junk_goes(fitted):
    docs, labels, crf = fitted
    rows = q.quality(docs, crf).join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg({"kept": "count"}).collect()
    kept = {(r["quality"], r["kept"]): r["n"] for r in q.quality(docs, crf).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert len(rows) == 2
    assert kept.get((1, False), 0) <= 0.01 * kept[1, True]
    assert kept.get((0, True), 0) <= 0.2 * kept[0, False]


def test_no_labels_and_empty_tables(spark, fitted):
    docs, labels, crf = fitted
    assert not q.train(docs, labels.limit(0)).emission.any()
    assert q.quality(empty_docs(spark), crf).count() == 0
    kept = q.retained(odd_docs(spark, "kept", "n_words", "c0"), crf)
    assert kept.columns == ["doc_id", "text", "kept", "n_words", "c0"]
    assert kept.filter("text is null or trim(text) = ''").count() == 0
