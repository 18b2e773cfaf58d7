import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helpers import empty_docs, odd_docs
from voxtable.llm import langid as q

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return q.train(docs)


def group(*texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)


def best_score(scores, switch):
    value = np.zeros(scores.shape[1])
    for row in scores:
        value = np.maximum(value, value.max() - switch) + row
    return value.max()


@pytest.mark.parametrize("n", [2, 4, 7])
def test_search_is_the_best_of_all_paths(n, monkeypatch):
    draw = np.random.default_rng(n)
    monkeypatch.setattr(q, "CHUNK", 5)
    sizes = np.array([0, 1, 4, 5, 6, 0, 37, 12, 100, 0])
    firsts = np.r_[0, np.cumsum(sizes)]
    scores = draw.normal(0, 3, (firsts[-1], n))
    for at_once in (1, 1 << 21):
        monkeypatch.setattr(q, "AT_ONCE", at_once)
        labels = q.paths(scores, firsts, 2.5)
        for a, b in zip(firsts, firsts[1:]):
            own, part = labels[a:b], scores[a:b]
            got = part[np.arange(b - a), own].sum() - 2.5 * (own[1:] != own[:-1]).sum()
            assert abs(got - (best_score(part, 2.5) if b > a else 0)) < 1e-9


def test_words_break_at_scripts_and_keep_marks():
    data, offsets = group("Été d'Орел x́y 12 ́", "", "日本語テキスト")
    found = q.words(data, offsets)
    texts = ["Été d'Орел x́y 12 ́", "", "日本語テキスト"]
    assert [texts[r][s:e] for r, s, e in zip(found.rows, found.starts, found.ends)] == ["Été", "d", "Орел", "x́y", "日本語", "テキスト"]
    assert [q.NAMES[s] for s in found.scripts] == ["latin", "latin", "cyrillic", "latin", "han", "kana"]
    assert found.letters.tolist() == [3, 1, 4, 2, 3, 4]


def test_held_out_accuracy_of_every_language(docs, model):
    got = q.languages(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    by_lang = {r["lang"]: r["ok"] for r in got.groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("ok")).collect()}
    assert set(by_lang) == {"de", "en", "es", "fr"} and min(by_lang.values()) >= 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def test_spans_of_mixed_texts(docs, model):
    pool = {r["lang"]: r["t"] for r in docs.filter(q.held_out("doc_id") & (F.length("text") > 400)).groupBy("lang").agg(F.collect_list("text").alias("t")).collect()}
    draw, right, total = random.Random(4), 0, 0
    for _ in range(60):
        langs = draw.sample(sorted(pool), 2)
        parts = [" ".join(draw.choice(pool[x]).split()[10:40]) for x in langs]
        text = " ".join(parts)
        _, _, spans = (c.to_pylist()[0] for c in q.judged(model, *group(text)))
        assert all(a["end"] <= b["start"] and a["lang"] != b["lang"] for a, b in zip(spans, spans[1:]))
        truth = [langs[0]] * (len(parts[0]) + 1) + [langs[1]] * len(parts[1])
        for s in spans:
            right += sum(truth[i] == s["lang"] for i in range(s["start"], s["end"]))
            total += s["end"] - s["start"]
    assert right / total > 0.9


def test_script_rules_languages_out():
    data, offsets = group("some latin words here", "некоторые слова здесь")
    found = q.words(data, offsets)
    counts, letters = np.zeros((2, q.BUCKETS), np.int64), np.zeros((2, len(q.NAMES)), np.int64)
    for row in (0, 1):
        mine = np.repeat(found.rows, np.diff(np.r_[found.firsts, len(found.buckets)])) == row
        counts[row] = np.bincount(found.buckets[mine], minlength=q.BUCKETS)
        letters[row] = np.bincount(found.scripts[found.rows == row], found.letters[found.rows == row], len(q.NAMES))
    model = q.fit(["en", "ru"], counts, letters)
    pred, _, spans = (c.to_pylist() for c in q.judged(model, *group("unseen Щ words", "неведомое", "ελληνικά")))
    assert pred[:2] == ["en", "ru"] and {s["lang"] for s in spans[1]} == {"ru"}
    assert pred[2] in ("en", "ru")


def test_odd_rows(spark, model, docs):
    odd = odd_docs(spark, "score", "held_out")
    rows = q.languages(odd, model).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (1, 2, 3):
            assert (r["lang_pred"], r["score"], r["spans"]) == ("und", 0.0, [])
        else:
            assert r["lang_pred"] in model.languages and 0 <= r["score"] <= 1
    assert q.languages(empty_docs(spark), model).count() == 0
    nothing = q.train(docs.limit(0))
    assert {r["lang_pred"] for r in q.languages(odd, nothing).collect()} == {"und"}


def test_nothing_is_learned_from_held_out_or_unlabelled_rows(docs, model):
    wrong = docs.withColumn("lang", F.when(q.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang")))
    bare = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang")).unionByName(wrong.select("doc_id", "text", "lang"))
    again = q.train(bare)
    assert again.languages == model.languages and np.array_equal(again.ratios, model.ratios)
