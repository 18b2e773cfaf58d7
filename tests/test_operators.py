"""Operators against brute force, error paths, storage round trips and streams."""

import hashlib
import json
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from given_tables import DATA
from voxtable.catalog.cleaning import raw_comments, raw_tickets
from voxtable.config import CommentConfig, TicketConfig
from voxtable.operators import categories as cat
from voxtable.operators import ensembles as en
from voxtable.operators import evaluation as ev
from voxtable.operators import features as ft
from voxtable.operators import gating as gt
from voxtable.operators import learning as ln
from voxtable.operators import ngrams as ng
from voxtable.operators import pseudo as ps
from voxtable.operators import schema
from voxtable.operators import scores as sc
from voxtable.operators import splits as sp
from voxtable.plans import datasets
from voxtable.scale import hashed_rank, scratch_path, top_k_per_group
from voxtable.sources import tables as src


def test_hashed_rank_on_a_dominant_group(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}") for i in range(900)] + [(900, None)]
    got = {r.i: r["rank"] for r in hashed_rank(spark.createDataFrame(rows, "i int, g string"), "g", "i", 42, "rank", hex_digits=2).collect()}
    expected = {}
    for g in {g for _, g in rows}:
        ids = sorted((i for i, h in rows if h == g), key=lambda i: (hashlib.md5(f"{i}-42".encode()).hexdigest(), i))
        expected.update({i: r for r, i in enumerate(ids, 1)})
    assert got == expected


def test_top_k_on_a_dominant_group(spark):
    rows = [(i, "big" if i % 10 else "small", i % 17) for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, g string, v int")
    got = {(r.g, r.i) for r in top_k_per_group(df, ["g"], [F.desc("v"), F.asc("i")], 15, ["i"], salts=8).collect()}
    expected = {(g, i) for g in ("big", "small") for i, _, _ in sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))[:15]}
    assert got == expected


def test_folds_are_even_and_complete(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    sizes = sp.assign_folds(df, "doc_id", "lang", 4).groupBy("lang", "fold").count().collect()
    per_label = {}
    for r in sizes:
        per_label.setdefault(r.lang, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 for v in per_label.values())
    folded = sp.assign_folds(df, "doc_id", "lang", 4)
    with pytest.raises(sp.FoldError):
        sp.require_complete(folded, folded.filter("fold <> 2"), "doc_id")


def _cut_char_wb(text, low, high):
    out = Counter()
    for word in text.lower().split():
        w = f" {word} "
        for n in range(low, high + 1):
            grams = [w[i:i + n] for i in range(len(w) - n + 1)]
            if not grams and n == low:
                grams = [w]
            out.update(grams)
    return out


def test_ngrams_match_brute_force(spark):
    texts = ["Le débit  est\n\nbas", "a bc", "", "😀 ok 😀ok", "x" * 9001 + " fin"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")

    def counts(terms):
        out = {i: Counter() for i in range(len(texts))}
        for r in ng.term_counts(terms, "id").collect():
            out[r.id][r.term] = r.tf
        return out

    chars, inside, words = counts(ng.explode_char_terms(df, "id", "t")), counts(ng.explode_char_wb_terms(df, "id", "t", 4, 6)), counts(ng.explode_word_terms(df, "id", "t", 1, 3))
    for i, t in enumerate(texts):
        flat = __import__("re").sub(r"\s\s+", " ", t.lower())
        assert chars[i] == Counter(flat[k:k + n] for n in (3, 4, 5) for k in range(len(flat) - n + 1))
        assert inside[i] == _cut_char_wb(t, 4, 6)
        ws = __import__("re").findall(r"\w\w+", t.lower())
        assert words[i] == Counter(" ".join(ws[k:k + n]) for n in (1, 2, 3) for k in range(len(ws) - n + 1))


def test_tfidf_unit_norm(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet").limit(60).select("doc_id", "text")
    terms = ng.explode_word_terms(df, "doc_id", "text")
    model = ng.Tfidf.fit(terms, "doc_id", ng.doc_count(df), 2, 500)
    norms = model.transform(terms).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("n")).collect()
    assert model.size <= 500 and all(math.isclose(r.n, 1.0, rel_tol=1e-9) for r in norms)


def test_macro_f1_golden(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    assert ev.macro_f1(df, "y", "p").first()[0] == pytest.approx(7 / 18)
    assert ev.macro_f1(df, "y", "p", [0, 1, 2, 3]).first()[0] == pytest.approx(7 / 24)
    with pytest.raises(ValueError):
        ev.confusion(df, "y", "p", normalize="rows")


def test_gate_is_sequential(spark):
    windows = spark.sql("select 5L as label, timestamp_ntz'2025-01-10' as t_min, timestamp_ntz'2025-01-20' as t_max union all select 3L, timestamp_ntz'2025-01-01', timestamp_ntz'2025-01-02'")
    df = spark.sql("select * from values (1, 5L, timestamp_ntz'2025-01-25'), (2, 5L, null), (3, 3L, timestamp_ntz'2025-01-25'), (4, 5L, timestamp_ntz'2025-01-15') t(i, p, t)")
    out = {r.i: (r.pred_gated, r.gate_changes) for r in gt.gate_by_time(df, windows, "p", "t", [3, 5], 2, {5: 1, 3: 5}).collect()}
    assert out == {1: (1, 1), 2: (5, 0), 3: (1, 2), 4: (5, 0)}
    assert gt.gate_settings({"gate_classes": [1], "fallback_class": 4, "fallback_map": {"5": 0}}) == {"classes": [1], "fallback": 4, "overrides": {5: 0}}
    assert gt.gate_settings(classes=[3, 3, 0], fallback=1, overrides={})["classes"] == [3, 0]


def _numpy_greedy(s, y, step, max_runs):
    def f1(mix):
        p = mix.argmax(axis=1)
        out = []
        for c in range(s[0].shape[1]):
            tp, den = ((p == c) & (y == c)).sum(), (p == c).sum() + (y == c).sum()
            out.append(2 * tp / den if den else 0.0)
        return float(np.mean(out))

    single = [f1(x) for x in s]
    start = int(np.argmax(single))
    ens, chosen, best, weights = s[start], [start], single[start], {start: 1.0}
    while len(chosen) < min(max_runs, len(s)):
        trials = [(f1(a * ens + (1 - a) * s[j]), -i, j, a) for j in range(len(s)) if j not in chosen for i, a in enumerate(np.arange(0, 1 + 1e-9, step))]
        top = max(trials, key=lambda t: t[0])
        if top[0] <= best + 1e-9:
            break
        best, _, j, a = top
        ens, weights = a * ens + (1 - a) * s[j], {k: w * a for k, w in weights.items()} | {j: 1 - a}
        chosen.append(j)
    return best, {f"m{k}": w for k, w in weights.items()}


def test_greedy_ensemble_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 4, 160)
    s = [rng.normal(size=(160, 4)) + 0.8 * np.eye(4)[y] for _ in range(3)]
    cells = [(f"m{m}", i, c, c, float(s[m][i, c])) for m in range(3) for i in range(160) for c in range(4)]
    scores = spark.createDataFrame(cells, src.SCORE_SCHEMA)
    truth = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "row_id long, y long")
    found = en.greedy_ensemble(scores, truth, ["m0", "m1", "m2"], range(4), step=0.25)
    best, weights = _numpy_greedy(s, y, 0.25, 6)
    assert found["score"] == pytest.approx(best)
    assert found["weights"] == pytest.approx(weights)


def test_score_checks(spark):
    cells = [("m0", i, c, c, 0.5) for i in range(3) for c in range(2)]
    scores = spark.createDataFrame(cells, src.SCORE_SCHEMA)
    path = scratch_path(spark, "t-scores")
    src.save_scores(scores, path)
    assert src.load_scores(spark, path, rows=3, labels=2).count() == 6
    with pytest.raises(src.ScoreShapeError):
        src.load_scores(spark, path, rows=4)
    holes = scratch_path(spark, "t-scores")
    src.save_scores(scores.filter("not (row_id = 1 and label = 1)"), holes)
    with pytest.raises(src.ScoreShapeError):
        src.load_scores(spark, holes)
    with pytest.raises(sc.AlignmentError):
        sc.align_classes(scores, [0, 5])
    for bad in ((-1, 1), (0, 0)):
        with pytest.raises(ValueError):
            sc.blend(scores, scores, *bad)
    total = sc.softmax(scores).groupBy("row_id").agg(F.sum("score").alias("t")).collect()
    assert all(r.t == pytest.approx(1.0) for r in total)


def test_label_encoder_and_pseudo(spark):
    enc = cat.LabelEncoder.load(spark, {"id2label": {"0": "4", "1": "9"}})
    df = spark.createDataFrame([(1, 9, 0.9), (2, 7, 0.9), (3, 4, 0.2)], "id int, label long, confidence double")
    folded = spark.createDataFrame([(8, 4, 1)], "id int, label long, fold int")
    rows = {(r.id, r.fold, r.weight) for r in ps.with_pseudo_rows(folded, df, enc, 0.5, 0.3).collect()}
    assert rows == {(8, 1, 1.0), (1, 0, 0.3)}
    with pytest.raises(ValueError):
        cat.LabelEncoder.load(spark, {})
    with pytest.raises(ps.SelectionError):
        ps.require_selected(ps.select_pseudo_labels(df, "id", 0.99))
    with pytest.raises(Exception, match="no prediction for id"):
        ps.complete_submission(spark.range(3), spark.createDataFrame([(0, 1)], "id long, y long"), "id", "y").collect()


def test_encodings(spark, tmp_path):
    for name, data, expected in (("u", "id,t\n1,é€\n".encode("utf-8"), "é€"), ("b", "﻿id,t\n1,é\n".encode("utf-8"), "é"), ("w", "id,t\n1,é€\n".encode("cp1252"), "é€"), ("l", b"id,t\n1,\xe9\x81\n", "é\x81")):
        (tmp_path / f"{name}.csv").write_bytes(data)
        row = src.read_csv_robust(spark, str(tmp_path / f"{name}.csv")).first()
        assert (row.id, row.t) == ("1", expected), name
    with pytest.raises(FileNotFoundError):
        src.read_csv(spark, str(tmp_path / "none.csv"))


def test_config_and_spec_round_trip():
    cfg = CommentConfig(lower=False)
    assert CommentConfig.from_dict(json.loads(json.dumps(cfg.to_dict()))) == cfg
    ticket = TicketConfig()
    assert TicketConfig.from_dict(json.loads(json.dumps(ticket.to_dict()))) == ticket
    spec = ft.ticket_spec(ticket)
    assert len(spec.feature_cols) == 55 and ft.read_spec(spec.to_json(), ticket) == spec
    assert len(ft.comment_spec(cfg).num_cols) == 20
    old = ft.read_spec({"text_cols": ["t"], "cat_cols": ["c"], "num_cols": []}, ticket)
    assert old.feature_cols == ["c", "t"]


def test_header_resolution():
    assert schema.header_key("Réseau Social") == "reseau_social"
    found = schema.resolve_comment_headers(["id", "Réseau Social", "Commentaire client", "Class"], CommentConfig(), True)
    assert list(found.values()) == ["id", "platform", "comment", "label"]
    with pytest.raises(schema.SchemaError):
        schema.resolve_comment_headers(["id", "x"], CommentConfig(), False)


def test_ticket_dataset_plan(spark):
    raw = raw_tickets(spark, DATA)
    train, test = raw.filter("id % 4 <> 0"), raw.filter("id % 4 = 0").drop("class_int")
    template = test.select("id").withColumn("class_int", F.lit(0))
    pair = datasets.clean_ticket_dataset(train, test, template, out_dir=scratch_path(spark, "t-tickets"))
    assert pair.train.columns[:2] == ["id", "class_int"] and pair.train.columns[2:] == pair.test.columns[1:]
    assert pair.train.count() == train.count() and pair.test.count() == test.count()
    assert pair.train.filter("(subs_level = 'UNK') <> (subs_level_missing = 1)").count() == 0
    assert pair.summary.count() > 50


def test_comment_dataset_plan(spark):
    raw = raw_comments(spark, DATA)
    pair = datasets.clean_comment_dataset(raw.filter("id % 4 <> 0"), raw.filter("id % 4 = 0").drop("Class"), out_dir=scratch_path(spark, "t-comments"))
    assert pair.train.filter("has_phone_token = 1").count() == pair.train.count()


def test_one_hot_stage_matches_relation(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, c string")
    stage = ln.one_hot_stages(["c"]).fit(df)
    seen = stage.transform(spark.createDataFrame([(9, "zz"), (1, "a")], "id int, c string")).orderBy("id").collect()
    assert [r.onehot.numNonzeros() for r in seen] == [1, 0]
    assert ln.OneHot.fit(df, ["c"]).transform(spark.createDataFrame([(9, "zz"), (1, "a")], "id int, c string"), "id").count() == 1


def test_streaming_equals_batch(spark):
    from voxtable import streaming

    folder = scratch_path(spark, "t-source")
    raw = raw_comments(spark, DATA).drop("Class")
    raw.repartition(3).write.parquet(folder)
    out = scratch_path(spark, "t-sink")
    cfg = CommentConfig(keep_raw_cols=False)
    query = streaming.write_stream(streaming.comment_stream(streaming.read_parquet_stream(spark, folder, raw.schema, 1), cfg), out, scratch_path(spark, "t-mark"))
    query.awaitTermination(100)
    batch = streaming.comment_stream(spark.read.parquet(folder), cfg)
    assert spark.read.parquet(out).exceptAll(batch).count() == 0 and spark.read.parquet(out).count() == batch.count()


def test_cuts_inside_tasks_count_like_the_relational_ones(spark, monkeypatch):
    """Renumbered prefixes, weights beside wide keys and blocks of single texts give the same counts."""
    import pyarrow as pa

    from voxtable.operators import cuts

    texts = ["Le débit  est\n\nbas", "a bc", "", None, "😀 ok 😀ok", "x" * 9001 + " fin", "a b cd  É_É cd"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    pairs = ((cuts.WORDS, ng.explode_word_terms), (cuts.CHARS, ng.explode_char_terms), (cuts.CHARS_WB, ng.explode_char_wb_terms))
    for cut, explode in pairs:
        want = {(r.id, r.term): r.tf for r in ng.term_counts(explode(df, "id", "t"), "id").collect()}
        flat = pa.array([r[0] for r in df.select("id", cut.prepared(F.col("t")).alias("p")).orderBy("id").select("p").collect()])
        for bits in (62, 16):
            monkeypatch.setattr(cuts, "_BITS", bits)
            got = cuts.counted(flat, cut)
            names = got.terms.to_pylist()
            assert {(int(d), names[g]): int(n) for d, g, n in zip(got.doc, got.gram, got.times)} == want
        monkeypatch.setattr(cuts, "_BITS", 62)
        totals = {r.term: (r.df, r.cf) for r in ng.term_stats(ng.term_counts(explode(df, "id", "t"), "id")).collect()}
        assert {r.term: (r.df, r.cf) for r in cuts.stats(df, "t", cut).collect()} == totals
