import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from helpers import empty_docs, odd_docs
from voxtable.llm import phrases as q
from voxtable.llm import queries

DATA = "/root/testdata/sf0.01"


def plain(rows, least=10, top=2000):
    """The contract, phrase by phrase."""
    found = {}
    for lang, text in rows:
        f, size = found.setdefault(lang or "und", (Counter(), [0]))
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lower):
            w = re.findall("[^ \t]+", piece)
            size[0] += len(w)
            f.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, (f, size) in found.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        hidden = {p for t, b in candidates.items() if len(t) == 3 for p in (t[:2], t[1:]) if p in candidates and 100 * b >= 50 * candidates[p]}
        best = []
        for p, a in candidates.items():
            if p not in hidden:
                score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, i, p.decode(), -a, left, right, size[0], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    draw = random.Random(12)
    words = ["New", "york", "the", "of", "Ünder", "ä", "x1", "(a)", "’s", "日本"] + [f"w{i}" for i in range(30)]
    made = []
    for _ in range(250):
        made.append((draw.choice(["en", "de", None]), draw.choice(["en", " ", ""]) + "".join(draw.choice(words[: draw.choice([4, 40])]) + draw.choice([" ", " ", " ", "\t", ", ", ".", "\n", "  ", "\x0b"]) for _ in range(120))))
    return [*made, ("en", None), ("fr", ""), ("en", "a a a a a a a a a a a a a a"), *[("en", "one new city of york " * 9)] * 3, ("xx", "too few words to count")]


def test_same_as_phrase_by_phrase(spark, texts, monkeypatch):
    for name, small in (("BURST", 20), ("HELD", 300), ("STEP", 700), ("MOST_BITS", 1 << 12)):
        monkeypatch.setattr(q, name, small)
    df = spark.createDataFrame([(t, x, "clash") for x, t in texts], "text string, lang string, rank string").repartition(3)
    assert rows_of(q.collocations(df)) == plain(texts)
    assert rows_of(q.collocations(df, per_lang=7)) == plain(texts, top=7)


def test_whole_table_equals_the_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    got = queries.QUERIES["op12_phrase_collocations"](spark, DATA)
    names = [c[0] for c in con.execute(queries.ORACLES["op12_phrase_collocations"]).description]
    assert names == got.columns
    assert rows_of(got) == sorted(con.execute(queries.ORACLES["op12_phrase_collocations"]).fetchall())


def test_phrases_are_spelt_whatever_task_meets_them(spark, texts, monkeypatch):
    """The last pass may deal the rows to other tasks than the counting."""
    spelt, asked = q._spelt, []

    def elsewhere(slim, seed, gates, mine, every):
        asked.append(every)
        return spelt(slim if every else slim.limit(0), seed, gates, mine, every)

    monkeypatch.setattr(q, "_spelt", elsewhere)
    df = spark.createDataFrame([(t, x) for x, t in texts], "text string, lang string").repartition(3)
    assert rows_of(q.collocations(df)) == plain(texts) and asked == [False, True]


def test_packed_runs_come_back():
    draw = np.random.default_rng(5)
    for top in (3, 1 << 20, 1 << 63):
        keys = np.unique(draw.integers(0, top - 1, 500))
        counts = draw.integers(1, 1 << draw.integers(1, 40), len(keys))
        back = q.unpacked(q.packed(keys, counts))
        assert np.array_equal(back[0], keys) and np.array_equal(back[1], counts)


def test_trie_counts_and_spills_sorted_runs(monkeypatch):
    monkeypatch.setattr(q, "BURST", 10)
    draw = np.random.default_rng(3)
    trie, total, spilled = q.Trie(24), Counter(), Counter()
    for _ in range(60):
        keys = np.sort(np.where(draw.random(200) < 0.3, 5, draw.integers(0, 1 << 24, 200) ** 2 >> 24))
        total.update(keys.tolist())
        trie.add(keys)
        if trie.size > 900:
            before = trie.size
            for run, counts in trie.spill(450):
                assert (np.diff(run) > 0).all()
                spilled.update(dict(zip(run.tolist(), counts.tolist())))
            assert trie.size <= 450 < before and trie.size == sum(map(len, trie._containers(trie.root)))
    for run, counts in trie.spill():
        spilled.update(dict(zip(run.tolist(), counts.tolist())))
    assert spilled == total and trie.size == 0


def test_filter_lets_every_member_through(spark):
    draw = np.random.default_rng(4)
    members, others = draw.integers(0, (1 << 63) - 1, 3000), draw.integers(0, (1 << 63) - 1, 20_000)
    gate = q.bloom(spark.createDataFrame([(int(x),) for x in members], "key long").repartition(3), 3000)
    assert gate.has(members).all() and gate.has(others).mean() < 0.02


def test_odd_rows(spark):
    odd = odd_docs(spark, "phrase", "n").selectExpr("*", "cast(null as string) lang")
    got = rows_of(q.collocations(odd, least=2))
    assert got == plain([(None, r["text"]) for r in odd.collect()], least=2) and len(got) == 2000
    assert q.collocations(empty_docs(spark).selectExpr("*", "text lang")).count() == 0
