import random

import pytest

from helpers import empty_docs, odd_docs
from voxtable.llm import neardup as q


def brute(rows, words, percent):
    sets = []
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append((i, {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()))
    label = {i: i for i, _ in rows if i is not None}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((top(i), top(j)))
                label[high] = low
    return {i: top(i) for i in label}


def near_copies(seed, groups=12, size=9):
    draw = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{draw.randrange(400)}" for _ in range(draw.choice((4, 40, 90, 200)))]
        for _ in range(draw.randint(1, size)):
            copy = list(base)
            for _ in range(draw.randint(0, 6)):
                copy[draw.randrange(len(copy))] = f"x{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy).upper() if draw.random() < 0.3 else " ".join(copy)))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,percent,seed", [(3, 85, 1), (5, 80, 2)])
def test_components_as_by_all_pairs(spark, words, percent, seed):
    rows = near_copies(seed) + [(900, "two words"), (901, "Two words"), (902, "w"), (903, ""), (904, None), (905, "")]
    got = q.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words, percent=percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_star_of_copies_far_from_each_other(spark):
    """Copies at growing distance from one text: settled through the pairs between components."""
    draw = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        copy = list(base)
        for k in draw.sample(range(150), draw.randint(0, 14)):
            copy[k] = f"x{draw.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = q.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 3, 85)


def test_repeated_ids_join_their_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (9, a), (3, b), (None, a)]
    got = q.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False)]


def test_odd_rows_and_columns(spark):
    rows = q.near_duplicates(odd_docs(spark, "rep", "kept")).collect()
    assert len(rows) == 7 and all(r["kept"] for r in rows)
    assert {r["n_shingles"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    out = q.deduplicated(odd_docs(spark, "rep", "c0", "kept"))
    assert out.columns == ["doc_id", "text", "rep", "c0", "kept"] and out.count() == 7
    assert q.near_duplicates(empty_docs(spark)).count() == 0


def test_pruning_keeps_links_within_the_chosen_miss():
    from math import comb

    for percent in (80, 85, 95):
        t, least = percent / 100 + (1 - percent / 100) / 256, q.prune_below(percent)
        for n, m in zip(range(q.BATCH, q.HASHES + 1, q.BATCH), least):
            below = sum(comb(n + 1, k) * t**k * (1 - t) ** (n + 1 - k) for k in range(m))
            assert below < q.MISS <= below + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102)], "a long, b long")
    got = {r["node"]: r["label"] for r in q.components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 101: 100, 102: 100}
