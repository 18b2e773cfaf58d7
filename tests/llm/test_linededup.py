import random
from collections import Counter

from helpers import empty_docs, odd_docs
from voxtable.llm import linededup as q

BLANKS = " \t\n\r\x0b\x0c"


def brute(rows, least):
    """New text and lines gone of every distinct row, comparing all stretches of lines."""
    docs = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    lines = {d: [(k, x.strip(BLANKS)) for k, x in enumerate((d[1] or "").split("\n")) if x.strip(BLANKS)] for d in docs}
    seen, gone = {}, {d: set() for d in docs}
    for d in docs:
        for a in range(len(lines[d])):
            for b in range(a, len(lines[d])):
                part = tuple(x for _, x in lines[d][a : b + 1])
                if sum(len(x.split()) for x in part) >= least and seen.setdefault(part, (d, a)) != (d, a):
                    gone[d].update(k for k, _ in lines[d][a : b + 1])
    cut = lambda d: "\n".join(x for k, x in enumerate(d[1].split("\n")) if k not in gone[d]) if d[1] else d[1]
    return {d: (cut(d), len(gone[d])) for d in docs}


def test_same_as_comparing_all_stretches(spark):
    draw = random.Random(5)
    lines = ["a b c", "d e f g", "  h i j", "k", "l m n o p", "", "  ", "q r", "s t u v w x"]
    rows = [(i, "\n".join(draw.choice(lines) for _ in range(draw.randint(0, 14)))) for i in range(80)]
    rows += [(None, "a b c\nd e f g\nk"), (7_000, None), (8_000, ""), (9_000, rows[3][1]), (9_000, rows[3][1])]
    for least in (4, 6, 11):
        got = q.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), min_words=least).collect()
        want = brute(rows, least)
        assert Counter((r["doc_id"], r["text"], r["n_removed_lines"]) for r in got) == Counter((i, *want[i, t]) for i, t in rows)


def test_windows_hold_just_enough_words():
    import numpy as np

    words, rows = np.array([3, 60, 10, 20, 30, 5, 5]), np.array([0, 0, 0, 0, 0, 1, 1])
    first, last = q._windows(words, rows, 50)
    assert {*zip(first.tolist(), last.tolist())} == {(0, 1), (1, 1), (2, 4), (1, 2), (1, 3), (3, 4)}


def test_odd_rows_and_columns(spark):
    out = q.without_repeats(odd_docs(spark, "c0", "n_lines", "spans", "n_chars"), size_col="n_chars")
    assert out.columns == ["doc_id", "text", "c0", "n_lines", "spans", "n_chars"]
    rows = out.collect()
    assert len(rows) == 7 and {r["spans"] for r in rows} == {"clash"}
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in odd_docs(spark).collect())
    assert q.line_dedup(empty_docs(spark)).count() == 0


def test_passage_in_many_texts_stays_once(spark):
    passage = " ".join(f"p{i}" for i in range(30)) + "\n" + " ".join(f"r{i}" for i in range(25))
    rows = [(i, f"own{i} line\n{passage}\nother{i}") for i in range(40)]
    got = q.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_removed_lines"] for r in got} == {i: 2 * (i > 0) for i in range(40)}
