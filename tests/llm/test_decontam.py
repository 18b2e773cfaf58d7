import random
import re
from collections import Counter

from helpers import empty_docs, odd_docs
from voxtable.llm import decontam as q

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    index = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            index.setdefault(tuple(w[k : k + 13]), set()).add(i)
    sizes = {len(x) for x in index}
    out = []
    for d, t in docs:
        w, hit, met = words(t), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := index.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    met |= found
        out.append((d, len(w), len(hit), tuple(sorted(str(x) for x in met if x is not None)), bool(hit) and 20 * len(hit) >= len(w)))
    return Counter(out)


def sample(seed):
    draw = random.Random(seed)
    line = lambda n, v: " ".join(f"w{draw.randrange(v)}" for _ in range(n))
    items = [(i, line(draw.choice((1, 2, 4, 7, 12, 13, 14, 30)), 300)) for i in range(25)] + [(50, ""), (51, None), (52, "!!"), (53, "Über straße"), (None, line(15, 300))]
    items += [(60, items[3][1]), (61, "a " * 40)]
    docs = []
    for i in range(120):
        text = line(draw.randrange(80), 300)
        for _ in range(draw.randrange(3)):
            source = draw.choice(items)[1] or ""
            own = source.split()
            low = draw.randrange(len(own) + 1)
            text += "; " + ", ".join(own[low : low + draw.randrange(40)]).upper() + ". " + line(draw.randrange(20), 300)
        docs.append((i, text))
    return docs + [(200, None), (201, ""), (202, "a " * 30), (203, "x über  STRASSE ÜBER straße"), (None, items[7][1] or "")], items


def test_same_as_comparing_all_windows(spark, monkeypatch):
    for seed in (1, 2):
        docs, items = sample(seed)
        for few in (q.FILTER_ROWS, 0):  # with and without the bit map
            monkeypatch.setattr(q, "FILTER_ROWS", few)
            got = q.overlaps(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string")).collect()
            assert Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"]) for r in got) == brute(docs, items)


def test_odd_rows_and_columns(spark):
    items = spark.createDataFrame([(1, "plain words stand here"), (2, None)], "item_id long, text string")
    out = q.clean(odd_docs(spark, "row", "n_words", "c0", "found"), items)
    assert out.columns == ["doc_id", "text", "row", "n_words", "c0", "found"]
    assert Counter(r["doc_id"] for r in out.collect()) == Counter([1, 2, 3, None, 5])
    assert q.overlaps(empty_docs(spark), items).count() == 0
    assert q.overlaps(odd_docs(spark, "row", "hit"), items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
