import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from helpers import LONG, empty_docs, odd_docs
from voxtable.llm import alignment as q

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    "a", " ", "  two  blanks ", "x<s> </s><|endoftext|>y", "日本語テキスト 😀😀👩‍👩‍👧 é̂", "a▁b stays without tokens", "\n\n\t tabs\r\n", "aaaa" * 600, "ab" * 500 + "!?" * 300,
    "don't we'll 1234567 ½", "ñandú über Straße", "\x00 nul", "=" * 900,
]


def token_bytes():
    letters = q._alphabet()
    a = {i: bytes(letters[c] for c in t) for t, i in Tokenizer.from_file(A).get_vocab(with_added_tokens=False).items() if all(c in letters for c in t)}
    sp = SentencePieceProcessor(model_file=B)
    b = {i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in range(sp.get_piece_size())}
    return a, b


def plain(rows):
    """The contract word for word, one token at a time."""
    library, sp = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    library.encode_special_tokens = True
    in_a, in_b = token_bytes()
    docs, held = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            a, b = library.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            if b"".join(in_a[i] for i in a) == (" " + text).encode() == b"".join(in_b[i] for i in b):
                ends = [set(np.cumsum([len(t[i]) for i in ids]).tolist()) for t, ids in ((in_a, a), (in_b, b))]
                both = sorted(ends[0] & ends[1])
                parts = [[[] for _ in both], [[] for _ in both]]
                for side, (t, ids) in enumerate(((in_a, a), (in_b, b))):
                    at, g = 0, 0
                    for i in ids:
                        at += len(t[i])
                        parts[side][g].append(i)
                        g += at == both[g]
                groups = list(zip(*parts))
        docs.append(groups)
        held.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    most = {}
    for (x, _), n in held.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), groups in zip(rows, docs):
        links = [(x, y) for ga, gb in groups for x in ga for y in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((
            i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(held[p] == most[p[0]] for p in links),
            sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else "",
        ))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(8)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    made = ["".join(draw.choice(" \n\t'’aeost1!é日́ relvmdthin.,") for _ in range(60)) for _ in range(80)]
    return docs + [(10_000 + i, t) for i, t in enumerate(HARD + made)] + [(1, None), (2, ""), (None, "no id"), (7, "twice twice"), (7, "twice twice"), (5, LONG[:20_000])]


def sort(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("sent", [q.PAIRS_SENT, 0])
def test_same_as_token_by_token(spark, rows, sent, monkeypatch):
    monkeypatch.setattr(q, "PAIRS_HELD", 2_000)
    monkeypatch.setattr(q, "BLOCK_BYTES", 200_000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sort([tuple(r) for r in q.aligned(df, A, B, pairs_sent=sent).collect()]) == sort(plain(rows))


def test_groups_tile_the_text(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    once = Counter(i for i, _ in rows)
    want, texts = {r[0]: r for r in plain(rows) if once[r[0]] == 1}, dict(rows)
    for r in q.groups(df, A, B).collect():
        if r["doc_id"] in want:
            got = r["groups"]
            assert len(got) == want[r["doc_id"]][3]
            ends = [g["end"] for g in got]
            assert [g["start"] for g in got] == [0, *ends][: len(got)]
            assert not got or ends[-1] == len((" " + texts[r["doc_id"]]).encode())
            text = ";".join(",".join(map(str, g["a"])) + "|" + ",".join(map(str, g["b"])) for g in got)
            assert not got or hashlib.sha256(text.encode()).hexdigest() == want[r["doc_id"]][7]


def test_faster_library_gives_the_ids_of_the_file(rows):
    library = Tokenizer.from_file(A)
    library.encode_special_tokens = True
    own = q.ByteLevel(A)
    texts = [t for _, t in rows if t] + [f" a{chr(c)}b {chr(c)} 1{chr(c)} !{chr(c)}" for c in [*range(1, 0xD800, 13), *range(0xE000, 0x30000, 57)]]
    assert own.encode(texts) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_odd_rows(spark):
    odd = odd_docs(spark, "n_a", "block", "a")
    got = q.aligned(odd, A, B)
    assert got.columns == q._RESULT and got.count() == odd.count()
    assert {(r["doc_id"], r["n_links"], r["groups_sha256"]) for r in got.filter("doc_id in (1, 2)").collect()} == {(1, 0, ""), (2, 0, "")}
    for sent in (q.PAIRS_SENT, 0):
        assert q.aligned(empty_docs(spark), A, B, pairs_sent=sent).count() == 0
        assert q.aligned(odd.filter("doc_id < 3"), A, B, pairs_sent=sent).count() == 2
    assert q.groups(empty_docs(spark), A, B).count() == 0
