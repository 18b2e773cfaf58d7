import random

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helpers import empty_docs, odd_docs
from voxtable.llm import pieces, token_counts as q

BPE, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "don't we'll they're 's 'l x'r  \n\n a\tb \n c   ", "'' '' 're're !'s 'S a'ſ", "\x85a　  b \x1c\x1d x\x1fy \x0b\x0c", "aaaa" * 50 + " " * 40 + "!!!!" * 30,
    "日本語テキスト 한국어 русский 😀😀👩‍👩‍👧 é̂", "<|endoftext|> a <|endoftext|><|endoftext|>  b <|endof", "a <|endoftext|>", "1234567 ½ ²³ x1y2_z", "   ", "\n", " \n \t x", "", "a\x00b", "▁x ▁▁ y",
]


def texts(seed, n):
    draw = random.Random(seed)
    return ODD + ["".join(draw.choice(" \n\t'’aeost1!é日́ relvmdthin▁,.") for _ in range(50)) for _ in range(n)]


def test_counts_of_every_prefix():
    library, own = Tokenizer.from_file(BPE), q.PrefixCounter(BPE)
    for text in texts(3, 150):
        counts = own.counts(text)
        assert len(counts) == len(text)
        for i in range(1, len(text) + 1):
            assert counts[i - 1] == len(library.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").union(odd_docs(spark))
    library = Tokenizer.from_file(BPE)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    got = q.token_counts(docs, BPE).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in got)
    assert q.token_counts(empty_docs(spark), BPE).count() == 0


def test_budgets_without_encoding_again(spark):
    library = Tokenizer.from_file(BPE)
    rows = [(i, t) for i, t in enumerate(texts(4, 20))]
    df = q.prefix_counts(spark.createDataFrame(rows, "doc_id long, text string"), BPE)
    got = df.select("doc_id", q.chars_within(F.col("counts"), F.lit(7)).alias("n"), q.tokens_of_prefix(F.col("counts"), F.lit(9)).alias("t")).collect()
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for r in got:
        text = rows[r["doc_id"]][1]
        assert r["n"] == max([0, *(i for i in range(1, len(text) + 1) if size(text[:i]) <= 7)])
        assert r["t"] == size(text[:9])


def test_pieces_are_those_of_the_library(spark):
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), pieces.PieceCoder.load(MODEL)
    docs = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    for text in texts(6, 300) + docs:
        ids = own.encode(text).tolist()
        assert ids == library.encode(text) and own.decode(ids) == library.decode(ids)
        assert own.decode(ids) == text.replace("▁", " ")


def test_unigram_search_is_the_best_of_all_splits():
    draw = random.Random(2)
    vocabulary = ["<unk>", "▁"] + sorted({"".join(draw.choice("ab▁") for _ in range(draw.randint(1, 4))) for _ in range(25)})
    vocabulary = list(dict.fromkeys(vocabulary))
    scores = [0.0] + [-draw.uniform(1, 6) for _ in vocabulary[1:]]
    own = pieces.PieceCoder(vocabulary, scores, [False] + [True] * (len(vocabulary) - 1), 0, merges=False)
    lone = min(scores[1:]) - pieces.UNKNOWN_PENALTY

    def best(text):
        score = [0.0] + [-1e9] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                part = text[start:end]
                gain = scores[vocabulary.index(part)] if part in vocabulary[1:] else lone if end - start == 1 else -1e9
                score[end] = max(score[end], score[start] + gain)
        return score[-1]

    for _ in range(200):
        text = "".join(draw.choice("ab c") for _ in range(draw.randint(1, 12)))
        ids = own.encode(text).tolist()
        if 0 not in ids:
            assert abs(sum(scores[i] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-9
            assert own.decode(ids) == text


def test_encoding_tables(spark):
    docs = odd_docs(spark, "ids")
    coded = pieces.encode(docs, MODEL)
    assert coded.filter("not round_trip").count() == 0 and coded.filter("doc_id in (1, 2) and n_ids > 0").count() == 0
    back = {(r["doc_id"], r["text"]) for r in pieces.decode(coded, MODEL).collect()}
    assert back == {(r["doc_id"], r["text"] or "") for r in docs.collect()}
    assert pieces.encode(empty_docs(spark), MODEL).count() == 0
    assert np.array_equal(pieces.PieceCoder.load(MODEL).encode(""), [])


def test_long_units_are_not_remembered_and_pairs_equal_the_plain_walk():
    """Memory follows short units alone, and merge tables answer as the general walk over merges does."""
    from voxtable.llm.merges import Neighbours

    library, own = Tokenizer.from_file(BPE), q.PrefixCounter(BPE)
    for text in ("x" * 5000, "日本" * 3000 + " a", "9" * 4000, "a" * q.UNIT_CHARS + " " + "b" * (q.UNIT_CHARS + 1)):
        assert own.counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)
    assert len(own.units) and max(map(len, own.units)) <= q.UNIT_CHARS
    draw, pairs = random.Random(5), own.fits
    walk = Neighbours(lambda a, b: pairs.joined.get(a << 24 | b), pairs.halves.__getitem__)
    keys = [draw.randrange(len(pairs.halves)) << 24 | draw.randrange(len(pairs.halves)) for _ in range(20_000)] + list(pairs.joined) + list(pairs.memo)
    assert all(pairs.memo[k] == walk.memo[k] for k in keys)
