"""Golden rows and brute-force checks of the text functions."""

import random
import unicodedata
from functools import reduce

import pytest
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.config import CommentConfig, TicketConfig
from voxtable.functions import features as fx
from voxtable.functions import phones as ph
from voxtable.functions import text as tx
from voxtable.functions import values as vx
from voxtable.functions.binding import rewrite_matches
from voxtable.operators import cleaning
from voxtable.regexes import java


def apply(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.o for r in df.select("i", fn(F.col("x")).alias("o")).orderBy("i").collect()]


TICKETS = {
    "pon stable ... 0559233222": "pon stable ... <PHONE>",
    "nc 0661224207 // ns2507310000009820": "nc <PHONE> ns <NUM>",
    "NC:0655462945 / refuse la pause": "nc <PHONE> refuse la pause",
    "NC:0655/462/945": "nc <PHONE>",
    "   ": "unk",
    None: "unk",
    "ns2507310000009820 ok": "ns<NUM> ok",
    "0559233222 0661224207": "<NUM> <NUM>",
    "Débit 12,5 Mbps + 100 mbps / 2 mo": "debit 12,5 mbps + 100 mbps 2 mo",
    "213559233222": "<PHONE>",
    "+213 559 23 32 22": "<PHONE>",
    "05 59 23 32 22 7": "05 59 23 32 22 7",
}


def test_ticket_text(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(TICKETS)], "i int, service_content string")
    out = cleaning.clean_ticket_text(df, TicketConfig()).orderBy("i").collect()
    assert [r.service_content for r in out] == list(TICKETS.values())


@pytest.mark.parametrize("compat, expected", [
    (False, ["see <URL>", "see <URL>", "mail <EMAIL>"]),
    (True, ["see https: ex.com a b", "see <url> a", "mail john <email>"]),
])
def test_comment_stage_order(spark, compat, expected):
    rows = ["see https://ex.com/a_b", "see www.ex.com/a", "mail john_doe@ex.com"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, comment string")
    out = cleaning.clean_comment_text(df, CommentConfig(), compat=compat).orderBy("i").collect()
    assert [r.comment for r in out] == expected


def test_phone_split_by_separators_is_masked(spark):
    df = spark.createDataFrame([("tel 0655/462/945 ou 0559233222/0661224207",)], "comment string")
    assert cleaning.clean_comment_text(df, CommentConfig()).first()[0] == "tel <PHONE> ou <PHONE> <PHONE>"


def test_comment_pieces(spark):
    assert apply(spark, ["sloooow"], tx.reduce_elongations) == ["sloow"]
    assert apply(spark, ["لfibre"], tx.split_scripts) == ["ل fibre"]
    assert apply(spark, ["!!!!"], tx.squash_punctuation) == ["!"]
    assert apply(spark, ["أإآ", "ى", "plain"], tx.normalize_arabic) == ["ااا", "ي", "plain"]
    assert apply(spark, ["5+123456789", "x +0559233222."], tx.mask_phones) == ["5+123456789", "x <PHONE>."]


def test_phone_predicate(spark):
    yes = ["0559233222", "055923322", "559233222", "21355923322", "0021355923322"]
    no = ["2131234", "0021312345", "159233222", ""]
    assert apply(spark, yes + no, ph.is_phone) == [True] * len(yes) + [False] * len(no)


def test_values(spark):
    assert apply(spark, ["ACTEL Boumerdes (22)", "ACTEL Imama (J9)", "ACTEL", None], vx.trailing_code) == ["22", "J9", None, None]
    assert apply(spark, ["FacebookFacebook", " Idoom Market ", None, "??"], vx.clean_platform) == ["facebook", "idoom_market", "UNK", "UNK"]
    assert apply(spark, ["3", "3.0", "3.5", "x", None], vx.to_long) == [3, 3, None, None, None]


def test_unicode_forms_every_character(spark):
    points = [chr(p) for p in [*range(1, 0xD800, 7), *range(0xE000, 0x20000, 7), *range(0x80, 0x700)]]
    rng = random.Random(3)
    rows = ["x" + c + "y" for c in points] + ["".join(rng.choices(points, k=8)) for _ in range(2000)]
    rows += ["é", "ㄱㅏ", "각 ﻻ ½ﬁ", "َّ"]
    bare = ["".join(c for c in unicodedata.normalize("NFKD", r) if not unicodedata.combining(c)) for r in rows]
    assert apply(spark, rows, tx.strip_accents) == bare
    assert apply(spark, rows, tx.nfkc) == [unicodedata.normalize("NFKC", r) for r in rows]


def test_flags_in_any_script(spark):
    def names(rows):
        return [r.split() for r in apply(spark, rows, lambda c: F.array_join(fx.intent_flags(c), " "))]

    assert names(["👏", "PROMO", "العروض", "époné promotion", "FİBRE ftth"]) == [["[PRAISE]"], ["[PRICES]"], ["[PRICES]"], [], ["[FIBRE]"]]


def test_number_extraction(spark):
    df = spark.createDataFrame([("debit 12,5 mbps + 100 mbps 2 mo",), ("none",)], "x string")
    cols = ["mbps_value_count", "mbps_value_max", "mo_value_count", "mo_value_max"]
    made = fx.ticket_text_features(F.col("x"))
    assert [tuple(r) for r in df.select(*[made[c].alias(c) for c in cols]).collect()] == [(2, 100, 1, 2), (0, 0, 0, 0)]


def test_cleaning_is_stable_and_leaves_no_phone(spark):
    rows = ["Appelez le 0559 23 32 22 svp", "A D S L chez idoom fibre 0661224207", "فضاء الزبون 021 55 92 33 22"]
    df = spark.createDataFrame([(r,) for r in rows], "comment string")
    once = cleaning.clean_comment_text(df, CommentConfig())
    assert cleaning.phone_leaks(once, "comment").count() == 0
    twice = cleaning.clean_comment_text(once, CommentConfig())
    assert sorted(r[0] for r in twice.collect()) == sorted(r[0] for r in once.collect())
    with pytest.raises(cleaning.LeakError):
        cleaning.require_no_phone(df.withColumn("id", F.lit(1)), "id", "comment")
    with pytest.raises(Exception, match="phone number left"):
        cleaning.gate_no_phone(df, "comment").collect()


def test_nfkc_is_one_pass_over_every_text(spark):
    """No text is taken apart in the JVM; marks that compose over a step's edge and nulls come out as the library has them."""
    import unicodedata

    rows = ["½ﬁ²x", "ẹ́ 각", "ﷺ", "", None, "a" * 5000 + "́"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").select(tx.nfkc(F.col("x")).alias("y"))
    assert [r["y"] for r in df.collect()] == [r if r is None else unicodedata.normalize("NFKC", r) for r in rows]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan and "regexp_replace" not in plan


def test_matches_are_rewritten_alone(spark):
    """One pass marks the matches; a text that holds the mark takes the longer way with the same result."""
    rows = ["a1b22c", "\x011\x01 22", "", "none", None]
    rewritten = apply(spark, rows, lambda c: rewrite_matches(c, r"[0-9]+", lambda m: F.concat(F.lit("<"), m, F.lit(">"))))
    assert rewritten == ["a<1>b<22>c", "\x01<1>\x01 <22>", "", "none", None]


def test_spelling_rules_pass_over_a_text_once(spark):
    """All Latin rules share one pattern; the rules themselves read its matches."""
    rows = ["Idoom  fibre optique", "a d s l 4\u00a0G", "mb/s Wi Fi 6 modeme", "xfibre fiber optic\u0301", "فيبر fiber"]
    step_by_step = lambda c: reduce(lambda t, r: F.regexp_replace(t, java(r[0], ignore_case=True), r[1]), lx.TELECOM_SPELLINGS, c)
    assert apply(spark, rows, tx.canonicalize_telecom) == apply(spark, rows, step_by_step)
    assert tx._TOKENS["wifi6"] == "wifi6"


def test_keywords_are_looked_for_at_their_places(spark):
    """Places hold a few words of a long text, and the flags are those of the whole text."""
    rows = ["word " * 200 + "los  rouge word, pon stable", "xpon los-rouge", "los\nallumée 100 12", "الفيبر modem", "mot de passe", ""]
    specs = [(p, p) for p in dict.fromkeys(p for _, p in (*lx.TICKET_KEYWORDS, *lx.COMMENT_KEYWORDS))]
    places = apply(spark, rows, lambda c: fx.keyword_places(c, [p for _, p in specs]))
    assert len(places[0]) < 60 and places[3] == rows[3] and places[5] == ""
    flags = lambda c: F.to_json(F.array(*fx.keyword_flags(c, specs).values()))
    whole = lambda c: F.to_json(F.array(*[fx.flag(fx.spotted(c, p)) for _, p in specs]))
    assert apply(spark, rows, flags) == apply(spark, rows, whole)


def test_words_are_counted_without_listing_them(spark):
    assert apply(spark, ["", "  ", " a  b\u00a0c ", "é 😂😂 x\n", None], fx.word_count) == [0, 0, 3, 3, None]
