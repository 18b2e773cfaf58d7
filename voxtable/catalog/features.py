"""Queries over feature columns, category operators and classifier text."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.catalog.cleaning import _PARSED as PARSED
from voxtable.catalog.cleaning import _WHEN as WHEN
from voxtable.catalog.cleaning import _cat_sql as category_sql
from voxtable.catalog.cleaning import docs
from voxtable.catalog.registry import NOISY, ORACLES, PLATFORM, gsub, has, query, table
from voxtable.config import CommentConfig, TicketConfig
from voxtable.functions import features as fx
from voxtable.operators import categories as cat
from voxtable.operators import features as ft


def _floats(d: dict) -> list:
    """Features are single precision; compared as doubles of that precision."""
    return [c.cast("double").alias(n) for n, c in d.items()]


def f32(expr: str, name: str) -> str:
    return f"cast(cast({expr} as float) as double) as {name}"


_TIME_PARTS = {
    "handle_year": "year(t)", "handle_month": "month(t)", "handle_day": "day(t)", "handle_dayofyear": "dayofyear(t)",
    "handle_dayofweek": "isodow(t) - 1", "handle_hour": "hour(t)", "handle_minute": "minute(t)", "handle_iso_week": "week(t)",
    "handle_time_ordinal": "date_diff('day', date '1970-01-01', cast(t as date)) + (hour(t) * 3600 + minute(t) * 60 + (microsecond(t) / 1000000.0)) / 86400.0",
    "handle_is_weekend": "case when isodow(t) >= 6 then 1 else 0 end",
}
_TIME_SQL = ", ".join(f32(f"coalesce({e}, -1)" if n != "handle_is_weekend" else f"case when t is null then -1 else {e} end", n) for n, e in _TIME_PARTS.items())
_MAYBE = "case when event_id % 19 = 0 then null else ts end"


@query("f1_time_features", f"select event_id, {_TIME_SQL}, {f32('case when t is null then 1 else 0 end', 'handle_time_missing')} from (select event_id, {_MAYBE} as t from events)")
def time_features(spark, d):
    df = table(spark, d, "events").select("event_id", F.expr(_MAYBE).alias("t"))
    return df.select("event_id", *_floats(fx.time_features(F.col("t"))))


@query("f2_text_counts", f"select doc_id, cast(length(x) as bigint) as chars, cast(len(regexp_extract_all(x, '\\S+')) as bigint) as words, cast(len(regexp_extract_all(x, '[0-9]')) as bigint) as digits from (select doc_id, {NOISY} as x from documents)")
def text_counts(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(NOISY).alias("x"))
    x = F.col("x")
    return df.select(
        "doc_id", F.char_length(x).cast("long").alias("chars"), fx.word_count(x).cast("long").alias("words"), fx.digit_count(x).cast("long").alias("digits")
    )


@query("f3_punctuation", "select doc_id, cast(len(regexp_extract_all(x, '[!?.,،؛؟]')) as bigint) as punct from (select doc_id, concat(text, '؟!،') as x from documents)")
def punctuation(spark, d):
    return docs(spark, d).select("doc_id", fx.punct_count(F.concat("text", F.lit("؟!،"))).cast("long").alias("punct"))


_TOKENS = "concat(text, case when doc_id % 2 = 0 then ' <NUM>' else ' <URL> <EMAIL>' end, case when doc_id % 3 = 0 then ' <PHONE> <ID>' else '' end)"


@query(
    "f4_placeholder_flags",
    "select doc_id, " + ", ".join(f32(f"case when contains(x, '<{t}>') then 1 else 0 end", f"has_{t.lower()}_token") for t in ("NUM", "PHONE", "URL", "EMAIL", "ID"))
    + f" from (select doc_id, {_TOKENS} as x from documents)",
)
def placeholder_flags(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(_TOKENS).alias("x"))
    ticket, comment = fx.ticket_text_features(F.col("x"), ()), fx.comment_text_features(F.col("x"), CommentConfig(), ())
    both = {n: ticket[n] for n in ("has_num_token", "has_phone_token")} | {n: comment[n] for n in ("has_url_token", "has_email_token", "has_id_token")}
    return df.select("doc_id", *_floats(both))


# One of the listed words in every text, so that every flag is sometimes on.
_TICKET_WORDS = ("pon stable", "LOS rouge", "los  allumé", "los eteinte", "pon instable", "pon clignotant", "chute de debit", "12 mbps download", "upload imei gps", "adsl ftth fttx", "4G ont modem", "xpon losx époné")
_TICKET_TEXT = "concat(text, ' ', case doc_id % 12 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_TICKET_WORDS)) + " end)"
_COMMENT_WORDS = ("idoom_fibre", "VDSL", "4g", "modem", "mot de passe", "ping", "débit debit", "gbps", "promo", "ne marche  pas", "1500", "فيبر", "انقطاع walou", "فضاء الزبون", "العروض 12", "bravo 😂", "quand depuis", "wilaya", "antenne 5g", "merci lol")
COMMENT_TEXT = "concat(text, ' ', case doc_id % 20 " + " ".join(f"when {i} then '{w}'" for i, w in enumerate(_COMMENT_WORDS)) + " end)"


@query(
    "f5_ticket_keywords",
    "select doc_id, " + ", ".join(f32(f"case when {has('x', p)} then 1 else 0 end", n) for n, p in lx.TICKET_KEYWORDS) + f" from (select doc_id, {_TICKET_TEXT} as x from documents)",
)
def ticket_keywords(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(_TICKET_TEXT).alias("x"))
    return df.select("doc_id", *_floats(fx.keyword_flags(F.col("x"), lx.TICKET_KEYWORDS)))


_COMMENT_FLAGS = ", ".join(f32(f"case when {has('x', p)} then 1 else 0 end", n) for n, p in lx.COMMENT_KEYWORDS)


@query(
    "f6_comment_keywords",
    "select *, " + f32("least(" + " + ".join(n for n, _ in lx.COMMENT_KEYWORDS) + ", 100)", "n_tech_flags") + f" from (select doc_id, {_COMMENT_FLAGS} from (select doc_id, {COMMENT_TEXT} as x from documents))",
)
def comment_keywords(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(COMMENT_TEXT).alias("x"))
    flags = df.select("doc_id", *[c.alias(n) for n, c in fx.keyword_flags(F.col("x"), lx.COMMENT_KEYWORDS).items()])
    names = [n for n, _ in lx.COMMENT_KEYWORDS]
    return flags.select("doc_id", *_floats({n: F.col(n) for n in names}), fx.flag_total(names).cast("double").alias("n_tech_flags"))


_SPEEDS = "concat(text, ' ', cast(doc_id % 100 as string), ',5 mbps + 100mbps ', cast(doc_id % 64 as string), '.25  mbps x7mbps ', cast(doc_id % 9 as string), ' mo 12345 mo ', cast(doc_id % 777 as string), 'mo')"


@query(
    "f7_extracted_numbers",
    "select doc_id, " + ", ".join([
        f32("len(a)", "mbps_value_count"), f32("coalesce(list_max(list_transform(a, lambda v: try_cast(replace(v, ',', '.') as double))), 0)", "mbps_value_max"),
        f32("len(b)", "mo_value_count"), f32("coalesce(list_max(list_transform(b, lambda v: try_cast(v as double))), 0)", "mo_value_max"),
    ]) + r" from (select doc_id, regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([0-9]+(?:[.,][0-9]+)?)\s*mbps(?:$|[^\p{L}\p{N}_])', 1) as a,"
    + r" regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_])([0-9]{1,4})\s*mo(?:$|[^\p{L}\p{N}_])', 1) as b from (select doc_id, replace(" + _SPEEDS + ", ' ', '  ') as x from documents))",
)
def extracted_numbers(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(f"replace({_SPEEDS}, ' ', '  ')").alias("x"))
    made = fx.ticket_text_features(F.col("x"), ())
    return df.select("doc_id", *_floats({n: made[n] for n in ("mbps_value_count", "mbps_value_max", "mo_value_count", "mo_value_max")}))


_LEVEL = "case when o_orderpriority = '4-NOT SPECIFIED' then 'UNK' else o_orderpriority end"


@query("f8_missing_indicator", f"select o_orderkey, {f32(f'case when {_LEVEL} = $$UNK$$ then 1 else 0 end', 'subs_level_missing')} from orders")
def missing_indicator(spark, d):
    return table(spark, d, "orders").select("o_orderkey", fx.unknown_flag(F.expr(_LEVEL)).cast("double").alias("subs_level_missing"))


def _ticket_frame(spark, d, where: str | None = None):
    """Documents as cleaned tickets: time and level come from the document id."""
    df = docs(spark, d).select(
        F.col("doc_id").alias("id"), F.expr("case lang when 'en' then 0 when 'fr' then 1 else 2 end").alias("class_int"),
        F.expr("timestamp_ntz'2025-01-01 06:30:00' + make_interval(0, 0, 0, cast(doc_id % 300 as int))").alias("handle_time"),
        F.lower(F.expr(_TICKET_TEXT)).alias("service_content"), F.expr("case when doc_id % 9 = 0 then 'UNK' else 'postpaid' end").alias("subs_level"),
        F.col("source").alias("dot"),
    )
    return df if where is None else df.filter(where)


_T = "timestamp '2025-01-01 06:30:00' + to_days(cast(doc_id % 300 as integer))"
_TICKET_NUMBERS = {
    **{n: (f"coalesce({e}, -1)" if n != "handle_is_weekend" else e) for n, e in _TIME_PARTS.items()},
    "handle_time_missing": "0", "text_len": "length(x)", "word_count": r"len(regexp_extract_all(x, '\S+'))", "digit_count": "len(regexp_extract_all(x, '[0-9]'))",
    "has_num_token": "case when contains(x, '<NUM>') then 1 else 0 end", "has_phone_token": "case when contains(x, '<PHONE>') then 1 else 0 end",
    **{n: f"case when {has('x', p)} then 1 else 0 end" for n, p in lx.TICKET_KEYWORDS}, "subs_level_missing": "case when doc_id % 9 = 0 then 1 else 0 end",
}
_TICKET_ROWS = f"(select *, {_T} as t, lower({_TICKET_TEXT}) as x from documents)"


@query("f9_ticket_features", "select doc_id as id, " + ", ".join(f32(e, n) for n, e in _TICKET_NUMBERS.items()) + f" from {_TICKET_ROWS}")
def ticket_features(spark, d):
    made = ft.ticket_features(_ticket_frame(spark, d), TicketConfig())
    return made.select("id", *_floats({n: F.col(n) for n in _TICKET_NUMBERS}))


_COMMENT_NUMBERS = {
    "len_chars": "length(x)", "len_tokens": r"len(regexp_extract_all(x, '\S+'))", "digit_count": "len(regexp_extract_all(x, '[0-9]'))",
    "punct_count": "len(regexp_extract_all(x, '[!?.,،؛؟]'))", **{f"has_{t}_token": f"case when contains(x, '<{t.upper()}>') then 1 else 0 end" for t in ("phone", "url", "email", "id")},
}


@query(
    "f9_comment_features",
    "select *, " + f32("least(" + " + ".join(n for n, _ in lx.COMMENT_KEYWORDS) + ", 100)", "n_tech_flags")
    + f" from (select doc_id, {', '.join(f32(e, n) for n, e in _COMMENT_NUMBERS.items())}, {_COMMENT_FLAGS} from (select doc_id, {COMMENT_TEXT} as x from documents))",
)
def comment_features(spark, d):
    cfg = CommentConfig(id_col="doc_id")
    made = ft.comment_features(docs(spark, d).select("doc_id", F.expr(COMMENT_TEXT).alias("comment")), cfg)
    return made.select("doc_id", *_floats({n: F.col(n) for n in ft.comment_spec(cfg).num_cols}))


_SPEC = ft.FeatureSpec("id", "class_int", "service_content", ("subs_level", "dot", "actel"), ("text_len", "handle_month", "absent_number"), "handle_time")


@query(
    "f10_apply_spec",
    f"select doc_id as id, case when doc_id % 9 = 0 then 'UNK' else 'postpaid' end as subs_level, source as dot, 'UNK' as actel, x as service_content,"
    f" {f32('length(x)', 'text_len')}, {f32('month(t)', 'handle_month')}, cast(null as double) as absent_number from {_TICKET_ROWS}",
)
def apply_spec(spark, d):
    made = ft.ticket_features(_ticket_frame(spark, d), TicketConfig())
    out = ft.apply_spec(made, _SPEC, strict=False, keep=("id",))
    return out.withColumns({n: F.col(n).cast("double") for n in _SPEC.num_cols})


@query(
    "f11_aligned_features",
    f"select case when doc_id % 5 = 0 then 'test' else 'train' end as split, doc_id as id, case when doc_id % 5 = 0 then null else cast(case lang when 'en' then 0 when 'fr' then 1 else 2 end as double) end as class_int,"
    f" source as dot, x as service_content, {f32('length(x)', 'text_len')} from {_TICKET_ROWS}",
)
def aligned_features(spark, d):
    made = ft.ticket_features(_ticket_frame(spark, d), TicketConfig())
    spec = ft.FeatureSpec("id", "class_int", "service_content", ("dot",), ("text_len",))
    train, test = ft.aligned_features(made.filter("id % 5 <> 0"), made.filter("id % 5 = 0").drop("class_int"), spec)
    both = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")), allowMissingColumns=True)
    return both.withColumn("text_len", F.col("text_len").cast("double"))


_PART_CODE = "case when p_partkey % 23 = 0 then null else concat(p_type, ' ', cast(p_size * (p_partkey % 4) as string)) end"
_PART_SQL = f"(select p_partkey, p_brand, {_PART_CODE} as code, p_partkey % 5 = 0 as is_test from part)"


def _parts(spark, d):
    df = table(spark, d, "part").select("p_partkey", "p_brand", F.expr(_PART_CODE).alias("code"))
    return df.filter("p_partkey % 5 <> 0"), df.filter("p_partkey % 5 = 0")


@query(
    "f12_rare_grouping",
    f"""with p as {_PART_SQL}, f as (select p_partkey, is_test, p_brand, coalesce(code, 'UNK') as code from p),
        kb as (select p_brand from f where not is_test group by 1 having count(*) >= 12), kc as (select code from f where not is_test group by 1 having count(*) >= 12)
        select p_partkey, case when p_brand in (select * from kb) or p_brand = 'UNK' then p_brand else 'RARE' end as p_brand,
        case when code in (select * from kc) or code = 'UNK' then code else 'RARE' end as code from f""",
)
def rare_grouping(spark, d):
    train, test = _parts(spark, d)
    rare = cat.RareGrouping.fit(train, ["p_brand", "code"], min_count=12)
    cols = ["p_partkey", "p_brand", "code"]
    return rare.transform(train).select(*cols).unionByName(rare.transform(test).select(*cols))


@query(
    "f12_rare_report",
    f"""with p as {_PART_SQL}, f as (select is_test, 'p_brand' as col, coalesce(p_brand, 'UNK') as v from p union all select is_test, 'code', coalesce(code, 'UNK') from p),
        k as (select col, v from f where not is_test group by 1, 2 having count(*) >= 12),
        g as (select f.*, case when k.v is not null or f.v = 'UNK' then f.v else 'RARE' end as s from f left join k on f.col = k.col and f.v = k.v)
        select col, count(distinct v) filter (where not is_test) as train_unique_before, count(distinct s) filter (where not is_test) as train_unique_after,
        count(*) filter (where not is_test and s = 'RARE') as n_rare_train, count(*) filter (where is_test and s = 'RARE') as n_rare_test from g group by col""",
)
def rare_report(spark, d):
    train, test = _parts(spark, d)
    return cat.RareGrouping.fit(train, ["p_brand", "code"], min_count=12).report(train, test)


_LEVELS = "case when o_orderkey % 6 = 0 then 'UNK' when o_orderstatus = 'F' and o_orderkey % 5 = 1 then 'prepaid' else 'postpaid' end"
_EVIDENCE = f"""with o as (select o_orderkey, case when o_orderkey % 6 = 0 and o_orderkey % 5 <> 1 then 'O' else o_orderstatus end as service_type, {_LEVELS} as subs_level from orders),
    e as (select service_type, count(*) filter (where subs_level <> 'UNK') as support, avg(case when subs_level = 'postpaid' then 1.0 else 0.0 end) filter (where subs_level <> 'UNK') as rate,
          count(*) filter (where subs_level = 'UNK') as missing from o group by 1),
    x as (select *, support >= 100 and rate >= 0.95 as ok from e),
    c as (select sum(missing) as m, sum(missing * coalesce(rate, 0)) / sum(missing) as expected, sum(case when ok then missing else 0 end) / sum(missing) as coverage, count(*) filter (where ok) as n from x)"""


def _levels(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", F.expr("case when o_orderkey % 6 = 0 and o_orderkey % 5 <> 1 then 'O' else o_orderstatus end").alias("service_type"), F.expr(_LEVELS).alias("subs_level"))
    return df, cat.EvidenceImputer.fit(df, "service_type", "subs_level")


@query(
    "f13_impute_levels",
    _EVIDENCE + """ select o_orderkey, service_type, case when subs_level = 'UNK' and ok and (select n > 0 and expected >= 0.95 from c) then 'postpaid' else subs_level end as subs_level,
        cast(case when subs_level = 'UNK' and not (ok and (select n > 0 and expected >= 0.95 from c)) then 1 else 0 end as double) as subs_level_missing from o join x using (service_type)""",
)
def impute_levels(spark, d):
    df, imputer = _levels(spark, d)
    out = imputer.transform(df, "subs_level_missing")
    return out.withColumn("subs_level_missing", F.col("subs_level_missing").cast("double"))


@query("f13_impute_decision", _EVIDENCE + " select cast(m as bigint) as missing_count, round(expected, 9)::double as expected_rate, round(coverage, 9)::double as coverage, n as n_eligible, n > 0 and expected >= 0.95 as impute from c")
def impute_decision(spark, d):
    row = _levels(spark, d)[1].decision()
    return row.withColumns({c: F.round(c, 9) for c in ("expected_rate", "coverage")})


@query("f14_encode_labels", "select event_id, cast(dense_rank() over (order by l) - 1 as integer) as label_id, l as label from (select event_id, user_id % 13 * 3 as l from events)")
def encode_labels(spark, d):
    df = table(spark, d, "events").select("event_id", (F.col("user_id") % 13 * 3).cast("string").alias("raw"))
    encoder = cat.LabelEncoder.fit(df, "raw")
    return encoder.decode(encoder.encode(df, "raw"), "label_id").select("event_id", "label_id", "label")


@query("f15_class_weights", "select lang, n, round(t / (k * n), 9)::double as balanced, round((t / n) / avg(t / n) over (), 9)::double as mean_one from (select lang, count(*) as n, sum(count(*)) over () as t, count(*) over () as k from documents group by lang)")
def class_weights(spark, d):
    a, b = cat.class_weights(docs(spark, d), "lang"), cat.class_weights(docs(spark, d), "lang", mean_one=True)
    return a.withColumnRenamed("weight", "balanced").join(b.select("lang", F.col("weight").alias("mean_one")), "lang").withColumns({c: F.round(c, 9) for c in ("balanced", "mean_one")})


@query("f15_row_weights", "select doc_id, round(t / (k * n), 9)::double as weight from documents join (select lang, count(*) as n, sum(count(*)) over () as t, count(*) over () as k from documents group by lang) using (lang)")
def row_weights(spark, d):
    return cat.with_class_weights(docs(spark, d), "lang").select("doc_id", F.round("weight", 9).alias("weight"))


@query("f16_platform_text", f"select doc_id, concat('platform=', lower(coalesce(p, 'unk')), ' ', text) as x from (select *, {PLATFORM} as p from documents)")
def platform_text(spark, d):
    return docs(spark, d).select("doc_id", fx.platform_prefixed(F.expr(PLATFORM), F.col("text")).alias("x"))


@query("f17_columns_text", f"select doc_id, concat('p:', coalesce(p, 'UNK'), ' | lang:', lang, ' || ', text) as x from (select *, {PLATFORM} as p from documents)")
def columns_text(spark, d):
    df = docs(spark, d).withColumn("p", F.expr(PLATFORM))
    return df.select("doc_id", fx.columns_prefixed(["p", "lang"], F.col("text")).alias("x"))


_FLAG_SQL = "concat_ws(' ', " + ", ".join(f"case when {has('x', p, i)} then '[{n}]' end" for n, p, i in lx.INTENT_FLAGS) + ")"


@query("f18_classifier_text", f"select doc_id, concat_ws(' ', concat('[PLATFORM] ', source), nullif({_FLAG_SQL}, ''), concat('[TEXT] ', x)) as out from (select doc_id, source, {COMMENT_TEXT} as x from documents)")
def classifier_text(spark, d):
    df = docs(spark, d).select("doc_id", "source", F.expr(COMMENT_TEXT).alias("x"))
    return df.select("doc_id", fx.classifier_text(F.col("source"), F.col("x"), add_flags=True).alias("out"))


@query("f18_allowed_tokens", f"select doc_id, concat_ws(' ', case when {has('x', lx.INTENT_FLAGS[0][1])} then '[FIBRE]' end, concat('[TEXT] ', x)) as out from (select doc_id, {COMMENT_TEXT} as x from documents)")
def allowed_tokens(spark, d):
    df = docs(spark, d).select("doc_id", "source", F.expr(COMMENT_TEXT).alias("x"))
    return df.select("doc_id", fx.classifier_text(F.col("source"), F.col("x"), add_flags=True, allowed={"[FIBRE]", "[TEXT]"}).alias("out"))


__all__ = ["COMMENT_TEXT", "gsub"]


# ---- whole cleaned tables: their parts have SQL of their own ----

ORACLES["c30_comment_table"] = (
    f"with c as ({ORACLES['c19_clean_comment']}), p as ({ORACLES['c21_clean_platform']}),"
    f" f as (select doc_id, comment, {', '.join(f32(e, n) for n, e in _COMMENT_NUMBERS.items())}, {_COMMENT_FLAGS} from (select *, comment as x from c))"
    " select doc_id as id, cast(case lang when 'en' then 1 when 'fr' then 2 when 'de' then 3 else 4 end as bigint) as label, platform, f.* exclude (doc_id), "
    + f32("least(" + " + ".join(n for n, _ in lx.COMMENT_KEYWORDS) + ", 100)", "n_tech_flags")
    + " from documents join p using (doc_id) join f using (doc_id)"
)

_RAW_TICKET = {
    "tt_status": "concat(upper(lang[1]), lang[2:])", "dept_initial": "upper(source)", "service_request_type": "'Réclamation'",
    "subs_level": "case when doc_id % 9 = 0 then null when doc_id % 29 = 0 then 'prepaid' else ' Postpaid ' end",
    "customer_level": "case when doc_id % 2 = 0 then 'Résidentiel' else 'Business' end", "dept_traitement": "concat(source, ' [used by system]')",
    "tech_comm": "'Tech'", "service_type": "case when doc_id % 3 = 0 then 'FTTH' else 'ADSL' end", "dot": "concat('DOT ', doc_id % 40)",
    "actel": "concat('ACTEL ', source, ' (J', doc_id % 25, ')')", "actel_code": "concat('J', doc_id % 25)",
}
_RAW_TICKET_RULES = {
    "dept_traitement": "coalesce(nullif(trim(regexp_replace({}, '\\s*\\[[^\\]]+\\]\\s*$', '')), ''), 'UNK')",
    "customer_level": "case when starts_with({0}, 'resid') then 'residential' else {0} end",
}
_TICKET_CATEGORIES = ", ".join(f"{_RAW_TICKET_RULES.get(n, '{}').format(category_sql(n))} as {n}" for n in _RAW_TICKET)
_EDGE = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
_TICKET_COUNTED = _TICKET_NUMBERS | {
    **{n: f"case when t is null then -1 else {e} end" for n, e in _TIME_PARTS.items()}, "handle_time_missing": "case when t is null then 1 else 0 end",
    "subs_level_missing": "case when subs_level = 'UNK' then 1 else 0 end",
    "mbps_value_count": "len(a)", "mbps_value_max": "coalesce(list_max(list_transform(a, lambda v: try_cast(replace(v, ',', '.') as double))), 0)",
    "mo_value_count": "len(b)", "mo_value_max": "coalesce(list_max(list_transform(b, lambda v: try_cast(v as double))), 0)",
}
ORACLES["c30_ticket_table"] = (
    f"with c as ({ORACLES['c20_clean_ticket_text']}), r as (select doc_id, {', '.join(f'{e} as {n}' for n, e in _RAW_TICKET.items())} from documents),"
    f" k as (select doc_id, {_TICKET_CATEGORIES} from r),"
    f" w as (select doc_id, {WHEN.replace('event_id', 'doc_id').replace('event_type', 'lang')} as x from documents), t as (select doc_id, {PARSED} as t from w),"
    f" j as (select documents.doc_id, lang, t, service_content, service_content as x, k.* exclude (doc_id),"
    f" regexp_extract_all(service_content, '{_EDGE[0]}([0-9]+(?:[.,][0-9]+)?)\\s*mbps{_EDGE[1]}', 1) as a, regexp_extract_all(service_content, '{_EDGE[0]}([0-9]{{1,4}})\\s*mo{_EDGE[1]}', 1) as b"
    " from documents join c using (doc_id) join k using (doc_id) join t using (doc_id))"
    " select cast(doc_id as varchar) as id, case lang when 'en' then '0' when 'fr' then '1' when 'de' then '2' else '3' end as class_int, concat('SN', doc_id) as sn, t as handle_time,"
    f" service_content, {', '.join(_RAW_TICKET)}, {', '.join(f32(e, n) for n, e in _TICKET_COUNTED.items())} from j"
)
