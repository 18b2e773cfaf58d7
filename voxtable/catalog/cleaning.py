"""Queries over the cleaning steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from voxtable.catalog.registry import (
    ARABIZED, NOISY, NOT_WORD, PLATFORM, WORD, gsub, is_phone, mask_phones, query, squeeze, table, telecom,
)
from voxtable import lexicon as lx
from voxtable.config import CommentConfig, TicketConfig
from voxtable.functions import phones as ph
from voxtable.functions import text as tx
from voxtable.functions import values as vx
from voxtable.operators import checks, cleaning
from voxtable.operators.features import comment_features, ordered_comment_columns, ordered_ticket_columns, ticket_features


def docs(spark, d):
    return table(spark, d, "documents")


def noisy(spark, d):
    return docs(spark, d).withColumn("noisy", F.expr(NOISY))


def step_query(name: str, fn, source: str, sql_expr: str | None):
    """Register a one-column step over every document; ``source`` is SQL both engines read."""
    sql = None if sql_expr is None else f"select doc_id, {sql_expr} as out from (select doc_id, {source} as x from documents)"

    @query(name, sql)
    def run(spark, d, fn=fn, source=source):
        return docs(spark, d).select("doc_id", F.expr(source).alias("x")).select("doc_id", fn(F.col("x")).alias("out"))


step_query("c1_collapse_spaces", tx.collapse_spaces, "concat('  ', replace(text, ' ', '  '), chr(9))", squeeze("x"))
step_query("c2_strip_accents", tx.strip_accents, "text", "strip_accents(x)")
step_query(
    "c3_plain_unicode", tx.plain_unicode, "concat(text, chr(13), '½ﬁ', doc_id, '​‪²x')",
    "replace(replace(replace(replace(replace(replace(replace(x, '½', '1⁄2'), 'ﬁ', 'fi'), '²', '2'), chr(13), ' '), chr(10), ' '), '​', ''), '‪', '')",
)
step_query("c4_split_separators", tx.split_separators, NOISY, gsub("x", "[/_|]+", " "))
step_query(
    "c5_split_colons", tx.split_colons, NOISY, gsub(gsub("x", f"({WORD}):({WORD})", r"\1 \2"), f"({WORD}):({WORD})", r"\1 \2")
)
step_query("c6_mask_urls", tx.mask_urls, NOISY, gsub("x", r"(?i)(?:https?://\S+|www\.\S+)", "<URL>"))
step_query(
    "c7_mask_emails", tx.mask_emails, NOISY,
    gsub("x", rf"(?i)(^|{NOT_WORD})({WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}})", r"\1<EMAIL>"),
)
step_query("c9_mask_phones", tx.mask_phones, NOISY, mask_phones("x"))
step_query("c10_mask_long_digits", tx.mask_long_digits, NOISY, gsub("x", r"[0-9]{6,}", "<NUM>"))
step_query(
    "c11_pad_placeholders", lambda c: tx.collapse_spaces(tx.pad_ticket_tokens(c)), NOISY,
    squeeze(gsub(gsub("x", r"(^|\S)(<PHONE>|<NUM>)(\S|$)", r"\1 \2 \3"), r"(^|\S)(<PHONE>|<NUM>)(\S|$)", r"\1 \2 \3")),
)
step_query(
    "c13_normalize_arabic", tx.normalize_arabic, ARABIZED,
    "translate(regexp_replace(replace(x, 'ـ', ''), '[ؐ-ًؚ-ٰٟۖ-ۭ]', '', 'g'), 'أإآى', 'اااي')",
)
step_query("c14_lowercase", F.lower, NOISY, "lower(x)")
step_query("c15_canonical_telecom", tx.canonicalize_telecom, NOISY, telecom("x"))
_AR = "[؀-ۿݐ-ݿࢠ-ࣿ]"
step_query(
    "c16_split_scripts", tx.split_scripts, ARABIZED,
    reduce(lambda c, _: gsub(gsub(c, f"({_AR})([A-Za-z])", r"\1 \2"), f"([A-Za-z])({_AR})", r"\1 \2"), range(2), "x"),
)
step_query(
    "c17_squash_punctuation", tx.squash_punctuation, "replace(replace(concat(text, '????،،،؛؛؛؛!!!'), '.', '...'), ',', ',,')",
    reduce(lambda c, ch: gsub(c, f"[{ch}]{{3,}}", ch), lx.PUNCTUATION, "x"),
)
step_query(
    "c18_reduce_elongations", tx.reduce_elongations, "replace(replace(concat(text, ' sloooow'), 'e', 'eee'), 't', 'tttt')",
    reduce(lambda c, ch: gsub(c, f"{ch}{{3,}}", ch * 2), "abcdefghijklmnopqrstuvwxyz", "x"),
)


@query(
    "c8_phone_predicate",
    f"""select digits, count(*) as n, bool_and({is_phone('digits')}) as phone from (
        select unnest([concat('0', lpad(cast(o_custkey as string), 8, '0')), concat('00213', cast(o_orderkey as string)),
            concat('213', cast(o_orderkey * 104729 as string)), cast(o_custkey * 7919 as string), concat('5', lpad(cast(o_orderkey as string), 8, '0'))]) as digits
        from orders) group by digits""",
)
def phone_predicate(spark, d):
    forms = F.expr(
        "array(concat('0', lpad(cast(o_custkey as string), 8, '0')), concat('00213', cast(o_orderkey as string)),"
        " concat('213', cast(o_orderkey * 104729 as string)), cast(o_custkey * 7919 as string), concat('5', lpad(cast(o_orderkey as string), 8, '0')))"
    )
    digits = table(spark, d, "orders").select(F.explode(forms).alias("digits"))
    return digits.groupBy("digits").agg(F.count("*").alias("n"), F.bool_and(ph.is_phone(F.col("digits"))).alias("phone"))


_PII_SQL = gsub("x", r"(?i)(?:https?://\S+|www\.\S+)", "<URL>")
_PII_SQL = gsub(_PII_SQL, rf"(?i)(^|{NOT_WORD})({WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}})", r"\1<EMAIL>")
_PII_NESTED = f"select doc_id, {gsub(mask_phones('y'), '[0-9]{6,}', '<ID>')} as out from (select doc_id, {_PII_SQL} as y from (select doc_id, {NOISY} as x from documents))"


@query("c12_mask_pii", _PII_NESTED)
def mask_pii(spark, d):
    cfg = CommentConfig()
    df = noisy(spark, d).select("doc_id", F.col("noisy").alias("out"))
    return cleaning.apply_steps(df, "out", tx.mask_pii_steps(cfg.url_token, cfg.email_token, cfg.phone_token, cfg.id_token))


def _nest(column: str, source: str, layers: list[str]) -> str:
    """Layered selects, so each SQL step is evaluated once."""
    sql = f"select doc_id, {source} as x from documents"
    for layer in layers:
        sql = f"select doc_id, {layer} as x from ({sql})"
    return f"select doc_id, x as {column} from ({sql})"


_SPLIT_SCRIPTS = reduce(lambda c, _: gsub(gsub(c, f"({_AR})([A-Za-z])", r"\1 \2"), f"([A-Za-z])({_AR})", r"\1 \2"), range(2), "x")
_ARABIC_SQL = "translate(regexp_replace(replace(x, 'ـ', ''), '[ؐ-ًؚ-ٰٟۖ-ۭ]', '', 'g'), 'أإآى', 'اااي')"
_COMMENT_LAYERS = [
    "replace(x, chr(10), ' ')",
    gsub("x", r"(?i)(?:https?://\S+|www\.\S+)", "<URL>"),
    gsub("x", rf"(?i)(^|{NOT_WORD})({WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}})", r"\1<EMAIL>"),
    mask_phones("x"),
    gsub("x", "[/_|]+", " "),
    mask_phones("x"),
    gsub("x", "[0-9]{6,}", "<ID>"),
    _ARABIC_SQL,
    "strip_accents(lower(x))",
    telecom("x"),
    reduce(lambda c, t: f"replace({c}, '{t.lower()}', ' {t} ')", ("<PHONE>", "<EMAIL>", "<URL>", "<ID>"), "x"),
    _SPLIT_SCRIPTS,
    reduce(lambda c, ch: gsub(c, f"[{ch}]{{3,}}", ch), lx.PUNCTUATION, "x"),
    reduce(lambda c, ch: gsub(c, f"{ch}{{3,}}", ch * 2), "abcdefghijklmnopqrstuvwxyz", "x"),
    squeeze("x"),
]


@query("c19_clean_comment", _nest("comment", NOISY, _COMMENT_LAYERS))
def clean_comment(spark, d):
    df = noisy(spark, d).select("doc_id", F.col("noisy").alias("comment"))
    return cleaning.clean_comment_text(df, CommentConfig())


_COMPAT_LAYERS = [
    "replace(x, chr(10), ' ')",
    gsub("x", "[/_|]+", " "),
    *_COMMENT_LAYERS[1:4],
    gsub("x", "[0-9]{6,}", "<ID>"),
    _ARABIC_SQL,
    "strip_accents(lower(x))",
    telecom("x"),
    *_COMMENT_LAYERS[11:],
]


@query("c19_clean_comment_compat", _nest("comment", NOISY, _COMPAT_LAYERS))
def clean_comment_compat(spark, d):
    df = noisy(spark, d).select("doc_id", F.col("noisy").alias("comment"))
    return cleaning.clean_comment_text(df, CommentConfig(), compat=True)


_TICKET_LAYERS = [
    f"strip_accents(lower(coalesce(nullif({squeeze('x')}, ''), 'UNK')))",
    squeeze(gsub(gsub(gsub("x", "[/_|]+", " "), f"({WORD}):({WORD})", r"\1 \2"), f"({WORD}):({WORD})", r"\1 \2")),
    mask_phones("x"),
    gsub("x", "[0-9]{6,}", "<NUM>"),
    gsub(gsub("x", r"(^|\S)(<PHONE>|<NUM>)(\S|$)", r"\1 \2 \3"), r"(^|\S)(<PHONE>|<NUM>)(\S|$)", r"\1 \2 \3"),
    f"coalesce(nullif({squeeze('x')}, ''), 'UNK')",
]


@query("c20_clean_ticket_text", _nest("service_content", NOISY, _TICKET_LAYERS))
def clean_ticket(spark, d):
    df = noisy(spark, d).select("doc_id", F.col("noisy").alias("service_content"))
    return cleaning.clean_ticket_text(df, TicketConfig())


@query(
    "c21_clean_platform",
    f"""select doc_id, coalesce(nullif(case when replace(p, ' ', '') in ('facebookfacebook', 'twittertwitter', 'instagraminstagram')
            then substr(replace(p, ' ', ''), 1, length(replace(p, ' ', '')) // 2)
            else trim(regexp_replace(p, '[^a-z0-9]+', '_', 'g'), '_') end, ''), 'UNK') as platform
        from (select doc_id, lower(strip_accents({squeeze(PLATFORM)})) as p from documents)""",
)
def clean_platform(spark, d):
    return docs(spark, d).select("doc_id", vx.clean_platform(F.expr(PLATFORM)).alias("platform"))


_CATS = {
    "priority": "case when o_orderpriority = '4-NOT SPECIFIED' then '  ' when o_orderkey % 13 = 0 then null else concat('  ', o_orderpriority, '  É  ') end",
    "status": "case when o_orderkey % 17 = 0 then 'UNK' else o_orderstatus end",
}


def _cat_sql(x: str) -> str:
    return f"case when coalesce({squeeze(x)}, '') in ('', 'UNK') then 'UNK' else lower(strip_accents({squeeze(x)})) end"


@query(
    "c22_clean_categories",
    f"select o_orderkey, {_cat_sql('priority')} as priority, {_cat_sql('status')} as status from (select o_orderkey, "
    + ", ".join(f"{e} as {n}" for n, e in _CATS.items()) + " from orders)",
)
def clean_categories(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", *[F.expr(e).alias(n) for n, e in _CATS.items()])
    return cleaning.clean_categories(df, TicketConfig(cat_cols=("priority", "status")))


_RULES = {
    "dept_traitement": "case when c_custkey % 5 = 0 then concat('[', c_mktsegment, ']') when c_custkey % 2 = 0 then concat(c_mktsegment, ' [used by ', c_name, ']') else c_mktsegment end",
    "customer_level": "case when c_custkey % 3 = 0 then 'Résidentiel' when c_custkey % 3 = 1 then 'residantiel' else c_mktsegment end",
}


@query(
    "c23_column_rules",
    f"""select c_custkey, coalesce(nullif(trim(regexp_replace({_cat_sql('dept_traitement')}, '\\s*\\[[^\\]]+\\]\\s*$', '')), ''), 'UNK') as dept_traitement,
        case when starts_with({_cat_sql('customer_level')}, 'resid') then 'residential' else {_cat_sql('customer_level')} end as customer_level
        from (select c_custkey, """ + ", ".join(f"{e} as {n}" for n, e in _RULES.items()) + " from customer)",
)
def column_rules(spark, d):
    df = table(spark, d, "customer").select("c_custkey", *[F.expr(e).alias(n) for n, e in _RULES.items()])
    return cleaning.clean_categories(df, TicketConfig(cat_cols=("dept_traitement", "customer_level")))


_ACTEL = "case when p_partkey % 4 = 0 then p_name when p_partkey % 4 = 1 then concat(p_brand, ' ( )') else concat('ACTEL ', p_brand, ' (J', cast(p_size as string), ') ') end"


@query(
    "c24_trailing_code",
    f"select p_partkey, nullif(trim(regexp_extract(x, '\\(([^()]*)\\)\\s*$', 1)), '') as code from (select p_partkey, {_ACTEL} as x from part)",
)
def trailing_code(spark, d):
    return table(spark, d, "part").select("p_partkey", vx.trailing_code(F.expr(_ACTEL)).alias("code"))


_DAY, _MONTH = "lpad(cast(13 + event_id % 15 as string), 2, '0')", "lpad(cast(1 + event_id % 12 as string), 2, '0')"
_CLOCK = "concat(lpad(cast(event_id % 24 as string), 2, '0'), ':', lpad(cast(event_id % 60 as string), 2, '0'), ':07')"
_WHEN = (
    f"case when event_id % 5 = 0 then concat('2025-', {_MONTH}, '-', {_DAY}, ' ', {_CLOCK}) when event_id % 5 = 1 then concat({_MONTH}, '/', {_DAY}, '/2025')"
    f" when event_id % 5 = 2 then concat({_DAY}, '/', {_MONTH}, '/2025') when event_id % 5 = 3 then concat('2025-', {_MONTH}, '-', {_DAY}) else event_type end"
)
_PARSED = "coalesce(try_strptime(x, '%Y-%m-%d %H:%M:%S'), try_strptime(x, '%Y-%m-%d'), try_strptime(x, '%m/%d/%Y'), try_strptime(x, '%d/%m/%Y'))"


@query("c25_parse_time", f"select event_id, strftime({_PARSED}, '%Y-%m-%d %H:%M:%S') as handle_time from (select event_id, {_WHEN} as x from events)")
def parse_time(spark, d):
    parsed = vx.parse_time(F.expr(_WHEN))
    return table(spark, d, "events").select("event_id", F.date_format(parsed, "yyyy-MM-dd HH:mm:ss").alias("handle_time"))


@query("c26_parse_rate", f"select avg(case when {_PARSED} is not null then 1.0 else 0.0 end)::double as parse_rate from (select {_WHEN} as x from events)")
def parse_rate(spark, d):
    df = table(spark, d, "events").select(F.expr(_WHEN).alias("handle_time"))
    return cleaning.parse_rate(cleaning.parse_handle_time(df, "handle_time"), "handle_time")


_RAW_ID = "case when o_orderkey % 7 = 0 then o_orderstatus when o_orderkey % 7 = 1 then concat(cast(o_custkey as string), '.0') when o_orderkey % 7 = 2 then '' else cast(o_custkey as string) end"


@query(
    "c27_to_long",
    f"select o_orderkey, coalesce(try_cast(case when x like '%.%' then null else x end as bigint), case when try_cast(x as double) = floor(try_cast(x as double)) then cast(try_cast(x as double) as bigint) end) as id from (select o_orderkey, {_RAW_ID} as x from orders)",
)
def to_long(spark, d):
    return table(spark, d, "orders").select("o_orderkey", vx.to_long(F.expr(_RAW_ID)).alias("id"))


def raw_comments(spark, d):
    """Documents under the raw comment headers."""
    return docs(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.expr(PLATFORM).alias("Réseau Social"),
        F.expr(NOISY).alias("Commentaire client"), F.expr("case lang when 'en' then '1' when 'fr' then '2' when 'de' then '3' else '4' end").alias("Class"),
    )


@query("c28_contract_columns", "select o_orderkey as id, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end as class_int, o_orderpriority as subs_level, strftime(o_orderdate, '%Y-%m-%d') as handle_time from orders")
def contract_columns(spark, d):
    cfg = TicketConfig(keep_cols=("id", "subs_level", "handle_time", "sn"), keep_sn_in_outputs=False)
    df = table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("subs_level"), F.col("o_custkey").alias("sn"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("handle_time"),
        F.expr("case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end").alias("class_int"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("other"),
    )
    return ordered_ticket_columns(df, cfg, is_train=True)


@query("c29_keep_raw", f"select doc_id, {PLATFORM} as platform_raw, text as comment_raw, lower(text) as comment from documents")
def keep_raw(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(PLATFORM).alias("platform"), F.col("text").alias("comment"))
    kept = cleaning.keep_raw(df, ["platform", "comment"])
    return kept.select("doc_id", "platform_raw", "comment_raw", F.lower("comment").alias("comment"))


@query("c30_comment_table")
def comment_table(spark, d):
    cfg = CommentConfig(keep_raw_cols=False)
    out = comment_features(cleaning.clean_comments(raw_comments(spark, d), cfg, is_train=True), cfg)
    return ordered_comment_columns(out, cfg, is_train=True)


def raw_tickets(spark, d):
    """Documents under the raw ticket headers."""
    when = _WHEN.replace("event_id", "doc_id").replace("event_type", "lang")
    return docs(spark, d).select(
        F.col("doc_id").cast("string").alias("id"), F.concat(F.lit("SN"), "doc_id").alias("SN"), F.expr(when).alias("Handle time"),
        F.initcap("lang").alias("TT status"), F.upper("source").alias("Dept. for initial handling"), F.lit("Réclamation").alias("Service request type"),
        F.expr("case when doc_id % 9 = 0 then null when doc_id % 29 = 0 then 'prepaid' else ' Postpaid ' end").alias("Subs Level"),
        F.expr("case when doc_id % 2 = 0 then 'Résidentiel' else 'Business' end").alias("Customer level"), F.expr(NOISY).alias("Service content"),
        F.concat("source", F.lit(" [used by system]")).alias("Département de traitement"), F.lit("Tech").alias("Tech/Comm"),
        F.expr("case when doc_id % 3 = 0 then 'FTTH' else 'ADSL' end").alias("Type"), F.concat(F.lit("DOT "), F.col("doc_id") % 40).alias("DOT"),
        F.expr("concat('ACTEL ', source, ' (J', cast(doc_id % 25 as string), ')')").alias("ACTEL's"),
        F.expr("case lang when 'en' then '0' when 'fr' then '1' when 'de' then '2' else '3' end").alias("class_int"),
    )


@query("c30_ticket_table")
def ticket_table(spark, d):
    cfg = TicketConfig()
    out = ticket_features(cleaning.clean_tickets(raw_tickets(spark, d), cfg), cfg)
    return ordered_ticket_columns(out, cfg, is_train=True)


_SOMETIMES = f"case when doc_id % 3 = 0 then {NOISY} else text end"


@query(
    "c31_phone_leaks",
    f"select doc_id, x as text from (select doc_id, {_SOMETIMES} as x from documents) where len(list_filter(regexp_extract_all(x, '\\+?\\d[\\d\\s\\-.]{{6,}}\\d'), lambda c: "
    + is_phone("regexp_replace(c, '[^0-9]', '', 'g')") + ")) > 0",
)
def phone_leaks(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(_SOMETIMES).alias("text"))
    return cleaning.phone_leaks(df, "text")


@query(
    "c32_quality_report",
    rf"""select count(*) as rows, count(*) filter (where doc_id is null) as id_missing, count(*) filter (where trim(coalesce(p, '')) = '') as platform_empty,
        count(*) filter (where text is null) as text_missing, count(*) filter (where trim(coalesce(text, '')) = '') as text_empty,
        count(*) filter (where regexp_matches(text, '(?i)(?:https?://\S+|www\.\S+)')) as url_leaks,
        count(*) filter (where regexp_matches(text, '{WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}($|{NOT_WORD})')) as email_leaks,
        count(*) filter (where regexp_matches(text, '[0-9]{{6,}}')) as long_digit_leaks_ge6,
        count(*) filter (where len(list_filter(regexp_extract_all(text, '\+?\d[\d\s\-.]{{6,}}\d'), lambda c: {is_phone("regexp_replace(c, '[^0-9]', '', 'g')")})) > 0) as phone_leaks,
        count(*) filter (where lang is null) as label_missing, count(distinct lang) as n_classes,
        count(distinct doc_id) as id_unique, count(*) - count(distinct doc_id) as id_dupes,
        (select string_agg(lang, ',' order by lang) from (select distinct lang from documents) where lang is not null) as labels_sorted
        from (select *, {PLATFORM} as p from documents)""",
)
def quality_report(spark, d):
    cfg = CommentConfig(id_col="doc_id", platform_col="p", text_col="text", target_col="lang")
    return checks.quality_report(docs(spark, d).withColumn("p", F.expr(PLATFORM)), cfg, is_train=True)
