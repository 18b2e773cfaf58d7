"""Queries over profiles and class relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.catalog.cleaning import docs
from voxtable.catalog.features import COMMENT_TEXT
from voxtable.catalog.registry import ORACLES, NOISY, NOT_WORD, PLATFORM, WORD, has, query, re2, squeeze, table
from voxtable.functions.text import collapse_spaces
from voxtable.operators import cleaning, profiling, relations
from voxtable.operators import profile_states as ps
from voxtable.config import CommentConfig
from voxtable.scale import checkpointed


def rounded(df, *columns, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


_HOLES = {"id": "case when o_orderkey % 97 = 0 then null else o_orderkey end", "status": "case when o_orderkey % 7 = 0 then null else o_orderstatus end", "priority": "o_orderpriority"}
_HOLES_SQL = "(select " + ", ".join(f"{e} as {n}" for n, e in _HOLES.items()) + " from orders)"


def holes(spark, d):
    return table(spark, d, "orders").select(*[F.expr(e).alias(n) for n, e in _HOLES.items()])


@query("p1_missing_table", " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {c} is null) as missing_count, round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as missing_rate from {_HOLES_SQL}" for c in _HOLES))
def missing_table(spark, d):
    return rounded(profiling.missing_table(holes(spark, d)), "missing_rate")


_CELLS = "(" + " union all ".join(f"select '{c}' as col, cast({c} as varchar) as v from {_HOLES_SQL}" for c in ("status", "priority")) + ")"


@query(
    "p2_top_values",
    f"""select col as "column", v as value, c as "count", r as rank from (select *, row_number() over (partition by col order by c desc, v) as r from
        (select col, coalesce(v, '<NA>') as v, count(*) as c from {_CELLS} group by 1, 2)) where r <= 3""",
)
def top_values(spark, d):
    return profiling.top_values(holes(spark, d), ["status", "priority"], 3)


@query("p3_cardinality", " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) + max(case when {c} is null then 1 else 0 end) as \"unique\" from {_HOLES_SQL}" for c in _HOLES))
def cardinality(spark, d):
    return profiling.cardinality(holes(spark, d), list(_HOLES))


_MERGED_COLUMNS = ["lang", "source", "doc_id"]


@query(
    "p3_merged_states",
    " union all ".join(f"select '{c}' as \"column\", count(*) as rows, count(*) filter (where {c} is null) as missing, true as near from documents" for c in _MERGED_COLUMNS),
)
def merged_states(spark, d):
    """Column states of each source alone, merged; and whether their distinct values are within 5 % of the exact ones."""
    df = docs(spark, d)
    batches = [ps.profile_state(df.filter(F.pmod(F.hash("source"), F.lit(3)) == i), _MERGED_COLUMNS, "text") for i in range(3)]
    state = checkpointed(ps.merged(batches))
    exact = profiling.cardinality(df, _MERGED_COLUMNS).withColumnRenamed("unique", "exact")
    near = F.abs(F.col("unique") - F.col("exact")) <= 0.05 * F.col("exact")
    return ps.column_report(state).join(exact, "column").select("column", "rows", "missing", near.alias("near"))


@query("p8_merged_lengths", "select count(*) as rows, min(length(text)) as min, max(length(text)) as max, round(avg(length(text)), 6)::double as mean, true as near from documents")
def merged_lengths(spark, d):
    """Length states of each source alone, merged; and whether the median's rank is within 3 % of the middle."""
    df = docs(spark, d)
    batches = [ps.profile_state(df.filter(F.pmod(F.hash("source"), F.lit(3)) == i), ["lang"], "text") for i in range(3)]
    state = checkpointed(ps.merged(batches))
    median = ps.length_report(state).select("q50").scalar()
    rank = df.agg((F.count_if(F.char_length("text") <= median) / F.count("*")).alias("r")).scalar()
    return rounded(ps.length_report(state).select("rows", "min", "max", "mean", (F.abs(rank - 0.5) <= 0.03).alias("near")), "mean")


_UNK = "(select case when o_orderpriority = '4-NOT SPECIFIED' then 'UNK' else o_orderpriority end as priority, case when o_orderkey % 5 = 0 then 'UNK' when o_orderkey % 7 = 0 then null else o_orderstatus end as status from orders)"


@query("p4_unknown_rates", " union all ".join(f"select '{c}' as \"column\", round(avg(case when {c} = 'UNK' then 1.0 else 0.0 end), 6)::double as unk_rate from {_UNK}" for c in ("priority", "status")))
def unknown_rates(spark, d):
    df = table(spark, d, "orders").select(
        F.expr("case when o_orderpriority = '4-NOT SPECIFIED' then 'UNK' else o_orderpriority end").alias("priority"),
        F.expr("case when o_orderkey % 5 = 0 then 'UNK' when o_orderkey % 7 = 0 then null else o_orderstatus end").alias("status"),
    )
    return rounded(profiling.unknown_rates(df, ["priority", "status"]), "unk_rate")


@query("p5_distribution", f"select coalesce(p, '<NA>') as value, count(*) as \"count\" from (select {PLATFORM} as p from documents) group by 1")
def distribution(spark, d):
    return profiling.distribution(docs(spark, d).withColumn("p", F.expr(PLATFORM)), "p")


_DUP_ROW = "case when doc_id % 10 = 0 then null else source end"


@query(
    "p6_duplicates",
    f"""select 'text' as key, count(*) - count(distinct text) as duplicates from documents
        union all select 'platform', count(*) - count(distinct p) - max(case when p is null then 1 else 0 end) from (select {_DUP_ROW} as p from documents)
        union all select 'row', (select count(*) from documents) - (select count(*) from (select distinct {_DUP_ROW} as p, text, lang from documents))""",
)
def duplicates(spark, d):
    df = docs(spark, d).select(F.expr(_DUP_ROW).alias("p"), "text", "lang")
    return profiling.duplicates(df, {"text": F.col("text"), "platform": F.col("p"), "row": profiling.full_row(df)})


_NOISE_TEXT = "concat(text, case when doc_id % 3 = 0 then ' http://x.io !!!! loool ' when doc_id % 3 = 1 then concat(' a.b@c.org sooooo ', cast(doc_id * 77777 as string)) else ' 05 59 23 32 22 ؟؟؟' end)"


def _re2_repeat(chars: str, times: int) -> str:
    return "(" + "|".join(f"[{c}]{{{times},}}" for c in chars) + ")"


_NOISE_SQL = {
    "url_candidates": r"(?i)(?:https?://\S+|www\.\S+)",
    "email_candidates": rf"{WORD}[\p{{L}}\p{{N}}_.+-]*@[\p{{L}}\p{{N}}_.-]+\.[A-Za-z]{{2,}}($|{NOT_WORD})",
    "phone_like_candidates": r"\+?\d[\d\s\-.]{6,}\d",
    "long_digit_seq_ge6": "[0-9]{6,}",
    "repeated_punct_ge3": _re2_repeat(lx.PUNCTUATION, 3),
    "elongated_latin_ge4": _re2_repeat("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", 4),
}


@query("p7_noise_counts", "select " + ", ".join(f"count(*) filter (where regexp_matches(x, '{p}')) as {n}" for n, p in _NOISE_SQL.items()) + f" from (select {_NOISE_TEXT} as x from documents)")
def noise_counts(spark, d):
    return profiling.noise_counts(docs(spark, d).withColumn("x", F.expr(_NOISE_TEXT)), "x")


def _length_sql(x: str) -> str:
    quantiles = ", ".join(f"round(quantile_cont(length({x}), {q}), 6)::double as {profiling.quantile_name(q)}" for q in lx.LENGTH_QUANTILES)
    return f"count(*) as rows, cast(min(length({x})) as bigint) as min, cast(max(length({x})) as bigint) as max, round(avg(length({x})), 6) as mean, {quantiles}"


_LENGTH_COLUMNS = ["mean", *[profiling.quantile_name(q) for q in lx.LENGTH_QUANTILES]]


@query("p8_length_stats", f"select {_length_sql('text')} from documents")
def length_stats(spark, d):
    return rounded(profiling.length_stats(docs(spark, d), "text"), *_LENGTH_COLUMNS)


@query("p8_length_by_source", f"select source, {_length_sql('text')} from documents group by source")
def length_by_source(spark, d):
    return rounded(profiling.length_stats(docs(spark, d), "text", ["source"]), *_LENGTH_COLUMNS)


_STAGES = f"(select 'raw' as stage, text as x from documents union all select 'clean', {squeeze('lower(text)')} from documents)"


def _stages(spark, d):
    df = docs(spark, d).select(F.col("text").alias("x"))
    return {"raw": df, "clean": df.withColumn("x", collapse_spaces(F.lower("x")))}


@query("p9_raw_vs_clean", f"select stage, {_length_sql('x')} from {_STAGES} group by stage")
def raw_vs_clean(spark, d):
    return rounded(profiling.length_stats(profiling.stage_union(_stages(spark, d)), "x", ["stage"]), *_LENGTH_COLUMNS)


_CAT_STAGES = f"(select 'raw' as stage, p as v from (select {PLATFORM} as p from documents) union all select 'clean', coalesce(nullif({squeeze('p')}, ''), 'UNK') from (select lower({PLATFORM}) as p from documents))"


def _cat_stages(spark, d):
    df = docs(spark, d).select(F.expr(PLATFORM).alias("platform"))
    clean = df.withColumn("platform", F.coalesce(F.nullif(collapse_spaces(F.lower("platform")), F.lit("")), F.lit("UNK")))
    return profiling.compare_stages({"raw": df, "clean": clean}, ["platform"], 10)


@query("p10_stage_cardinality", f"select stage, 'platform' as \"column\", count(distinct v) as \"unique\" from {_CAT_STAGES} group by stage")
def stage_cardinality(spark, d):
    return _cat_stages(spark, d)[0]


@query(
    "p10_stage_top_values",
    f"select stage, 'platform' as \"column\", v as value, c as \"count\", r as rank from (select *, row_number() over (partition by stage order by c desc, v) as r from"
    f" (select stage, coalesce(v, '<NA>') as v, count(*) as c from {_CAT_STAGES} group by 1, 2)) where r <= 10",
)
def stage_top_values(spark, d):
    return _cat_stages(spark, d)[1]


@query(
    "p11_crosstab",
    """select s.source, l.lang, coalesce(c, 0) as "count", round(100.0 * coalesce(c, 0) / t, 2)::double as row_pct
       from (select source, count(*) as t from documents group by 1) s, (select distinct lang from documents) l
       left join (select source, lang, count(*) as c from documents group by 1, 2) x on x.source = s.source and x.lang = l.lang""",
)
def crosstab(spark, d):
    return relations.crosstab(docs(spark, d), "source", "lang")


@query("p12_length_by_class", "select lang, count(*) as n, round(avg(length(text)), 6) as mean, round(median(length(text)), 6)::double as median, round(quantile_cont(length(text), 0.9), 6)::double as q90 from documents group by lang")
def length_by_class(spark, d):
    return rounded(relations.length_by_class(docs(spark, d), "text", "lang"), "mean", "median", "q90")


_MIXED = "case when doc_id % 4 = 0 then translate(text, 'aeiounrtsl', 'ابتثجحخدذر') when doc_id % 50 = 1 then '' else text end"
_AR, _LA, _DI = "len(regexp_extract_all(x, '[؀-ۿݐ-ݿࢠ-ࣿ]'))", "len(regexp_extract_all(x, '[A-Za-z]'))", "len(regexp_extract_all(x, '[0-9]'))"


@query(
    "p13_script_mix",
    f"""select lang, round(avg(n), 6) as mean_len, round(avg(a / nullif(n, 0)), 6) as arabic_frac_mean, round(avg(l / nullif(n, 0)), 6) as latin_frac_mean,
        round(avg(g / nullif(n, 0)), 6) as digit_frac_mean, round(avg(case when a > l then 1.0 else 0.0 end), 6)::double as pct_mostly_arabic,
        round(avg(case when l > 0 then 1.0 else 0.0 end), 6)::double as pct_has_latin, round(avg(case when a > 0 then 1.0 else 0.0 end), 6)::double as pct_has_arabic,
        round(avg(case when g > 0 then 1.0 else 0.0 end), 6)::double as pct_has_digits
        from (select lang, length(x) as n, {_AR} as a, {_LA} as l, {_DI} as g from (select lang, {_MIXED} as x from documents)) group by lang""",
)
def script_mix(spark, d):
    out = relations.script_mix(docs(spark, d).withColumn("x", F.expr(_MIXED)), "x", "lang")
    return rounded(out, *[c for c in out.columns if c != "lang"])


@query("p14_pattern_rates", "select lang, " + ", ".join(f"round(avg(case when {has('x', p, i)} then 1.0 else 0.0 end), 6)::double as {n}" for n, p, i in lx.DOMAIN_PATTERNS) + f" from (select lang, {COMMENT_TEXT} as x from documents) group by lang")
def pattern_rates(spark, d):
    out = relations.pattern_rates(docs(spark, d).withColumn("x", F.expr(COMMENT_TEXT)), "x", "lang")
    return rounded(out, *[n for n, _, _ in lx.DOMAIN_PATTERNS])


_TOKEN = "<[^>]+>|[؀-ۿݐ-ݿࢠ-ࣿ]+|[a-zA-Z]+|[0-9]+"


@query("p15_tokens", f"select doc_id, array_to_string(list_transform(regexp_extract_all(x, '{_TOKEN}'), lambda t: case when regexp_matches(t, '^[A-Za-z]+$') then lower(t) else t end), ' ') as tokens from (select doc_id, {COMMENT_TEXT} as x from documents)")
def tokens(spark, d):
    df = docs(spark, d).select("doc_id", F.expr(COMMENT_TEXT).alias("x"))
    return df.select("doc_id", F.array_join(relations.tokens(F.col("x")), " ").alias("tokens"))


_COUNTS = f"""t as (select role as label, unnest(regexp_extract_all(text, '{_TOKEN}')) as w from conversations),
    n as (select label, case when regexp_matches(w, '^[A-Za-z]+$') then lower(w) else w end as token from t where length(w) >= 2 and not regexp_matches(w, '^[0-9]{{1,2}}$')),
    c as (select label, token, count(*) as n from n group by 1, 2)"""


def _token_counts(spark, d):
    return relations.token_counts(table(spark, d, "conversations"), "text", "role")


@query("p16_top_tokens", f"with {_COUNTS} select label, token, n, r as rank from (select *, row_number() over (partition by label order by n desc, token) as r from c) where r <= 25")
def top_tokens(spark, d):
    return relations.top_tokens(_token_counts(spark, d), 25)


@query(
    "p17_distinctive_tokens",
    f"""with {_COUNTS}, k as (select label, sum(n) as nc from c group by 1), a as (select token, sum(n) as tot from c group by 1),
        z as (select sum(n) as nn, count(distinct token) as vv from c),
        g as (select k.label, a.token, coalesce(c.n, 0) as x, a.tot - coalesce(c.n, 0) as y, k.nc, greatest(z.nn - k.nc, 1) as nr, z.vv from k cross join a cross join z left join c on c.label = k.label and c.token = a.token),
        p as (select label, token, greatest(least((x + 0.01) / (nc + 0.01 * vv), 1 - 1e-9), 1e-9)::double as p1, greatest(least((y + 0.01) / (nr + 0.01 * vv), 1 - 1e-9), 1e-9)::double as p2 from g),
        s as (select label, token, round(ln(p1 / (1 - p1)) - ln(p2 / (1 - p2)), 9) as score from p)
        select label, token, round(score, 6) as score, r as rank from (select *, row_number() over (partition by label order by score desc, token) as r from s) where r <= 20""",
)
def distinctive_tokens(spark, d):
    counts = checkpointed(_token_counts(spark, d))
    return rounded(relations.distinctive_tokens(counts, 20), "score")


_TOP20 = f"with {_COUNTS}, top as (select label, token from (select *, row_number() over (partition by label order by n desc, token) as r from c) where r <= 20)"
_JACCARD = f"""{_TOP20}, z as (select label, count(*) as s from top group by 1),
    m as (select a.label, b.label as other, count(*) as k from top a join top b using (token) group by 1, 2),
    j as (select a.label, b.label as other, case when a.label = b.label then 1.0 else round(coalesce(m.k, 0) / greatest(a.s + b.s - coalesce(m.k, 0), 1), 3) end::double as jaccard
          from z a cross join z b left join m on m.label = a.label and m.other = b.label)"""


def _similarity(spark, d):
    top = checkpointed(relations.top_tokens(_token_counts(spark, d), 25))
    return relations.class_similarity(top, 20)


@query("p18_class_similarity", f"{_JACCARD} select label, other, jaccard from j")
def class_similarity(spark, d):
    return _similarity(spark, d)


@query("p18_nearest_classes", f"{_JACCARD} select label, other, jaccard, r as rank from (select *, row_number() over (partition by label order by jaccard desc, other) as r from j where label <> other) where r <= 3")
def nearest_classes(spark, d):
    return relations.nearest_classes(_similarity(spark, d), 3)


@query("p19_seeded_examples", "select lang as label, doc_id as id, replace(substr(text, 1, 260), chr(10), ' ') as example, r as rank from (select *, row_number() over (partition by lang order by md5(concat(doc_id, '-42')), doc_id) as r from documents) where r <= 3")
def seeded_examples(spark, d):
    return relations.seeded_examples(docs(spark, d), "text", "lang", "doc_id")


@query("p19_first_examples", "select lang as label, doc_id as id, substr(replace(text, chr(10), ' '), 1, 220) as example, r as rank from (select *, row_number() over (partition by lang order by doc_id) as r from documents) where r <= 3")
def first_examples(spark, d):
    return relations.first_examples(docs(spark, d), "text", "lang", "doc_id")


_BASIC_LENGTH = " union all ".join(
    [f"select 'length' as section, '{n}' as key, {e}::double as value from documents" for n, e in (("rows", "count(*)"), ("min", "min(length(text))"), ("max", "max(length(text))"), ("mean", "round(avg(length(text)), 6)"))]
    + [f"select 'length', '{profiling.quantile_name(q)}', round(quantile_cont(length(text), {q}), 6)::double from documents" for q in lx.LENGTH_QUANTILES]
)


@query(
    "p20_basic_stats",
    f"""{_BASIC_LENGTH} union all select 'duplicates', 'row', ((select count(*) from documents) - (select count(*) from (select distinct * from documents)))::double union all select 'duplicates', 'text', (count(*) - count(distinct text))::double from documents
        union all (select 'platform', source, count(*)::double as n from documents group by source order by n desc, source limit 20)
        union all select 'label', lang, count(*)::double from documents group by lang""",
)
def basic_stats(spark, d):
    df = docs(spark, d).select("doc_id", "source", "lang", "text")
    return rounded(profiling.basic_stats(df, "source", "lang", "text"), "value")


_SUMMARY = " union all ".join(
    f"""select '{s}' as split, 'rows' as section, 'rows' as key, count(*)::double as value from {_HOLES_SQL} where {w}
        union all select '{s}', 'missing_rate', c, v from (select {', '.join(f"round(avg(case when {c} is null then 1.0 else 0.0 end), 6)::double as {c}" for c in _HOLES)} from {_HOLES_SQL} where {w}) unpivot (v for c in ({', '.join(_HOLES)}))
        union all select '{s}', 'datetime_parse_rate', 'status', round(avg(case when status is not null then 1.0 else 0.0 end), 6)::double from {_HOLES_SQL} where {w}"""
    for s, w in (("train", "priority <> '1-URGENT'"), ("test", "priority = '1-URGENT'"))
)


@query("p21_run_summary", _SUMMARY)
def run_summary(spark, d):
    df = holes(spark, d)
    out = profiling.run_summary(df.filter("priority <> '1-URGENT'"), df.filter("priority = '1-URGENT'"), "status")
    return rounded(out, "value")


@query(
    "p22_script_dominance",
    f"""select lang, count(*) as rows, round(avg(case when a / nullif(a + l, 0) >= 0.55 then 1.0 else 0.0 end), 6)::double as pct_ar_dominant,
        round(avg(case when l / nullif(a + l, 0) >= 0.55 then 1.0 else 0.0 end), 6)::double as pct_lat_dominant, round(avg(coalesce(a / nullif(a + l, 0), 0)), 6) as mean_ar_ratio,
        round(avg(coalesce(l / nullif(a + l, 0), 0)), 6) as mean_lat_ratio from (select lang, {_AR} as a, {_LA} as l from (select lang, {_MIXED} as x from documents)) group by lang""",
)
def script_dominance(spark, d):
    out = profiling.script_dominance(docs(spark, d).withColumn("x", F.expr(_MIXED)), "x", ["lang"])
    return rounded(out, *[c for c in out.columns if c not in ("lang", "rows")])


@query("p22_intent_prevalence", "select lang, " + ", ".join(f"round(avg(case when {has('x', p, i)} then 1.0 else 0.0 end), 6)::double as {n}" for n, p, i in lx.INTENT_FLAGS) + f" from (select lang, {COMMENT_TEXT} as x from documents) group by lang")
def intent_prevalence(spark, d):
    out = profiling.intent_prevalence(docs(spark, d).withColumn("x", F.expr(COMMENT_TEXT)), "x", ["lang"])
    return rounded(out, *[n for n, _, _ in lx.INTENT_FLAGS])


@query("p22_unknown_platforms", f"select p as platform, count(*) as \"count\", round(count(*) / (select count(*) from documents), 6) as rate from (select {PLATFORM} as p from documents) where p is null or p not in ('FacebookFacebook', 'SRC1 Page') group by p")
def unknown_platforms(spark, d):
    return rounded(profiling.unknown_platforms(docs(spark, d).withColumn("p", F.expr(PLATFORM)), "p", ["FacebookFacebook", "SRC1 Page"]), "rate")


@query(
    "flagship_masked_profile",
    "select lang, count(*) as rows, round(avg(length(comment)), 6) as mean_len, "
    + ", ".join(f"round(avg(case when contains(comment, '<{t.upper()}>') then 1.0 else 0.0 end), 6)::double as {t}_rate" for t in ("phone", "email", "url", "id"))
    + f" from ({ORACLES['c19_clean_comment']}) join (select doc_id, lang from documents) using (doc_id) group by lang",
)
def flagship(spark, d):
    """Per language: rows, length and share of texts holding each placeholder after cleaning."""
    cfg = CommentConfig()
    clean = cleaning.clean_comment_text(docs(spark, d).select("doc_id", "lang", F.expr(NOISY).alias("comment")), cfg)
    text = F.col("comment")
    return clean.groupBy("lang").agg(
        F.count("*").alias("rows"), F.round(F.avg(F.char_length(text)), 6).alias("mean_len"),
        *[F.round(F.avg(text.contains(t).cast("double")), 6).alias(f"{t[1:-1].lower()}_rate") for t in cfg.tokens],
    )


__all__ = ["re2"]
