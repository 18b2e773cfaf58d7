"""Queries over readers, checks and writers."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxtable.catalog.cleaning import docs, raw_comments
from voxtable.catalog.registry import NOISY, PLATFORM, query, table
from voxtable.config import CommentConfig
from voxtable.operators import checks, profiling, schema
from voxtable.scale import scratch_path
from voxtable.sources import tables as src


@query("s1_read_table", "select cast(doc_id as varchar) as doc_id, lang, n_chars, cast(length(text) as bigint) as text_len from documents")
def read_table(spark, d):
    df = src.read_table(spark, f"{d}/documents.parquet", "doc_id")
    return df.select("doc_id", "lang", "n_chars", F.char_length("text").cast("long").alias("text_len"))


@query("s1_read_csv", "select cast(page_id as varchar) as page_id, url, html from pages")
def read_csv(spark, d):
    path = scratch_path(spark, "pages-csv")
    src.write_clean(table(spark, d, "pages"), path, "csv")
    return src.read_csv(spark, path)


@query("s2_encoding_fallback", "select cast(doc_id as varchar) as doc_id, concat(text, ' 5€') as text from documents")
def encoding_fallback(spark, d):
    path = scratch_path(spark, "legacy-csv")
    # Byte 0x80 is the euro sign in Windows-1252 and invalid in UTF-8.
    df = docs(spark, d).select("doc_id", F.concat("text", F.lit(" 5\x80")).alias("text"))
    df.write.option("header", True).option("escape", '"').option("quoteAll", True).option("encoding", "iso-8859-1").csv(path)
    return src.read_csv_robust(spark, path)


_COMMENT_COLUMNS = f"cast(doc_id as varchar) as id, {PLATFORM} as platform, {NOISY} as comment, case lang when 'en' then '1' when 'fr' then '2' when 'de' then '3' else '4' end as label"


@query("s5_resolve_columns", f"select {_COMMENT_COLUMNS} from documents")
def resolve_columns(spark, d):
    return schema.rename_comment_columns(raw_comments(spark, d), CommentConfig(), is_train=True)


def _orders_contract(spark, d):
    train = table(spark, d, "orders")
    test = train.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    rows = schema.contract_rows(train.columns, test.columns, None, "o_orderstatus", ["o_orderkey", "o_orderstatus"], "o_orderkey")
    return schema.contract_report(spark, rows).unionByName(checks.null_ids(test, "o_orderkey", "o_custkey"))


@query(
    "s6_column_contract",
    """select * from (values ('target_in_train', 'ok', 0::bigint, ''), ('target_not_in_test', 'ok', 0::bigint, ''), ('id_in_both', 'ok', 0::bigint, ''),
    ('train_matches_test', 'fail', 2::bigint, 'o_totalprice<>o_orderdate,o_orderdate<>o_totalprice'), ('required_in_train', 'ok', 0::bigint, ''),
    ('required_in_test', 'ok', 0::bigint, '')) t("check", status, n, examples)
    union all select 'null_id', case when count(*) > 0 then 'fail' else 'ok' end, count(*), coalesce(string_agg(cast(o_custkey as varchar), ','), '') from orders where o_orderkey is null""",
)
def column_contract(spark, d):
    return _orders_contract(spark, d)


def _status(check: str, bad: str, value: str, order: str, source: str) -> str:
    """A check row: number of bad rows and the first ten distinct examples."""
    return (
        f"select '{check}' as \"check\", case when n > 0 then 'fail' else 'ok' end as status, n, coalesce(e, '') as examples from"
        f" (select count(*) as n from {source} where {bad}), (select string_agg(coalesce(v, 'NULL'), ',' order by r) as e from"
        f" (select v, row_number() over (order by o, v) as r from (select distinct cast({value} as varchar) as v, {order} as o from {source} where {bad})) where r <= 10)"
    )


_ORDERS_NULL = "(select *, case when o_orderkey % 97 = 0 then null else o_orderkey end as id from orders)"
_S7 = _status("null_id", "id is null", "o_custkey", "o_custkey", _ORDERS_NULL)


def _null_ids(spark, d):
    df = table(spark, d, "orders").withColumn("id", F.expr("case when o_orderkey % 97 = 0 then null else o_orderkey end"))
    return checks.null_ids(df, "id", "o_custkey")


@query("s7_null_ids", _S7)
def null_ids(spark, d):
    return _null_ids(spark, d)


_S8 = """select 'duplicate_id' as "check", case when n > 0 then 'fail' else 'ok' end as status, n, coalesce(e, '') as examples from
    (select cast(coalesce(sum(c - 1), 0) as bigint) as n from (select count(*) as c from lineitem group by l_orderkey)),
    (select string_agg(cast(l_orderkey as varchar), ',' order by l_orderkey) as e from (select l_orderkey from lineitem group by l_orderkey having count(*) > 1 order by 1 limit 10))"""


@query("s8_duplicate_ids", _S8)
def duplicate_ids(spark, d):
    return checks.duplicate_ids(table(spark, d, "lineitem"), "l_orderkey")


@query("s8_id_flags", "select count(*) as rows, count(distinct l_orderkey) as id_unique, count(*) <> count(distinct l_orderkey) as has_duplicates from lineitem")
def id_flags(spark, d):
    return checks.id_flags(table(spark, d, "lineitem"), "l_orderkey")


def _extra(check: str, a: str, b: str) -> str:
    bad = f"(select id from {a} where id not in (select id from {b}))"
    return (
        f"select '{check}', case when n > 0 then 'fail' else 'ok' end, n, coalesce(e, '') from (select count(distinct id) as n from {bad}),"
        f" (select string_agg(cast(id as varchar), ',' order by id) as e from (select distinct id from {bad} order by id limit 10))"
    )


_ORDER_IDS, _LINE_IDS = "(select o_orderkey as id from orders)", "(select l_orderkey * 2 as id from lineitem)"


@query(
    "s9_same_ids",
    "select 'row_count' as \"check\", case when a <> b then 'fail' else 'ok' end as status, abs(a - b) as n, concat(a, '<>', b) as examples from"
    " (select count(*) as a from orders), (select count(*) as b from lineitem)"
    f" union all {_extra('extra_in_orders', _ORDER_IDS, _LINE_IDS)} union all {_extra('extra_in_lines', _LINE_IDS, _ORDER_IDS)}",
)
def same_ids(spark, d):
    left = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    right = table(spark, d, "lineitem").select((F.col("l_orderkey") * 2).alias("id"))
    return checks.same_ids(left, right, "id", ("orders", "lines"))


@query(
    "s10_same_order",
    """select 'id_order' as "check", case when count(*) > 0 then 'fail' else 'ok' end as status, count(*) as n,
       coalesce(concat(min(event_id), ':', arg_min(user_id, event_id), '<>', arg_min(user_id + 1, event_id)), '') as examples
       from events where event_id % 1000 = 7""",
)
def same_order(spark, d):
    left = table(spark, d, "events").select(F.col("event_id").alias("pos"), F.col("user_id").alias("id"))
    right = left.withColumn("id", F.when(F.col("pos") % 1000 == 7, F.col("id") + 1).otherwise(F.col("id")))
    return checks.same_order(left, right, "id", "pos")


@query("s10_row_numbers", "select doc_id, row_number() over () as position from documents")
def row_numbers(spark, d):
    """Each document's place in the table's files."""
    return src.numbered_rows(table(spark, d, "documents")).select("doc_id", "position")


@query(
    "s10_file_order",
    """select 'id_order' as "check", 'ok' as status, 0::bigint as n, '' as examples, 'same' as pair union all
       select 'id_order', 'fail', count(*), concat(min(p), ':', arg_min(a, p), '<>', arg_min(b, p)), 'shifted' from
       (select row_number() over () as p, event_id as a, event_id + cast(event_id % 50 = 1 as integer) as b from events) where a <> b""",
)
def file_order(spark, d):
    """Two CSV files in the events' order, and one with some ids changed, compared by their rows' own places."""
    rows = src.numbered_rows(table(spark, d, "events"), "p").select(F.col("event_id").alias("id"), "p")
    changed = rows.withColumn("id", F.col("id") + (F.col("id") % 50 == 1).cast("int"))
    paths = [scratch_path(spark, "ordered-csv") for _ in range(3)]
    for df, path in zip((rows, rows, changed), paths):
        src.write_clean(df.repartitionByRange(4, "p").sortWithinPartitions("p").select("id"), path, "csv")
    a, b, c = (src.numbered_rows(src.read_csv(spark, path)) for path in paths)
    same = checks.same_order(a, b, "id", "position").withColumn("pair", F.lit("same"))
    return same.unionByName(checks.same_order(a, c, "id", "position").withColumn("pair", F.lit("shifted")))


_TARGET = "case when o_orderkey % 501 = 3 then o_orderstatus else cast(o_custkey as string) end"
_S11 = _status("target_numeric", "t is null or try_cast(t as double) is null", "concat(o_orderkey, ':', t)", "o_orderkey", f"(select *, {_TARGET} as t from orders)")


def _numeric_target(spark, d):
    return checks.numeric_target(table(spark, d, "orders").withColumn("t", F.expr(_TARGET)), "t", "o_orderkey")


@query("s11_numeric_target", _S11)
def numeric_target(spark, d):
    return _numeric_target(spark, d)


_LABEL = "case when event_id % 50 = 0 then event_type else cast(user_id % 7 as string) end"


@query(
    "s13_label_sanity",
    f"""select count(*) filter (where l is null) as label_missing, count(distinct l) as n_classes,
        (select string_agg(cast(l as varchar), ',' order by l) from (select distinct try_cast({_LABEL} as bigint) as l from events) where l is not null) as labels_sorted
        from (select try_cast({_LABEL} as bigint) as l from events)""",
)
def label_sanity(spark, d):
    return checks.label_sanity(table(spark, d, "events").withColumn("t", F.expr(_LABEL)), "t")


@query("s14_all_checks", f"{_S7} union all {_S8} union all {_S11}")
def all_checks(spark, d):
    return checks.run_all([_null_ids(spark, d), duplicate_ids(spark, d), _numeric_target(spark, d)])


@query("s15_clean_sink", "select doc_id, lang, source, n_chars, text from documents")
def clean_sink(spark, d):
    path = scratch_path(spark, "clean")
    src.write_clean(docs(spark, d), path)
    return spark.read.parquet(path).select("doc_id", "lang", "source", "n_chars", "text")


@query(
    "s16_report_sink",
    "select 'o_orderkey' as \"column\", count(*) filter (where o_orderkey is null) as missing_count, 0.0::double as missing_rate from orders"
    " union all select 'id', count(*) filter (where o_orderkey % 97 = 0), round(avg(case when o_orderkey % 97 = 0 then 1.0 else 0.0 end), 9) from orders",
)
def report_sink(spark, d):
    df = table(spark, d, "orders").withColumn("id", F.expr("case when o_orderkey % 97 = 0 then null else o_orderkey end"))
    report, path = profiling.missing_table(df, ["o_orderkey", "id"]), scratch_path(spark, "report")
    src.write_report(report, path)
    return src.read_report(spark, path, report.schema).withColumn("missing_rate", F.round("missing_rate", 9))


# Eight models scoring eight classes: all 64 entries of the embedding vectors.
SCORES_SQL = (
    "(select concat('m', m) as model, vec_id as row_id, cast(l as bigint) as label, cast(l as integer) as label_pos,"
    " cast(embedding[m * 8 + l + 1] as double) * 6 as score, label % 5 as y from embeddings, range(8) t(m), range(8) u(l))"
)


def scores(spark, d):
    df = table(spark, d, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") % 5).alias("y"), F.posexplode("embedding").alias("i", "v")
    )
    return df.select(
        F.concat(F.lit("m"), F.floor(F.col("i") / 8).cast("string")).alias("model"), "row_id", (F.col("i") % 8).cast("long").alias("label"),
        (F.col("i") % 8).cast("int").alias("label_pos"), (F.col("v").cast("double") * 6).alias("score"), "y",
    )


@query("s17_score_store", f"select model, row_id, label, label_pos, score from {SCORES_SQL}")
def score_store(spark, d):
    path = scratch_path(spark, "scores")
    src.save_scores(scores(spark, d), path)
    return src.load_scores(spark, path, labels=8)


@query("s17_score_shape", f"select model, count(distinct row_id) as n_rows, count(distinct label) as n_labels, count(*) as n_cells, count(*) = count(distinct row_id) * count(distinct label) as complete from {SCORES_SQL} group by model")
def score_shape(spark, d):
    return src.score_shape(scores(spark, d))
