"""Registered queries of this subpackage, each over its whole table, and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtable.llm import alignment, chat, decontam, langid, licences, linededup, neardup, phrases, pieces, quality, secrets, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_licence_scan")
def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files of a tree: source, language, thousand; short texts are licence files, the shorter the higher."""
    place, n = F.concat_ws("/", "source", "lang", F.floor(F.col("doc_id") / 1000)), F.length("text")
    name = F.concat(F.lit("LICENSE-"), F.col("doc_id"))
    path = (
        F.when(n < 120, F.concat_ws("/", "source", name)).when(n < 240, F.concat_ws("/", "source", "lang", name))
        .when(n < 400, F.concat_ws("/", place, name)).otherwise(F.concat_ws("/", place, F.concat("doc_id", F.lit(".txt"))))
    )
    return licences.scan(table(spark, folder, "documents"), path)


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.quality(docs, quality.train(docs, table(spark, folder, "labels")))


@query("op3_line_dedup")
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return linededup.line_dedup(table(spark, folder, "documents"))


@query("op4_perspective_rotation", chat.ORACLE)
def op4_perspective_rotation(spark: SparkSession, folder: str) -> DataFrame:
    return chat.rotate(table(spark, folder, "conversations"))


OP5_SQL = """
with recursive docs as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) as w from documents
), raw as (
  select doc_id, array_to_string(list_slice(w, i, i + 2), ' ') as s from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from docs where len(w) > 0)
), sh as (select distinct doc_id, s from raw),
sizes as (select doc_id, count(*) as n from sh group by doc_id),
-- Equal sets first: one member stands for them.
keyed as (select doc_id, md5(string_agg(s, chr(10) order by s)) as k from sh group by doc_id),
rep as (select doc_id, min(doc_id) over (partition by k) as r from keyed),
few as (select sh.doc_id, s, n from sh join rep on rep.doc_id = sh.doc_id and rep.r = rep.doc_id join sizes on sizes.doc_id = sh.doc_id),
shared as (
  select a.doc_id as x, b.doc_id as y, any_value(a.n) as nx, any_value(b.n) as ny, count(*) as met
  from few a join few b on a.s = b.s and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) group by a.doc_id, b.doc_id
), link as (select x, y from shared where 100 * met >= 85 * (nx + ny - met)),
edge as (select x, y from link union select y, x from link),
reach as (select x as node, x as seen from edge union select r.node, e.y from reach r join edge e on r.seen = e.x),
low as (select node, min(seen) as c from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(c, r, d.doc_id) as component_id, coalesce(c, r, d.doc_id) = d.doc_id as kept
from docs d left join sizes on sizes.doc_id = d.doc_id left join rep on rep.doc_id = d.doc_id left join low on low.node = rep.r
"""


@query("op5_near_duplicates", OP5_SQL)
def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"), words=3, percent=85)


@query("op6_sentencepiece")
def op6_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(table(spark, folder, "documents"))


def _words_sql(name: str, key: str) -> str:
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"select {key}, coalesce(regexp_extract_all({lower}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) as w from {name}"


OP9_SQL = f"""
with items as ({_words_sql("benchmark", "item_id")}),
docs as ({_words_sql("documents", "doc_id")}),
places as (select item_id, w, least(13, len(w)) as size, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0),
windows as (select distinct cast(item_id as varchar) as item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') as win from places),
spots as (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from docs, (select distinct size from windows) where len(w) >= size),
met as (
  select distinct doc_id, i, spots.size, item_id from spots
  join windows on spots.size = windows.size and array_to_string(list_slice(w, i, i + spots.size - 1), ' ') = win
), hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + size)) as p from met) group by doc_id),
listed as (
  select doc_id, count(*) as n_items, sha256(string_agg(item_id, ',' order by item_id)) as items_sha256
  from (select distinct doc_id, item_id from met) group by doc_id
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  coalesce(items_sha256, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from docs left join hit using (doc_id) left join listed using (doc_id)
"""


@query("op9_decontamination", OP9_SQL)
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    got = decontam.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return got.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query("op10_toxicity")
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, folder, "labels")))


@query("op11_language_id")
def op11_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.languages(docs, langid.train(docs))


OP12_SQL = r"""
with lines as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents
), spoken as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from lines),
one as (select lang, x as p, count(*) as f from (select lang, unnest(w) as x from spoken) group by lang, x),
two as (
  select lang, p1, p2, count(*) as f from (select lang, unnest(w[:-2]) as p1, unnest(w[2:]) as p2 from spoken where len(w) > 1) group by lang, p1, p2
), three as (
  select lang, p1, p2, p3, count(*) as f from (select lang, unnest(w[:-3]) as p1, unnest(w[2:-2]) as p2, unnest(w[3:]) as p3 from spoken where len(w) > 2) group by lang, p1, p2, p3
), longer as (
  select lang, p1, p2, max(f) as f from (select lang, p1, p2, f from three where f >= 10 union all select lang, p2, p3, f from three where f >= 10) group by lang, p1, p2
), twos as (
  select two.lang, two.p1 || ' ' || two.p2 as phrase, two.f as a, x.f as l, y.f as r, (cast(two.f as hugeint) * two.f * 1000000) // (cast(x.f as hugeint) * y.f) as score
  from two join one x on x.lang = two.lang and x.p = two.p1 join one y on y.lang = two.lang and y.p = two.p2
  left join longer on longer.lang = two.lang and longer.p1 = two.p1 and longer.p2 = two.p2
  where two.f >= 10 and (longer.f is null or 100 * longer.f < 50 * two.f)
), cuts as (
  select t.lang, t.p1 || ' ' || t.p2 || ' ' || t.p3 as phrase, t.f as a, x.f as l1, yz.f as r1, xy.f as l2, z.f as r2,
    (cast(t.f as hugeint) * t.f * 1000000) // (cast(x.f as hugeint) * yz.f) as s1, (cast(t.f as hugeint) * t.f * 1000000) // (cast(xy.f as hugeint) * z.f) as s2
  from three t join one x on x.lang = t.lang and x.p = t.p1 join one z on z.lang = t.lang and z.p = t.p3
  join two xy on xy.lang = t.lang and xy.p1 = t.p1 and xy.p2 = t.p2 join two yz on yz.lang = t.lang and yz.p1 = t.p2 and yz.p2 = t.p3 where t.f >= 10
), found as (
  select * from twos union all
  select lang, phrase, a, case when s2 < s1 then l2 else l1 end, case when s2 < s1 then r2 else r1 end, least(s1, s2) from cuts
), ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from found),
sizes as (select lang, sum(f) as n from one group by lang)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join sizes using (lang) where rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12_phrase_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_token_alignment")
def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.aligned(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
