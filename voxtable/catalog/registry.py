"""Registry of queries over the shared test tables and their reference SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxtable import lexicon as lx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the ANSI SQL that must give the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# ---- SQL text that both engines read the same way ----

# Documents with contact data, addresses, references and telecom words added to every text.
NOISY = (
    "concat(text, ' Tel:+213 5', lpad(cast(doc_id as string), 8, '0'), ' NC:0655/', lpad(cast(doc_id % 1000 as string), 3, '0'),"
    " '/945 REF_', cast(doc_id * 7919 + 1000000 as string), ' https://Ex.com/', source, '?q=', cast(doc_id as string),"
    " ' Mail', cast(doc_id as string), '@ex-', lang, '.COM !!!! sloooow DÉBIT ', cast(doc_id % 100 as string), ',5 Mbps + ',"
    " cast(doc_id % 37 as string), ' mbps ', cast(doc_id % 64 as string), ' mo a:b:c pon  stable 4 G idoom fibre ns<NUM>x<PHONE>')"
)
# Latin letters turned into Arabic ones (with variants, tatweel and diacritics).
ARABIZED = "translate(text, 'aeiounrtsl', 'اأإآىـًٌةل')"
# A platform column with blanks, doubled names and missing values.
PLATFORM = (
    "case when doc_id % 11 = 0 then null when doc_id % 11 = 1 then '  ' when doc_id % 11 = 2 then 'FacebookFacebook'"
    " when doc_id % 11 = 3 then ' Twitter Twitter ' when doc_id % 11 = 4 then ' Idoom  Market!' when doc_id % 11 = 5 then"
    " 'Réseau É' else concat(upper(source), ' Page') end"
)
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def re2(pattern: str, ignore_case: bool = True) -> str:
    """A yes/no pattern for the reference engine, which has no lookaround."""
    body = re.sub(r"\\b(?=$|[|)])", lambda _: rf"(?:$|{NOT_WORD})", pattern)
    body = body.replace(r"\b", rf"(?:^|{NOT_WORD})").replace(r"\w", WORD)
    return ("(?i)" if ignore_case else "") + body


def has(column: str, pattern: str, ignore_case: bool = True) -> str:
    return f"regexp_matches({column}, '{re2(pattern, ignore_case)}')"


def gsub(column: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({column}, '{pattern}', '{replacement}', 'g')"


def squeeze(column: str) -> str:
    return f"trim({gsub(column, '[[:space:]]+', ' ')})"


def chain(column: str, steps) -> str:
    for step in steps:
        column = step(column)
    return column


PHONE_CHUNK = r"\+?\d[\d\s\-.]{6,}\d"


def is_phone(digits: str) -> str:
    return (
        f"(regexp_matches({digits}, '^((00)?213[0-9]{{8,10}}|0[0-9]{{8,9}}|[567][0-9]{{8}})$') and not"
        f" (regexp_matches({digits}, '^(00)?213') and not regexp_matches({digits}, '^(00)?213[0-9]{{8,10}}$')))"
    )


def mask_phones(column: str) -> str:
    """Cut around the chunks and put them back, masked where they are phone numbers."""
    digits = "regexp_replace(c, '[^0-9]', '', 'g')"
    return (
        f"array_to_string(list_transform(list_zip(regexp_split_to_array({column}, '{PHONE_CHUNK}'),"
        f" list_transform(regexp_extract_all({column}, '{PHONE_CHUNK}'), lambda c: case when {is_phone(digits)} then '<PHONE>' else c end)),"
        " lambda z: concat(z[1], coalesce(z[2], ''))), '')"
    )


def telecom(column: str) -> str:
    for pattern, token in lx.TELECOM_SPELLINGS:
        if r"\b" in pattern:
            inner = pattern.replace(r"\b", "")
            for _ in range(2):
                column = f"regexp_replace({column}, '(?i)(^|{NOT_WORD}){inner}($|{NOT_WORD})', '\\1{token}\\3', 'g')"
        else:
            column = gsub(column, pattern, token)
    return column
