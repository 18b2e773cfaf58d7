"""Cleaning of categorical, numeric and time values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.config import UNK
from voxtable.functions.binding import bind
from voxtable.functions.text import collapse_spaces, strip_accents
from voxtable.lexicon import BRACKET_SUFFIX, DOUBLED_PLATFORMS, PAREN_CODE
from voxtable.regexes import java

# fixed values: timestamp layouts tried in order, ISO and month-first before day-first
TIME_LAYOUTS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd",
    "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy/M/d",
    "M/d/yyyy H:mm:ss", "M/d/yyyy H:mm", "M/d/yyyy", "M-d-yyyy H:mm:ss", "M-d-yyyy H:mm", "M-d-yyyy",
    "d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "d/M/yyyy", "d-M-yyyy H:mm:ss", "d-M-yyyy H:mm", "d-M-yyyy",
)


def or_unknown(value: Column) -> Column:
    """NULL and blank become the missing marker."""
    return bind(value, lambda v: F.coalesce(F.nullif(v, F.lit("")), F.lit(UNK)))


def clean_category(value: Column, remove_accents: bool = True, lower: bool = True) -> Column:
    """Trim and collapse; missing becomes UNK and keeps its case."""

    def shown(v: Column) -> Column:
        plain = strip_accents(v) if remove_accents else v
        return F.when(F.coalesce(v, F.lit("")).isin("", UNK), F.lit(UNK)).otherwise(F.lower(plain) if lower else plain)

    return bind(collapse_spaces(value.cast("string")), shown)


def drop_bracket_suffix(value: Column) -> Column:
    """``oss sdm [used by system]`` becomes ``oss sdm``; nothing left becomes UNK."""
    return or_unknown(F.trim(F.regexp_replace(value, java(BRACKET_SUFFIX), "")))


def unify_residential(value: Column, lower: bool = True) -> Column:
    return F.when(F.lower(value).startswith("resid"), F.lit("residential" if lower else "Residential")).otherwise(value)


def trailing_code(value: Column) -> Column:
    """Code in trailing parentheses, NULL when there is none."""
    return F.nullif(collapse_spaces(F.regexp_extract(F.coalesce(value, F.lit("")), java(PAREN_CODE), 1)), F.lit(""))


def clean_platform(value: Column) -> Column:
    """Platform name as a lower-case token; doubled names are undone."""

    def token(v: Column) -> Column:
        doubled = F.regexp_extract(F.replace(v, F.lit(" "), F.lit("")), "^(" + "|".join(DOUBLED_PLATFORMS) + r")\1$", 1)
        return F.coalesce(F.nullif(doubled, F.lit("")), F.trim(F.regexp_replace(v, "[^a-z0-9]+", "_"), F.lit("_")))

    return or_unknown(bind(F.lower(strip_accents(collapse_spaces(value))), token))


def parse_time(value: Column) -> Column:
    """First layout that fits; values that fit none become NULL."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(value), F.lit(layout)) for layout in TIME_LAYOUTS])


def to_long(value: Column) -> Column:
    """Nullable whole number (``"3"``, ``"3.0"``); anything else becomes NULL."""
    wide = value.try_cast("double")
    return F.coalesce(value.try_cast("bigint"), F.when(wide == F.floor(wide), wide.try_cast("bigint")))


def is_number(value: Column) -> Column:
    return value.try_cast("double").isNotNull()
