"""Phone numbers inside free text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable.functions.binding import bind, rewrite_matches
from voxtable.lexicon import LONG_DIGITS
from voxtable.regexes import java

# A chunk is the longest run of digits and separators that starts and ends with a digit.
# Starting at the first digit of a run is implied by leftmost matching; only an optional
# plus sign has to check that no digit stands before it. The look at the next character
# passes over everything else.
CHUNK = java(r"(?=[+\d])(?:(?<!\d)\+)?\d[\d\s\-.]{6,}\d")
# fixed values: national forms, mobile without its zero, and the 213 country code
_NUMBER = java(r"^(?:(?:00)?213\d{8,10}|0\d{8,9}|[567]\d{8})$")
_WRONG_COUNTRY_FORM = java(r"^(?:00)?213(?!\d{8,10}$)")


def is_phone(digits: Column) -> Column:
    """Is a digit string a phone number?"""
    return digits.rlike(_NUMBER) & ~digits.rlike(_WRONG_COUNTRY_FORM)


def _digits(chunk: Column) -> Column:
    return F.regexp_replace(chunk, java(r"\D+"), "")


def phone_chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def mask_phones(text: Column, token: str = "<PHONE>") -> Column:
    """Replace every chunk whose digits form a phone number; other chunks stay."""
    return rewrite_matches(text, CHUNK, lambda c: F.when(is_phone(_digits(c)), F.lit(token)).otherwise(c))


def has_phone(text: Column) -> Column:
    """Does a text still hold a phone number? The chunk test runs first, it is cheap."""

    def found(t: Column) -> Column:
        return t.rlike(CHUNK) & F.exists(phone_chunks(t), lambda c: is_phone(_digits(c)))

    return bind(text, found)


def mask_long_digits(text: Column, token: str = "<NUM>", min_digits: int = 6) -> Column:
    pattern = java(LONG_DIGITS) if min_digits == 6 else java(rf"\d{{{min_digits},}}")
    return F.regexp_replace(text, pattern, token)
