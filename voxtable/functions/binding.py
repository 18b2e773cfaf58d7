"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` present once, however often the body uses it.

    Filters on a cleaned column are pushed below the cleaning, which copies its expressions
    into the filter. With one occurrence of the input per step the copy stays as long as
    the chain; otherwise it would grow exponentially with the number of steps.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


# Set around the matches of a pattern; texts that hold it themselves take the longer way.
_MARK = "\x01"


def rewrite_matches(text: Column, pattern: str, image: Callable[[Column], Column]) -> Column:
    """``text`` with each match of ``pattern`` replaced by ``image(match)``, which must not be null.

    The pattern passes over the text once, and ``image`` sees the matches alone, so a step that
    takes many patterns pays for them only where one of them can apply.
    """

    def marked(t: Column) -> Column:
        parts = F.split(F.regexp_replace(t, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
        return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, image(part)).otherwise(part)), "")

    def cut(t: Column) -> Column:
        shown = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), image)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), shown, lambda part, c: F.concat(part, F.coalesce(c, F.lit("")))), "")

    return bind(text, lambda t: F.when(t.contains(_MARK), cut(t)).otherwise(marked(t)))
