"""Feature columns: time parts, text counts, keyword flags, extracted numbers, text prefixes."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.config import UNK, CommentConfig
from voxtable.functions.binding import bind
from voxtable.functions.text import has_arabic
from voxtable.regexes import SPACE, WORD, any_edged, branches, java, opened

_ARABIC_LETTER, _OTHER_LETTER = re.compile("[\u0620-\u064a]"), re.compile("(?<!\\\\)[A-Za-z]|[\u2000-\U0010ffff]")
MISSING = -1.0


def _number(value: Column) -> Column:
    return value.cast("float")


def _or_missing(value: Column) -> Column:
    return F.coalesce(_number(value), F.lit(MISSING).cast("float"))


def day_ordinal(when: Column) -> Column:
    """Days since 1970-01-01 with the time of day as fraction; independent of the time zone."""
    seconds = F.hour(when) * 3600 + F.minute(when) * 60 + F.extract(F.lit("SECOND"), when).cast("double")
    return F.datediff(when, F.lit("1970-01-01").cast("date")) + seconds / 86400.0


def time_features(when: Column) -> dict[str, Column]:
    """Calendar parts of a timestamp; every part is -1 where the time is missing."""
    weekday = F.weekday(when)
    parts = {
        "handle_year": F.year(when),
        "handle_month": F.month(when),
        "handle_day": F.dayofmonth(when),
        "handle_dayofyear": F.dayofyear(when),
        "handle_dayofweek": weekday,
        "handle_hour": F.hour(when),
        "handle_minute": F.minute(when),
        "handle_iso_week": F.weekofyear(when),
        "handle_time_ordinal": day_ordinal(when),
        "handle_is_weekend": (weekday >= 5).cast("int"),
    }
    out = {name: _or_missing(part) for name, part in parts.items()}
    out["handle_time_missing"] = _number(when.isNull().cast("int"))
    return out


def word_count(text: Column) -> Column:
    """Words counted as the length of the text with one character left of each."""
    inside = f"[!-~[^{SPACE}]]"
    return F.char_length(F.regexp_replace(text, f"({inside}){inside}*+[{SPACE}]*+|^[{SPACE}]++", "$1"))


def digit_count(text: Column) -> Column:
    """Digits counted by the length they leave behind: one pass over runs, not single digits."""
    return F.char_length(text) - F.char_length(F.regexp_replace(text, java(r"\d+"), ""))


def punct_count(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, lx.PUNCTUATION, ""))


def flag(condition: Column) -> Column:
    return _number(condition.cast("int"))


def spotted(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    """Does the pattern occur? Its Arabic branches are only tried in texts with Arabic letters."""
    arabic = [b for b in branches(pattern) if _ARABIC_LETTER.search(b) and not _OTHER_LETTER.search(b)]
    other = [b for b in branches(pattern) if b not in arabic]
    parts = [text.rlike(java("|".join(other), ignore_case))] if other else []
    if arabic:
        parts.append(text.rlike(lx.ARABIC) & text.rlike(java("|".join(arabic), ignore_case)))
    return reduce(lambda a, b: a | b, parts)


def _at_edge(branch: str) -> bool:
    """Does a branch start with a word edge and a plain letter or digit?"""
    return branch.startswith(r"\b") and branch[2:3].isalnum() and branch[3:4] not in ("?", "*", "+", "{")


def keyword_places(text: Column, patterns: Iterable[str]) -> Column:
    """The words at which a branch with a word edge may start, each with as many words as a branch can span.

    A branch that starts with a word edge occurs in a text without Arabic letters if and only if it
    occurs here; a text with Arabic letters comes back whole. The pattern passes over the text once
    for all keywords, which are then looked for in a few words.
    """
    edged = dict.fromkeys(b for p in patterns for b in opened(p) if _at_edge(b))
    if not edged:
        return text
    gaps = max(b.count(r"\s") for b in edged)
    words = f"[{WORD}]+(?:[{SPACE}]+[{WORD}]+){{0,{gaps}}}"
    start = any_edged([b[2:] for b in edged], ignore_case=True, ahead=True)
    places = F.regexp_extract_all(text, F.lit(f"{start}(?=({words}))"), F.lit(1))
    return F.when(has_arabic(text), text).otherwise(F.array_join(places, "\x00"))


def spotted_at(text: Column, places: Column, pattern: str, ignore_case: bool = True) -> Column:
    """``spotted``, with the branches that ``places`` were made for looked for there."""
    parts = opened(pattern)
    arabic = [b for b in parts if _ARABIC_LETTER.search(b) and not _OTHER_LETTER.search(b)]
    here = [b for b in parts if _at_edge(b) or b in arabic]
    rest = [b for b in parts if b not in here]
    tests = [places.rlike(java("|".join(here) if rest else pattern, ignore_case))] if here else []
    if rest:
        tests.append(text.rlike(java("|".join(rest), ignore_case)))
    return reduce(lambda a, b: a | b, tests)


def keyword_flags(text: Column, specs: Iterable[tuple[str, str]]) -> dict[str, Column]:
    """One 0/1 column per (name, pattern), ignoring case."""
    places = keyword_places(text, [pattern for _, pattern in specs])
    return {name: flag(spotted_at(text, places, pattern)) for name, pattern in specs}


def extracted_numbers(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """(count, maximum) of the numbers captured by ``pattern``; 0 and 0 without any.

    ``hint`` is a literal every match contains, tested first.
    """
    raw = F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(1))
    values = F.transform(raw, lambda n: F.replace(n, F.lit(","), F.lit(".")).try_cast("double"))
    present = text.contains(hint)
    count = F.when(present, F.size(raw)).otherwise(F.lit(0))
    largest = F.when(present, F.coalesce(F.array_max(values), F.lit(0.0))).otherwise(F.lit(0.0))
    return _number(count), _number(largest)


def ticket_text_features(text: Column, specs=lx.TICKET_KEYWORDS) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    mbps_n, mbps_max = extracted_numbers(text, lx.MBPS_VALUE, "mbps")
    mo_n, mo_max = extracted_numbers(text, lx.MO_VALUE, "mo")
    return {
        "text_len": _number(F.char_length(text)),
        "word_count": _number(word_count(text)),
        "digit_count": _number(digit_count(text)),
        "has_num_token": flag(text.contains("<NUM>")),
        "has_phone_token": flag(text.contains("<PHONE>")),
        "mbps_value_count": mbps_n,
        "mbps_value_max": mbps_max,
        "mo_value_count": mo_n,
        "mo_value_max": mo_max,
        **keyword_flags(text, specs),
    }


def comment_text_features(text: Column, cfg: CommentConfig, specs=lx.COMMENT_KEYWORDS) -> dict[str, Column]:
    text = F.coalesce(text, F.lit(""))
    return {
        "len_chars": _number(F.char_length(text)),
        "len_tokens": _number(word_count(text)),
        "digit_count": _number(digit_count(text)),
        "punct_count": _number(punct_count(text)),
        "has_phone_token": flag(text.contains(cfg.phone_token)),
        "has_url_token": flag(text.contains(cfg.url_token)),
        "has_email_token": flag(text.contains(cfg.email_token)),
        "has_id_token": flag(text.contains(cfg.id_token)),
        **keyword_flags(text, specs),
    }


def flag_total(names: Iterable[str]) -> Column:
    """Sum of flag columns, at most 100."""
    total = F.lit(0.0)
    for name in names:
        total = total + F.col(name)
    return _number(F.least(total, F.lit(100.0)))


def unknown_flag(value: Column) -> Column:
    return flag(F.coalesce(value.cast("string"), F.lit("")) == UNK)


# ---- text handed to a classifier ----

def platform_prefixed(platform: Column, text: Column) -> Column:
    return F.concat(
        F.lit("platform="), F.lower(F.coalesce(platform, F.lit("unk"))), F.lit(" "), F.coalesce(text, F.lit(""))
    )


def columns_prefixed(columns: list[str], text: Column) -> Column:
    """``col:value | col:value || text``; NULL values show as UNK."""
    body = F.coalesce(text, F.lit(""))
    if not columns:
        return body
    parts = [F.concat(F.lit(f"{c}:"), F.coalesce(F.col(c).cast("string"), F.lit(UNK))) for c in columns]
    return F.concat(F.concat_ws(" | ", *parts), F.lit(" || "), body)


def intent_flags(text: Column, allowed: set[str] | None = None) -> Column:
    """Array of the ``[FLAG]`` tokens whose pattern occurs in the text."""
    shown = [(n, p, i) for n, p, i in lx.INTENT_FLAGS if allowed is None or f"[{n}]" in allowed]
    if not shown:
        return F.array().cast("array<string>")

    def hits(t: Column, places: Column) -> Column:
        return F.array_compact(F.array(*[F.when(spotted_at(t, places, p, i), F.lit(f"[{n}]")) for n, p, i in shown]))

    return bind(text, lambda t: bind(keyword_places(t, [p for _, p, _ in shown]), lambda places: hits(t, places)))


def classifier_text(
    platform: Column,
    text: Column,
    add_meta: bool = True,
    add_flags: bool = False,
    allowed: set[str] | None = None,
) -> Column:
    """``[PLATFORM] p [FLAGS...] [TEXT] t``; tokens outside ``allowed`` are left out."""
    body = F.coalesce(text, F.lit(""))
    if not add_meta and not add_flags:
        return body
    parts = []
    if add_meta and (allowed is None or "[PLATFORM]" in allowed):
        parts.append(F.concat(F.lit("[PLATFORM] "), F.lower(F.coalesce(platform, F.lit("unk")))))
    if add_flags:
        parts.append(F.nullif(F.array_join(intent_flags(body, allowed), " "), F.lit("")))
    marker = "[TEXT] " if allowed is None or "[TEXT]" in allowed else ""
    return F.concat_ws(" ", *parts, F.concat(F.lit(marker), body))
