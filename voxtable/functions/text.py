"""Free-text cleaning steps, each ``Column -> Column``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxtable import lexicon as lx
from voxtable.functions.binding import bind, rewrite_matches
from voxtable.functions.phones import mask_long_digits, mask_phones
from voxtable.functions.unicode_forms import nfkc, strip_accents
from voxtable.regexes import SPACE, any_edged, java

# Matches only what has to change: runs of blanks, or one blank that is not a plain space.
# The look at the next character passes over visible ASCII.
_BLANKS = rf"(?=[^!-~])(?: [{SPACE}]+|[{SPACE}&&[^ ]][{SPACE}]*)"
_URL, _EMAIL = java(lx.URL, ignore_case=True), java(lx.EMAIL, ignore_case=True, word_inside=False)
# A whole run of the characters of addresses with an at sign in it; what stands around it is no
# word character, so the address pattern finds the same inside the run alone.
_AT_RUN = java(r"(?<![\w.+\-@])[\w.+\-]*+@[\w.+\-@]*+")
# Spellings between word edges in one pattern. Their matches share no word with a spelling of another
# rule but the longer idoom fibre, and no token made by one starts another.
_EDGED = [(p, t) for p, t in lx.TELECOM_SPELLINGS if p.startswith(r"\b(")]
_SPELT = [(b, token) for p, token in _EDGED for b in p.removeprefix(r"\b(").removesuffix(r")\b").split("|")]
_SPELLING = any_edged([b + r"\b" for b, _ in _SPELT], ignore_case=True)
# Spellings without blanks, of the branches that are letters and blanks only; the rules take what is not here.
_TOKENS = {key: token for b, token in reversed(_SPELT) if (key := b.replace(r"\s*", "")).replace("/", "").isalnum()}


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, _BLANKS, " "))


def plain_unicode(text: Column) -> Column:
    """NFKC, line breaks to spaces, zero-width and direction marks removed."""
    spaced = F.replace(F.replace(nfkc(text), F.lit("\r"), F.lit(" ")), F.lit("\n"), F.lit(" "))
    return F.regexp_replace(spaced, lx.ZERO_WIDTH, "")


def split_separators(text: Column) -> Column:
    return F.regexp_replace(text, lx.SEPARATORS, " ")


def split_colons(text: Column) -> Column:
    return F.regexp_replace(text, java(lx.COLON_IN_WORD), " ")


def mask_urls(text: Column, token: str = "<URL>") -> Column:
    return F.regexp_replace(text, _URL, token)


def mask_emails(text: Column, token: str = "<EMAIL>") -> Column:
    """E-mail masking; texts without an at sign skip the pattern, others take it around at signs."""
    masked = lambda t: rewrite_matches(t, _AT_RUN, lambda run: F.regexp_replace(run, _EMAIL, token))
    return bind(text, lambda t: F.when(t.contains("@"), masked(t)).otherwise(t))


def mask_pii_steps(url: str, email: str, phone: str, number: str | None, min_digits: int = 6) -> list:
    """The masking steps in order; applied one Project each so no step is repeated."""
    steps = [
        lambda c: mask_urls(c, url),
        lambda c: mask_emails(c, email),
        lambda c: mask_phones(c, phone),
    ]
    if number is not None:
        steps.append(lambda c: mask_long_digits(c, number, min_digits))
    return steps


def pad_ticket_tokens(text: Column) -> Column:
    """Space around a placeholder that touches non-blank text on both sides."""
    return F.regexp_replace(text, java(r"(?<!\s)(<PHONE>|<NUM>)(?!\s)"), " $1 ")


def pad_tokens(text: Column, tokens) -> Column:
    return reduce(lambda c, tok: F.replace(c, F.lit(tok), F.lit(f" {tok} ")), tokens, text)


def has_arabic(text: Column) -> Column:
    """Arabic letters? ASCII texts are told by their bytes, and other letters by one range."""
    return (F.octet_length(text) > F.char_length(text)) & text.rlike(f"[\u0600-\u08ff&&{lx.ARABIC}]")


def normalize_arabic(text: Column) -> Column:
    """Drop tatweel and diacritics, unify letter variants; texts without Arabic pass through."""

    def unified(t: Column) -> Column:
        bare = F.regexp_replace(F.replace(t, F.lit(lx.TATWEEL), F.lit("")), lx.ARABIC_MARKS, "")
        return F.translate(bare, "".join(lx.ARABIC_VARIANTS), "".join(lx.ARABIC_VARIANTS.values()))

    return bind(text, lambda t: F.when(has_arabic(t), unified(t)).otherwise(t))


def canonicalize_telecom(text: Column) -> Column:
    """The spelling rules in order: Latin ones on what one of them matches, Arabic ones in texts with Arabic."""

    def applied(t: Column, rules) -> Column:
        return reduce(lambda c, rule: F.regexp_replace(c, java(rule[0], ignore_case=True), rule[1]), rules, t)

    arabic = [rule for rule in lx.TELECOM_SPELLINGS if rule not in _EDGED]
    known = F.create_map(*[F.lit(v) for pair in _TOKENS.items() for v in pair])
    token = lambda m: F.coalesce(F.try_element_at(known, F.lower(F.replace(m, F.lit(" "), F.lit("")))), applied(m, _EDGED))
    latin = rewrite_matches(text, _SPELLING, token)
    return bind(latin, lambda t: F.when(has_arabic(t), applied(t, arabic)).otherwise(t))


def split_scripts(text: Column) -> Column:
    """Space wherever Arabic and Latin letters touch."""
    a, b = lx.ARABIC, lx.LATIN
    edge = f"(?<={a})(?={b})|(?<={b})(?={a})"
    return bind(text, lambda t: F.when(has_arabic(t), F.regexp_replace(t, edge, " ")).otherwise(t))


def squash_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, f"([{lx.PUNCTUATION}])\\1{{2,}}", "$1")


def reduce_elongations(text: Column) -> Column:
    return F.regexp_replace(text, r"([a-z])\1{2,}", "$1$1")


__all__ = [
    "canonicalize_telecom", "collapse_spaces", "has_arabic", "mask_emails", "mask_long_digits", "mask_phones", "mask_pii_steps",
    "mask_urls", "nfkc", "normalize_arabic", "pad_ticket_tokens", "pad_tokens", "plain_unicode",
    "reduce_elongations", "split_colons", "split_scripts", "split_separators", "squash_punctuation", "strip_accents",
]
