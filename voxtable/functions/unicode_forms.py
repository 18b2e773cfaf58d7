"""Unicode normal forms as Column expressions.

NFKD followed by dropping combining marks works character by character (reordering only
moves marks that are dropped), so it is a plain character mapping, applied to the runs outside ASCII alone. Latin letters with a one-letter
image go through a short ``translate``, others with one through a long one; the rest
(ligatures, Hangul, ...) are split out and looked up, only in runs that hold one. NFKC additionally composes, which is not
character-wise; one Arrow function does it for all rows, at a tenth of what it takes to tell in
the JVM which rows need it and to map the others.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from voxtable.functions.binding import rewrite_matches

_HANGUL = range(0xAC00, 0xD7A4)


def _as_class(points: list[int]) -> str:
    """Character class covering sorted code points, written as ranges."""
    runs: list[list[int]] = []
    for p in points:
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(rf"\x{{{a:X}}}" + (rf"-\x{{{b:X}}}" if b > a else "") for a, b in runs) + "]"


def _assigned():
    """Code points with decompositions or combining classes all lie in these blocks."""
    blocks = (range(0x80, 0x20000), range(0x2F800, 0x2FA20))
    return (p for block in blocks for p in block if not 0xD800 <= p < 0xE000 and p not in _HANGUL)


@lru_cache(maxsize=1)
def _bare_tables():
    """(dropped, one-to-one, expanding) parts of the "decompose and drop marks" mapping."""
    dropped, single, expanding = [], {}, {}
    for p in _assigned():
        ch = chr(p)
        bare = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if bare == ch:
            continue
        if bare == "":
            dropped.append(ch)
        elif len(bare) == 1:
            single[ch] = bare
        else:
            expanding[ch] = bare
    return dropped, single, expanding


# Blocks most feedback text is made of: Latin, Arabic, general punctuation, currency, emoji.
_FREQUENT = (range(0x00, 0x180), range(0x600, 0x700), range(0x2010, 0x203B), range(0x20A0, 0x20C0), range(0x1F300, 0x1FB00))


def _inert(special) -> str:
    """Ranges of frequent characters outside ``special``, as the inside of a class.

    Java tests the ranges of a class one by one, so long classes are only ever applied to
    what is left after these few ranges are taken out.
    """
    return _as_class([p for block in _FREQUENT for p in block if p not in special])[1:-1]


def _map_rare(text: Column, inert: str, image) -> Column:
    """Replace single characters outside the inert ranges by ``image(char)``."""
    pieces = F.regexp_extract_all(text, F.lit(f"[{inert}]+|[^{inert}]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda s: F.when(F.char_length(s) == 1, image(s)).otherwise(s)), "")


def _looked_up(table: dict[str, str]):
    """Lookup of a character in one string literal of ``key SOH value STX`` entries."""
    text = F.lit("\x02" + "\x02".join(f"{k}\x01{v}" for k, v in table.items()) + "\x02")

    def image(ch: Column) -> Column:
        key = F.concat(F.lit("\x02"), ch, F.lit("\x01"))
        return F.when(F.contains(text, key), F.substring_index(F.call_function("substring_index", text, key, F.lit(-1)), "\x02", 1)).otherwise(ch)

    return image


def _hangul_parts(ch: Column) -> Column:
    at = F.ascii(ch) - 0xAC00
    lead = F.array(*[F.lit(chr(0x1100 + i)) for i in range(19)])
    vowel = F.array(*[F.lit(chr(0x1161 + i)) for i in range(21)])
    tail = F.array(F.lit(""), *[F.lit(chr(0x11A8 + i)) for i in range(27)])
    return F.concat(
        F.get(lead, F.floor(at / 588).cast("int")),
        F.get(vowel, F.floor((at % 588) / 28).cast("int")),
        F.get(tail, (at % 28).cast("int")),
    )


@lru_cache(maxsize=1)
def _bare_parts():
    dropped, single, expanding = _bare_tables()
    moved = "".join(single) + "".join(dropped), "".join(single.values())
    return moved, expanding, _inert({ord(c) for c in expanding}), _as_class(sorted(map(ord, expanding)))


def strip_accents(text: Column) -> Column:
    """NFKD without combining marks, exact for every character and fully inside the JVM."""
    (moved, meant), expanding, inert, wide = _bare_parts()
    syllables = r"[\x{AC00}-\x{D7A3}]"
    mapped = _looked_up(expanding)

    def image(ch: Column) -> Column:
        return F.when(ch.rlike(syllables), _hangul_parts(ch)).otherwise(mapped(ch))

    latin = [(m, i) for m, i in zip(moved, meant) if ord(m) < 0x180]
    short = "".join(m for m, _ in latin), "".join(i for _, i in latin)

    def stripped(t: Column) -> Column:
        bare = F.translate(t, moved, meant)
        leftover = F.regexp_replace(t, f"[{inert}]+", "")
        expands = t.rlike(f"[^{inert}]") & leftover.rlike(f"{wide}|{syllables}")
        return F.when(expands, _map_rare(bare, inert, image)).otherwise(bare)

    def run(t: Column) -> Column:
        easy = F.translate(t, *short)
        return F.when(F.octet_length(easy) == F.char_length(t), easy).otherwise(stripped(t))

    return rewrite_matches(text, r"[^\x00-\x7F]+", run)


def _normalized(texts: pa.Array) -> pa.Array:
    return pa.array([None if s is None else unicodedata.normalize("NFKC", s) for s in texts.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Unicode NFKC of whole texts in an Arrow function, whose quick check passes over texts in that form.

    Called nondeterministic so that no plan copies the call into every use of its result.
    """
    return F.arrow_udf(_normalized, StringType()).asNondeterministic()(text)
