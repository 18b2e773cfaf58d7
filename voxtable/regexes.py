"""Java patterns with full-Unicode shorthands.

Java's ``\\w \\d \\s \\b`` are ASCII unless flags are set, and the flagged ``\\w`` also takes
combining marks. Spelling the classes out keeps one meaning on every JDK.
"""

from __future__ import annotations

WORD = r"\p{L}\p{N}_"
SPACE = r"\s\x1c-\x1f\x85\p{Z}"
DIGIT = r"\p{Nd}"
# Word edge between any two characters, needed where the inner side may be punctuation.
ANY_EDGE = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"

_OUTSIDE = {
    "w": f"[{WORD}]", "W": f"[^{WORD}]",
    "s": f"[{SPACE}]", "S": f"[^{SPACE}]",
    "d": f"[{DIGIT}]", "D": f"[^{DIGIT}]",
}
_INSIDE = {"w": WORD, "s": SPACE, "d": DIGIT}


def _first_letters(rest: str) -> str:
    """First characters a pattern can start with, when every branch starts with a plain one."""
    body = rest
    if rest.startswith("("):
        depth = end = 0
        for end, ch in enumerate(rest):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        body = rest[1:end].removeprefix("?:")
    if "(" in body.split("|")[0]:
        body = body.split("|")[0]
    depth, starts, fresh = 0, [], True
    for ch in body:
        if depth == 0 and fresh:
            starts.append(ch)
        fresh = depth == 0 and ch == "|"
        depth += (ch == "(") - (ch == ")")
    return "".join(dict.fromkeys(starts)) if all(c.isalnum() or ord(c) > 0x2000 for c in starts) else ""


def _letters(letters: str, ignore_case: bool) -> str:
    """Class of some letters, which lists both cases itself (with the long s, dotless i and Kelvin
    sign), because a plain class is a table lookup while a case-folding one is not."""
    if ignore_case:
        folds = {"s": "\u017f", "i": "\u0130\u0131", "k": "\u212a"}
        letters = "".join(dict.fromkeys(f for c in letters for f in (c, c.lower(), c.upper(), *folds.get(c.lower(), ""))))
    return f"[{letters}]"


def _peek(rest: str, ignore_case: bool) -> str:
    """Look at the next character first: one class test instead of every branch."""
    if rest.startswith((r"(\d", r"\d")) and "|" not in rest:
        return f"(?={DIGIT})"
    letters = _first_letters(rest)
    return f"(?-iu:(?={_letters(letters, ignore_case)}))" if letters else ""


def java(pattern: str, ignore_case: bool = False, word_inside: bool = True) -> str:
    """Spell out the shorthands of ``pattern``.

    ``word_inside`` says that every ``\\b`` has a word character on its inner side, so one
    outward look is enough; pass False where the match may start or end with punctuation.
    Opening edges first peek at the next letter, which is far cheaper than looking behind.
    """
    out, i, in_class = [], 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            code, rest = pattern[i + 1], pattern[i + 2:]
            if code == "b" and not in_class:
                closes = rest == "" or rest[0] in "|)"
                outward = f"(?![{WORD}])" if closes else f"{_peek(rest, ignore_case)}(?<![{WORD}])"
                out.append(outward if word_inside else ANY_EDGE)
            else:
                out.append((_INSIDE if in_class else _OUTSIDE).get(code, "\\" + code))
            i += 2
            continue
        if ch == "(" and pattern.startswith("(?:", i) and (i == 0 or pattern[i - 1] == "|"):
            out.append(_peek(pattern[i:], ignore_case))
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)


def any_edged(plain: list[str], ignore_case: bool = False, ahead: bool = False) -> str:
    """Any of some patterns after a word edge; each starts with a plain letter or digit, which is tested once for all.

    ``ahead`` only looks at the match, which is then empty.
    """
    by_first: dict[str, list[str]] = {}
    for body in plain:
        if not body[0].isalnum() or body[1:2] in ("?", "*", "+", "{"):
            raise ValueError(f"no plain first letter: {body}")
        by_first.setdefault(body[0], []).append(java(body[1:]))
    peek = f"(?-iu:(?={_letters(''.join(by_first), ignore_case)}))(?<![{WORD}])"
    tails = (f"(?-iu:{_letters(first, ignore_case)})(?:{'|'.join(rests)})" for first, rests in by_first.items())
    return ("(?iu)" if ignore_case else "") + peek + f"({'?=' if ahead else '?:'}{'|'.join(tails)})"


def opened(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern, and of groups that are a whole alternative or its start before a word edge."""
    out = []
    for b in branches(pattern):
        edge = r"\b" if b.startswith(r"\b") else ""
        body = b[len(edge):]
        depth = end = 0
        for end, ch in enumerate(body):
            depth += (ch == "(") - (ch == ")")
            if depth == 0:
                break
        tail = body[end + 1:]
        if body.startswith("(?:") and tail in ("", r"\b"):
            out += [o if not edge and not tail else edge + o + tail for o in opened(body[3:end])]
        else:
            out.append(b)
    return out


def branches(pattern: str) -> list[str]:
    """Top-level alternatives of a pattern."""
    depth, out = 0, [""]
    for ch in pattern:
        depth += (ch in "([") - (ch in ")]")
        if ch == "|" and depth == 0:
            out.append("")
        else:
            out[-1] += ch
    return out
