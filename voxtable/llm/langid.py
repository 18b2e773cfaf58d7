"""Language of texts and of the spans of mixed texts.

A word is a run of letters (with their marks) of one script. The script narrows the languages a
word may be in to those that were learned with it; within these, hashed letter trigrams (each
letter with its neighbours or the word's edge) score the word. A Viterbi search over the words of
a text, with a penalty for each change of language, labels every word; equal neighbours form a
span. The language with most letters is the text's.

All statistics are counted over all rows learned from: letters per language and script, and
trigrams per language in ``BUCKETS`` buckets, so the model is bounded by the languages alone.

Defined results: a null or empty text, or one without a letter, is ``und`` with score 0 and no
spans; so is every text if nothing was learned. Marks without a letter are no word. In a script
that no language was learned with, all languages stay candidates. Ties go to the first language
in alphabetical order. Rows without an id or a language are never learned from, and rows without
an id are held out. Repeated rows are labelled alike; extra columns are ignored. The label,
source and id of a row never enter its prediction.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx

NONE = "und"
FOLDS, HELD_OUT = 4, 2
BITS = 17
BUCKETS = 1 << BITS
# Letters' worth of the average language that a bucket's estimate starts from.
PRIOR_LETTERS = 100_000.0
# A letter stands in three trigrams.
ORDER = 3
# What a change of language costs, and a word in a script the language does not use.
SWITCH, FOREIGN = 6.0, 50.0
# Share of its letters from which a language uses a script.
LEAST_SCRIPT_SHARE = 0.01
# Words handled as one step of the search over a text, and numbers of one table of that search.
CHUNK = 64
AT_ONCE = 1 << 21

# First and last code point of the scripts' letters (Unicode blocks).
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x0250, 0x02AF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("syriac", 0x0700, 0x074F), ("arabic", 0x0750, 0x077F), ("arabic", 0x0870, 0x08FF),
    ("devanagari", 0x0900, 0x097F), ("bengali", 0x0980, 0x09FF), ("gurmukhi", 0x0A00, 0x0A7F), ("gujarati", 0x0A80, 0x0AFF), ("oriya", 0x0B00, 0x0B7F),
    ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("kannada", 0x0C80, 0x0CFF), ("malayalam", 0x0D00, 0x0D7F), ("sinhala", 0x0D80, 0x0DFF),
    ("thai", 0x0E00, 0x0E7F), ("lao", 0x0E80, 0x0EFF), ("tibetan", 0x0F00, 0x0FFF), ("myanmar", 0x1000, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("mongolian", 0x1800, 0x18AF), ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("hangul", 0x3130, 0x318F), ("kana", 0x31F0, 0x31FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xA960, 0xA97F), ("hangul", 0xAC00, 0xD7FF), ("han", 0xF900, 0xFAFF), ("latin", 0xFB00, 0xFB06),
    ("hebrew", 0xFB1D, 0xFB4F), ("arabic", 0xFB50, 0xFDFF), ("arabic", 0xFE70, 0xFEFF), ("latin", 0xFF21, 0xFF5A), ("kana", 0xFF66, 0xFF9F),
    ("han", 0x20000, 0x3FFFF),
)
NAMES = (*dict.fromkeys(name for name, _, _ in SCRIPTS), "other")
_MARK = 255
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_EDGE = np.uint32(1)


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: 0 for no letter, script + 1 for a letter, _MARK for a mark; and its lower case."""
    kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    script = np.full(0x110000, NAMES.index("other") + 1, np.uint8)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name) + 1
    for c in [*range(0x40000), *range(0xE0100, 0xE01F0)]:
        char = chr(c)
        if char.isalpha():
            kind[c] = script[c]
            low = char.lower()
            if len(low) == 1:
                lower[c] = ord(low)
        elif unicodedata.category(char)[0] == "M":
            kind[c] = _MARK
    return kind, lower


@dataclass(frozen=True)
class Words:
    """The words of some texts: row, place (code points within the row), letters, script and trigram buckets."""

    rows: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    letters: np.ndarray
    scripts: np.ndarray
    buckets: np.ndarray
    firsts: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    kind, lower = _characters()
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    bounds = cx.running((data & 0xC0) != 0x80)[offsets]
    kinds = kind[chars]
    at = np.flatnonzero(kinds)
    if not len(at):
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, nothing, nothing, nothing, nothing, nothing)
    own = kinds[at]
    is_letter = own != _MARK
    # A mark has the script of the letter before it.
    script = own[np.maximum.accumulate(np.where(is_letter, np.arange(len(at)), 0))]
    rows = np.searchsorted(bounds, at, "right") - 1
    begins = np.ones(len(at), bool)
    begins[1:] = (at[1:] != at[:-1] + 1) | (rows[1:] != rows[:-1]) | (script[1:] != script[:-1])
    firsts = np.flatnonzero(begins)
    real = np.add.reduceat(is_letter, firsts, dtype=np.int64) > 0
    if not real.all():
        stays = np.repeat(real, np.diff(np.r_[firsts, len(at)]))
        at, rows, script, begins, is_letter = (x[stays] for x in (at, rows, script, begins, is_letter))
        firsts = np.flatnonzero(begins)
    if not len(at):
        nothing = np.zeros(0, np.int64)
        return Words(nothing, nothing, nothing, nothing, nothing, nothing, nothing)
    folded = lower[chars[at]]
    before, after = np.full(len(at), _EDGE), np.full(len(at), _EDGE)
    inner = np.flatnonzero(~begins)
    before[inner] = folded[inner - 1]
    after[inner - 1] = folded[inner]
    mix = before * _FACTORS[0] + folded * _FACTORS[1] + after * _FACTORS[2]
    mix ^= mix >> np.uint32(15)
    mix *= np.uint32(0x2C1B3C6D)
    mix ^= mix >> np.uint32(13)
    lasts = np.r_[firsts[1:], len(at)] - 1
    row = rows[firsts]
    return Words(
        row, at[firsts] - bounds[row], at[lasts] + 1 - bounds[row], np.add.reduceat(is_letter, firsts, dtype=np.int64),
        script[firsts].astype(np.int64) - 1, (mix >> np.uint32(32 - BITS)).astype(np.int64), firsts,
    )


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    ratios: np.ndarray  # (BUCKETS, languages), against the average language
    uses: np.ndarray  # (scripts, languages)

    def scores(self, found: Words) -> np.ndarray:
        """One row per word: log-ratio of every language; far below for languages the script rules out."""
        total = np.add.reduceat(self.ratios[found.buckets], found.firsts, axis=0).astype(np.float64) / ORDER
        return np.where(self.uses[found.scripts], total, total - FOREIGN)


def fit(languages: list[str], counts: np.ndarray, letters: np.ndarray) -> Model:
    """From trigrams per (language, bucket) and letters per (language, script)."""
    sizes = counts.sum(1, keepdims=True).astype(np.float64)
    average = (counts / np.maximum(sizes, 1)).mean(0)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log((counts / average + PRIOR_LETTERS) / (sizes + PRIOR_LETTERS))
    uses = letters >= LEAST_SCRIPT_SHARE * np.maximum(letters.sum(1, keepdims=True), 1)
    uses[:, ~uses.any(0)] = True
    return Model(tuple(languages), np.ascontiguousarray(np.where(average > 0, ratio, 0.0).T.astype(np.float32)), np.ascontiguousarray(uses.T))


def paths(scores: np.ndarray, firsts: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Label of every word on the best path of its text; text d has words firsts[d] to firsts[d + 1]."""
    labels = np.zeros(len(scores), np.int64)
    if scores.shape[1] < 2:
        return labels
    # With many languages few texts go into one search, so its tables stay small.
    room = max(CHUNK, AT_ONCE // scores.shape[1] ** 2 * CHUNK)
    d = 0
    while d < len(firsts) - 1:
        e = max(d + 1, int(np.searchsorted(firsts, firsts[d] + room, "right")) - 1)
        labels[firsts[d] : firsts[e]] = _paths(scores[firsts[d] : firsts[e]], firsts[d : e + 1] - firsts[d], switch)
        d = e
    return labels


def _paths(scores: np.ndarray, firsts: np.ndarray, switch: float) -> np.ndarray:
    """Texts are cut into chunks. Best scores between any label before a chunk and any label at
    its end are found for all chunks at once; running over the chunks of a text joins them, and
    the way back is taken in the same two steps. So long texts take few steps, and the path is
    the one of a word-by-word search.
    """
    n_words, n = scores.shape
    labels = np.zeros(n_words, np.int64)
    sizes = np.diff(firsts)
    if not n_words:
        return labels
    parts = -(-sizes // CHUNK)
    text_first = np.r_[0, np.cumsum(parts)]
    text = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(len(text)) - text_first[text]
    begin = firsts[text] + number * CHUNK
    length = np.minimum(CHUNK, firsts[text + 1] - begin)
    order = np.argsort(-length, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(CHUNK), "left")

    across = np.where(np.eye(n, dtype=bool), 0.0, -switch)[None].repeat(len(order), 0)
    for t in range(CHUNK):
        k = active[t]
        if t:
            across[:k] = np.maximum(across[:k], across[:k].max(2, keepdims=True) - switch)
        across[:k] += scores[begin[:k] + t][:, None, :]
    entry = np.zeros((len(order), n))
    reach = np.zeros((len(sizes), n))
    by_parts = np.argsort(-parts, kind="stable")
    with_part = np.searchsorted(-parts[by_parts], -np.arange(parts.max()), "left")
    for q in range(parts.max()):
        who = by_parts[: with_part[q]]
        chunk = place[text_first[who] + q]
        entry[chunk] = reach[who]
        reach[who] = (reach[who][:, :, None] + across[chunk]).max(1)

    stays = np.zeros((CHUNK, len(order), n), bool)
    jumps = np.zeros((CHUNK, len(order)), np.int64)
    value = entry
    for t in range(CHUNK):
        k = active[t]
        best = value[:k].argmax(1)
        jump = value[np.arange(k), best][:, None] - switch
        stays[t, :k], jumps[t, :k] = value[:k] >= jump, best
        value[:k] = np.maximum(value[:k], jump) + scores[begin[:k] + t]
    each = np.arange(len(order))[:, None]
    back = np.tile(np.arange(n), (len(order), 1))
    for t in range(CHUNK - 1, -1, -1):
        k = active[t]
        back[:k] = np.where(stays[t][each[:k], back[:k]], back[:k], jumps[t, :k][:, None])
    end = np.zeros(len(order), np.int64)
    last = place[text_first[1:][sizes > 0] - 1]
    end[last] = value[last].argmax(1)
    for q in range(parts.max() - 1, 0, -1):
        chunk = text_first[by_parts[: with_part[q]]] + q
        end[place[chunk - 1]] = back[place[chunk], end[place[chunk]]]
    each = each[:, 0]
    for t in range(CHUNK - 1, -1, -1):
        k = active[t]
        labels[begin[:k] + t] = end[:k]
        end[:k] = np.where(stays[t][each[:k], end[:k]], end[:k], jumps[t, :k])
    return labels


def held_out(id_col: str):
    """Rows that nothing is learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS == HELD_OUT, F.lit(True))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language that are not held out."""
    known = docs.filter(~held_out(id_col)).select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for i, j, data, offsets in cx.groups(batch.column(1)):
                langs, code = np.unique(np.array(batch.column(0).slice(i, j - i).to_pylist(), object).astype(str), return_inverse=True)
                found = words(data, offsets)
                of_word = code[found.rows] if len(found.rows) else found.rows
                of_letter = np.repeat(of_word, np.diff(np.r_[found.firsts, len(found.buckets)]))
                for k, lang in enumerate(langs.tolist()):
                    own = sums.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    own[:BUCKETS] += np.bincount(found.buckets[of_letter == k], minlength=BUCKETS)
                    own[BUCKETS:] += np.bincount(found.scripts[of_word == k], found.letters[of_word == k], len(NAMES)).astype(np.int64)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            # A language without a letter still is one.
            used = used if len(used) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used), pa.array(own[used])], ["lang", "slot", "n"])

    sums = known.mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    table = sums.toArrow()  # at most languages * (BUCKETS + scripts) rows of counts
    languages = sorted(set(table["lang"].to_pylist()))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    at = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), BUCKETS + len(NAMES)), np.int64)
    counts[np.array([at[x] for x in table["lang"].to_pylist()], np.int64), table["slot"].to_numpy()] = table["n"].to_numpy()
    return fit(languages, counts[:, :BUCKETS], counts[:, BUCKETS:])


_SPANS = "array<struct<start:int,end:int,lang:string>>"
_SPANS_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))


def judged(model: Model, data: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
    """Language, score and spans of every text of a group."""
    n, found, k = len(offsets) - 1, words(data, offsets), len(model.languages)
    if not len(found.rows) or not k:
        return [pa.array([NONE] * n), pa.array(np.zeros(n)), pa.array([[]] * n, _SPANS_TYPE)]
    scores = model.scores(found)
    firsts = np.searchsorted(found.rows, np.arange(n + 1))
    labels = paths(scores, firsts)
    letters = np.bincount(found.rows * k + labels, found.letters, n * k).reshape(n, k)
    best, total = letters.argmax(1), letters.sum(1)
    inside = labels == best[found.rows]
    sums = np.stack([np.bincount(found.rows[inside], scores[inside, lang], n) for lang in range(k)], 1)
    # How much of the text is in the language, times how sure its own spans are.
    sure = 1 / np.exp(sums - sums[np.arange(n), best][:, None]).clip(0, 1e300).sum(1)
    score = np.where(total > 0, letters[np.arange(n), best] / np.maximum(total, 1) * sure, 0.0)
    names = np.array([*model.languages, NONE], object)
    opens = np.ones(len(labels), bool)
    opens[1:] = (labels[1:] != labels[:-1]) | (found.rows[1:] != found.rows[:-1])
    first = np.flatnonzero(opens)
    last = np.r_[first[1:], len(labels)] - 1
    flat = pa.StructArray.from_arrays(
        [pa.array(found.starts[first].astype(np.int32)), pa.array(found.ends[last].astype(np.int32)), pa.array(names[labels[first]].tolist(), pa.string())], ["start", "end", "lang"],
    )
    cuts = np.searchsorted(found.rows[first], np.arange(n + 1)).astype(np.int32)
    return [pa.array(names[np.where(total > 0, best, k)].tolist(), pa.string()), pa.array(score), pa.ListArray.from_arrays(pa.array(cuts), flat)]


def languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: whether it is held out, its language, a score, and its spans (code points)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(data, offsets):
        with np.errstate(over="ignore"):
            return judged(shared.value, data, offsets)

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return cx.text_map(slim, "text", run, f"lang_pred string, score double, spans {_SPANS}", ["doc_id", "held_out"])
