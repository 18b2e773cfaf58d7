"""Quality rules: a linear-chain CRF labels every line content or boilerplate.

Base rules count words, symbols, repeated lines and repeated word windows. The CRF has two
states, one-hot line features and learned transitions; Viterbi decoding marks each line, and
the share of word characters in content lines decides whether a text is retained.

Defined results: a null or empty text has no words, fails the base rules and is rejected.
Lines without a word belong to no state. Equal scores decode as content. Without usable
labels the weights stay zero, so every line is content and only the base rules reject.
Repeated rows each get the same verdict; a null id is carried as it is. Texts of any length
are read whole. Extra columns are ignored by ``quality`` and kept by ``retained``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MIN_CONTENT_SHARE = 0.5
# The CRF is fitted on a sample of labelled texts: about this many of each label, chosen by
# a hash of the id, from texts of at most TRAIN_LINES lines.
TRAIN_TEXTS = 2_000
TRAIN_LINES = 200
STEPS = 80

CONTENT, BOILERPLATE = 0, 1
_SYMBOLS = cx.separators(b"#*$%&|<>")
_DIGITS = cx.separators(b"0123456789")
_UPPER = cx.separators(bytes(range(65, 91)))
_LOWER = cx.separators(bytes(range(97, 123)))
_END = cx.separators(b".!?:;\"'")
# Upper edges of the buckets of each line feature.
BUCKETS = {
    "words": (1, 2, 5, 10, 20, 60),
    "symbol_share": (0.0, 0.01, 0.03, 0.1),
    "upper_share": (0.02, 0.1, 0.3, 0.6),
    "digit_share": (0.0, 0.05, 0.2),
    "exclamation_share": (0.0, 0.02, 0.06),
    "pipe_share": (0.0, 0.02, 0.06),
    "word_bytes": (2.5, 4, 8, 14),
    "repeat_share": (0.0, 0.2, 0.6),
    "earlier_line": (0,),
    "ends_sentence": (0,),
}
WIDTHS = [len(edges) + 1 for edges in BUCKETS.values()]
SHIFTS = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
SIZE = int(sum(WIDTHS))
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


@dataclass(frozen=True)
class Crf:
    """Scores of boilerplate over content per feature bucket, and of moving between states."""

    emission: np.ndarray
    transition: np.ndarray
    start: np.ndarray

    @classmethod
    def blank(cls) -> "Crf":
        return cls(np.zeros(SIZE), np.zeros((2, 2)), np.zeros(2))

    def decode(self, features: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """State of every line; ``firsts`` are the first lines of the texts."""
        scores = self.emission[features + SHIFTS].sum(1).tolist()
        (cc, cb), (bc, bb) = self.transition.tolist()
        states = np.zeros(len(scores), np.int8)
        for low, high in zip(firsts.tolist(), [*firsts.tolist()[1:], len(scores)]):
            content, boiler = self.start[0], self.start[1] + scores[low]
            back = []
            for x in scores[low + 1 : high]:
                from_content = (content + cc >= boiler + bc, content + cb >= boiler + bb)
                back.append(from_content)
                content, boiler = (content + cc if from_content[0] else boiler + bc), x + (content + cb if from_content[1] else boiler + bb)
            state = CONTENT if content >= boiler else BOILERPLATE
            states[high - 1] = state
            for i in range(high - 2, low - 1, -1):
                state = CONTENT if back[i - low][state] else BOILERPLATE
                states[i] = state
        return states


def measures(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts per text, and rows, features and word characters per line with a word."""
    n = len(offsets) - 1
    blank = cx.BLANK[data]
    starts, ends, rows = cx.spans(blank, offsets)
    hashes = cx.hasher(11, False)(data, starts, ends)
    chars = cx.running(~blank & ((data & 0xC0) != 0x80))
    symbols = cx.running(_SYMBOLS[data])
    out = {"n_words": cx.per_row(rows, n), "word_chars": np.diff(chars[offsets]), "n_symbols": np.diff(symbols[offsets])}

    repeated = np.zeros(len(starts) + 1, np.int64)
    grams = cx.gram_hashes(hashes, WINDOW, 12)
    whole = np.flatnonzero(cx.inside(rows, WINDOW))
    keys = grams[whole] + rows[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = whole[twice]
    np.add.at(repeated, at, 1)
    np.add.at(repeated, at + WINDOW, -1)
    repeated = np.cumsum(repeated[:-1]) > 0
    out["n_repeat_words"] = cx.per_row(rows[repeated], n)

    first, last, line_rows = cx.spans(data == 10, offsets)
    word_line = np.searchsorted(first, starts, "right") - 1
    words = np.bincount(word_line, minlength=len(first))
    full = np.flatnonzero(words)
    first, last, line_rows, words = first[full], last[full], line_rows[full], words[full]
    line_of = np.zeros(len(words) and int(full[-1]) + 1, np.int64)
    line_of[full] = np.arange(len(full))
    keys = cx.hasher(13, False)(data, first, last) + line_rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(keys, kind="stable")
    earlier = np.zeros(len(keys), bool)
    earlier[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    out["n_dup_lines"] = cx.per_row(line_rows[earlier], n)
    out["n_lines"] = cx.per_row(line_rows, n)

    size = np.maximum(last - first, 1)
    count = lambda flags: np.diff(cx.running(flags)[np.stack([first, last], 1)], axis=1)[:, 0] if len(first) else np.zeros(0)
    upper = count(_UPPER[data])
    line_chars = chars[last] - chars[first]
    values = (
        words, (symbols[last] - symbols[first]) / size, upper / np.maximum(upper + count(_LOWER[data]), 1), count(_DIGITS[data]) / size,
        count(data == 33) / size, count(data == 124) / size, count(~blank) / words,
        np.bincount(line_of[word_line[repeated]], minlength=len(full)) / words, earlier, _END[data[last - 1]] if len(last) else last,
    )
    features = np.stack([np.searchsorted(edges, v, "left") for edges, v in zip(BUCKETS.values(), values)], 1).astype(np.int16) if len(full) else np.zeros((0, len(BUCKETS)), np.int16)
    return out | {"rows": line_rows, "features": features, "line_chars": line_chars}


def _firsts(rows: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)


def fit_crf(sequences: list[np.ndarray], low: np.ndarray, steps: int = STEPS) -> Crf:
    """Penalised maximum likelihood from labels of whole texts.

    Lines of good texts are content. Lines of low-quality texts start as boilerplate; the second
    pass takes back those which their own features place with the content lines.
    """
    if not len(sequences) or low.all() or not low.any():
        return Crf.blank()
    order = np.argsort([-len(s) for s in sequences], kind="stable")
    sequences, low = [sequences[i] for i in order], low[order]
    sizes = np.array([len(s) for s in sequences])
    features = np.concatenate(sequences) + SHIFTS
    at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    y = np.repeat(low, sizes).astype(int)
    # Lines by step of their text: texts are sorted by size, so each step is a prefix.
    steps_at = [at[: int((sizes > t).sum())] + t for t in range(int(sizes[0]))]
    crf = Crf.blank()
    for turn in range(2):
        if turn:
            y = np.where(y == 1, (crf.emission[features].sum(1) + crf.start[1] > 0).astype(int), 0)
        crf = _ascend(crf, features, steps_at, y, steps)
    return crf


def _ascend(crf: Crf, features, steps_at, y, steps: int) -> Crf:
    theta = [crf.emission.copy(), crf.transition.copy(), crf.start.copy()]
    moment, spread = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    firsts = steps_at[0]
    seen_start = np.bincount(y[firsts], minlength=2)
    moves = np.zeros((2, 2))
    for before, now in zip(steps_at, steps_at[1:]):
        np.add.at(moves, (y[before[: len(now)]], y[now]), 1)
    for step in range(1, steps + 1):
        unary = np.zeros((len(y), 2))
        unary[:, 1] = theta[0][features].sum(1)
        alpha, beta = np.zeros_like(unary), np.zeros_like(unary)
        alpha[firsts] = theta[2] + unary[firsts]
        for before, now in zip(steps_at, steps_at[1:]):
            alpha[now] = unary[now] + np.logaddexp.reduce(alpha[before[: len(now)]][:, :, None] + theta[1], axis=1)
        expected = np.zeros((2, 2))
        for before, now in zip(reversed(steps_at[:-1]), reversed(steps_at[1:])):
            b = before[: len(now)]
            onward = theta[1] + (unary[now] + beta[now])[:, None, :]
            beta[b] = np.logaddexp.reduce(onward, axis=2)
            joint = alpha[b][:, :, None] + onward
            expected += np.exp(joint - np.logaddexp.reduce(joint.reshape(len(b), 4), axis=1)[:, None, None]).sum(0)
        marginal = alpha + beta
        marginal = np.exp(marginal - np.logaddexp.reduce(marginal, axis=1)[:, None])
        slack = y - marginal[:, 1]
        gradient = [np.bincount(features.ravel(), np.repeat(slack, features.shape[1]), SIZE), moves - expected, seen_start - marginal[firsts].sum(0)]
        for i, g in enumerate(gradient):
            g = (g - 1.0 * theta[i]) / len(y)
            moment[i] = 0.9 * moment[i] + 0.1 * g
            spread[i] = 0.999 * spread[i] + 0.001 * g * g
            theta[i] += 0.1 * moment[i] / (1 - 0.9**step) / (np.sqrt(spread[i] / (1 - 0.999**step)) + 1e-8)
    return Crf(*theta)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_label: int = TRAIN_TEXTS) -> Crf:
    """Fit on about ``per_label`` labelled texts of each quality; fewer when there are fewer."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("quality").cast("int").alias("q")).filter("i is not null and q in (0, 1)").groupBy("i").agg(F.min("q").alias("q"))
    sizes = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    share = F.when(F.col("q") == 0, F.lit(min(1.0, per_label / max(1, sizes.get(0, 0))))).otherwise(F.lit(min(1.0, per_label / max(1, sizes.get(1, 0)))))
    # At most about 2 * per_label rows of two numbers, so they can be broadcast.
    chosen = known.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < share * 1_000_003)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "i")

    def lines(data, offsets):
        got = measures(data, offsets)
        cuts = np.concatenate([[0], np.cumsum(got["n_lines"])])
        raw = [got["features"][a:b].astype(np.int8).tobytes() if b - a <= TRAIN_LINES else b"" for a, b in zip(cuts, cuts[1:])]
        return [pa.array(raw, pa.binary())]

    rows = [r for r in cx.text_map(texts, "t", lines, "f binary", ["i", "q"]).collect() if r["f"]]
    rows.sort(key=lambda r: (r["i"], bytes(r["f"])))
    return fit_crf([np.frombuffer(r["f"], np.int8).reshape(-1, len(BUCKETS)).astype(np.int64) for r in rows], np.array([r["q"] == 0 for r in rows], bool))


def verdicts(df: DataFrame, crf: Crf, text_col: str, keep: list[str] | None = None, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    def judge(data, offsets):
        got = measures(data, offsets)
        n, rows = len(offsets) - 1, got["rows"]
        content = crf.decode(got["features"], _firsts(rows)) == CONTENT
        n_content = cx.per_row(rows[content], n)
        kept_chars, chars = cx.per_row(rows[content], n, got["line_chars"][content]), got["word_chars"]
        share = kept_chars / np.maximum(chars, 1)
        failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
        base = [cx.long_column(got[f.split()[0]]) for f in FIELDS.split(", ")]
        return [*base, pa.array(failed), pa.array(~failed & (share >= min_share)), cx.long_column(n_content), pa.array(share)]

    return cx.text_map(df, text_col, judge, f"{FIELDS}, base_failed boolean, kept boolean, n_content_lines long, content_share double", keep)


def quality(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text: base counts, the lines the CRF calls content, and whether it is kept."""
    return verdicts(docs, crf, text_col, [id_col])


def retained(docs: DataFrame, crf: Crf, text_col: str = "text") -> DataFrame:
    """The rows that are kept, with the columns of ``docs`` alone."""
    added = [*(f.split()[0] for f in FIELDS.split(", ")), "base_failed", "kept", "n_content_lines", "content_share"]
    names = [f"c{i}" for i in range(len(docs.columns))]
    assert not set(names) & set(added)
    plain = docs.toDF(*names)
    return verdicts(plain, crf, names[docs.columns.index(text_col)]).filter("kept").select(*names).toDF(*docs.columns)
