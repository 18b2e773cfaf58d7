"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes ratios.

Every text is the set of its character n-grams (3 to 5, lower case, blanks made single),
hashed into ``BUCKETS``. Over all labelled texts the share of toxic and of other texts that
hold a bucket gives its log-count ratio, drawn to zero for rare buckets. A logistic regression
on the ratios of the buckets present is fitted on a bounded sample of labelled texts, its
intercept corrected for the sample's share of toxic texts, and scores every text.

Defined results: a null or empty text has no n-grams and scores by the intercept. Ids with
several labels count as toxic if one label is. Without labels of both kinds the score is the
smoothed share of toxic labels. A null id is held out. Repeated rows score alike; extra
columns are ignored. Label, language, source and id never enter a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import settled, sized

SIZES = (3, 4, 5)
BITS = 18
BUCKETS = 1 << BITS
FOLDS = 5
# The regression sees about this many labelled texts of each kind, by a hash of their id.
SAMPLE = 1_500
# Texts' worth of the overall share that a bucket's ratio starts from.
PRIOR_TEXTS = 10.0
# Ratios this close to zero carry no weight.
LEAST_RATIO = 0.05
STEPS = 150
RIDGE = 1e-3

_FACTORS = np.random.default_rng(101).integers(0, 1 << 32, (max(SIZES) + 1, max(SIZES)), dtype=np.uint32) | np.uint32(1)
_BLANKS = re.compile(r"\s+")


class Grams:
    """Distinct buckets of one text, with a scratch table instead of a sort."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, np.int64)

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int64)
        chars = np.frombuffer(f" {_BLANKS.sub(' ', text.lower())} ".encode("utf-32-le", "surrogatepass"), np.uint32)
        parts = []
        for size in SIZES:
            n = len(chars) - size + 1
            if n > 0:
                total = chars[:n] * _FACTORS[size, 0]
                for j in range(1, size):
                    total += chars[j : j + n] * _FACTORS[size, j]
                total ^= total >> np.uint32(15)
                total *= np.uint32(0x85EBCA6B)
                parts.append(total >> np.uint32(32 - BITS))
        if not parts:
            return np.zeros(0, np.int64)
        buckets = np.concatenate(parts).astype(np.int64)
        places = np.arange(len(buckets))
        self.seen[buckets] = places
        return buckets[self.seen[buckets] == places]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    intercept: float

    def score(self, buckets: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.intercept + self.weights[buckets].sum(dtype=np.float64), -500, 500))))


def _ratios(rows: DataFrame, n_toxic: int, n_other: int) -> np.ndarray:
    """Log-count ratio of every bucket over all labelled texts (columns toxic, text)."""

    def count(batches):
        grams, counts = Grams(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            for i, j, _, _ in cx.groups(batch.column(1)):
                for toxic, text in zip(batch.column(0).slice(i, j - i).to_pylist(), batch.column(1).slice(i, j - i).to_pylist()):
                    counts[toxic, grams(text or "")] += 1
        used = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["b", "o", "t"])

    sums = rows.select("toxic", "text").mapInArrow(count, "b long, o long, t long").groupBy("b").agg(F.sum("o").alias("o"), F.sum("t").alias("t"))
    table = sums.toPandas()  # at most BUCKETS rows
    counts = np.zeros((2, BUCKETS))
    counts[:, table["b"].to_numpy(np.int64)] = table[["o", "t"]].to_numpy(np.float64).T
    share = counts.sum(0) / (n_toxic + n_other)
    ratio = np.log((counts[1] + PRIOR_TEXTS * share + 1e-9) / (n_toxic + PRIOR_TEXTS)) - np.log((counts[0] + PRIOR_TEXTS * share + 1e-9) / (n_other + PRIOR_TEXTS))
    return np.where((counts.sum(0) == 0) | (np.abs(ratio) < LEAST_RATIO), 0.0, ratio)


def fit_linear(present: list[np.ndarray], toxic: np.ndarray, ratios: np.ndarray, share: float) -> Model:
    """Ridge logistic regression on the ratios present in each text, started from naive Bayes."""
    flat = np.concatenate(present)
    sizes = np.array([len(p) for p in present])
    owner = np.repeat(np.arange(len(present)), sizes)
    values = ratios[flat]
    w, b = np.zeros(len(ratios)), 0.0
    moment, spread = np.zeros(len(ratios) + 1), np.zeros(len(ratios) + 1)
    for step in range(1, STEPS + 1):
        margin = np.bincount(owner, values * w[flat], len(present)) + b
        slack = 1 / (1 + np.exp(-np.clip(margin, -500, 500))) - toxic
        g = np.append(np.bincount(flat, values * slack[owner], len(ratios)) / len(present) + RIDGE * w, slack.mean())
        moment, spread = 0.9 * moment + 0.1 * g, 0.999 * spread + 0.001 * g * g
        move = 0.02 * (moment / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    sampled = toxic.mean()
    shift = np.log(share / (1 - share)) - np.log(sampled / (1 - sampled))
    return Model((w * ratios).astype(np.float32), float(b + shift))


def held_out(id_col: str):
    """Rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % FOLDS == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Ratios from all labelled texts that are not held out, weights from about ``sample`` of each kind."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("toxic")).filter("i is not null and toxic in (0, 1)")
    known = settled(known.filter(~held_out("i")).groupBy("i").agg(F.max("toxic").alias("toxic")))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_other, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not (n_other and n_toxic):
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = texts.join(sized(known, n_other + n_toxic), "i").select("i", "toxic", "text")
    ratios = _ratios(rows, n_toxic, n_other)
    part = F.when(F.col("toxic") == 1, F.lit(min(1.0, sample / n_toxic))).otherwise(F.lit(min(1.0, sample / n_other)))
    chosen = known.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_003)) < part * 1_000_003)
    # About 2 * sample ids; of an id with several texts the least one, so no id brings more than one row.
    used = texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.min("toxic").alias("toxic"), F.min("text").alias("text"))
    weighty = ratios != 0

    def buckets(texts):
        grams = Grams()
        return [pa.array([b[weighty[b]].astype(np.int32).tobytes() for b in map(grams, texts)], pa.binary())]

    got = cx.text_map(used, "text", buckets, "b binary", ["i", "toxic"], strings=True).toArrow()
    order = np.argsort(got["i"].to_numpy(), kind="stable")
    present = [np.frombuffer(got["b"][int(k)].as_py(), np.int32).astype(np.int64) for k in order]
    toxic = got["toxic"].to_numpy()[order].astype(float)
    if not len(toxic) or toxic.min() == toxic.max():
        share = (n_toxic + 1) / (n_toxic + n_other + 2)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share))))
    return fit_linear(present, toxic, ratios, n_toxic / (n_toxic + n_other))


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: whether it is held out, its score and the class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts):
        grams = Grams()
        scores = [shared.value.score(grams(t)) for t in texts]
        return [pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())]

    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), held_out(id_col).alias("held_out"))
    return cx.text_map(slim, "text", run, "score double, predicted int", ["doc_id", "held_out"], strings=True)
