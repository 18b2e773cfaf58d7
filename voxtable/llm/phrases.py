"""Phrase collocations, counted in burst tries that spill sorted runs.

Words, pairs and triples are each counted in a pass over the texts. A phrase is named by a hash of
its words' ids (an id is a hash of language and bytes), and a task counts names in a trie over their
digits. A container at the trie's edge is a hash table; one that grows past ``BURST`` names bursts
into a node with a container for each next digit, so the trie stays shallow. When a task holds
``HELD`` names it spills its largest subtrees as sorted runs, packed as differences in five to seven
bytes a name, which are merged by prefix partition. A prefix of words may be hot, one of hashes is
not.

A pair can only be frequent if both words are, a triple only if both pairs are: a Bloom filter of
bounded size over the frequent phrases of one pass lets the next leave most others out. Wrong passes
do not matter, as the counts are whole and cut at the least count afterwards. A last pass spells the
frequent phrases: of the tasks that met one, the first to be merged names its words. Names have
``KEY_BITS`` bits; two of 10^9 phrases share one with a chance of about 5 %, and such a pair would
only add its counts up.

Defined results: a null text counts as empty, a null language as ``und``. Phrases never cross the
end of a piece or of a text. Overlapping occurrences all count. Languages without a candidate have
no rows. Equal scores are ordered by count and then by the bytes of the phrase; repeated rows
count as often as they stand; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import counted, settled
from voxtable.scale import Lookup, top_k_per_group, work_partitions

LEAST, TOP, COVERED_PERCENT = 10, 2_000, 50
# Bits of a phrase's name, and of one digit of the trie.
KEY_BITS, DIGIT_BITS = 63, 6
# Prefix partitions for each shuffle partition, so that chance deals them out evenly.
PREFIXES = 8
FAN = 1 << DIGIT_BITS
# Names in a container before it bursts, and in a task before it spills.
BURST, HELD = 8_192, 800_000
# Words handled at once.
STEP = 1 << 17
# Bits of a filter for each member, at most MOST_BITS in all.
MEMBER_BITS, MOST_BITS, PROBES = 16, 1 << 28, 3

_BREAK = cx.separators(b".,;:!?\n\x0b\x0c\r")
_APART = _BREAK | cx.separators(b" \t")
_PROBE = np.random.default_rng(121).integers(0, (1 << 64) - 1, PROBES, dtype=np.uint64) | np.uint64(1)
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Trie:
    """Counts of integer keys of ``bits`` bits: nodes are lists of FAN children, containers are hash tables."""

    def __init__(self, bits: int):
        self.bits, self.size = bits, 0
        self.root: Counter | list = Counter()

    def add(self, keys: np.ndarray) -> None:
        """Count sorted keys."""
        if len(keys):
            self.root = self._add(self.root, self.bits - DIGIT_BITS, keys)

    def _add(self, node, shift: int, keys: np.ndarray):
        if isinstance(node, Counter):
            before = len(node)
            node.update(keys.tolist())
            self.size += len(node) - before
            return self._burst(node, shift) if len(node) > BURST and shift >= 0 else node
        cuts = np.searchsorted(keys >> shift & FAN - 1, np.arange(FAN + 1))
        for d in np.flatnonzero(np.diff(cuts)):
            child = node[d] if node[d] is not None else Counter()
            node[d] = self._add(child, shift - DIGIT_BITS, keys[cuts[d] : cuts[d + 1]])
        return node

    def _burst(self, container: Counter, shift: int) -> list:
        children: list = [None] * FAN
        for key, n in container.items():
            d = key >> shift & FAN - 1
            if children[d] is None:
                children[d] = Counter()
            children[d][key] = n
        return [self._burst(c, shift - DIGIT_BITS) if c is not None and len(c) > BURST and shift >= DIGIT_BITS else c for c in children]

    def _containers(self, node) -> Iterator[Counter]:
        if isinstance(node, Counter):
            yield node
        else:
            for child in node:
                if child is not None:
                    yield from self._containers(child)

    def _run(self, node) -> tuple[np.ndarray, np.ndarray]:
        """A subtree as one sorted run."""
        keys, counts = [], []
        for c in self._containers(node):
            k = np.fromiter(c.keys(), np.int64, len(c))
            order = np.argsort(k)
            keys.append(k[order])
            counts.append(np.fromiter(c.values(), np.int64, len(c))[order])
        self.size -= sum(map(len, keys))
        return np.concatenate(keys), np.concatenate(counts)

    def spill(self, down_to: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Give away whole subtrees, the largest first, until ``down_to`` keys or fewer are left."""
        if isinstance(self.root, Counter):
            if self.root:
                yield self._run(self.root)
            self.root = Counter()
            return
        sizes = [sum(map(len, self._containers(c))) if c is not None else 0 for c in self.root]
        for d in sorted(range(FAN), key=lambda d: -sizes[d]):
            if self.size <= down_to or not sizes[d]:
                break
            yield self._run(self.root[d])
            self.root[d] = None


class Bloom:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - (len(words) * 64).bit_length() + 1)

    def places(self, keys: np.ndarray) -> list[np.ndarray]:
        keys = keys.astype(np.uint64)
        return [cx.mixed(keys * p) >> self.shift for p in _PROBE]

    def add(self, keys: np.ndarray) -> None:
        for at in self.places(keys):
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for at in self.places(keys):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return found


def word_key(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - KEY_BITS)).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return word_key(cx.mixed(a * _LEFT + b * _RIGHT))


def triple_key(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return word_key(cx.mixed(cx.mixed(a * _LEFT + b * _RIGHT) * _LEFT + c * _RIGHT))


def owned(keys: np.ndarray, owner) -> np.ndarray:
    """Names together with the task that is to spell them."""
    return cx.mixed(keys.astype(np.uint64) + cx.mixed(np.asarray(owner, np.uint64) + _LEFT)).astype(np.int64)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: numbers of keys and large counts, bytes a key, first key; differences, one byte a count, large counts."""
    steps = np.diff(keys, prepend=keys[0])
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    large = np.flatnonzero(counts > 254)
    head = np.array([len(keys), len(large), width, keys[0]], "<i8").tobytes()
    raw = steps.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width]
    return b"".join([head, np.ascontiguousarray(raw).tobytes(), np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[large].astype("<i8").tobytes()])


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, n_large, width, first = np.frombuffer(run, "<i8", 4).tolist()
    raw = np.zeros((n, 8), np.uint8)
    raw[:, :width] = np.frombuffer(run, np.uint8, n * width, 32).reshape(n, width)
    counts = np.frombuffer(run, np.uint8, n, 32 + n * width).astype(np.int64)
    counts[counts == 255] = np.frombuffer(run, "<i8", n_large, 32 + n * (width + 1))
    return first + np.cumsum(raw.view("<i8").ravel()), counts


def bloom(members: DataFrame, rows: int) -> Bloom:
    """Filter over the column ``key`` of ``members``, with ``owner`` if it is there; its size never passes MOST_BITS."""
    bits = min(MOST_BITS, 1 << max(12, (MEMBER_BITS * rows).bit_length()))

    def run(batches):
        part = Bloom(np.zeros(bits >> 6, np.uint64))
        for batch in batches:
            keys = [c.to_numpy() for c in batch.columns]
            part.add(keys[0] if len(keys) == 1 else owned(*keys))
        used = np.flatnonzero(part.words)
        yield pa.RecordBatch.from_arrays([cx.long_column(used), cx.signed(part.words[used])], ["slot", "bits"])

    table = members.mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    words = np.zeros(bits >> 6, np.uint64)
    words[table["slot"].to_numpy()] = table["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return Bloom(words)


@lru_cache(4096)
def _salt(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "big"))


def _task() -> int:
    return TaskContext.get().partitionId() if TaskContext.get() else 0


def _word_groups(batches, seed: int):
    """Per group of texts (columns lang, text): word ids, which neighbours share a piece, how to spell a word, languages and words by row."""
    hash_of = cx.hasher(seed)
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for i, j, data, offsets in cx.groups(batch.column(1)):
            starts, ends, rows = cx.spans(_APART[data], offsets)
            if not len(starts):
                continue
            salts = np.array([_salt(x) for x in langs[i:j]], np.uint64)
            words = cx.mixed(hash_of(data, starts, ends) ^ salts[rows])
            pieces = cx.running(_BREAK[data])[starts]
            joined = (rows[1:] == rows[:-1]) & (pieces[1:] == pieces[:-1])

            def spell(w, data=data, starts=starts, ends=ends, rows=rows, langs=langs[i:j]):
                return langs[rows[w]], data[starts[w] : ends[w]].tobytes().lower().decode("utf-8", "replace")

            yield words, joined, spell, langs[i:j], cx.per_row(rows, j - i)


def _phrases(n: int, words: np.ndarray, joined: np.ndarray, gates: list) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of ``n`` words begin whose parts may be frequent, and their names."""
    if n == 1:
        return np.arange(len(words)), word_key(words)
    if n == 2:
        known = gates[0].value.has(word_key(words))
        at = np.flatnonzero(known[:-1] & known[1:] & joined)
        return at, pair_key(words[at], words[at + 1])
    pair, pairs = np.flatnonzero(joined), np.zeros(len(words), bool)
    pairs[pair] = gates[1].value.has(pair_key(words[pair], words[pair + 1]))
    at = np.flatnonzero(pairs[:-1] & pairs[1:])
    return at, triple_key(words[at], words[at + 1], words[at + 2])


def _steps(n: int, words: np.ndarray, joined: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of words in which all phrases of ``n`` words begin once."""
    for low in range(0, len(words), STEP):
        yield low, words[low : low + STEP + n - 1], joined[low : low + STEP + n - 2]


def _counted(slim: DataFrame, n: int, seed: int, gates: list, least: int) -> DataFrame:
    """(key, n, owner) of the phrases of ``n`` words that occur ``least`` times; the owner is the first task that met one."""
    prefixes = PREFIXES * work_partitions(slim)

    def count(batches):
        trie, task = Trie(KEY_BITS), _task()

        def out(down_to=0):
            for keys, counts in trie.spill(down_to):
                part = (keys >> KEY_BITS - 23) * prefixes >> 23
                cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
                runs = [packed(keys[a:b], counts[a:b]) for a, b in zip(cuts, cuts[1:])]
                yield pa.RecordBatch.from_arrays([cx.long_column(part[cuts[:-1]]), pa.array([task] * len(runs), pa.int32()), pa.array(runs, pa.binary())], ["prefix", "task", "run"])

        for words, joined, *_ in _word_groups(batches, seed):
            for _, part, near in _steps(n, words, joined):
                keys = np.sort(_phrases(n, part, near, gates)[1])
                trie.add(keys)
                if trie.size > HELD:
                    yield from out(HELD // 2)
        yield from out()

    def merge(batches):
        prefix, held = None, []

        def out():
            runs = [unpacked(run) for _, run in held]
            keys, counts = (np.concatenate(x) for x in zip(*runs))
            tasks = np.repeat([t for t, _ in held], [len(k) for k, _ in runs])
            keys, at = np.unique(keys, return_inverse=True)
            total, owner = np.zeros(len(keys), np.int64), np.full(len(keys), 1 << 31)
            np.add.at(total, at, counts)
            np.minimum.at(owner, at, tasks)
            kept = total >= least
            return pa.RecordBatch.from_arrays([cx.long_column(x[kept]) for x in (keys, total, owner)], ["key", "n", "owner"])

        for batch in batches:
            for p, task, run in zip(*(c.to_pylist() for c in batch.columns)):
                if held and p != prefix:
                    yield out()
                    held = []
                prefix = p
                held.append((task, run))
        if held:
            yield out()

    runs = slim.mapInArrow(count, "prefix long, task int, run binary").repartition("prefix").sortWithinPartitions("prefix")
    return runs.mapInArrow(merge, "key long, n long, owner long")


_SPELT = "size int, key long, owner long, h1 long, h2 long, h3 long, lang string, word string"


def _spelt(slim: DataFrame, seed: int, gates: list, mine, every: bool) -> DataFrame:
    """Words of the phrases that a task owns (or of every phrase); and, as size 0, words in all by language."""
    names = [f.split()[0] for f in _SPELT.split(", ")]

    def run(batches):
        done: list[set] = [set(), set(), set()]  # phrases this task has spelt: its share of the frequent ones
        totals, task = Counter(), _task()
        for words, joined, spell, langs, in_row in _word_groups(batches, seed):
            for lang, size in zip(langs, in_row.tolist()):
                totals[lang] += size
            for n in (1, 2, 3):
                for low, part, near in _steps(n, words, joined):
                    at, keys = _phrases(n, part, near, gates)
                    chosen = mine.value.has(owned(keys, 0 if every else task))
                    keys, first = np.unique(keys[chosen], return_index=True)
                    at = at[chosen][first]
                    new = np.array([k not in done[n - 1] for k in keys.tolist()], bool)
                    if not new.any():
                        continue
                    keys, at = keys[new], at[new]
                    done[n - 1].update(keys.tolist())
                    ids = [cx.long_column(word_key(part[at + k])) if k < n else pa.nulls(len(at), pa.int64()) for k in range(3)]
                    read = [spell(int(w) + low) for w in at] if n == 1 else [(None, None)] * len(at)
                    fixed = [pa.array(np.full(len(at), n, np.int32)), cx.long_column(keys), cx.long_column(np.full(len(at), task))]
                    yield pa.RecordBatch.from_arrays([*fixed, *ids, *(pa.array(x, pa.string()) for x in zip(*read))], names)
        sizes = [pa.array([0] * len(totals), pa.int32()), pa.array(list(totals.values()), pa.int64()), pa.array([task] * len(totals), pa.int64())]
        yield pa.RecordBatch.from_arrays([*sizes, *[pa.nulls(len(totals), pa.int64())] * 3, pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string())], names)

    return slim.mapInArrow(run, _SPELT)


def frequencies(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, seed: int = 61) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Languages (lang, n) with all their words; and words (h1, lang, word, n), pairs (h1, h2, n) and triples (h1, h2, h3, n) that occur ``least`` times."""
    slim = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    gates, tables, rows = [], [], 0
    for n in (1, 2, 3):
        table, size = counted(_counted(slim, n, seed, gates, least).withColumn("size", F.lit(n)))
        gates.append(context.broadcast(bloom(table.select("key"), size)))
        tables.append(table)
        rows += size
    every = tables[0].unionByName(tables[1]).unionByName(tables[2])
    for by_owner in (True, False):
        mine = bloom(every.select("key", "owner" if by_owner else F.lit(0).cast("long").alias("owner")), rows)
        spelt = settled(_spelt(slim, seed, gates, context.broadcast(mine), not by_owner))
        if by_owner:
            found = spelt.join(every, ["size", "key", "owner"])
        else:
            # Rows were dealt to other tasks than before: all tasks spell what they meet.
            found = spelt.filter("size > 0").dropDuplicates(["size", "key"]).drop("owner").join(every.drop("owner"), ["size", "key"])
        found, n_found = counted(found.select("size", "h1", "h2", "h3", "lang", "word", "n"))
        if n_found == rows:
            break
    sizes = spelt.filter("size = 0").groupBy("lang").agg(F.sum("key").alias("n"))
    of = lambda n, *columns: found.filter(F.col("size") == n).select(*columns, "n")
    return sizes, of(1, "h1", "lang", "word"), of(2, "h1", "h2"), of(3, "h1", "h2", "h3")


def _score(a: str, left: str, right: str):
    whole = lambda c: F.col(c).cast("decimal(18,0)")
    top, bottom = whole(a) * whole(a) * F.lit(1_000_000).cast("decimal(7,0)"), whole(left) * whole(right)
    return F.call_function("div", top, bottom).cast("long")


def collocations(
    docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, per_lang: int = TOP, covered_percent: int = COVERED_PERCENT,
) -> DataFrame:
    """The first ``per_lang`` phrases of two and three words of each language by score, with counts of the parts of their weakest cut."""
    sizes, frequent, pairs, triples = frequencies(docs, lang_col, text_col, least)
    known = Lookup.measured(frequent)

    def with_word(df: DataFrame, j: int, more: list | None = None) -> DataFrame:
        own = known.table.select(F.col("h1").alias(f"h{j}"), F.col("word").alias(f"w{j}"), F.col("n").alias(f"f{j}"), *(more or []))
        return known.part(own).join(df, f"h{j}", "inner")

    # A longer candidate hides the pairs inside it that it covers.
    covers = triples.select(F.explode(F.array(F.struct("h1", "h2"), F.struct(F.col("h2").alias("h1"), F.col("h3").alias("h2")))).alias("p"), "n")
    covers = covers.groupBy("p.h1", "p.h2").agg(F.max("n").alias("longer"))
    two = pairs.withColumnRenamed("n", "a").join(covers, ["h1", "h2"], "left").filter(F.coalesce(100 * F.col("longer") < covered_percent * F.col("a"), F.lit(True)))
    two = with_word(with_word(two, 1, ["lang"]), 2)
    two = two.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), _score("a", "f1", "f2").alias("score"))

    of = lambda x, y, name: pairs.select(F.col("h1").alias(x), F.col("h2").alias(y), F.col("n").alias(name))
    three = triples.withColumnRenamed("n", "a").join(of("h1", "h2", "f12"), ["h1", "h2"]).join(of("h2", "h3", "f23"), ["h2", "h3"])
    three = with_word(with_word(with_word(three, 1, ["lang"]), 2), 3).withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    late = F.col("s2") < F.col("s1")
    pick = lambda x, y: F.when(late, F.col(x)).otherwise(F.col(y))
    three = three.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", pick("f12", "f1").alias("l"), pick("f3", "f23").alias("r"), pick("s2", "s1").alias("score"))

    best = top_k_per_group(two.union(three), ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], per_lang, ["phrase"], "rank")
    return best.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
