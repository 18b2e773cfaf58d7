"""Alignment of the tokens of two tokenizers over the same text.

Both token sequences tile the bytes of one blank and the text, so each token is an interval. All
intervals of A and B are sorted by start and their ends are accumulated to a running maximum: a
group breaks where a start reaches the maximum. Inside a group every A token is linked with every
B token. How many documents hold a pair of ids linked is counted over all documents, and each
document's links are then looked up in these counts.

Texts are encoded once; ids are written to the shared folder in two to four bytes each, and the
counting and the look-up read them from there. The table of pairs is sent to the tasks while its
counted rows stay within ``PAIRS_SENT``; beyond that, each block of documents is brought together
with the counts of its own pairs by a shuffle. Both give the same rows.

Defined results: texts that are null or empty, or whose tokens of A or of B do not join to the
bytes of a blank and the text (such as texts with a literal U+2581 under a model that has it for a
blank), have no tokens: zeros and an empty string of groups. Special tokens are never added and
their strings in a text are plain text. Repeated rows count as documents of their own; null ids
are carried; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import counted
from voxtable.llm.token_counts import _alphabet
from voxtable.scale import scratch_path

# Fixed value: how byte-level vocabularies cut a text before merging.
BYTE_LEVEL_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ID_BITS = 20
# Rows of the table of pairs (17 bytes each) that are sent to every task.
PAIRS_SENT = 2_000_000
# Text of one block where the table is larger, and pairs a task counts before it hands them on.
BLOCK_BYTES = 8 << 20
PAIRS_HELD = 1_000_000
# Links that are made one by one in a group; above, equal ids of the group are made one first.
SMALL_GROUP = 1024


class ByteLevel:
    """Byte-level merges of a tokenizers file; by the faster library where its ranks are its ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], _alphabet()
        special = {t["content"] for t in spec.get("added_tokens", [])}
        vocabulary = {t: i for t, i in model["vocab"].items() if t not in special}
        self.bytes = [b""] * (max([*model["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocabulary.get(a + b, -1) for a, b in merges]
        before = spec.get("pre_tokenizer") or {}
        ranked = (
            model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space", True)
            and spec.get("normalizer") is None and not model.get("ignore_merges") and not model.get("dropout")
            and made == sorted(set(made)) and len(vocabulary) == 256 + len(made) and (not made or made[0] >= 256)
        )
        if ranked:
            import tiktoken

            coder = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_SPLIT, mergeable_ranks={self.bytes[i]: i for i in vocabulary.values()}, special_tokens={})
            self.encode = lambda texts: [coder.encode_ordinary(t) for t in texts]
        else:
            from tokenizers import Tokenizer

            coder = Tokenizer.from_file(path)
            coder.encode_special_tokens = True
            coder.no_truncation()
            coder.no_padding()
            self.encode = lambda texts: [e.ids for e in coder.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model; its pieces' bytes, where U+2581 is a blank."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        coder = SentencePieceProcessor(model_file=path)
        ids = range(coder.get_piece_size())
        self.bytes = [bytes([int(p[3:5], 16)]) if coder.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, coder.id_to_piece(i)) for i in ids)]
        self.encode = lambda texts: coder.encode(texts, num_threads=1)


class Pair:
    """Both vocabularies: encoding, byte lengths, and ids as parts of a group's string."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        if max(len(self.a.bytes), len(self.b.bytes)) >> ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
        self.sizes = [np.array([len(x) for x in v.bytes], np.int64) for v in (self.a, self.b)]
        n_a, n_b = len(self.a.bytes), len(self.b.bytes)
        # A first of its group, A, B first of its group, B.
        self.names = [f"{sep}{i}".encode() for sep, n in ((";", n_a), (",", n_a), ("|", n_b), (",", n_b)) for i in range(n)]
        self.base = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])

    def tokens(self, texts: list[str]) -> tuple[list, list]:
        """Ids of A and of B for each text; none for both where one does not give the text back."""
        full = [i for i, t in enumerate(texts) if t]
        out: tuple[list, list] = ([[] for _ in texts], [[] for _ in texts])
        found = (self.a.encode([" " + texts[i] for i in full]), self.b.encode([texts[i] for i in full])) if full else ([], [])
        for i, a, b in zip(full, *found):
            whole = (" " + texts[i]).encode()
            if b"".join(map(self.a.bytes.__getitem__, a)) == whole and b"".join(map(self.b.bytes.__getitem__, b)) == whole:
                out[0][i], out[1][i] = a, b
        return out


@lru_cache(2)
def pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def coalesced(a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group of each A and of each B token of sequences that tile the same bytes."""
    a_ends, b_ends = np.cumsum(a_sizes), np.cumsum(b_sizes)
    starts, ends = np.r_[a_ends - a_sizes, b_ends - b_sizes], np.r_[a_ends, b_ends]
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.zeros(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks)
    return group[: len(a_sizes)], group[len(a_sizes) :]


class Batch:
    """Tokens of some texts end to end, with their groups."""

    def __init__(self, own: Pair, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray):
        self.a, self.b, self.a_bounds, self.b_bounds = a, b, a_bounds, b_bounds
        self.n = len(a_bounds) - 1
        self.ga, self.gb = coalesced(own.sizes[0][a], own.sizes[1][b])
        self.n_groups = int(self.ga[-1]) + 1 if len(a) else 0
        self.in_a, self.in_b = np.bincount(self.ga, minlength=self.n_groups), np.bincount(self.gb, minlength=self.n_groups)
        # First group of each text: groups never cross texts.
        self.bounds = np.r_[self.ga, self.n_groups][a_bounds] if len(a) else np.zeros(self.n + 1, np.int64)

    def per_text(self, of_group: np.ndarray) -> np.ndarray:
        return np.diff(cx.running(of_group)[self.bounds])

    def strings(self, own: Pair) -> list[bytes]:
        """``a1,a2|b1;a3|b2,b3`` of each text."""
        before_a, before_b = cx.running(self.in_a), cx.running(self.in_b)
        at_a, at_b = np.arange(len(self.a)), np.arange(len(self.b))
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[at_a + before_b[self.ga]] = self.a + own.base[np.where(at_a == before_a[self.ga], 0, 1)]
        code[at_b + before_a[self.gb + 1]] = self.b + own.base[np.where(at_b == before_b[self.gb], 2, 3)]
        parts = list(map(own.names.__getitem__, code.tolist()))
        ends = (self.a_bounds + self.b_bounds).tolist()
        return [b"".join(parts[i:j])[1:] for i, j in zip(ends, ends[1:])]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, pair, times) of the distinct id pairs of each text, sorted."""
        if not self.n_groups:
            nothing = np.zeros(0, np.int64)
            return nothing, nothing, nothing
        first_b, text_of = cx.running(self.in_b), np.repeat(np.arange(self.n), np.diff(self.bounds))
        large = self.in_a * self.in_b > SMALL_GROUP
        one = np.flatnonzero(~large[self.ga])
        fan = self.in_b[self.ga[one]]
        left = np.repeat(one, fan)
        right = np.arange(len(left)) - np.repeat(np.cumsum(fan) - fan, fan) + np.repeat(first_b[self.ga[one]], fan)
        texts, keys, times = [text_of[self.ga[left]]], [self.a[left] << ID_BITS | self.b[right]], [np.ones(len(left), np.int64)]
        first_a = cx.running(self.in_a)
        for g in np.flatnonzero(large):
            ids_a, n_a = np.unique(self.a[first_a[g] : first_a[g + 1]], return_counts=True)
            ids_b, n_b = np.unique(self.b[first_b[g] : first_b[g + 1]], return_counts=True)
            keys.append((ids_a[:, None] << ID_BITS | ids_b[None, :]).ravel())
            times.append((n_a[:, None] * n_b[None, :]).ravel())
            texts.append(np.full(len(keys[-1]), text_of[g]))
        text, key, n = (np.concatenate(x) for x in (texts, keys, times))
        order = np.lexsort((key, text))
        text, key, n = text[order], key[order], n[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        return text[at], key[at], np.add.reduceat(n, at)


def _ends(sizes) -> np.ndarray:
    return np.r_[0, np.cumsum(sizes)].astype(np.int64)


def _flat(ids: list) -> np.ndarray:
    return np.fromiter((i for x in ids for i in x), np.int64, sum(map(len, ids)))


def _packed(own: Pair) -> np.dtype:
    return np.dtype(np.uint16 if max(len(own.a.bytes), len(own.b.bytes)) <= 1 << 16 else np.uint32)


def _stored(columns: list[pa.Array], own: Pair) -> Batch:
    """The batch that columns of packed ids hold."""
    kind, parts = _packed(own), []
    for c in columns:
        raw = c.to_pylist()
        parts.append((np.frombuffer(b"".join(raw), kind).astype(np.int64), _ends([len(x) // kind.itemsize for x in raw])))
    return Batch(own, parts[0][0], parts[1][0], parts[0][1], parts[1][1])


def groups(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per text: its groups in order, each with its bytes (of a blank and the text) and the ids of both sides."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))

    def run(texts):
        own = pair(path_a, path_b)
        a, b = own.tokens(texts)
        got = Batch(own, _flat(a), _flat(b), _ends(list(map(len, a))), _ends(list(map(len, b))))
        sides = [pa.ListArray.from_arrays(pa.array(cx.running(n).astype(np.int32)), pa.array(ids.astype(np.int32))) for n, ids in ((got.in_a, got.a), (got.in_b, got.b))]
        ends = np.cumsum(own.sizes[0][got.a])[np.cumsum(got.in_a) - 1] if got.n_groups else np.zeros(0, np.int64)
        starts = np.r_[0, ends[:-1]] if got.n_groups else ends
        base = np.repeat(starts[np.minimum(got.bounds[:-1], max(got.n_groups - 1, 0))], np.diff(got.bounds)) if got.n_groups else ends
        flat = pa.StructArray.from_arrays([cx.long_column(starts - base), cx.long_column(ends - base), *sides], ["start", "end", "a", "b"])
        return [pa.ListArray.from_arrays(pa.array(got.bounds.astype(np.int32)), flat).cast(kind)]

    return cx.text_map(docs, text_col, run, "groups array<struct<start:bigint,end:bigint,a:array<int>,b:array<int>>>", [id_col], strings=True)


def _encoded(docs: DataFrame, path_a: str, path_b: str, id_col: str, text_col: str) -> DataFrame:
    """Per text its digest and packed ids, written once; ``block`` names up to BLOCK_BYTES of text of one task."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a binary, b binary, block long"
    names = ["doc_id", *(f.split()[0] for f in fields.split(", "))]

    def run(batches):
        own = pair(path_a, path_b)
        kind = _packed(own)
        block, room = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, BLOCK_BYTES
        for batch in batches:
            for i, j, data, _ in cx.groups(batch.column(1)):
                a, b = own.tokens([x or "" for x in batch.column(1).slice(i, j - i).to_pylist()])
                got = Batch(own, _flat(a), _flat(b), _ends(list(map(len, a))), _ends(list(map(len, b))))
                digests = [hashlib.sha256(s).hexdigest() if s else "" for s in got.strings(own)]
                packed = []
                for ids, bounds in ((got.a, got.a_bounds), (got.b, got.b_bounds)):
                    raw, at = ids.astype(kind).tobytes(), (bounds * kind.itemsize).tolist()
                    packed.append(pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary()))
                room -= len(data)
                if room < 0:
                    block, room = block + 1, BLOCK_BYTES - len(data)
                columns = [np.diff(got.a_bounds), np.diff(got.b_bounds), np.diff(got.bounds), got.per_text(got.in_a * got.in_b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), *map(cx.long_column, columns), pa.array(digests, pa.string()), *packed, cx.long_column(np.full(j - i, block))], names,
                )

    path = scratch_path(docs.sparkSession, "aligned")
    slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, {fields}").write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _sliced(batch: pa.RecordBatch, at: int) -> list[tuple[int, int]]:
    """Runs of rows with about GROUP_BYTES of packed ids in column ``at``."""
    sizes = _ends([len(x) for x in batch.column(at).to_pylist()])
    out, i = [], 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + cx.GROUP_BYTES, "right")) - 1)
        out.append((i, j))
        i = j
    return out


def _counts(coded: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(key, n, best): how many documents hold a pair, and whether no pair of its A id is held by more."""

    def run(batches):
        own, held, size = pair(path_a, path_b), [], 0

        def merged():
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.int64)
            n = np.concatenate([n for _, n in held]) if held else keys
            keys, at = np.unique(keys, return_inverse=True)
            return keys, np.bincount(at, n, len(keys)).astype(np.int64)

        for batch in batches:
            for i, j in _sliced(batch, 0):
                _, keys, _ = _stored([batch.column(c).slice(i, j - i) for c in (0, 1)], own).links()
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
                if size > 2 * PAIRS_HELD:
                    held = [merged()]
                    size = len(held[0][0])
                    if size > PAIRS_HELD:
                        yield pa.RecordBatch.from_arrays([*map(cx.long_column, held[0])], ["key", "n"])
                        held, size = [], 0
        yield pa.RecordBatch.from_arrays([*map(cx.long_column, merged())], ["key", "n"])

    sums = coded.select("a", "b").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    of_a = Window.partitionBy(F.shiftright("key", ID_BITS))  # at most one row per id of B
    return sums.withColumn("best", F.col("n") == F.max("n").over(of_a))


_RESULT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def _looked_up(own: Pair, columns: list[pa.Array], keys: np.ndarray, n: np.ndarray, best: np.ndarray) -> list[pa.Array]:
    text, key, times = _stored(columns, own).links()
    at, size = np.searchsorted(keys, key), len(columns[0])
    sums = [np.zeros(size, np.int64), np.zeros(size, np.int64)]
    for total, weight in zip(sums, (best, n)):
        np.add.at(total, text, times * weight[at])
    return [cx.long_column(x) for x in sums]


def aligned(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", pairs_sent: int = PAIRS_SENT) -> DataFrame:
    """One row per document: tokens, groups and links, the links' document counts, and a digest of the groups."""
    spark = docs.sparkSession
    coded = _encoded(docs, path_a, path_b, id_col, text_col)
    counts, n_pairs = counted(_counts(coded, path_a, path_b))
    kept = [c for c in _RESULT if c not in ("n_best", "count_sum")]
    schema = ", ".join(f"{c} {'long' if c in ('n_best', 'count_sum') else coded.schema[c].dataType.simpleString()}" for c in _RESULT)

    def row(own, columns, found):
        named = dict(zip(kept, columns[: len(kept)])) | dict(zip(("n_best", "count_sum"), _looked_up(own, columns[len(kept) :], *found)))
        return pa.RecordBatch.from_arrays([named[c] for c in _RESULT], _RESULT)

    if n_pairs <= pairs_sent:
        table = counts.toArrow().sort_by("key")
        shared = spark.sparkContext.broadcast((table["key"].to_numpy(), table["n"].to_numpy(), table["best"].to_numpy(zero_copy_only=False)))

        def run(batches):
            own = pair(path_a, path_b)
            for batch in batches:
                for i, j in _sliced(batch, len(kept)):
                    yield row(own, [c.slice(i, j - i) for c in batch.columns], shared.value)

        return coded.select(*kept, "a", "b").mapInArrow(run, schema)

    def own_pairs(batches):
        own, block, seen = pair(path_a, path_b), None, []

        def out():
            keys = np.unique(np.concatenate(seen))
            return pa.RecordBatch.from_arrays([cx.long_column(np.full(len(keys), block)), cx.long_column(keys)], ["block", "key"])

        for batch in batches:
            blocks = batch.column(2).to_numpy()
            cuts = _ends(np.diff(np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1], True])))
            for i, j in zip(cuts, cuts[1:]):
                if block is not None and blocks[i] != block:
                    yield out()
                    seen = []
                block = blocks[i]
                seen.append(np.unique(_stored([batch.column(c).slice(i, j - i) for c in (0, 1)], own).links()[1]))
        if seen:
            yield out()

    needed = coded.select("a", "b", "block").mapInArrow(own_pairs, "block long, key long").distinct().join(counts, "key").select("block", "key", "n", "best")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        own, right = pair(path_a, path_b), right.sort_by("key")
        found = right["key"].to_numpy(), right["n"].to_numpy(), right["best"].to_numpy(zero_copy_only=False)
        left = left.select([*kept, "a", "b"]).combine_chunks()
        parts = [row(own, b.columns, found) for b in left.to_batches(max_chunksize=256)]
        return pa.Table.from_batches(parts, left.schema if not parts else None)

    return coded.groupBy("block").cogroup(needed.groupBy("block")).applyInArrow(meet, schema)
