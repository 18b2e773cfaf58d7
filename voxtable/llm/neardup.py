"""MinHash near-duplicates with sequential Bayesian verification.

1. Texts with equal shingle sets form a class and are represented by their smallest id.
2. Representatives are banded by MinHash. In every bucket all members are paired with the
   most central one (the member with the most company in all its buckets): this star joins
   groups of copies in a number of pairs that grows with the members, not their square.
3. A pair's signatures are compared batch by batch. With a uniform prior the posterior of the
   similarity after n comparisons and m matches is Beta(m + 1, n - m + 1); the pair is dropped
   once the chance of a similarity at the threshold or above is under ``MISS``. Survivors are
   verified on their full shingle sets.
4. Buckets whose members are still in different components are settled pair by pair between
   those components. Pairs that cannot link are never made: shingles that few candidates have
   bound a set's similarity to all sets that lack them, and sizes bound the rest.
5. Components are closed by exchanging least labels with shortcuts, on written edges.

Defined results: a null, empty or wordless text has an empty set, is linked with nothing and is
its own component. Texts with fewer words than a shingle have one shingle, the whole sequence.
Rows that repeat an id share the component of that id, and each of the id's texts can link it.
A row with a null id is linked with nothing, has a null component and is kept. Extra columns
are ignored by ``near_duplicates`` and kept by ``deduplicated``.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxtable.llm import columnar as cx
from voxtable.llm.joins import counted, gathered, row_key, settled, sized, without

WORDS = 5
PERCENT = 80
# A pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8**5)**38, 3e-7.
BANDS = 38
ROWS = 5
HASHES = BANDS * ROWS
# Signature entries per batch, and the chance at which a true link may be dropped by them.
BATCH = 19
MISS = 1e-7
# Candidates that share a shingle up to which it counts as rare.
RARE = 64

_A = np.random.default_rng(51).integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = np.random.default_rng(52).integers(0, 1 << 32, HASHES, dtype=np.uint32)


def prune_below(percent: int, batch: int = BATCH, miss: float = MISS, hashes: int = HASHES) -> list[int]:
    """Least matches to go on with after each batch.

    P(p >= t | m of n) = P(Bin(n + 1, t) <= m) for the Beta posterior of a uniform prior. Entries
    are compared by their lowest byte, so they agree with chance p = J + (1 - J) / 256.
    """
    t = percent / 100
    t, out = t + (1 - t) / 256, []
    for n in range(batch, hashes + 1, batch):
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted by row and hash, and the rows' bounds."""
    n = len(offsets) - 1
    starts, ends, rows = cx.spans(cx.BLANK[data], offsets)
    words = cx.hasher(31)(data, starts, ends)
    sizes = cx.per_row(rows, n)
    grams, whole = cx.gram_hashes(words, k, 320 + k), cx.inside(rows, k)
    keys, owners = [grams[whole]], [rows[: len(whole)][whole]]
    first = np.concatenate([[0], np.cumsum(sizes)])
    for size in range(1, k):
        short = np.flatnonzero(sizes == size)
        at = first[short]
        if len(at):
            few = cx.gram_hashes(words, size, 320 + size)
            keys.append(few[at])
            owners.append(short)
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((keys, owners))
    keys, owners = keys[order], owners[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])
    keys, owners = keys[new], owners[new]
    return keys, np.searchsorted(owners, np.arange(n + 1))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of HASHES minima per set that is not empty."""
    full = np.flatnonzero(np.diff(bounds))
    out = np.empty((HASHES, len(full)), np.uint32)
    if not len(full):
        return out.T
    short = (keys >> np.uint64(32)).astype(np.uint32)
    starts = bounds[full]
    for h in range(HASHES):
        out[h] = np.minimum.reduceat((short ^ _B[h]) * _A[h], starts)
    return np.ascontiguousarray(out.T)


def _profile(k: int):
    """Set size, set digest, signature and band keys of every text."""

    def run(data, offsets):
        keys, bounds = shingle_sets(data, offsets, k)
        n, sizes = len(offsets) - 1, np.diff(bounds)
        full = np.flatnonzero(sizes)
        signs = signatures(keys, bounds)
        digest = np.zeros((2, n), np.uint64)
        if len(full):
            digest[0, full] = np.add.reduceat(cx.mixed(keys), bounds[full])
            digest[1, full] = np.bitwise_xor.reduceat(cx.mixed(keys * np.uint64(0x9E3779B97F4A7C15)), bounds[full])
        raw: list = [None] * n
        for i, sign in zip(full.tolist(), signs):
            raw[i] = sign.tobytes()
        return [cx.long_column(sizes), cx.signed(digest[0]), cx.signed(digest[1]), pa.array(raw, pa.binary())]

    return run


def _bucketed(reps: DataFrame) -> DataFrame:
    """(rep, bucket) for every band of every signature."""
    mix = np.random.default_rng(53).integers(0, (1 << 64) - 1, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)

    def run(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = cx.mixed((signs * mix).sum(2, dtype=np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            owners = np.repeat(np.arange(len(signs)), BANDS)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), cx.signed(keys.ravel())], ["rep", "bucket"])

    return reps.select("rep", "sign").mapInArrow(run, "rep long, bucket long")


def _sketches(reps: DataFrame) -> DataFrame:
    """(rep, sketch): the lowest byte of every signature entry."""

    def run(batches):
        for batch in batches:
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).astype(np.uint8).reshape(-1, HASHES)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in signs], pa.binary())], ["rep", "sketch"])

    return reps.select("rep", "sign").mapInArrow(run, "rep long, sketch binary")


def _verified(pairs: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: pruned by signature, then checked on full sets."""
    pairs, _ = counted(pairs)
    ends, n_ends = counted(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct())
    signed = _sketches(reps.join(sized(ends, n_ends), "rep", "left_semi"))
    both = pairs.join(signed.select(F.col("rep").alias("a"), F.col("sketch").alias("sa")), "a").join(signed.select(F.col("rep").alias("b"), F.col("sketch").alias("sb")), "b")
    least = prune_below(percent)

    def survive(batches):
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, HASHES)
            y = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, HASHES)
            left, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
            for step, m in enumerate(least):
                cut = slice(step * BATCH, (step + 1) * BATCH)
                matches = matches + (x[left, cut] == y[left, cut]).sum(1)
                on = matches >= m
                left, matches = left[on], matches[on]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(left)), batch.column(1).take(pa.array(left))], ["a", "b"])

    passed, _ = counted(both.select("a", "b", "sa", "sb").mapInArrow(survive, "a long, b long"))
    needed, n_needed = counted(passed.select(F.explode(F.array("a", "b")).alias("rep")).distinct())

    def sets(data, offsets):
        keys, bounds = shingle_sets(data, offsets, k)
        return [pa.array([keys[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]

    keyed = _texts_of(needed, n_needed, reps, texts)
    full = cx.text_map(keyed, "text", sets, "keys binary", ["rep"])
    full, _ = counted(full.dropDuplicates(["rep"]))
    held = passed.join(full.select(F.col("rep").alias("a"), F.col("keys").alias("ka")), "a").join(full.select(F.col("rep").alias("b"), F.col("keys").alias("kb")), "b")

    def check(batches):
        for batch in batches:
            good = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * shared >= percent * (len(x) + len(y) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(good, pa.int64())), batch.column(1).take(pa.array(good, pa.int64()))], ["a", "b"])

    return held.select("a", "b", "ka", "kb").mapInArrow(check, "a long, b long")


def _texts_of(needed: DataFrame, n: int, reps: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of some classes, by the id and content of their representatives."""
    chosen, _ = counted(reps.select("rep", "doc_id", "k").join(sized(needed, n), "rep", "left_semi"))
    return texts.join(sized(chosen, n), ["doc_id", "k"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for every node of an edge.

    Large and small stars in turn, after Kiveris and others: every node hands its larger
    neighbours, then itself and its smaller ones, to its least neighbour, until nothing moves.
    """
    edges, n = counted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while n:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = gathered(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), n)
        large = gathered(near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), n)
        low = gathered(large.groupBy("u").agg(F.min("v").alias("m")), n)
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        edges = gathered(settled(small), n)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    heads = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads.select("node", F.col("node").alias("label")))


def _labelled(reps: DataFrame, found: DataFrame) -> DataFrame:
    return reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("label", "rep")).drop("label")


def classes(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int, keys: list) -> tuple[DataFrame, DataFrame]:
    """Rows with their set size and class digest, and (rep, component) of every class."""
    slim = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *keys
    ).withColumn("k", F.xxhash64("text"))
    texts = slim.select("doc_id", "k", "text")
    profile = settled(cx.text_map(slim, "text", _profile(words), "n_shingles long, d1 long, d2 long, sign binary", [c for c in slim.columns if c != "text"]))
    named = profile.filter("n_shingles > 0 and doc_id is not null")
    first = named.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "k")).alias("least")).select("d1", "d2", "least.*")
    reps = named.join(first, ["d1", "d2", "doc_id", "k"]).withColumn("rep", F.xxhash64("d1", "d2")).dropDuplicates(["rep"])
    reps, _ = counted(reps.select("rep", "doc_id", "k", "sign", F.col("n_shingles").alias("n")))

    member = _bucketed(reps)
    crowded = member.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    member, _ = counted(member.join(crowded, "bucket"))
    weight = member.groupBy("rep").agg(F.sum("size").alias("weight"))
    member = member.join(weight, "rep").select("rep", "bucket", "weight")
    centre = member.groupBy("bucket").agg(F.max_by("rep", F.struct("weight", "rep")).alias("centre"))
    star = member.join(centre, "bucket").filter("rep <> centre").select(F.least("rep", "centre").alias("a"), F.greatest("rep", "centre").alias("b")).distinct()
    links, _ = counted(_verified(star, reps, texts, words, percent))

    # Ids that repeat with different texts tie their classes together.
    tied = named.select("doc_id", "d1", "d2").distinct().withColumn("class", F.xxhash64("d1", "d2"))
    tied = tied.withColumn("low", F.min("class").over(Window.partitionBy("doc_id"))).filter("low <> class").select(F.col("low").alias("a"), F.col("class").alias("b"))
    found, _ = counted(components(links.union(tied)))

    open_ = member.select("rep", "bucket").join(_labelled(reps.select("rep", "n"), found), "rep")
    mixed = open_.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("bucket")
    open_, n_open = counted(open_.join(mixed, "bucket"))
    # Where no bucket holds members of two components, there is nothing left to settle.
    more, n_more = counted(_verified(_crossing(open_, reps, texts, words, percent), reps, texts, words, percent)) if n_open else (None, 0)
    if n_more:
        # Components found so far count as nodes of the second closure.
        joined = more.select(F.col("a").alias("rep"), "b").join(_labelled(more.select(F.col("a").alias("rep")), found).distinct(), "rep").select(F.col("comp").alias("a"), F.col("b").alias("rep"))
        joined = joined.join(_labelled(more.select(F.col("b").alias("rep")), found).distinct(), "rep").select("a", F.col("comp").alias("b"))
        again = components(joined).withColumnRenamed("node", "comp").withColumnRenamed("label", "final")
        found, _ = counted(_labelled(reps.select("rep"), found).join(again, "comp", "left").select(F.col("rep").alias("node"), F.coalesce("final", "comp").alias("label")))
    labelled = _labelled(reps.select("rep", "doc_id"), found)
    low = labelled.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return profile, labelled.join(low, "comp").select(F.col("rep").alias("class"), "component_id")


def _crossing(open_: DataFrame, reps: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs of two components whose sizes and shared shingles let them link.

    A shingle is rare if at most RARE candidates have it. Two sets of n and m shingles, r and q
    of them rare, share s <= c + min(n - r, m - q) with c rare ones in common, and a link needs
    100 s >= percent (n + m - s). Pairs with c > 0 come from joining the rare shingles, each with
    few owners. For the others c = 0, so n, r and m, q alone decide: they are joined by bucket
    and size, with the sizes that r and q still allow.
    """
    keyed = _texts_of(*counted(open_.select("rep").distinct()), reps, texts)

    def keys(data, offsets):
        found, bounds = shingle_sets(data, offsets, k)
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), cx.signed(found))]

    shingles = cx.text_map(keyed, "text", keys, "keys array<long>", ["rep"]).dropDuplicates(["rep"]).select("rep", F.explode("keys").alias("key"))
    shingles, _ = counted(shingles)
    owners = shingles.groupBy("key").agg(F.count("*").alias("owners")).filter(F.col("owners") <= RARE)
    rare, _ = counted(shingles.join(owners, "key"))
    kinds = rare.groupBy("rep").agg(F.count("*").alias("r"))
    known, _ = counted(open_.select("rep", "n", "comp").distinct().join(kinds, "rep", "left").withColumn("r", F.coalesce("r", F.lit(0))))

    side = lambda x: known.select(*[F.col(c).alias(f"{c}_{x}") for c in known.columns])
    linked = rare.filter("owners > 1").select("key", "rep")
    left, right = (linked.withColumnRenamed("rep", f"rep_{x}").join(side(x), f"rep_{x}") for x in "ab")
    apart = (F.col("rep_a") < F.col("rep_b")) & (F.col("comp_a") != F.col("comp_b"))
    near_sizes = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * F.col("n_b") >= percent * F.col("n_a"))
    met = left.join(right, "key").filter(apart & near_sizes).groupBy("rep_a", "rep_b", "n_a", "n_b", "r_a", "r_b").agg(F.count("*").alias("c"))
    most_shared = F.col("c") + F.least(F.col("n_a") - F.col("r_a"), F.col("n_b") - F.col("r_b"))
    by_key = met.filter((100 + percent) * most_shared >= percent * (F.col("n_a") + F.col("n_b"))).select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))

    shared = F.col("n") - F.col("r")
    most = F.floor(((100 + percent) * shared - percent * F.col("n")) / percent)
    sizes = open_.select("rep", "bucket").join(known, "rep").select("rep", "bucket", "comp", "n", F.least(most, F.floor(100 * F.col("n") / percent)).alias("most"))
    sizes = sizes.filter(100 * F.col("most") >= percent * F.col("n"))
    # A bucket's largest component is only on one side: its own pairs are settled.
    main = open_.groupBy("bucket", "comp").agg(F.count("*").alias("size")).groupBy("bucket").agg(F.max_by("comp", F.struct("size", "comp")).alias("main"))
    sizes, _ = counted(sizes.join(main, "bucket"))
    # Sizes fall in steps of a factor of the threshold, so partners are in the same or the next step.
    step = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(-np.log(percent / 100)))).cast("int")
    left = sizes.filter("comp <> main").select("bucket", F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("most").alias("ma"), F.explode(F.array(step - 1, step, step + 1)).alias("step"))
    right = sizes.select("bucket", F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("most").alias("mb"), "main", step.alias("step"))
    fits = (F.col("ca") != F.col("cb")) & ((F.col("a") < F.col("b")) | (F.col("cb") == F.col("main"))) & (F.col("nb") <= F.col("ma")) & (F.col("na") <= F.col("mb"))
    by_size = left.join(right, ["bucket", "step"]).filter(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return by_key.union(by_size).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, keys: list | None = None) -> DataFrame:
    """One row per document: set size, component and whether it is the one that stays."""
    profile, found = classes(docs, id_col, text_col, words, percent, keys or [])
    rows = profile.drop("sign", "k").withColumn("class", F.xxhash64("d1", "d2"))
    joined = rows.filter("n_shingles > 0").join(found, "class", "left").union(rows.filter("n_shingles = 0").withColumn("component_id", F.lit(None).cast("long")).select("class", *[c for c in rows.columns if c != "class"], "component_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    extra = [c for c in rows.columns if c.startswith("__")]
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), *extra).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of rows alike in id and text all stay or none."""
    bad = near_duplicates(docs, id_col, text_col, words, percent, row_key(id_col, text_col)).filter("not kept")
    return without(docs, bad, id_col, text_col)
