"""N-gram Jaccard join: a size-aware heavy-light set similarity self-join.

A document is the set of its distinct word n-grams. Sets that link must share k elements among the first few
of each under one global order, rarest first (k-prefixes). Small sets enumerate all fixed-size subsets, the
2-subsets of their 2-prefix, and meet where a subset is equal; large sets scan the inverted lists of single
elements of their prefixes, which small sets of comparable size join too. The size that divides the two is
the one of least estimated cost. Equal sets are collapsed before, so copies cost nothing; groups of near
copies are held against leaders (see ``linkage``); candidates pass a positional bound and are then verified
on their whole sets.

The global order comes from a table of ``CELLS`` counters over all n-grams of all documents. It decides cost
only: any order gives the same links. N-grams are compared as 64-bit hashes.

Defined cases: null and blank texts have empty sets and link with nothing; fewer words than n make one
n-gram; equal sets link; rows that repeat a doc_id are rows of their own, under that id; a null doc_id gets
the component of its set, null if no other row has one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Scratch, binaries, bounded_batches, map_batches, possibly_in, table, words_of
from tallymark.llm.linkage import connected_components, gather_cells, links_among, nodes_of, shared_only

CELLS_LOG2 = 20
SIZES = 64
#: Bits of the tables that tell which sets and which texts are candidates.
FILTER_LOG2 = 23
CACHE_ENTRIES = 1 << 19
#: Odd multipliers that tell the places of a word in an n-gram apart.
PLACES = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) & (2**64 - 1) | 1 for k in range(64)], np.uint64)


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[word] = h
        return h


HASHES = WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes | None, n: int = 4) -> np.ndarray:
    """The set of hashed word n-grams, sorted."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    m = len(words) - n + 1
    sums = h[:m] * PLACES[0]
    for k in range(1, n):
        sums = sums + h[k : k + m] * PLACES[k]
    return np.unique(mix(sums))


class Threshold:
    """Jaccard of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: int) -> int:
        """The smallest overlap of a set of n with anything it links to."""
        return -(-self.num * n // self.den)

    def prefix(self, n: int, k: int) -> int:
        return min(n, n - self.least(n) + k)

    def overlap(self, n: Column, m: Column) -> Column:
        """The smallest overlap of linked sets of n and m."""
        return F.ceil(F.lit(self.num) * (n + m) / F.lit(self.num + self.den) - 1e-9)


def choose_boundary(sizes: np.ndarray, scan: float, limit: Threshold) -> int:
    """The largest size of small sets, by least cost: subsets made by small sets, lists made and scanned by large ones."""
    subsets = np.array([limit.prefix(n, 2) * (limit.prefix(n, 2) - 1) / 2 for n in range(SIZES)])
    lists = np.array([limit.prefix(n, 1) * (1 + scan) for n in range(SIZES)])
    costs = []
    for x in range(SIZES):
        near = np.arange(SIZES) >= limit.least(x + 1)
        small = np.arange(SIZES) <= x
        costs.append((sizes * (small * subsets + (~small | near) * lists)).sum())
    return int(np.argmin(costs))


def signatures(keys: np.ndarray, order: np.ndarray, boundary: int, limit: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of a set, the place of each less its surplus elements, and whether it is a small set's list entry."""
    n = len(keys)
    ranked = keys[np.lexsort((keys, order))]
    sigs, slack, lone = [], [], []
    if n <= boundary:
        p = ranked[: limit.prefix(n, 2)]
        i, j = np.triu_indices(len(p), 1)
        sigs.append(mix(p[i] * PLACES[4] + p[j] * PLACES[5]))
        slack.append(j - 1)
        lone.append(np.zeros(len(i), bool))
    if n > boundary or n >= limit.least(boundary + 1):
        p = ranked[: limit.prefix(n, 1)]
        sigs.append(mix(p ^ PLACES[6]))
        slack.append(np.arange(len(p)))
        lone.append(np.full(len(p), n <= boundary))
    return np.concatenate(sigs), np.concatenate(slack), np.concatenate(lone)


def set_key(keys: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit digest of a set."""
    d = xxhash.xxh3_128_digest(keys.astype("<u8").tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def as_lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else [], kind))


def text_sets(docs: DataFrame, n: int, limit: Threshold) -> tuple[DataFrame, int]:
    """Per row: doc_id, n_shingles, the set's key (k1, k2), the text's hash, how common the set is, and its signatures; and the boundary."""
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_hash().alias("own"))
    cells = 1 << CELLS_LOG2

    def fill(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        for text in binaries(batch.column(1)):
            keys = shingles(text, n)
            np.add.at(counts, cells + min(len(keys), SIZES), 1)
            np.add.at(counts, (keys >> np.uint64(64 - CELLS_LOG2)).astype(np.int64), 1)

    bounded_batches(docs.sparkSession)
    counts = gather_cells(own.select("doc_id", "text"), fill, cells + 64 * SIZES, "<u8")
    sizes, counts = counts[cells : cells + SIZES].astype(float), counts[:cells]
    mean = max(1e-9, counts.mean())
    boundary = choose_boundary(sizes, max(0.0, float((counts.astype(float) ** 2).sum() / max(1, counts.sum()) / mean - 1)), limit)
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id long, n int, k1 long, k2 long, own long, common float, sig array<long>, slack array<int>, lone array<boolean>"

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        order, rows, sigs, slacks, lones = shared.value, [], [], [], []
        for doc_id, text, there in zip(batch.column(0).to_pylist(), binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            keys = shingles(text, n)
            own = order[(keys >> np.uint64(64 - CELLS_LOG2)).astype(np.int64)]
            rows.append((doc_id, len(keys), *set_key(keys), there, float(np.median(own)) if len(keys) else 0.0))
            sig, slack, lone = signatures(keys, own, boundary, limit) if len(keys) else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, bool))
            sigs.append(sig.view(np.int64))
            slacks.append(slack.astype(np.int32))
            lones.append(lone)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.float32()]
        columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, as_lists(sigs, pa.int64()), as_lists(slacks, pa.int32()), as_lists(lones, pa.bool_())], [x.split()[0] for x in schema.split(", ")])

    return map_batches(own, sets, schema), boundary


def join_ngrams(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles and component_id, the smallest doc_id that links reach."""
    spark, limit = docs.sparkSession, Threshold(num, den)
    scratch = Scratch(spark, "ngram-join")
    found, _ = text_sets(docs, n, limit)
    made = scratch.save(found, "made")
    sets = scratch.save(made.select("doc_id", "n", "k1", "k2"), "sets")
    whole = [F.first(c).alias(c) for c in ("n", "common", "sig", "slack", "lone")]
    reps = scratch.save(made.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.min("own").alias("own"), F.count("*").alias("copies"), *whole), "reps")
    scratch.drop(made)
    scratch.release()
    entries = reps.select(F.col("k1").alias("node"), F.explode(F.arrays_zip("sig", "slack", "lone")).alias("e"))
    place = F.shiftleft(F.col("e.slack"), 1) + F.col("e.lone").cast("int")
    shared = shared_only(scratch, entries.select("e.sig", "node", place.alias("place")))
    whole = reps.select(F.col("k1").alias("node"), "n", (F.col("copies") * 1e9 + F.col("common")).alias("rank"))
    buckets = scratch.save(shared.join(whole, "node").select("sig", "node", "rank", "n", F.shiftright("place", 1).alias("slack"), (F.col("place") % 2 == 1).alias("lone")), "members")
    scratch.drop(shared)
    scratch.release()

    def feasible(x: Column, y: Column) -> Column:
        need = limit.overlap(x["n"], y["n"])
        return ~(x["lone"] & y["lone"]) & (F.least(x["n"] - x["slack"], y["n"] - y["slack"]) >= need)

    def verify(pairs: DataFrame) -> DataFrame:
        nodes = nodes_of(pairs).join(reps.select(F.col("k1").alias("node"), "own"), "node")
        sets_of = candidate_sets(scratch, docs, scratch.save(nodes, "nodes"), n)
        scratch.release()
        a, b = (sets_of.select(F.col("node").alias(c), F.col("keys").alias(f"keys_{c}")) for c in "ab")

        def link(batch: pa.RecordBatch) -> pa.RecordBatch:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                keep.append(den * both >= num * ((len(x) + len(y)) // 8 - both))
            return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        held = scratch.save(map_batches(pairs.join(a, "a").join(b, "b").select("a", "b", "keys_a", "keys_b"), link, "a long, b long"), "verified")
        scratch.drop(sets_of)
        scratch.release()
        return held

    links = links_among(scratch, buckets, feasible, verify)
    part = scratch.save(connected_components(scratch, links), "components")
    owned = reps.join(part, reps.k1 == part.node, "left").select("k1", "k2", "rep", F.coalesce("component", "k1").alias("c"))
    owned = scratch.save(owned, "owned")
    least = owned.groupBy("c").agg(F.min("rep").alias("component_id"))
    by_set = owned.join(least, "c").select("k1", "k2", "component_id")
    out = sets.select("doc_id", "n", "k1", "k2").join(by_set, ["k1", "k2"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def candidate_sets(scratch: Scratch, docs: DataFrame, nodes: DataFrame, n: int) -> DataFrame:
    """(node, keys) of the sets in ``nodes`` (node, own), made again from the text of each with the hash ``own``.

    Bounded bit tables keep most other texts from being read by Python, and most other sets from being moved.
    """
    slots = 1 << FILTER_LOG2
    bits = gather_cells(nodes.select("node"), lambda t, b: t.__setitem__(b.column(0).to_numpy() & (slots - 1), 1), slots, "u1", np.bitwise_or)
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bits != 0))

    def keys(batch: pa.RecordBatch) -> pa.RecordBatch:
        there, rows = shared.value, []
        for text in binaries(batch.column(0)):
            own = shingles(text, n)
            k1 = set_key(own)[0]
            at = k1 & (slots - 1)
            if len(own) and there[at >> 3] >> (7 - (at & 7)) & 1:
                rows.append((k1, own.astype("<u8").tobytes()))
        node, data = zip(*rows, strict=True) if rows else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(data, pa.binary())], ["node", "keys"])

    texts = possibly_in(docs.select(F.col("text").cast("string").alias("text"), text_hash().alias("own")), nodes.select("own"), "own", slots // 64)
    made = map_batches(texts.select("text"), keys, "node long, keys binary")
    return scratch.save(made.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "candidates")


def keep_representatives(docs: DataFrame, **how: int) -> DataFrame:
    """The rows of ``docs`` but those that link to a smaller doc_id; repeated rows of one doc_id count once.

    Rows without a doc_id or without words stay.
    """
    spark = docs.sparkSession
    parts = Scratch(spark, "representatives").save(join_ngrams(docs, **how), "parts")
    gone = parts.filter("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(table(spark, sf_dir, "documents"), 4, 85, 100)
