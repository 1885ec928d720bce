"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

A benchmark item of m bytes occurs in a document with at most e edits only if they share at least
m - q + 1 - q*e q-grams whose diagonals (position in the document less position in the item) lie within a
span of e + 1. Shared q-grams are therefore counted in overlapping bands of 2*(e + 1) diagonals; bands that
reach the bound are verified by an alignment confined to the band. Both texts are first folded: lower case,
anything but letters, digits and non-ASCII characters becomes one space.

The benchmark is a query set: it is read in blocks of at most ``BLOCK_BYTES`` and every block is held
against all documents, so what a worker holds is bounded however large the benchmark is.

Defined cases: null and empty texts, on either side, match nothing; an item shorter than q bytes counts
only where it is a document's whole folded text; rows that repeat are reported each; an empty benchmark
leaves every document; ties between occurrences go to the first one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import map_batches, table

Q = 8
#: Edits allowed, as a share of the item's length.
EDIT_SHARE = 0.1
BLOCK_BYTES = 4 << 20
#: Document bytes scanned at once, and log2 of the bits that tell which q-grams the benchmark has.
SCAN_BYTES, SLOTS = 1 << 20, 22
FOLD = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """Lower case, other marks and white space to single spaces, none at the ends."""
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(FOLD).split())


def codes(data: bytes) -> np.ndarray:
    """All runs of 8 bytes as integers, without a copy."""
    return np.ndarray((max(0, len(data) - Q + 1),), "<u8", data, 0, (1,)) if len(data) >= Q else np.zeros(0, "<u8")


def slot(keys: np.ndarray) -> np.ndarray:
    return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)


def edit_budget(m: int, share: float) -> int:
    """Edits allowed in an item of m bytes: its share, and few enough for a positive q-gram bound."""
    return max(0, min(int(share * m), (m - Q) // Q))


class Block:
    """A block of benchmark items with its q-gram index."""

    def __init__(self, items: list[tuple[int, str]], share: float = EDIT_SHARE):
        folded = [(i, fold(t)) for i, t in items]
        self.short: dict[bytes, list[int]] = {}
        for i, t in folded:
            if 0 < len(t) < Q:
                self.short.setdefault(t, []).append(i)
        kept = [(i, t) for i, t in folded if len(t) >= Q]
        self.ids, self.texts = [i for i, _ in kept], [t for _, t in kept]
        self.budget = np.array([edit_budget(len(t), share) for t in self.texts], np.int64)
        lengths = np.array([len(t) for t in self.texts], np.int64)
        self.bound = lengths - Q + 1 - Q * self.budget

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted q-grams with item and offset of each, and a table that tells which slots have any."""
        keys = np.concatenate([codes(t) for t in self.texts])
        item = np.repeat(np.arange(len(self.texts)), [len(t) - Q + 1 for t in self.texts])
        offset = np.concatenate([np.arange(len(t) - Q + 1) for t in self.texts])
        order = np.argsort(keys, kind="stable")
        there = np.zeros(1 << SLOTS, bool)
        there[slot(keys)] = True
        return keys[order], item[order], offset[order], there

    def candidates(self, docs: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(document, item, first diagonals of the bands that reach the bound) over some documents."""
        keys, item, offset, there = self.index
        data = b"\0".join(docs)
        starts = np.cumsum([0, *(len(d) + 1 for d in docs[:-1])])
        grams = codes(data)
        at = np.flatnonzero(there[slot(grams)])
        hit = grams[at]
        low, high = np.searchsorted(keys, hit, "left"), np.searchsorted(keys, hit, "right")
        n = high - low
        if not (total := int(n.sum())):
            return
        at = np.repeat(at, n)
        post = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
        items, doc = item[post], np.searchsorted(starts, at, "right") - 1
        step = self.budget[items] + 1
        longest = max(map(len, self.texts))
        band = (at - offset[post] + longest) // step  # shifted, so that it is not negative
        both = np.concatenate([band, band - 1])
        span = np.int64(len(data) + longest + 2)
        pair = np.tile(doc * len(self.texts) + items, 2)
        found, counts = np.unique(pair * span + both + 1, return_counts=True)
        pair, band = found // span, found % span - 1
        enough = counts >= self.bound[pair % len(self.texts)]
        if not enough.any():
            return
        # of these, count each q-gram of the item once
        key = np.tile(doc * len(self.texts) + items, 2) * span + both + 1
        own = np.flatnonzero(np.isin(key, found[enough]))
        where = np.searchsorted(found, key[own])
        once = np.unique(where * longest + np.tile(offset[post], 2)[own]) // longest
        enough &= np.bincount(once, minlength=len(found)) >= self.bound[pair % len(self.texts)]
        groups: dict[int, list[int]] = {}
        for p, b in zip(pair[enough].tolist(), band[enough].tolist(), strict=True):
            d, i = divmod(p, len(self.texts))
            groups.setdefault(p, []).append(b * int(self.budget[i] + 1) - longest - int(starts[d]))
        for p, diagonals in groups.items():
            yield *divmod(p, len(self.texts)), diagonals

    def search(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(document, item_id, edits, start, end) of the best occurrence of each item in each document."""
        out = [(d, i, 0, 0, len(t)) for d, t in enumerate(docs) for i in self.short.get(t, ())]
        if self.texts:
            for d, i, diagonals in self.candidates(docs):
                want, text, budget = self.texts[i], docs[d], int(self.budget[i])
                if (a := text.find(want)) >= 0:
                    out.append((d, self.ids[i], 0, a, a + len(want)))
                    continue
                best = min((align(want, text, k, 2 * (budget + 1), budget) for k in diagonals), default=(budget + 1, 0, 0))
                if best[0] <= budget:
                    out.append((d, self.ids[i], *best))
        return out


def align(item: bytes, text: bytes, first: int, width: int, budget: int) -> tuple[int, int, int]:
    """Fewest edits of the whole item against a part of ``text``, on diagonals first .. first + width - 1; and the part.

    Stops with budget + 1 once every diagonal has cost more than the budget.
    """
    far = len(item) + width + 1
    window = np.full(len(item) + width, 256, np.int16)
    a, b = max(0, first), min(len(text), first + len(window))
    if b <= a:
        return budget + 1, 0, 0
    window[a - first : b - first] = np.frombuffer(text[a:b], np.uint8)
    ramp = np.arange(width)
    origin = first + ramp
    cost = np.full(width + 1, far)  # the last entry stays far: there is no diagonal beyond it
    cost[:-1] = np.where((origin >= 0) & (origin <= len(text)), 0, far)
    origin = np.append(origin, 0)
    for i, c in enumerate(item):
        step = cost[:-1] + (window[i : i + width] != c)
        up = cost[1:] + 1  # the item's byte has no partner
        take = up < step
        source = np.where(take, origin[1:], origin[:-1])
        level = np.where(take, up, step) - ramp
        run = np.minimum.accumulate(level)  # bytes of the text have no partner
        cost[:-1] = run + ramp
        if cost.min() > budget:
            return budget + 1, 0, 0
        origin[:-1] = source[np.maximum.accumulate(np.where(level == run, ramp, 0))]
    k = int(cost.argmin())
    return int(cost[k]), int(origin[k]), min(len(text), len(item) + first + k)


def benchmark_blocks(benchmark: DataFrame, share: float = EDIT_SHARE, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The items in blocks of bounded size."""
    held, n = [], 0
    for r in benchmark.filter(F.col("text").isNotNull()).select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).toLocalIterator():
        held.append((r.i, r.t))
        n += len(r.t)
        if n >= size:
            yield Block(held, share)
            held, n = [], 0
    if held:
        yield Block(held, share)


def scan(block: Block, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
    """Occurrences in whole texts, taken in groups of about ``SCAN_BYTES``."""
    held, first, n = [], 0, 0
    for k, t in enumerate(texts):
        held.append(fold(t))
        n += len(held[-1])
        if n >= SCAN_BYTES or k == len(texts) - 1:
            for d, *rest in block.search(held):
                yield first + d, *rest
            held, first, n = [], k + 1, 0


def find_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """Per document and benchmark item that it contains: doc_id, item_id, edits and the span in the folded text's bytes."""
    spark, schema = docs.sparkSession, "doc_id long, item_id long, edits long, start long, end long"
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = spark.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark, share):
        shared = spark.sparkContext.broadcast(block)

        def search(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch | None:
            rows = list(scan(shared.value, batch.column(1).to_pylist()))
            if not rows:
                return None
            at, *rest = zip(*rows, strict=True)
            columns = [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, pa.int64()) for x in rest)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "edits", "start", "end"])

        out = out.unionAll(map_batches(own, search, schema))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = EDIT_SHARE) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns."""
    for block in benchmark_blocks(benchmark, share):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            keep = np.ones(batch.num_rows, bool)
            for d, *_ in scan(shared.value, batch.column(batch.schema.get_field_index("text")).to_pylist()):
                keep[d] = False
            return batch.filter(pa.array(keep))

        docs = map_batches(docs, clean, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
