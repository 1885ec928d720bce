"""Connected groups of near-duplicates from shared signatures, without listing all pairs of a group.

Members of a signature's bucket are first held against one leader, the member of the highest rank. What
links to the leader is one component; only members that are still apart are then held against the others of
their bucket, and pairs inside one component are never formed. The result is exact: two members that share a
signature and link are in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import Scratch, possibly_in

#: 64-bit words of the broadcast table that tells which members are still apart: 2^24 bits.
FILTER_WORDS = 1 << 18

#: (side, side) -> whether two rows of a bucket, seen as columns of structs, can link at all.
Feasible = Callable[[Column, Column], Column]
#: Pairs (a, b) -> those that link.
Verify = Callable[[DataFrame], DataFrame]
#: (signature, side, side) -> whether two members that are still apart are to be verified for this signature.
Closer = Callable[[Column, Column, Column], Column]


def connected_components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest node.

    Alternates large and small stars until nothing changes; each round is a written table.
    """
    state = None
    edges = scratch.save(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = scratch.save(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, scratch.save(small, "small")
        scratch.drop(before, large)
        now = edges.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def links_among(scratch: Scratch, buckets: DataFrame | Sequence[DataFrame], feasible: Feasible, verify: Verify, about: DataFrame | None = None, closer: Closer | None = None, detail: DataFrame | None = None) -> DataFrame:
    """Edges (a, b) whose connected components are those of all links among ``buckets`` (sig, node, rank, ...).

    ``buckets`` must hold shared signatures only and is dropped on the way. ``verify`` takes pairs (a, b) and
    returns those that link; it gets whatever sets or texts these pairs need, so that no others are moved.
    Buckets dealt into several tables, each signature in one of them, are moved one table after the other, so
    that shuffles hold one at a time; what ``feasible`` needs of a node can stand in ``about`` (node, ...) once.
    Members that are still apart after their leaders also have to pass ``closer``, which has ``detail`` (node, ...)
    of them instead, with the columns of ``about`` and more. It may turn down pairs that do not link, and other pairs for all of their signatures but one.
    """
    dealt = [buckets] if isinstance(buckets, DataFrame) else list(buckets)
    extra = ["node", *(c for c in (dealt[0] if about is None else about).columns if c not in ("sig", "rank", "node"))]
    member = F.struct(*extra)

    def whole(rows: DataFrame) -> DataFrame:
        return rows if about is None else rows.join(about, "node")

    def near(sig: Column, x: Column, y: Column) -> Column:
        return feasible(x, y) if closer is None else feasible(x, y) & closer(sig, x, y)

    known = member if detail is None else F.struct(*detail.columns)

    def together(tables: list[DataFrame], name: str) -> DataFrame:
        """The rows of all tables, each once; the tables go."""
        if len(tables) == 1:
            return tables[0]
        out = scratch.save(reduce(DataFrame.unionByName, tables).distinct(), name)
        scratch.drop(*tables)
        return out

    def stars(own: DataFrame) -> DataFrame:
        rows = whole(own).select("sig", "rank", member.alias("x")).repartition("sig")  # dealt once, for leaders and for members
        lead = rows.groupBy("sig").agg(F.max_by("x", F.struct("rank", F.col("x.node"))).alias("y"), F.count("*").alias("n"))
        met = rows.join(lead, "sig").filter((F.col("x.node") != F.col("y.node")) & feasible(F.col("x"), F.col("y")))
        return scratch.save(ordered(met).distinct(), "star-pairs")

    found = []
    for own in dealt:
        found.append(stars(own))
        scratch.release()
    first = together(found, "all-star-pairs")
    links = scratch.save(verify(first), "star-links")
    part = scratch.save(connected_components(scratch, links), "star-components")

    def others(own: DataFrame) -> DataFrame:
        if "members" in own.columns:  # a bucket of two is done with its star
            own = own.filter("members > 2")
        else:
            own = own.join(own.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 2").select("sig"), "sig", "left_semi")
        named = own.select("sig", "rank", "node").join(part, "node", "left").select("sig", "rank", "node", F.coalesce("component", "node").alias("c"))
        mixed = named.groupBy("sig").agg(F.max_by("c", F.struct("rank", "node")).alias("main"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("sig", "main")
        mixed = scratch.save(mixed, "mixed")
        known_of = about if detail is None else detail
        if known_of is None:
            met = own.join(mixed, "sig")
        else:  # the few that are apart are told before what is known of all nodes moves
            few = scratch.save(own.join(mixed, "sig").select("sig", "node", "main"), "met")
            met = few.join(possibly_in(known_of, few, "node", FILTER_WORDS), "node")
        apart = met.select("sig", known.alias("x"), "main").join(part, F.col("x.node") == part.node, "left")
        apart = scratch.save(apart.select("sig", "x", F.coalesce("component", F.col("x.node")).alias("c"), "main"), "apart")
        scratch.drop(mixed, *([] if known_of is None else [few]))
        scratch.release()
        one = apart.filter("c <> main").select("sig", "x", F.col("c").alias("cx"), "main")
        two = apart.select(F.col("sig").alias("sig2"), F.col("x").alias("y"), F.col("c").alias("cy"))
        once = (F.col("cy") == F.col("main")) | (F.col("x.node") < F.col("y.node"))
        rest = one.join(two, (F.col("sig") == F.col("sig2")) & (F.col("cx") != F.col("cy")) & once & near(F.col("sig"), F.col("x"), F.col("y")))
        rest = scratch.save(ordered(rest).distinct().join(first, ["a", "b"], "left_anti"), "rest-pairs")
        scratch.drop(apart)
        return rest

    found = []
    for own in dealt:
        found.append(others(own))
        scratch.drop(own)
        scratch.release()
    rest = together(found, "all-rest-pairs")
    edges = part.select(F.col("node").alias("a"), F.col("component").alias("b"))
    return edges if rest.isEmpty() else scratch.save(edges.unionByName(verify(rest)), "links")


def nodes_of(pairs: DataFrame) -> DataFrame:
    """(node) of the pairs (a, b), each once."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"))


def shared_only(scratch: Scratch, buckets: DataFrame) -> DataFrame:
    """The rows of ``buckets`` whose signature more than one row has, as a written table.

    A node must not repeat a signature. Signatures are counted before the rows themselves move; the few that
    are shared are the hashed side of the join, so the many rows need no sort.
    """
    shared = buckets.groupBy("sig").agg(F.count("*").alias("n")).filter("n > 1").select("sig")
    return scratch.save(buckets.join(shared.hint("shuffle_hash"), "sig", "left_semi"), "buckets")


def shared_among(scratch: Scratch, rows: DataFrame) -> DataFrame:
    """The rows of ``rows`` (sig, node, n) whose signature more than one has, as a written table (sig, node, rank, members).

    A node must not repeat a signature. Rows are dealt once, for counting and for choosing. ``rank`` is 1 for one
    of the nodes with the most occurrences ``n`` (from 127 on they count as equal), else 0; ``members`` counts the rows.
    """
    moved = rows.select("sig", "node", F.least("n", F.lit(127)).cast("int").alias("n")).repartition("sig")
    order = F.shiftleft(F.col("n").cast("long"), 56).bitwiseOR(F.shiftrightunsigned("node", 8))
    top = moved.groupBy("sig").agg(F.count("*").alias("members"), F.max(order).alias("top")).filter("members > 1")
    return scratch.save(moved.join(top.hint("shuffle_hash"), "sig").select("sig", "node", (order == F.col("top")).cast("int").alias("rank"), "members"), "buckets")


def gather_cells(df: DataFrame, fill: Callable[[np.ndarray, pa.RecordBatch], None], cells: int, dtype: str, merge: np.ufunc = np.add, chunks: int = 64) -> np.ndarray:
    """A table of ``cells`` numbers merged over all rows; tasks and the driver hold one table each, whatever the input.

    ``fill`` adds a batch to a task's table. Tables travel in chunks, which are merged as they stream by. Marks
    need ``np.bitwise_or`` as ``merge``, for a sum of narrow numbers wraps; counts need 64 bits.
    """
    size = cells // chunks

    def chunk_rows(table: np.ndarray) -> pa.RecordBatch:
        used = [k for k in range(chunks) if table[k * size : (k + 1) * size].any()]
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([table[k * size : (k + 1) * size].tobytes() for k in used], pa.binary())], ["chunk", "cells"])

    def fold(table: np.ndarray, chunk: int, own: bytes) -> None:
        part = table[chunk * size : (chunk + 1) * size]
        merge(part, np.frombuffer(own, dtype), out=part)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype)
        for batch in batches:
            fill(table, batch)
        yield chunk_rows(table)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, dtype)
        for batch in batches:
            for k, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold(table, k, own)
        yield chunk_rows(table)

    out = np.zeros(cells, dtype)
    for row in df.mapInArrow(count, "chunk int, cells binary").repartition("chunk").mapInArrow(add, "chunk int, cells binary").toLocalIterator():
        fold(out, row.chunk, row.cells)
    return out
