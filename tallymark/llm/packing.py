"""Packing of tokenised documents into sequences of bounded length.

Documents become runs of token ids with an end id, cut into pieces of at most ``SEQUENCE`` ids. Pieces are
dealt into randomised groups of about ``GROUP`` pieces; within a group they are placed first-fit decreasing,
and a tournament tree over the bins' free capacities finds the first bin that fits in logarithmic time.
Groups are independent, so nothing is ever gathered beyond one group.

Defined cases: a null or empty text is the end id alone; an empty table gives no pieces; rows that repeat a
doc_id, or have none, are documents of their own; pieces of equal length keep the order of their documents'
hash; other columns are ignored unless they are carried along on purpose.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import Scratch, map_batches, table

SEQUENCE, GROUP, END_ID = 2048, 4096, 1
#: Pre-tokens of byte-level BPE vocabularies of this kind. A fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's cache, and the longest chunk that enters it.
CACHE_ENTRIES, CACHE_CHARS = 500_000, 32


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files of byte-level BPE."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: A mark after a letter is a pre-token of its own at a chunk's end.
PUNCTUATION = frozenset(".,;:!?")


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Chunks(dict):
    """Ids, as little-endian bytes, of text chunks that stand after a space (or start with a line break)."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode
        self.marks = {c: packed(encode(c)) for c in PUNCTUATION}

    def __missing__(self, chunk: str) -> bytes:
        if chunk[-1:] in PUNCTUATION and chunk[-2:-1].isalpha():
            ids = self[chunk[:-1]] + self.marks[chunk[-1]]
        else:
            ids = packed(self.encode(chunk if chunk[:1] == "\n" else f" {chunk}"))
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Byte-level BPE over a vocabulary file, with a cache of chunks between single spaces.

    Between single white-space characters pre-tokens never cross a space, so chunks are encoded one by one.
    Texts with other or repeated white space are encoded whole. With ``added``, added tokens of the vocabulary
    that a text spells out become their ids, as tokenizers do by default; otherwise they are text like any other.
    """

    def __init__(self, path: str, added: bool = False):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet, special = byte_alphabet(), {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items() if token not in special}
        self.plain = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks = Chunks(self.plain)
        own = [t for t in spec.get("added_tokens", ()) if added]
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in own):
            raise ValueError("added tokens that take in white space or need whole words are not supported")
        self.added = {t["content"]: t["id"] for t in own}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if own else None

    def split(self, text: str) -> list[int]:
        """The ids of a text that may hold added tokens."""
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += [*self.plain(text[at : m.start()]), self.added[m[0]]]
            at = m.end()
        return ids + self.plain(text[at:])

    def ids(self, text: str | None) -> bytes:
        """The text's ids and the end id, 4 bytes each."""
        if not text:
            return packed([END_ID])
        if self.cut and self.cut.search(text):
            return packed([*self.split(text), END_ID])
        words = text.split()
        gaps = len(words) - 1
        if len(text) - len("".join(words)) != gaps or text.count(" ") + text.count("\n") != gaps:
            return packed([*self.plain(text), END_ID])
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join([packed(self.plain(first)), *map(self.chunks.__getitem__, rest), packed([END_ID])])


@cache
def encoder(path: str, added: bool = False) -> Encoder:
    """One per worker process."""
    return Encoder(path, added)


def tokenize_pieces(docs: DataFrame, vocabulary: str, size: int = SEQUENCE, added: bool = False) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) that cover each document's ids once; ids are unsigned 32-bit."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode, rows = encoder(vocabulary, added).ids, []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids = encode(text)
            n = len(ids) // 4
            rows += [(doc_id, a, min(size, n - a), n, ids[4 * a : 4 * (a + size)]) for a in range(0, n, size)]
        kinds = [pa.int64()] * 4 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "doc_tokens", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), cut, "doc_id long, start long, length long, doc_tokens long, ids binary")


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; a tournament tree over free capacities finds the first bin that fits."""
    n = max(1, len(lengths))
    leaves = 1 << (n - 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= need
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
    return bins, offsets


def assign_sequences(pieces: DataFrame, size: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset added; offsets run gapless from 0 in each sequence."""
    spark = pieces.sparkSession
    saved = Scratch(spark, "packing").save(pieces, "pieces")  # row numbers below must not change on a retry
    groups = max(1, -(-saved.count() // group))
    schema = saved.drop("__group").schema.simpleString()[7:-1] + ",sequence_id:bigint,offset:bigint"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = first_fit_decreasing(rows["length"].to_numpy(), size)
        return rows.drop(columns="__group").assign(sequence_id=(int(key[0]) << 24) | bins, offset=offsets)

    dealt = saved.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(pack, ", ".join(x.replace(":", " ", 1) for x in schema.split(",")))


def pack(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Packed pieces with their ids: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return assign_sequences(tokenize_pieces(docs, vocabulary))


def packed_digest(docs: DataFrame, vocabulary: str) -> DataFrame:
    """As ``pack``, with the ids' crc32 in place of the ids, which then need not be shuffled, and added tokens as the tokenizer takes them."""
    pieces = tokenize_pieces(docs, vocabulary, added=True).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return assign_sequences(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digest(table(spark, sf_dir, "documents"), default_vocabulary())
