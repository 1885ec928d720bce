"""Language identification by prediction by partial matching.

Each language has a variable-order tree of byte contexts (orders 3 to 0, then uniform) with the escape
probabilities of method C, frozen after training. A text's score under a language is its exact code
length in bits; the language with the shortest code wins. The trees of all languages are flattened into
sorted gram tables whose rows hold the complete code lengths, escapes included, so scoring a text is a
few vectorised lookups.

Training takes whole texts from a bounded sample: ``TRAIN_BYTES`` expected bytes a language, chosen by a
hash of the id, from texts of at most ``TRAIN_TEXT_BYTES`` each. Scoring reads every text to its end.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any training row all
texts are ``und``; ties go to the language whose name sorts first; repeated rows get equal answers; the
score is the winner's posterior under equal priors; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import in_fold, map_batches, table

ORDER = 3
TRAIN_BYTES, TRAIN_TEXT_BYTES = 800_000, 1 << 16
#: Every text starts after this, so its first bytes have contexts too.
PAD = b"\n" * ORDER
#: Bytes scored at once.
BLOCK = 1 << 20
SLOTS = 20


def normal(text: str) -> bytes:
    return PAD + text.lower().encode("utf-8", "replace")


def grams(data: np.ndarray, order: int) -> np.ndarray:
    """Big-endian codes of all runs of ``order`` + 1 bytes that end at or after the pad."""
    n = len(data) - ORDER
    out = np.zeros(n, np.uint32)
    for k in range(ORDER - order, ORDER + 1):
        out = (out << np.uint32(8)) | data[k : k + n]
    return out


class Trees:
    """Frozen statistics of all languages."""

    def __init__(self, samples: dict[str, list[str]]):
        self.langs = sorted(samples)
        shape = len(self.langs)
        self.keys: list[np.ndarray] = []
        self.costs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        if not samples:
            return
        data = [[np.frombuffer(normal(t), np.uint8) for t in samples[x]] for x in self.langs]
        lower = np.full((256, shape), 8.0)  # order -1: uniform over bytes
        for order in range(ORDER + 1):
            counted = [np.unique(np.concatenate([grams(d, order) for d in own]), return_counts=True) for own in data]
            keys = np.unique(np.concatenate([k for k, _ in counted]))
            if order == 0:
                keys = np.arange(256, dtype=np.uint32)
            contexts = np.unique(keys >> np.uint32(8))
            back = lower[(keys & np.uint32(0xFF)).astype(np.intp)] if order == 0 else lower[np.searchsorted(self.keys[-1], keys & np.uint32((1 << 8 * order) - 1))]
            costs, escapes = back.copy(), np.zeros((len(contexts), shape))
            for j, (k, n) in enumerate(counted):
                at = np.searchsorted(contexts, k >> np.uint32(8))
                total = np.bincount(at, n, len(contexts))
                kinds = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escapes[seen, j] = -np.log2(kinds[seen] / (total[seen] + kinds[seen]))
                costs[:, j] += escapes[np.searchsorted(contexts, keys >> np.uint32(8)), j]
                costs[np.searchsorted(keys, k), j] = -np.log2(n / (total + kinds)[at])
            self.keys.append(keys)
            self.costs.append(costs.astype(np.float32))
            self.contexts.append(contexts)
            self.escapes.append(escapes.astype(np.float32))
            lower = costs
        # a hashed index of the longest grams; those that lose their slot are found by search
        self.index = np.full(1 << SLOTS, -1, np.int32)
        self.index[self.slot(self.keys[-1])] = np.arange(len(self.keys[-1]), dtype=np.int32)

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - SLOTS)

    def cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of grams of one order, searched; a row per gram, a column per language."""
        own = self.keys[order]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        out = self.costs[order][at]
        if len(miss := np.flatnonzero(own[at] != keys)):
            low = self.cost(keys[miss] & np.uint32((1 << 8 * order) - 1), order - 1)
            ctx = keys[miss] >> np.uint32(8)
            c = np.minimum(np.searchsorted(self.contexts[order], ctx), len(self.contexts[order]) - 1)
            out[miss] = low + self.escapes[order][c] * (self.contexts[order][c] == ctx)[:, None]
        return out

    def bits(self, data: np.ndarray) -> np.ndarray:
        """Code lengths of the bytes after the pad: a row per byte."""
        keys = grams(data, ORDER)
        at = self.index[self.slot(keys)]
        out = self.costs[-1][at]
        if len(miss := np.flatnonzero((at < 0) | (self.keys[-1][at] != keys))):
            out[miss] = self.cost(keys[miss], ORDER)
        return out

    def lengths(self, texts: list[str]) -> np.ndarray:
        """Total code lengths: a row per text."""
        out = np.zeros((len(texts), len(self.langs)))
        for ids, data, starts in blocks(texts):
            sums = np.add.reduceat(self.bits(data), starts, axis=0, dtype=np.float64) if len(starts) > 1 else self.bits(data).sum(0, dtype=np.float64)[None]
            np.add.at(out, ids, sums[::2] if len(starts) > 1 else sums)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        asked = [k for k, t in enumerate(texts) if t and self.langs and any(map(str.isalpha, t))]
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        if asked:
            bits = self.lengths([texts[k] for k in asked])
            best = bits.argmin(1)
            sure = 1 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000.0)).sum(1)
            for k, b, s in zip(asked, best, sure, strict=True):
                names[k], scores[k] = self.langs[b], float(s)
        return names, scores


def blocks(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, list[int]]]:
    """Texts joined to blocks of about ``BLOCK`` bytes: their numbers, the bytes, and reduceat's bounds.

    The bounds alternate between a text's own bytes and the pad of the next; long texts are cut with an
    overlap of one context, which changes no byte's context.
    """
    ids, parts, bounds, at = [], [], [], 0
    for k, t in enumerate(texts):
        data = normal(t)
        for a in range(0, len(data) - ORDER, BLOCK):
            part = data[a : a + BLOCK + ORDER]
            ids.append(k)
            parts.append(part)
            if bounds:
                bounds.append(at - ORDER)
            bounds.append(at)
            at += len(part)
            if at >= BLOCK:
                yield ids, np.frombuffer(b"".join(parts), np.uint8), bounds
                ids, parts, bounds, at = [], [], [], 0
    if ids:
        yield ids, np.frombuffer(b"".join(parts), np.uint8), bounds


def train(labelled: DataFrame, train_bytes: int = TRAIN_BYTES) -> Trees:
    """Trees from (doc_id, text, lang); the sample a language has is bounded in bytes."""
    fit = labelled.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.octet_length("text").between(1, TRAIN_TEXT_BYTES))
    sizes = fit.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()
    if not sizes:
        return Trees({})
    spark = labelled.sparkSession
    share = spark.createDataFrame([(r.lang, min(1.0, train_bytes / r.n)) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share") * (1 << 30)
    samples: dict[str, list[str]] = {}
    for r in fit.join(F.broadcast(share), "lang").filter(draw).select("lang", "text").toLocalIterator():
        samples.setdefault(r.lang, []).append(r.text)
    return Trees(samples)


def identify(docs: DataFrame, trees: Trees) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred and score, from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def predict(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), predict, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows outside the held-out fold, predicts every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = train(docs.filter(~in_fold(F.col("doc_id"), 4, 2)))
    return identify(docs, trees).select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")
