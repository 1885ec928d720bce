"""Quality rules as a short-circuit cascade.

Each rule looks at one lazily computed feature of a document. The cost of a rule, which is the time it takes,
and its selectivity are measured on a bounded sample; rules then run in the order of rejections per cost, and
a document leaves at its first rejection. The order changes the work, never the verdict; which rule is named as
the one that rejected may differ from run to run.

Defined cases: a null text has no words, counts as zero everywhere and fails ``few_words``; an empty
table gives an empty result with the rules in their declared order; repeated rows get the same verdict
each; columns of the input are passed through unread, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import binaries, bounded_batches, map_batches, table, words_of

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
#: Documents and bytes at most in the sample that orders the rules.
SAMPLE_DOCS, SAMPLE_BYTES = 400, 8 << 20


class Doc:
    """Features of one text, each computed when it is first asked for."""

    def __init__(self, text: bytes | None):
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def joined(self) -> bytes:
        return b"".join(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.joined.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.joined) - len(self.joined.translate(None, SYMBOLS))

    @cached_property
    def n_upper(self) -> int:
        return len(self.joined) - len(self.joined.translate(None, UPPER))

    @cached_property
    def n_lower(self) -> int:
        return len(self.joined) - len(self.joined.translate(None, LOWER))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_distinct_words(self) -> int:
        return len(set(self.words))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a 3-word window found twice or more; the first occurrence counts too."""
        if self.n_words < 4:
            return 0
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in self.words), np.int64, self.n_words)
        pairs = ids[:-1] * len(codes) + ids[1:]
        if len(codes) >= 1 << 20:  # three ids would not fit into 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(codes) + ids[2:]
        _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
        twice = counts[inverse] > 1
        covered = np.zeros(self.n_words, bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        return int(covered.sum())


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a document fails."""

    name: str
    rejects: Callable[[Doc], bool]


#: The rules in their declared order.
RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_windows", lambda d: 100 * d.n_repeat_words > 50 * d.n_words),
    Rule("symbols", lambda d: 10 * d.n_symbols > 3 * d.n_words),
    Rule("upper_case", lambda d: 2 * d.n_upper > d.n_upper + d.n_lower),
    Rule("duplicate_lines", lambda d: 10 * d.n_dup_lines > 8 * len(d.lines)),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
    Rule("few_distinct_words", lambda d: d.n_distinct_words < 200 and 10 * d.n_distinct_words < d.n_words),
)


def order_rules(texts: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """Rules by rejections per second on ``texts``; an empty sample, and rules that reject nothing, keep the declared order.

    Every rule is timed on documents of its own, so features that rules share count for each that would be first.
    """
    gain = {}
    for r in rules:
        docs, began = [Doc(t) for t in texts], time.perf_counter()
        rejected = sum(map(r.rejects, docs))
        gain[r.name] = rejected / max(time.perf_counter() - began, 1e-9)
    return tuple(sorted(rules, key=lambda r: -gain[r.name]))


def sample_texts(docs: DataFrame, n: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES) -> list[bytes | None]:
    """At most ``n`` texts of at most ``size`` bytes together, for ordering the rules only.

    Texts over a hundredth of ``size`` are left out of the sample, so its bytes are bounded.
    """
    short = docs.filter(F.octet_length("text") <= size // 100).select(F.col("text").cast("binary").alias("text"))
    rows, got = short.limit(n).collect(), 0
    return [r.text for r in rows if (got := got + len(r.text)) <= size]


def judge(doc: Doc, rules: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects, or None."""
    return next((r.name for r in rules if r.rejects(doc)), None)


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns; stops at the first rejection."""
    ordered = order_rules(sample_texts(docs), rules)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = binaries(batch.column(batch.schema.get_field_index("text")))
        return batch.filter(pa.array([judge(Doc(t), ordered) is None for t in texts], pa.bool_()))

    bounded_batches(docs.sparkSession)
    return map_batches(docs, keep, docs.schema)


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the base features, ``base_failed``, ``kept`` and the rule that rejected it (null if kept)."""
    ordered = order_rules(sample_texts(docs), rules)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [Doc(t) for t in binaries(batch.column(1))]
        base = [d.n_words < 50 or 100 * d.n_repeat_words > 50 * d.n_words for d in found]
        by = [judge(d, ordered) for d in found]
        longs = [pa.array([getattr(d, k) for d in found], pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        kept = [not b and r is None for b, r in zip(base, by, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(base, pa.bool_()), pa.array(kept, pa.bool_()), pa.array(by, pa.string())], schema.replace(",", "").split()[::2])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), score, schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).drop("rejected_by")


#: Windows, lines and words by list functions; the rules as in RULES, whose order does not matter for the verdict.
OP4_SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
windows AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS p FROM twice) GROUP BY r),
f AS (
  SELECT doc_id, len(ws) AS n_words, array_to_string(ws, '') AS j, len(ls) AS n_lines,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_distinct(ws)) AS n_distinct
  FROM w LEFT JOIN covered c USING (r)),
g AS (
  SELECT *, length(j) AS word_chars, length(regexp_replace(j, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         length(regexp_replace(j, '[^A-Z]', '', 'g')) AS up, length(regexp_replace(j, '[^a-z]', '', 'g')) AS low,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT (10 * n_symbols > 3 * n_words OR 2 * up > up + low OR 10 * n_dup_lines > 8 * n_lines
         OR NOT (2 * n_words <= word_chars AND word_chars <= 20 * n_words) OR 10 * n_distinct < least(n_words, 2000)) AS kept
FROM g
"""
