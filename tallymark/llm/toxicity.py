"""Toxicity by a lexicon trie intersected with Levenshtein automata, and context windows.

The lexicon is learned from labelled texts: words and stems whose contexts (the words before and after)
occur in toxic texts only, tested by a likelihood ratio. Contexts rather than texts are counted, so copies of
one text count once. Every word of a text runs as a Levenshtein automaton (bit sets of reached positions)
through the trie, which finds misspelled terms; words that clean training texts use are never taken for
misspellings. A window around each match tells quotation and report from abuse, and a logistic model turns
the matches into a probability.

Training reads a bounded sample: about ``TRAIN_DOCS`` labelled rows chosen by a hash of the id, texts of at
most ``TRAIN_TEXT_BYTES``. Scoring reads every text to its end.

Defined cases: null and empty texts have no match and get the score of such texts; without labelled rows, or
without a toxic one, the lexicon is empty and every score is 0; several labels of one id count as toxic if
any is; repeated rows get equal scores; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.common import in_fold, map_batches, table

TRAIN_DOCS, TRAIN_TEXT_BYTES = 8_000, 1 << 16
#: Least likelihood ratio of a word and of a stem; lengths of stems; words that a stem must have.
#: Contexts of one word that training counts on each side at most: a bound of the classifier's sample, which frequent words reach.
CONTEXTS = 5000
LEAST_RATIO, STEM_RATIO, STEM_LENGTHS, STEM_WORDS = 30.0, 45.0, range(4, 8), 8
#: Words before and after a match that make its context.
WINDOW = 6
MARKS = ".,;:!?\"'()[]{}<>*#$%&|/\\-_~`“”„«»‘’…¡¿"
QUOTES = frozenset("\"“”„«»")
#: Words that report speech and words that address someone. Fixed values.
REPORTING = frozenset("said says wrote writes called calls quote quoted quotes quoting word words term terms dit écrit mot sagte schrieb wort dijo escribió palabra".split())
ADDRESSING = frozenset("you your you're youre u ur du dein deine dich ihr tu toi ton vous votre tú usted vosotros".split())
CACHE_ENTRIES = 400_000


def budget(n: int) -> int:
    """Edits allowed in a term of n letters."""
    return 0 if n < 5 else 1 if n < 8 else 2


def letters(word: str) -> int:
    """The set of a word's letters, folded to 64 bits."""
    mask = 0
    for c in word:
        mask |= 1 << (ord(c) & 63)
    return mask


class Lexicon:
    """A trie of terms and stems with their strengths in (0, 1]."""

    def __init__(self, terms: dict[str, float], stems: dict[str, float], known: frozenset[str] = frozenset()):
        self.known, self.root = known, {}
        for words, mark in ((terms, "term"), (stems, "stem")):
            for word, strength in words.items():
                node = self.root
                for c in word:
                    node = node.setdefault(c, {})
                node[mark] = (strength, budget(len(word)) if mark == "term" else int(len(word) >= 7))
        self.size = len(terms) + len(stems)
        self.starts = tuple(s for s in stems if len(s) < 7)
        self.masks: dict[int, list[tuple[int, int]]] = {}
        for w in terms:
            for n in range(len(w) - budget(len(w)), len(w) + budget(len(w)) + 1):
                self.masks.setdefault(n, []).append((letters(w), budget(len(w))))
        self.loose = [letters(s) for s in stems if len(s) >= 7]

    def possible(self, word: str) -> bool:
        """False only where no entry can match: an edit adds or removes one letter of the set at most."""
        if word.startswith(self.starts):
            return True
        own = letters(word)
        return any((own & ~m).bit_count() <= d and (m & ~own).bit_count() <= d for m, d in self.masks.get(len(word), ())) or any((m & ~own).bit_count() <= 1 for m in self.loose)

    def match(self, word: str) -> tuple[float, int] | None:
        """Strength and edits of the best entry within its budget of edits, or None."""
        n = len(word)
        if n < 3 or not self.possible(word):
            return None
        most = budget(n + 2)  # of the longest term that may lose letters to this word
        exact = word in self.known
        places: dict[str, int] = {}
        for k, c in enumerate(word):
            places[c] = places.get(c, 0) | 1 << k
        end, full = 1 << n, (1 << n + 1) - 1
        start = [1]
        for d in range(most):
            start.append(start[-1] | start[-1] << 1 & full)
        best, stack = None, [(self.root, tuple(start))]
        while stack:
            node, reached = stack.pop()
            for mark in ("term", "stem"):
                if mark in node:
                    strength, allowed = node[mark]
                    for d in range(min(most, 0 if exact else allowed) + 1):
                        if reached[d] & (end if mark == "term" else full):
                            found = (strength * (1 - 0.15 * d), -d)
                            best = found if best is None or found > best else best
                            break
            for c, below in node.items():
                if len(c) > 1:
                    continue
                at = places.get(c, 0)
                row = [(reached[0] & at) << 1]
                for d in range(1, most + 1):
                    # the letter matches; it is extra in the term; it stands for another; the word has an extra one
                    row.append((reached[d] & at) << 1 | reached[d - 1] | (reached[d - 1] << 1 & full) | (row[-1] << 1 & full))
                if row[-1] if most else row[0]:
                    stack.append((below, tuple(row)))
        return best and (best[0], -best[1])


class Matches(dict):
    """Matches of raw tokens, kept up to a bound."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> tuple[float, int] | None:
        found = self.lexicon.match(token.strip(MARKS))
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = found
        return found


def context_factor(tokens: list[str], k: int) -> float:
    """Below 1 in quotation or report, above 1 where somebody is addressed."""
    before, own, after = tokens[max(0, k - WINDOW) : k], tokens[k], tokens[k + 1 : k + 1 + WINDOW]
    opens = own[0] in QUOTES or sum(t[0] in QUOTES for t in before) > sum(t.rstrip(".,;:!?")[-1:] in QUOTES for t in before)
    closes = own.rstrip(".,;:!?")[-1:] in QUOTES or any(t.rstrip(".,;:!?")[-1:] in QUOTES for t in after)
    near = {t.strip(MARKS) for t in before + after}
    factor = 0.3 if opens and closes else 0.6 if near & REPORTING else 1.0
    return min(1.25, factor * 1.25) if near & ADDRESSING else factor


class Scorer:
    """Lexicon and logistic weights over (strongest match, matches, share of quoted ones)."""

    def __init__(self, lexicon: Lexicon, weights: tuple[float, ...] = (0.0, 0.0, 0.0), bias: float = -1e3):
        self.lexicon, self.weights, self.bias = lexicon, weights, bias

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "seen"}

    def features(self, text: str | None) -> tuple[float, float, float]:
        if not text:
            return 0.0, 0.0, 0.0
        if "seen" not in self.__dict__:
            self.seen = Matches(self.lexicon)
        tokens = text.lower().split()
        hits = [(k, m) for k, m in enumerate(map(self.seen.__getitem__, tokens)) if m]
        if not hits:
            return 0.0, 0.0, 0.0
        factors = [context_factor(tokens, k) for k, _ in hits]
        strengths = [m[0] * f for (_, m), f in zip(hits, factors, strict=True)]
        return max(strengths), math.log1p(sum(strengths)), sum(f < 0.5 for f in factors) / len(hits)

    def score(self, text: str | None) -> float:
        if not self.lexicon.size:
            return float(self.bias > 0)
        z = self.bias + sum(w * x for w, x in zip(self.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def likelihood_ratio(a: int, b: int, share: float) -> float:
    """Twice the log likelihood ratio of a toxic and b clean contexts against the share of toxic contexts."""
    p = a / (a + b)
    return 2 * (a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0)) if p > share else 0.0


def learn_lexicon(texts: list[str], toxic: list[bool]) -> Lexicon:
    """Words and stems with toxic contexts only (98 of 100 at least), by likelihood ratio."""
    contexts: tuple[defaultdict, defaultdict] = defaultdict(set), defaultdict(set)
    for text, bad in zip(texts, toxic, strict=True):
        words = [t.strip(MARKS) for t in text.lower().split()]
        for k, w in enumerate(words):
            if len(w) >= 3 and len(own := contexts[bad][w]) < CONTEXTS:
                own.add(hash((words[k - 1] if k else "", words[k + 1] if k + 1 < len(words) else "")))
    sizes = [Counter({w: len(c) for w, c in x.items()}) for x in contexts]
    del contexts
    share = sizes[1].total() / max(1, sizes[0].total() + sizes[1].total())
    if not 0 < share < 1:
        return Lexicon({}, {})

    def strong(a: int, b: int, least: float) -> float:
        return r if a >= 49 * b and (r := likelihood_ratio(a, b, share)) >= least else 0.0

    ratios: dict[str, float] = {}
    stems: dict[str, float] = {}
    for n in STEM_LENGTHS:
        bad, clean, kinds = Counter(), Counter(), Counter()
        for w, c in sizes[1].items():
            if len(w) > n:
                bad[w[:n]] += c
                kinds[w[:n]] += 1
        for w, c in sizes[0].items():
            clean[w[:n]] += c
        for s, c in bad.items():
            if kinds[s] >= STEM_WORDS and not any(s.startswith(x) for x in stems) and (r := strong(c, clean[s], STEM_RATIO)):
                stems[s] = r
    for w, c in sizes[1].items():
        if not any(w.startswith(s) for s in stems) and (r := strong(c, sizes[0][w], LEAST_RATIO)):
            ratios[w] = r
    scaled = lambda x: {w: min(1.0, 0.5 + r / 200) for w, r in x.items()}
    lexicon = Lexicon(scaled(ratios), scaled(stems))
    known = frozenset(w for w in sizes[0] if lexicon.match(w))
    return Lexicon(scaled(ratios), scaled(stems), known)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights and bias by Newton's method with an L2 penalty on the weights."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (p - y) + penalty @ w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return w


def train(labelled: list[tuple[str, int]]) -> Scorer:
    """A scorer from texts and labels."""
    texts, toxic = [t for t, _ in labelled], [bool(y) for _, y in labelled]
    if not any(toxic) or all(toxic):
        return Scorer(Lexicon({}, {}), bias=-1e3 if not any(toxic) else 1e3)
    plain = Scorer(learn_lexicon(texts, toxic))
    w = fit_logistic(np.array([plain.features(t) for t in texts]), np.array(toxic, float))
    # matches never speak for a clean text, and quotation never for a toxic one
    return Scorer(plain.lexicon, (max(0.0, w[0]), max(0.0, w[1]), min(0.0, w[2])), float(w[3]))


def labelled_sample(docs: DataFrame, labels: DataFrame, n: int = TRAIN_DOCS) -> list[tuple[str, int]]:
    """About n labelled texts outside the held-out fold, by a hash of the id."""
    fit = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~in_fold(F.col("doc_id"), 5, 0))
    share = min(1.0, n / max(1, fit.count()))
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 30)) < int(share * (1 << 30))
    few = fit.filter(drawn).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.filter(drawn & F.octet_length("text").between(1, TRAIN_TEXT_BYTES)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = texts.join(F.broadcast(few), texts.doc_id == few.label_id).select("doc_id", "text", "toxic").toLocalIterator()
    return [(r.text, r.toxic) for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def score_toxicity(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """Per row: doc_id and the score of its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = shared.value
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), score, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scorer = train(labelled_sample(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score_toxicity(docs, scorer).select("doc_id", in_fold(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
