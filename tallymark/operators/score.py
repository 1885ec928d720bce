"""From verifier signals to one nonconformity score, and how well a score separates errors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.quantities import convert, with_quantity
from tallymark.operators.verify import any_hard


def applicable_trusts(signals: Column) -> Column:
    return F.transform(F.filter(signals, lambda s: s["applicable"]), lambda s: s["trust"])


def heuristic_score(signals: Column) -> Column:
    """1 for a hard failure or where no verifier had an opinion; else 1 less the least trust."""
    trusts = applicable_trusts(signals)
    return F.when(any_hard(signals) | (F.size(trusts) == 0), 1.0).otherwise(1 - F.array_min(trusts))


def features(signals: list[Column]) -> Column:
    """Trust and applicability of each verifier in name order, then least, mean and share of applicable trusts."""
    every = F.array(*signals)
    trusts = applicable_trusts(every)
    each = [x for s in signals for x in (F.when(s["applicable"], s["trust"]).otherwise(0.0), s["applicable"].cast("double"))]
    mean = F.coalesce(F.try_divide(F.aggregate(trusts, F.lit(0.0), lambda a, t: a + t), F.size(trusts)), F.lit(0.0))
    return F.array(*each, F.coalesce(F.array_min(trusts), F.lit(0.0)), mean, F.size(trusts) / F.lit(float(max(len(signals), 1))))


@dataclass(frozen=True)
class LearnedScorer:
    """Logistic weights over the feature vector; without weights the heuristic score is used."""

    verifiers: tuple[str, ...]
    weights: tuple[float, ...] = ()
    bias: float = 0.0

    def score(self) -> Column:
        signals = [F.col(v) for v in self.verifiers]
        every = F.array(*signals)
        if not self.weights:
            return heuristic_score(every)
        z = F.aggregate(F.zip_with(features(signals), F.array(*map(F.lit, self.weights)), lambda x, w: x * w), F.lit(self.bias), lambda a, x: a + x)
        return F.when(any_hard(every), 1.0).otherwise(1 / (1 + F.exp(-z)))

    def named_weights(self) -> dict[str, float]:
        names = [f"{v}.{k}" for v in self.verifiers for k in ("trust", "applicable")] + ["min_trust", "mean_trust", "coverage"]
        return dict(zip(names, self.weights, strict=False))


def fit_scorer(df: DataFrame, verifiers: list[str], label: str = "is_error") -> LearnedScorer:
    """Balanced logistic regression with an L2 penalty of one; hard failures are left out, both classes are needed."""
    names = tuple(sorted(verifiers))
    signals = [F.col(v) for v in names]
    rows = df.filter(~any_hard(F.array(*signals))).select(array_to_vector(features(signals)).alias("features"), F.col(label).cast("double").alias("label")).persist()
    try:
        counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
        if len(counts) < 2:
            return LearnedScorer(names)
        n = sum(counts.values())
        weighted = rows.withColumn("w", F.when(F.col("label") == 1, n / (2 * counts[1.0])).otherwise(n / (2 * counts[0.0])))
        fit = LogisticRegression(weightCol="w", regParam=1 / n, elasticNetParam=0.0, standardization=False, tol=1e-10, maxIter=1000).fit(weighted)
        return LearnedScorer(names, tuple(float(x) for x in fit.coefficients), float(fit.intercept))
    finally:
        rows.unpersist()


def prefix_counts(df: DataFrame, score: str, error: str, parts: int = 64) -> DataFrame:
    """One row a distinct score: n, errors, and their running sums in ascending order, ties together.

    Scores are dealt into ranges by approximate quantiles, so no task sees all of them; a range starts from the
    totals of the ranges before it.
    """
    hist = df.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("n"), F.sum(F.col(error).cast("long")).alias("errors"))
    cuts = hist.agg(F.percentile_approx("score", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    part = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]) if cuts else F.expr("cast(array() as array<double>)"), lambda c: c < F.col("score")))
    hist = hist.withColumn("part", part)
    totals = hist.groupBy("part").agg(F.sum("n").alias("tn"), F.sum("errors").alias("te"))
    before = "over (order by part rows between unbounded preceding and 1 preceding)"
    offsets = totals.select("part", F.expr(f"coalesce(sum(tn) {before}, 0)").alias("n0"), F.expr(f"coalesce(sum(te) {before}, 0)").alias("e0"))
    inner = "over (partition by part order by score)"
    return hist.join(F.broadcast(offsets), "part").select("score", "n", "errors", "part", F.expr(f"n0 + sum(n) {inner}").alias("cum_n"), F.expr(f"e0 + sum(errors) {inner}").alias("cum_errors"))


def auroc(df: DataFrame, score: str, error: str) -> DataFrame:
    """One row: the chance that an error scores above a correct value, ties half; NaN if one class is missing."""
    p = prefix_counts(df, score, error)
    rank = F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2
    sums = p.agg(F.sum(rank * F.col("errors")).alias("r"), F.sum("errors").cast("double").alias("e"), F.sum("n").cast("double").alias("n"))
    return sums.select(F.coalesce(F.try_divide(F.col("r") - F.col("e") * (F.col("e") + 1) / 2, F.col("e") * (F.col("n") - F.col("e"))), F.lit(float("nan"))).alias("auroc"))


def values_agree(df: DataFrame, got: str, want: str, out: str = "agrees") -> DataFrame:
    """Needs kind. Same text, or the same quantity within 0.1 % after conversion; a missing unit agrees only with a missing one."""
    df = with_quantity(with_quantity(df, got, "__g"), want, "__w")
    g, w = F.col("__g"), F.col("__w")
    same = F.lower(F.regexp_replace(got, r"^\s+|\s+$", "")) == F.lower(F.regexp_replace(want, r"^\s+|\s+$", ""))
    bare = g["unit"].isNull() & w["unit"].isNull() & (F.abs(g["magnitude"] - w["magnitude"]) < 1e-9)
    near = F.abs(convert(g["magnitude"], g["unit"], w["unit"]) - w["magnitude"]) / F.greatest(F.abs(w["magnitude"]), F.lit(1e-9)) < 1e-3
    agrees = (
        F.when(same, True)
        .when(~F.col("kind").isin("quantity", "range") | g.isNull() | w.isNull(), False)
        .when(g["unit"].isNull() | w["unit"].isNull(), bare)
        .otherwise(F.coalesce(near, F.lit(False)))
    )
    return df.withColumn(out, agrees).drop("__g", "__w")
