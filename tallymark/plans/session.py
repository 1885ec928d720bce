"""The whole path: catalog, extraction, faults, verification, score, threshold, certificate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions.canonical import normalise_values
from tallymark.functions.quantities import with_quantity
from tallymark.operators.certify import DIAL_STOPS, certificate, review_queue, risk_coverage, select_thresholds, with_provenance
from tallymark.operators.extract import extract_rules
from tallymark.operators.faults import inject_faults
from tallymark.operators.score import LearnedScorer, auroc, fit_scorer, values_agree
from tallymark.operators.verify import abstain, any_hard, nominal_profile, numeric_profile, verify_coherence, verify_constraints, verify_dimension, verify_ensemble
from tallymark.plans.staging import Stages
from tallymark.sources.catalog import Category, shipped, spec_table
from tallymark.sources.synthetic import answer_key, generate_catalog


def three_way_split(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``ordinal`` and ``split`` (0 fit, 1 calibrate, 2 test) by position in a total order.

    Rows are dealt by ranges and written once; only the count of each range meets in one place.
    """
    placed = df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id())
    placed = Stages(df.sparkSession).keep(placed, "ranges")  # counted and numbered from one table, so both see the same ranges
    placed = placed.withColumn("__i", F.row_number().over(W.partitionBy("__p").orderBy(*order)))
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", F.expr("coalesce(sum(n) over (order by __p rows between unbounded preceding and 1 preceding), 0)").alias("__b"))
    out = placed.join(F.broadcast(before), "__p").withColumn("ordinal", F.col("__b") + F.col("__i") - 1)
    return out.withColumn("split", F.pmod("ordinal", F.lit(3))).drop("__p", "__i", "__b")


def assay(values: DataFrame, verifiers: Sequence[str] = ("dimensional", "constraint"), samples: DataFrame | None = None, categories: dict[str, Category] | None = None, further: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """One signal column a verifier. Values need their spec columns; constraints abstain on categories not among
    ``categories``. ``further`` are verifiers of one's own: each adds the signal column of its name.
    """
    df = values
    if "dimensional" in verifiers:
        df = verify_dimension(df)
    if "constraint" in verifiers:
        known = categories or shipped()
        parts = [verify_constraints(df.filter(F.col("category_id") == k), c) for k, c in known.items()]
        others = df.filter(~F.coalesce(F.col("category_id").isin(*known), F.lit(False))).withColumn("constraint", abstain("no schema"))
        df = reduce(DataFrame.unionByName, [*parts, others])
    if "coherence" in verifiers:
        keys = ["category_id", "attribute"]
        numbers = with_quantity(values.filter(F.col("kind").isin("quantity", "range")), "raw", "q").select(*keys, F.col("q.magnitude").alias("x"))
        terms = values.filter(F.col("kind") == "nominal").select(*keys, F.col("raw").alias("term"))
        df = verify_coherence(df, numeric_profile(numbers, keys), nominal_profile(terms, keys))
    if "ensemble" in verifiers and samples is not None:
        df = verify_ensemble(df, samples)
    return reduce(lambda out, verify: verify(out), (further or {}).values(), df)


@dataclass
class Session:
    """Scored values, kept so that every setting of the dial is only the last, small stage."""

    scored: DataFrame
    scorer: LearnedScorer
    delta: float = 0.05
    verifiers: tuple[str, ...] = ()
    seed: int = 0

    def part(self, k: int) -> DataFrame:
        return self.scored.filter(F.col("split") == k)

    def dial(self, alphas: Sequence[float] = DIAL_STOPS) -> DataFrame:
        return risk_coverage(self.part(1), self.part(2), alphas, self.delta)

    def certificate(self, alphas: Sequence[float]) -> DataFrame:
        return with_provenance(certificate(self.dial(alphas)), self.seed, self.verifiers, shipped().values(), "rules")

    def queue(self, alpha: float, limit: int = 25) -> DataFrame:
        """Without a feasible threshold the whole test set is under review."""
        chosen = select_thresholds(self.part(1), [alpha], self.delta).first()
        return review_queue(self.part(2), chosen.threshold, limit)

    def stats(self) -> DataFrame:
        test = self.part(2)
        return auroc(test, "score", "is_error").crossJoin(test.agg(F.count("*").alias("n_test"), F.avg(F.col("is_error").cast("double")).alias("baseline_error")))


def build_session(spark: SparkSession, n_per_category: int = 200, fault_rate: float = 0.12, seed: int = 20260820, verifiers: Sequence[str] = ("dimensional", "constraint"), path: str | None = None) -> Session:
    """Synthetic catalog through to scored values. Each stage is a written table, below ``path`` where one is given."""
    stages = Stages(spark, path)
    gold = stages.keep(generate_catalog(spark, n_per_category, seed), "gold")
    specs = spec_table(spark)
    values = stages.keep(extract_rules(gold).join(F.broadcast(specs.drop("ordinal")), ["category_id", "attribute"]), "values")
    damaged = stages.keep(inject_faults(values, fault_rate, seed), "damaged")
    canonical = normalise_values(damaged.drop("kind", "vocabulary"), specs).join(F.broadcast(specs.select("category_id", "attribute", "kind", "vocabulary")), ["category_id", "attribute"])
    keyed = stages.keep(canonical.join(answer_key(gold), ["sku", "attribute"]).join(gold.select("sku", "rec_ord"), "sku"), "keyed")
    judged = stages.keep(assay(keyed, verifiers), "assayed")
    judged = stages.keep(values_agree(judged, "raw", "expected").withColumn("is_error", ~F.col("agrees")), "judged")
    placed = stages.keep(three_way_split(judged, ["category_id", "rec_ord", "val_ord"]), "placed")
    scorer = fit_scorer(placed.filter("split = 0"), list(verifiers))
    hard = any_hard(F.array(*[F.col(v) for v in verifiers]))
    return Session(stages.keep(placed.withColumns({"score": scorer.score(), "hard": hard}), "scored"), scorer, verifiers=tuple(verifiers), seed=seed)
