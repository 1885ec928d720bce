"""Thresholds whose error rate is bounded, and what follows from them."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.binomial import clopper_pearson_upper, needed
from tallymark.operators.score import prefix_counts
from tallymark.sources.catalog import Category, fingerprint

GRID, MIN_ACCEPTED = 50, 30
DIAL_STOPS = (0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15)
NONE = float("-inf")


def select_thresholds(calibration: DataFrame, alphas: Sequence[float], delta: float = 0.05, score: str = "score", error: str = "is_error", grid: int = GRID, min_accepted: int = MIN_ACCEPTED) -> DataFrame:
    """One row an alpha: the last threshold of a fixed sequence whose exact bound holds, before the first that fails.

    The sequence is a grid of quantiles fixed before labels are seen. Scores are reduced to running counts per
    distinct score first; what follows is at most ``grid`` rows an alpha.
    """
    spark = calibration.sparkSession
    need = {a: needed(a, delta) for a in alphas}
    prefix = prefix_counts(calibration, score, error)
    total = F.col("total")
    settings = spark.createDataFrame([(float(a), float(delta), int(m), int(max(min_accepted, m))) for a, m in need.items()], "alpha double, delta double, needed long, least long")
    sized = settings.crossJoin(prefix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))  # both sides are a few rows
    fits = sized.filter((total >= F.col("least")) & (total > 0)).select("*", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("i"))
    start = F.col("least") / total
    q = F.when(F.col("i") == grid - 1, 1.0).otherwise(start + F.col("i") * ((1 - start) / (grid - 1)))
    points = fits.withColumn("at", F.ceil(q * (total - 1)))
    bounds = prefix.groupBy("part").agg(F.max("cum_n").alias("hi"), F.min(F.col("cum_n") - F.col("n")).alias("lo"))
    placed = points.join(F.broadcast(bounds), (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))).drop("lo", "hi")
    met = prefix.join(F.broadcast(placed), "part").filter((F.col("at") >= F.col("cum_n") - F.col("n")) & (F.col("at") < F.col("cum_n")) & (F.col("cum_n") >= F.col("least")))
    tested = met.withColumn("upper", clopper_pearson_upper(F.col("cum_errors").cast("double"), F.col("cum_n").cast("double"), F.col("delta")))
    tested = tested.withColumn("stop", F.expr("min(CASE WHEN upper > alpha THEN i END) over (partition by alpha)"))
    best = tested.filter("stop IS NULL OR i < stop").groupBy("alpha").agg(F.max_by(F.struct("score", "cum_n", "cum_errors", "upper"), "i").alias("b"))
    out = sized.join(best, "alpha", "left")
    reason = F.when(total == 0, "empty calibration set").when(total < F.col("needed"), "too few calibration points").when(total < F.col("least"), "too few points to accept").when(F.col("b").isNull(), "no threshold can be certified").otherwise("")
    return out.select(
        "alpha", "delta", F.col("b").isNotNull().alias("feasible"), F.coalesce("b.score", F.lit(NONE)).alias("threshold"), total.alias("n_calibration"), F.col("b.cum_n").alias("n_accepted"),
        (F.col("b.cum_errors") / F.col("b.cum_n")).alias("empirical_error"), F.col("b.upper").alias("error_upper_bound"), (F.col("b.cum_n") / total).alias("coverage"), reason.alias("reason"),
    )


def decision(hard: Column, score: Column, threshold: Column) -> Column:
    """Hard failures are rejected; no score, or one above the threshold, is reviewed."""
    return F.when(hard, "reject").when(score <= threshold, "auto_publish").otherwise("review")


def realised_error(published: Column, error: Column) -> Column:
    """Share of errors among the published, 0 if there are none. An aggregate."""
    return F.coalesce(F.avg(F.when(published, error.cast("double"))), F.lit(0.0))


def risk_coverage(calibration: DataFrame, test: DataFrame, alphas: Sequence[float] = DIAL_STOPS, delta: float = 0.05) -> DataFrame:
    """Per alpha what its threshold does to a test set (score, hard, is_error): counts, automation and realised error.

    The test set is reduced to a histogram first; each alpha reads that.
    """
    chosen = select_thresholds(calibration, alphas, delta)
    hist = test.groupBy("score", "hard").agg(F.count("*").alias("n"), F.sum(F.col("is_error").cast("long")).alias("errors"))
    told = decision(F.col("hard"), F.col("score"), F.col("threshold"))
    each = hist.join(F.broadcast(chosen), F.lit(True)).withColumn("decision", told)
    count = lambda d, c="n": F.coalesce(F.sum(F.when(F.col("decision") == d, F.col(c))), F.lit(0))
    sums = each.groupBy("alpha").agg(count("auto_publish").alias("n_auto_published"), count("reject").alias("n_rejected"), F.sum("n").alias("n_total"), count("auto_publish", "errors").alias("wrong"), F.sum("errors").alias("all_wrong"))
    sums = sums.withColumns({
        "n_review": F.col("n_total") - F.col("n_auto_published"),
        "automation_rate": F.col("n_auto_published") / F.col("n_total"),
        "realized_error": F.coalesce(F.try_divide("wrong", "n_auto_published"), F.lit(0.0)),
        "baseline_error": F.col("all_wrong") / F.col("n_total"),
    })
    return chosen.join(sums.drop("wrong", "all_wrong"), "alpha", "left")


def certificate(dial: DataFrame) -> DataFrame:
    """The certificate of feasible settings: counts, bound, and the assumption it rests on."""
    return dial.filter("feasible").select(
        "alpha", "delta", "threshold", "n_calibration", "n_total", "n_auto_published", "n_review", "n_rejected", "automation_rate", "error_upper_bound", "realized_error", "baseline_error",
        F.lit("calibration and published values are exchangeable").alias("assumption"),
    )


def with_provenance(cert: DataFrame, seed: int, verifiers: Iterable[str], categories: Iterable[Category], proposer: str, version: str = "0.1.0") -> DataFrame:
    """Certificates with what they rest on: run id, time, proposer, verifier versions and schema fingerprints."""
    versions = F.create_map(*[F.lit(x) for v in verifiers for x in (v, version)]).cast("map<string, string>")
    return cert.withColumns({
        "run_id": F.lit(f"run-{seed}-{uuid.uuid4().hex[:8]}"),
        "issued_at": F.current_timestamp(),
        "proposer_model": F.lit(proposer),
        "verifier_versions": versions,
        "schema_fingerprint": F.lit(",".join(sorted(map(fingerprint, categories)))),
    })


def dial_json(dial: DataFrame) -> DataFrame:
    """(alpha, json): a setting of the dial for a page. A refusal has null for threshold and bound, not zero."""
    # The names that pages read.
    names = {
        "alpha": "alpha", "feasible": "feasible", "reason": "reason", "threshold": "threshold", "automation_rate": "automationRate", "n_auto_published": "nAutoPublished", "n_review": "nReview",
        "n_total": "nTotal", "realized_error": "realizedError", "error_upper_bound": "certifiedBound", "baseline_error": "baselineError",
    }
    shown = {**{c: F.col(c) for c in names}, **{c: F.when(F.col("feasible"), F.col(c)) for c in ("threshold", "error_upper_bound")}}
    return dial.select("alpha", F.to_json(F.struct(*[shown[c].alias(name) for c, name in names.items()]), {"ignoreNullFields": "false"}).alias("json"))


def certificate_summary() -> Column:
    """One line about a row of ``certificate``."""
    percent = lambda c: F.col(c) * 100
    return F.format_string("auto-published %d of %d (%.1f%%) at a certified error of at most %.1f%% with %.0f%% confidence", "n_auto_published", "n_total", percent("automation_rate"), percent("alpha"), (1 - F.col("delta")) * 100)


def review_queue(scored: DataFrame, threshold: float, limit: int = 25, order: str = "ordinal") -> DataFrame:
    """The values most in doubt first, ties by order. A missing or zero score counts as 1. Limit is 1 to 200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie between 1 and 200")
    effective = F.when(F.coalesce("score", F.lit(0.0)) == 0, 1.0).otherwise(F.col("score"))
    return scored.filter(effective > threshold).orderBy(F.desc(effective), order).limit(limit)
