"""Stateless scoring of a stream with frozen artefacts, and windowed drift of its scores. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.operators.certify import decision
from tallymark.operators.extract import extract_rules
from tallymark.operators.score import LearnedScorer
from tallymark.operators.verify import any_hard, verify_dimension


def score_stream(products: DataFrame, specs: DataFrame, scorer: LearnedScorer, threshold: float) -> DataFrame:
    """Values of arriving products (sku, category_id, description) with score and decision; no state is kept."""
    values = extract_rules(products).join(F.broadcast(specs.drop("ordinal")), ["category_id", "attribute"])
    scored = verify_dimension(values).withColumn("score", scorer.score())
    hard = any_hard(F.array(*[F.col(v) for v in scorer.verifiers]))
    return scored.withColumn("decision", decision(hard, F.col("score"), F.lit(threshold)))


def drift(scored: DataFrame, ts: str = "ts", window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean score and count a tumbling window, with a watermark for late rows."""
    return scored.withWatermark(ts, late).groupBy(F.window(ts, window)).agg(F.avg("score").alias("mean_score"), F.count("*").alias("n"))
