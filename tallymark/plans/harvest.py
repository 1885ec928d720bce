"""A catalog read by a model, cached: one pass that is to repeat, or passes that are to vary for the ensemble."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.extract import extract_rules, merge_values
from tallymark.operators.model import FIXED, VARIED, Client, ask, model_values, read_answers, requests
from tallymark.sources.catalog import Category, fingerprint, shipped
from tallymark.sources.feeds import cache_key, harvest


def pass_key(corpus: str, model: str, seed: int, categories: dict[str, Category], sample: int | None, use_rules: bool) -> str:
    """The cache key of a pass; ``corpus`` names the products, and each varied pass has a key of its own."""
    return cache_key(corpus=corpus, model=model, seed=seed, schemas=sorted(map(fingerprint, categories.values())), sample=sample, temperature=FIXED["temperature"] if sample is None else VARIED, rules=use_rules and sample is None)


def harvest_pass(spark: SparkSession, folder: str, products: DataFrame, client: Client, model: str, corpus: str, seed: int = 20260820, categories: dict[str, Category] | None = None, sample: int | None = None, use_rules: bool = True, refresh: bool = False) -> DataFrame:
    """Long values of ``products``. The first pass has fixed options, and with ``use_rules`` the model only fills
    what the rules left absent; pass ``sample`` is the model alone, at a higher temperature and with its own seed.
    """
    known = categories or shipped()

    def make() -> DataFrame:
        options = None if sample is None else {"temperature": VARIED, "seed": seed + sample}
        values = model_values(read_answers(ask(requests(products, known), client, options), known), model)
        return merge_values(extract_rules(products.filter(F.col("category_id").isin(*known))), values) if use_rules and sample is None else values

    return harvest(spark, folder, pass_key(corpus, model, seed, known, sample, use_rules), make, refresh)
