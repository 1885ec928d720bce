"""Verifiers: each adds one signal struct<trust, applicable, detail> to the long value table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.quantities import convert, dimension_name, dimension_of, format_g, with_quantity
from tallymark.operators.constraints import compile_constraint, references
from tallymark.sources.catalog import Category

# Trusts of the doubts, and the limits under which statistics abstain.
NO_UNIT_TRUST, SINGLE_FOR_RANGE_TRUST, SKIPPED_TRUST = 0.55, 0.4, 0.7
LEAST_SAMPLES, WIDEST_SPREAD, Z_LIMIT, Z_SPAN, LEAST_TRUST = 12, 0.75, 3.5, 7.0, 0.05
RARE_SHARE, RARE_TRUST, UNSEEN_TRUST, MAD_SCALE = 0.02, 0.5, 0.15, 1.4826


def ok(detail: Column | str = "") -> Column:
    return signal(F.lit(1.0), True, detail)


def fail(detail: Column | str = "") -> Column:
    return signal(F.lit(0.0), True, detail)


def doubt(trust: Column | float, detail: Column | str = "") -> Column:
    """Trust is held between 0 and 1."""
    t = trust if isinstance(trust, Column) else F.lit(float(trust))
    return signal(F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)), True, detail)


def abstain(detail: Column | str = "") -> Column:
    """No trust, and not applicable: an abstention is not a failure."""
    return signal(F.lit(0.0), False, detail)


def signal(trust: Column, applicable: bool, detail: Column | str) -> Column:
    return F.struct(trust.alias("trust"), F.lit(applicable).alias("applicable"), (detail if isinstance(detail, Column) else F.lit(detail)).alias("detail"))


def is_hard(s: Column) -> Column:
    return s["applicable"] & (s["trust"] == 0.0)


def any_hard(signals: Column) -> Column:
    return F.exists(signals, is_hard)


def failure_reasons(signals: Column) -> Column:
    """Details of the applicable signals that doubt or fail, the least trusted first."""
    told = F.filter(signals, lambda s: s["applicable"] & (s["trust"] < 1.0) & (s["detail"] != ""))
    return F.transform(F.array_sort(F.transform(told, lambda s: F.struct(s["trust"], s["detail"]))), lambda s: s["detail"])


def verify_dimension(values: DataFrame, raw: str = "raw", out: str = "dimensional") -> DataFrame:
    """Needs kind, dimension and canonical_unit. Does the text hold a number of the declared dimension?"""
    df = with_quantity(values, raw, "__q")
    c, q = F.col, F.col("__q")
    expected = F.coalesce(dimension_of(c("canonical_unit")), c("dimension"))
    actual = dimension_of(q["unit"])
    verdict = (
        F.when(~c("kind").isin("quantity", "range"), abstain("not a physical quantity"))
        .when(c("dimension").isNull(), abstain("no dimension declared"))
        .when(q.isNull(), fail(F.concat(F.lit("no readable number in "), c(raw))))
        .when((c("kind") == "range") & q["low"].isNull(), doubt(SINGLE_FOR_RANGE_TRUST, "a single value where a range is expected"))
        .when(q["unit"].isNull(), doubt(NO_UNIT_TRUST, "no unit"))
        .when(~actual.eqNullSafe(expected), fail(F.concat(F.lit("requires "), dimension_name(expected), F.lit(", found "), F.coalesce(dimension_name(actual), F.lit("unknown")))))
        .when(q["low"] > q["high"], fail("inverted range"))
        .otherwise(ok(F.concat(format_g(q["magnitude"]), F.lit(" "), q["unit"])))
    )
    return df.withColumn(out, verdict).drop("__q")


def canonical_magnitude(q: Column, canonical_unit: Column) -> Column:
    """The magnitude in the canonical unit; taken at face value without a unit; NULL if it cannot be converted."""
    return F.when(q["unit"].isNull() | canonical_unit.isNull(), q["magnitude"]).otherwise(convert(q["magnitude"], q["unit"], canonical_unit))


def environments(values: DataFrame, raw: str = "raw") -> DataFrame:
    """(sku, env): canonical magnitudes and flags of each record by attribute; the last of a repeated attribute wins."""
    df = with_quantity(values.filter(F.col("kind").isin("quantity", "boolean")), raw, "__q")
    flag = F.when(F.lower(F.trim(raw)).isin("yes", "true", "y", "1"), 1.0).when(F.lower(F.trim(raw)).isin("no", "false", "n", "0"), 0.0)
    number = F.when(F.col("kind") == "boolean", flag).otherwise(canonical_magnitude(F.col("__q"), F.col("canonical_unit")))
    # filtering after the aggregate keeps the parsed expression out of a pushed-down predicate
    one = df.select("sku", "attribute", "val_ord", number.alias("x")).groupBy("sku", "attribute").agg(F.max_by("x", F.when(F.col("x").isNotNull(), F.col("val_ord"))).alias("x"))
    return one.filter("x IS NOT NULL").groupBy("sku").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "x"))).alias("env"))


def verify_constraints(values: DataFrame, category: Category, envs: DataFrame | None = None, out: str = "constraint") -> DataFrame:
    """Holds each value against its category's constraints, evaluated once a record."""
    envs = environments(values) if envs is None else envs
    each = []
    for expression in category.constraints:
        holds, broken = compile_constraint(expression, lambda a: F.try_element_at("env", F.lit(a)))
        each.append(F.struct(F.lit(expression).alias("expression"), F.array(*[F.lit(r) for r in sorted(references(expression))]).alias("refs"), holds.alias("holds"), broken.alias("broken")))
    if not each:
        return values.withColumn(out, abstain("no constraints"))
    df = values.join(envs.withColumn("__all", F.array(*each)).select("sku", "__all"), "sku", "left")
    df = df.withColumn("__own", F.filter("__all", lambda r: F.array_contains(r["refs"], F.col("attribute"))))
    named = sorted({r for e in category.constraints for r in references(e)})
    count = lambda f: F.size(F.filter("__own", f))
    skipped, total = count(lambda r: r["holds"].isNull()), F.size("__own")
    violated = F.filter("__own", lambda r: ~r["holds"])
    verdict = (
        F.when(~F.col("attribute").isin(named), abstain("no constraint mentions it"))
        .when(F.col("__own").isNull(), abstain("no inputs"))
        .when(F.exists("__own", lambda r: r["broken"]), abstain("division by zero"))
        .when(F.size(violated) > 0, fail(F.concat(F.lit("violates "), F.array_join(F.transform(violated, lambda r: r["expression"]), "; "))))
        .when(skipped == total, abstain("inputs are missing"))
        .when(skipped > 0, doubt(SKIPPED_TRUST, "some inputs are missing"))
        .otherwise(ok())
    )
    return df.withColumn(out, verdict).drop("__all", "__own")


def numeric_profile(samples: DataFrame, keys: list[str], x: str = "x") -> DataFrame:
    """Exact median, median absolute deviation and count a group."""
    medians = samples.groupBy(*keys).agg(F.median(x).alias("median"))
    spread = samples.join(medians, keys).groupBy(*keys, "median").agg(F.median(F.abs(F.col(x) - F.col("median"))).alias("mad"), F.count(x).alias("n"))
    return spread.filter("n > 0").select(*keys, "median", "mad", "n")


def nominal_profile(samples: DataFrame, keys: list[str], term: str = "term") -> DataFrame:
    """Count of each term and of all, a group; terms are trimmed and lower-cased."""
    counts = samples.groupBy(*keys, F.lower(F.trim(F.col(term))).alias("term")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, keys)


def numeric_coherence(x: Column, median: Column, mad: Column, n: Column) -> Column:
    """A robust z within 3.5 is fine; groups that are small, constant, centred on zero or wide abstain."""
    z = F.try_divide(F.abs(x - median), MAD_SCALE * mad)
    blind = n.isNull() | (n < LEAST_SAMPLES) | (mad <= 0) | (median == 0) | (F.try_divide(mad, F.abs(median)) > WIDEST_SPREAD)
    return F.when(x.isNull(), abstain("no number")).when(blind, abstain("no usable statistics")).when(z <= Z_LIMIT, ok()).otherwise(doubt(F.greatest(F.lit(LEAST_TRUST), 1 - (z - Z_LIMIT) / Z_SPAN), "far from its peers"))


def nominal_coherence(n: Column, total: Column) -> Column:
    """Terms that peers never or rarely use are doubted."""
    share = F.coalesce(n, F.lit(0)) / total
    return F.when(total.isNull() | (total < LEAST_SAMPLES), abstain("too few samples")).when(F.coalesce(n, F.lit(0)) == 0, doubt(UNSEEN_TRUST, "never seen")).when(share < RARE_SHARE, doubt(RARE_TRUST, "rare")).otherwise(ok())


def verify_coherence(values: DataFrame, numeric: DataFrame, nominal: DataFrame, raw: str = "raw", out: str = "coherence") -> DataFrame:
    """Against profiles of (category_id, attribute); a range counts by its middle, in the unit it was written in."""
    keys = ["category_id", "attribute"]
    df = with_quantity(values, raw, "__q").withColumn("__term", F.lower(F.trim(raw)))
    df = df.join(F.broadcast(numeric.select(*keys, F.col("median").alias("__median"), F.col("mad").alias("__mad"), F.col("n").alias("__n"))), keys, "left")
    totals = nominal.select(*keys, F.col("total").alias("__total")).distinct()
    df = df.join(F.broadcast(totals), keys, "left").join(nominal.select(*keys, F.col("term").alias("__term"), F.col("n").alias("__tn")), [*keys, "__term"], "left")
    c = F.col
    verdict = F.when(c("kind").isin("quantity", "range"), numeric_coherence(c("__q")["magnitude"], c("__median"), c("__mad"), c("__n"))).when(c("kind") == "nominal", nominal_coherence(c("__tn"), c("__total"))).otherwise(abstain("no statistics for this kind"))
    return df.withColumn(out, verdict).drop("__q", "__term", "__median", "__mad", "__n", "__total", "__tn")


def spread_report(profile: DataFrame, keys: list[str]) -> DataFrame:
    """Which numeric groups abstain, and why."""
    c = F.col
    why = F.when(c("n") < LEAST_SAMPLES, "too few samples").when(c("mad") <= 0, "constant").when(c("median") == 0, "median is zero").when(c("mad") / F.abs("median") > WIDEST_SPREAD, "too wide").otherwise("usable")
    return profile.select(*keys, "median", "mad", "n", why.alias("status")).orderBy(*keys)


def ensemble_index(samples: DataFrame, order: list[str]) -> DataFrame:
    """(sku, attribute, samples): what each resampling pass said, in the given order."""
    entries = F.array_sort(F.collect_list(F.struct(*order, "value")))
    return samples.groupBy("sku", "attribute").agg(F.transform(entries, lambda e: e["value"]).alias("samples"))


def others(own: Column, samples: Column) -> Column:
    """The first three distinct samples, in order, that differ from the value."""
    return F.slice(F.array_sort(F.array_distinct(F.filter(samples, lambda s: F.lower(F.trim(s)) != F.lower(F.trim(own))))), 1, 3)


def verify_ensemble(values: DataFrame, index: DataFrame, raw: str = "raw", out: str = "ensemble") -> DataFrame:
    """Agreement of a value with its samples; text similarity runs on distinct lists only."""
    from tallymark.functions.similarity import pairwise_similarity

    df = values.join(index, ["sku", "attribute"], "left").withColumn("__all", F.when(F.size("samples") > 0, F.concat(F.array(raw), "samples")))
    known = df.select("__all").filter("__all IS NOT NULL").distinct().select("__all", pairwise_similarity(F.col("__all")).alias("__sim"))
    df = df.join(known, "__all", "left")
    verdict = F.when(F.col("__sim").isNull(), abstain("no samples")).when(F.col("__sim") >= 0.999, ok()).otherwise(doubt(F.greatest(F.lit(0.08), F.col("__sim")), F.concat(F.lit("also seen: "), F.array_join(others(F.col(raw), F.col("samples")), ", "))))
    return df.withColumn(out, verdict).drop("__all", "__sim", "samples")


