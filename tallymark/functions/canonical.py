"""Canonical text of attribute values: codes, numbers, vocabulary and synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.quantities import bound, format_g, literal_map, strip
from tallymark.sources.catalog import CODES, SYNONYMS

#: A whole number and a fraction must be separated, so 15/16 is never read as 1 and 5/16.
FRACTION = r"^(-?)(?:(\d+)[\s-]+)?(\d+)/(\d+)"


def parse_fraction(text: Column) -> Column:
    """``1/4``, ``1-1/4``, ``3 1/2``; NULL for anything else."""
    return _fraction(strip(text), FRACTION + "$")


def _fraction(t: Column, pattern: str) -> Column:
    part = lambda k: F.regexp_extract(t, pattern, k).try_cast("double")
    value = F.coalesce(part(2), F.lit(0.0)) + F.try_divide(part(3), part(4))
    return F.when(t.rlike(pattern), F.when(F.regexp_extract(t, pattern, 1) == "-", -value).otherwise(value))


def canonical_number(text: Column) -> Column:
    """The number in decimal form with its unit as written; NULL if the text starts with no number.

    Separators of thousands and decimal commas are read, and numbers of a million or more keep their digits.
    """
    plain = r"^(-?(?:\d[\d,]*(?:\.\d+)?|\.\d+))"

    def read(t: Column) -> Column:
        digits = F.regexp_extract(t, plain, 1)
        comma = digits.rlike(r"^-?\d+,\d+$") & ~digits.rlike(r"^-?\d+,\d{3}$")
        number = F.when(comma, F.replace(digits, F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit(""))).try_cast("double")
        fraction = _fraction(t, FRACTION)
        rest = strip(F.regexp_replace(t, F.when(fraction.isNotNull(), F.lit(FRACTION)).otherwise(F.lit(plain)), F.lit("")))
        return bound(F.struct(F.coalesce(fraction, number).alias("value"), rest.alias("suffix")), shown)

    def shown(n: Column) -> Column:
        value, suffix = n["value"], n["suffix"]
        number = F.when((F.abs(value) >= 1e6) & (value == F.floor(value)), value.cast("decimal(38,0)").cast("string")).otherwise(format_g(value))
        return F.when(value.isNotNull(), F.concat(number, F.when(suffix.isin('"', "'", ""), F.lit("")).otherwise(F.lit(" ")), suffix))

    return bound(strip(text), read)


def from_vocabulary(text: Column, vocabulary: Column) -> Column:
    """The term that equals the text, else the only one that starts with it; case is ignored."""
    low = F.lower(strip(text))
    exact = F.get(F.filter(vocabulary, lambda t: F.lower(t) == low), F.lit(0))
    starting = F.filter(vocabulary, lambda t: F.startswith(F.lower(t), low))
    return F.coalesce(exact, F.when(F.size(starting) == 1, F.get(starting, F.lit(0))))


def normalise(raw: Column, attribute: Column, kind: Column, vocabulary: Column) -> tuple[Column, Column]:
    """(text, rule): the first of code, number, vocabulary and synonym that applies; else the text unchanged."""
    t = strip(raw)
    low = F.lower(t)
    codes = literal_map({f"{a}\0{c.lower()}": term for a, own in CODES.items() for c, term in own.items()})
    allowed = lambda term: vocabulary.isNull() | F.array_contains(vocabulary, term)
    code = F.try_element_at(codes, F.concat(attribute, F.lit("\0"), low))
    synonym = F.try_element_at(literal_map(SYNONYMS), low)
    tries = [
        ("code-expansion", F.when(allowed(code), code)),
        ("numeric", F.when(kind.isin("quantity", "range"), canonical_number(t))),
        ("vocabulary", from_vocabulary(t, vocabulary)),
        ("synonym", F.when(allowed(synonym), synonym)),
    ]
    rule = F.when(t == "", "empty")
    for name, found in tries:
        rule = rule.when(found.isNotNull(), name)
    return F.when(t == "", raw).otherwise(F.coalesce(*[x for _, x in tries], raw)), rule.otherwise("unchanged")


def normalise_values(values: DataFrame, specs: DataFrame) -> DataFrame:
    """``values`` (category_id, attribute, raw, ...) with raw made canonical and ``rule`` added; unknown attributes pass through."""
    own = F.broadcast(specs.select("category_id", "attribute", F.col("kind").alias("__kind"), F.col("vocabulary").alias("__vocabulary")))
    text, rule = normalise(F.col("raw"), F.col("attribute"), F.col("__kind"), F.col("__vocabulary"))
    known = F.col("__kind").isNotNull()
    out = values.join(own, ["category_id", "attribute"], "left").withColumns({"rule": F.when(known, rule).otherwise("unchanged"), "raw": F.when(known, text).otherwise(F.col("raw"))})
    return out.drop("__kind", "__vocabulary")
