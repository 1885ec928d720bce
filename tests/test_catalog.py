import pytest
from pyspark.sql import functions as F

from tallymark.functions.canonical import canonical_number, normalise, normalise_values, parse_fraction
from tallymark.operators.constraints import ConstraintError, compile_constraint, parse, references
from tallymark.sources.catalog import Attribute, Category, SchemaError, fingerprint, get_category, load_category, load_folder, shipped, spec_table

YAML = "category_id: a.b\nattributes:\n  - {name: x, kind: quantity, dimension: '[length]'}\nconstraints: [x > 0]\n"


def test_shipped_categories():
    assert {k: (len(c.attributes), len(c.constraints)) for k, c in shipped().items()} == {"bearing.ball": (10, 5), "fastener.hex_cap_screw": (12, 5), "valve.ball": (11, 5)}


@pytest.mark.parametrize("make", [lambda: Attribute("x", "quantity"), lambda: Attribute("x", "nominal"), lambda: Attribute("x", "odd"), lambda: Category("c", (Attribute("x", "text"), Attribute("x", "text"))), lambda: Category("c", (Attribute("x", "text"),), ("y > 0",)), lambda: get_category("nope")])
def test_invalid_schemas(make):
    with pytest.raises(SchemaError):
        make()


def test_yaml(tmp_path):
    with pytest.raises(SchemaError):
        load_folder(tmp_path)
    (tmp_path / "a.yaml").write_text(YAML)
    assert load_folder(tmp_path)["a.b"].constraints == ("x > 0",)
    (tmp_path / "b.yaml").write_text(YAML)
    with pytest.raises(SchemaError):
        load_folder(tmp_path)
    for bad in ("- 1", "a: [", "category_id: x\nattributes: [{kind: text}]"):
        (tmp_path / "c.yaml").write_text(bad)
        with pytest.raises(SchemaError):
            load_category(tmp_path / "c.yaml")


def test_fingerprint_follows_content():
    a = Category("c", (Attribute("x", "text"),))
    assert fingerprint(a) == fingerprint(Category("c", (Attribute("x", "text"),))) != fingerprint(Category("c", (Attribute("y", "text"),)))


@pytest.mark.parametrize("bad", ["__import__('os')", "x.y > 0", "[a for a in b]", "(lambda: 1)()", "eval('1')", "x >", "'a' == x", "x if y else z"])
def test_constraints_are_data(bad):
    with pytest.raises(ConstraintError):
        parse(bad)


@pytest.mark.parametrize(
    ("expression", "env", "holds", "broken"),
    [
        ("a < b", {"a": 1, "b": 2}, True, False), ("a < b", {"a": 1}, None, False), ("a < b and c < d", {"a": 3, "b": 2}, None, False), ("0 < a <= b", {"a": -1}, False, False),
        ("0 < a <= b", {"a": 1}, None, False), ("a / b > 1", {"a": 1, "b": 0}, None, True), ("min(a, b) > 0", {"a": 1}, None, False), ("max(a, 2) == 2", {"a": 1}, True, False),
        ("round(a) == 2", {"a": 2.5}, True, False), ("not a > 1", {"a": 0}, True, False), ("a ** 2 + -a == 2", {"a": 2}, True, False), ("abs(a) >= 1 or b > 0", {"a": -1, "b": 0}, True, False),
    ],
)
def test_constraint_logic(spark, expression, env, holds, broken):
    value = lambda n: F.lit(float(env[n])) if n in env else F.lit(None).cast("double")
    got = spark.range(1).select(*compile_constraint(expression, value)).first()
    assert tuple(got) == (holds, broken)
    assert references(expression) >= set(env)


@pytest.mark.parametrize(("text", "want"), [("1/4", "0.25"), ("25 mm", "25 mm"), ('1-1/4"', '1.25"'), ("15/16", "0.9375"), ("11/4", "2.75"), ("1,200 psi", "1200 psi"), ("12,7 mm", "12.7 mm"), (".500", "0.5"), ("1000000 psi", "1000000 psi"), ("odd", None), ("-1/2", "-0.5")])
def test_canonical_number(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(canonical_number(F.col("t"))).first()[0]
    assert got == want


def test_fraction(spark):
    texts = {"1/4": 0.25, "1-1/4": 1.25, "3 1/2": 3.5, "15/16": 0.9375, "1/0": None, "7": None}
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_fraction(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == texts


@pytest.mark.parametrize(("attribute", "kind", "raw", "want", "rule"), [("seal_type", "nominal", "Z", "Z metal shielded one side", "code-expansion"), ("seal_type", "nominal", "2rs", "2RS rubber sealed both sides", "code-expansion"), ("material", "nominal", "18-8", "304 stainless steel", "code-expansion"), ("finish", "nominal", "z", "z", "unchanged"), ("finish", "nominal", "zinc", "zinc plated", "vocabulary"), ("finish", "nominal", " ", " ", "empty"), ("bore_diameter", "quantity", "1-1/4 in", "1.25 in", "numeric")])
def test_normalise(spark, attribute, kind, raw, want, rule):
    terms = next((a.vocabulary for c in shipped().values() for a in c.attributes if a.name == attribute and a.vocabulary), None)
    vocabulary = F.array(*map(F.lit, terms)) if terms else F.lit(None).cast("array<string>")
    if raw == "z":
        vocabulary = F.array(F.lit("zinc plated"), F.lit("zinc flake"))
    assert tuple(spark.range(1).select(*normalise(F.lit(raw), F.lit(attribute), F.lit(kind), vocabulary)).first()) == (want, rule)


def test_unknown_attributes_pass_through(spark):
    v = spark.createDataFrame([("1", "valve.ball", "nope", "1/2")], "sku string, category_id string, attribute string, raw string")
    assert tuple(normalise_values(v, spec_table(spark)).select("raw", "rule").first()) == ("1/2", "unchanged")
