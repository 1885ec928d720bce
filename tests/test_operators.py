import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions.binomial import needed, upper_bound
from tallymark.functions.similarity import mean_ratio
from tallymark.operators.certify import review_queue, risk_coverage, select_thresholds
from tallymark.operators.extract import extract_model, extract_rules, ground, merge_values, string_properties
from tallymark.operators.faults import MIX, inject_faults
from tallymark.operators.score import auroc, fit_scorer, heuristic_score, values_agree
from tallymark.operators.verify import failure_reasons, nominal_coherence, numeric_coherence, numeric_profile, verify_constraints, verify_dimension, verify_ensemble
from tallymark.plans.session import build_session, three_way_split
from tallymark.sources.catalog import Attribute, Category, spec_table
from tallymark.sources.feeds import cache_key, fetch_many, harvest, load_samples
from tallymark.sources.synthetic import answer_key, generate_catalog

SIGNAL = "struct<trust:double,applicable:boolean,detail:string>"


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_clopper_pearson_published_points():
    assert [round(100 * upper_bound(e, n, 0.05), 2) for n, e in ((50, 0), (100, 1), (150, 1), (200, 7))] == [5.82, 4.66, 3.12, 6.47]
    assert upper_bound(0, 10, 0.05) == pytest.approx(0.2589, abs=1e-4)
    assert upper_bound(0, 0, 0.05) == upper_bound(5, 5, 0.05) == 1.0
    assert round(100 * upper_bound(1000, 20_000, 0.05), 2) == 5.26


def test_sample_sizes():
    assert [needed(a, 0.05) for a in (0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15)] == [598, 299, 149, 99, 59, 42, 29, 19]
    with pytest.raises(ValueError):
        needed(0, 0.05)


def sequence_threshold(scores, errors, alpha, delta=0.05):
    """The fixed sequence, point by point."""
    n, ordered = len(scores), sorted(zip(scores, errors, strict=True))
    least = max(30, needed(alpha, delta))
    if least > n:
        return None
    best = None
    for i in range(50):
        q = 1.0 if i == 49 else least / n + i * ((1 - least / n) / 49)
        tau = ordered[math.ceil(q * (n - 1))][0]
        got = [e for s, e in ordered if s <= tau]
        if len(got) < least:
            continue
        if upper_bound(sum(got), len(got), delta) > alpha:
            break
        best = tau
    return best


@pytest.mark.parametrize(("n", "seed"), [(40, 1), (200, 2), (1500, 3)])
def test_thresholds_equal_the_sequence(spark, n, seed):
    r = random.Random(seed)
    scores = [round(r.random(), 3) for _ in range(n)]
    errors = [r.random() < 1 / (1 + math.exp(-12 * (s - 0.8))) for s in scores]
    df = rows(spark, list(zip(scores, errors, strict=True)), "score double, is_error boolean")
    alphas = (0.02, 0.05, 0.1)
    got = {x.alpha: (x.threshold if x.feasible else None) for x in select_thresholds(df, alphas).collect()}
    assert got == {a: sequence_threshold(scores, errors, a) for a in alphas}


def test_guarantee_by_simulation():
    r, alpha, bad, trials = random.Random(5), 0.05, 0, 60
    risk = lambda s: 1 / (1 + math.exp(-12 * (s - 0.8)))
    for _ in range(trials):
        scores = [r.random() for _ in range(500)]
        tau = sequence_threshold(scores, [r.random() < risk(s) for s in scores], alpha)
        bad += tau is not None and sum(risk(tau * (k + 0.5) / 200) for k in range(200)) / 200 > alpha
    assert bad <= 3 * 0.05 * trials


def test_empty_calibration_is_refused(spark):
    x = select_thresholds(rows(spark, [], "score double, is_error boolean"), [0.05]).first()
    assert not x.feasible and x.threshold == float("-inf") and x.reason == "empty calibration set"


def test_dial_and_queue(spark):
    cal = rows(spark, [(k / 400, k > 380) for k in range(400)], "score double, is_error boolean")
    test = rows(spark, [(k, k / 100, k % 10 == 0, k > 95) for k in range(100)], "ordinal int, score double, hard boolean, is_error boolean")
    d = risk_coverage(cal, test, [0.05, 0.005]).orderBy("alpha").collect()
    assert not d[0].feasible and d[0].n_auto_published == 0 and d[1].feasible
    assert d[1].n_auto_published + d[1].n_review == d[1].n_total == 100
    q = [x.ordinal for x in review_queue(test, 0.9, 3).collect()]
    assert q == [0, 99, 98]  # a score of zero counts as one
    with pytest.raises(ValueError):
        review_queue(test, 0.5, 0)


@pytest.mark.parametrize(("pairs", "want"), [([(0.1, 0), (0.9, 1)], 1.0), ([(0.9, 0), (0.1, 1)], 0.0), ([(0.5, 0), (0.5, 1)], 0.5), ([(0.5, 0)], None)])
def test_auroc(spark, pairs, want):
    got = auroc(rows(spark, [(s, bool(e)) for s, e in pairs], "s double, e boolean"), "s", "e").first()[0]
    assert math.isnan(got) if want is None else got == want


@pytest.mark.parametrize(("kind", "raw", "trust", "applicable"), [("quantity", "4.2 kg", 0.0, True), ("quantity", "0.5", 0.55, True), ("quantity", "see chart", 0.0, True), ("range", "120 mm", 0.4, True), ("quantity", "12 mm", 1.0, True), ("range", "10/+5 mm", 0.0, True), ("nominal", "x", 0.0, False), ("quantity", "", 0.0, True)])
def test_dimension(spark, kind, raw, trust, applicable):
    df = rows(spark, [(raw, kind, "[length]", "millimeter")], "raw string, kind string, dimension string, canonical_unit string")
    s = verify_dimension(df).first().dimensional
    assert (s.trust, s.applicable) == (trust, applicable)


def test_constraints_over_records(spark):
    c = Category("v", tuple(Attribute(a, "quantity", "[length]", "millimeter") for a in ("bore", "body", "face")), ("bore <= body", "body <= face"))
    data = [("a", 0, "bore", "200 mm"), ("a", 1, "body", "15 mm"), ("b", 0, "bore", '1/2"'), ("b", 1, "body", "15 mm"), ("c", 0, "bore", "1 mm"), ("d", 0, "bore", '2"'), ("d", 1, "body", "15 mm"), ("d", 2, "face", "20 mm")]
    df = rows(spark, [(*x, "quantity", "[length]", "millimeter") for x in data], "sku string, val_ord int, attribute string, raw string, kind string, dimension string, canonical_unit string")
    got = {(r.sku, r.attribute): (r.constraint.trust, r.constraint.applicable) for r in verify_constraints(df, c).collect()}
    assert got == {("a", "bore"): (0.0, True), ("a", "body"): (0.0, True), ("b", "bore"): (1.0, True), ("b", "body"): (0.7, True), ("c", "bore"): (0.0, False), ("d", "bore"): (0.0, True), ("d", "body"): (0.0, True), ("d", "face"): (1.0, True)}


def test_coherence(spark):
    p = numeric_profile(rows(spark, [("k", float(x)) for x in [24, 25, 26] * 8 + [520]], "k string, x double"), ["k"]).first()
    assert (p["median"], p["mad"], p["n"]) == (25.0, 1.0, 25)
    f = lambda x, m, d, n: tuple(spark.range(1).select(numeric_coherence(F.lit(x), F.lit(m), F.lit(d), F.lit(n)).alias("s")).select("s.trust", "s.applicable").first())
    assert f(25.0, 25.0, 1.0, 25) == (1.0, True) and f(520.0, 25.0, 1.0, 25) == (0.05, True)
    assert not any(x[1] for x in (f(25.0, 25.0, 1.0, 11), f(25.0, 25.0, 0.0, 25), f(25.0, 0.0, 1.0, 25), f(25.0, 25.0, 20.0, 25)))
    g = lambda n, t: tuple(spark.range(1).select(nominal_coherence(F.lit(n).cast("int"), F.lit(t).cast("int")).alias("s")).select("s.trust", "s.applicable").first())
    assert [g(39, 40), g(1, 100), g(None, 40), g(3, 5)] == [(1.0, True), (0.5, True), (0.15, True), (0.0, False)]


def test_ensemble(spark):
    assert mean_ratio(["a"]) == 1.0 and mean_ratio(["tide", "diet"]) == 0.25 and mean_ratio(["diet", "tide"]) == 0.5
    v = rows(spark, [("a", "x", "brass"), ("b", "x", "brass"), ("c", "x", "brass")], "sku string, attribute string, raw string")
    i = rows(spark, [("a", "x", ["Brass", "brass"]), ("b", "x", ["zzz"])], "sku string, attribute string, samples array<string>")
    got = {r.sku: (round(r.ensemble.trust, 2), r.ensemble.applicable) for r in verify_ensemble(v, i).collect()}
    assert got == {"a": (1.0, True), "b": (0.08, True), "c": (0.0, False)}


def test_scores(spark):
    s = rows(spark, [([(0.5, True, "b"), (0.0, False, "")],), ([(0.0, True, "a"), (0.9, True, "c")],), ([(0.0, False, "")],)], f"s array<{SIGNAL}>")
    assert [x[0] for x in s.select(heuristic_score(F.col("s"))).collect()] == [0.5, 1.0, 1.0]
    assert s.select(failure_reasons(F.col("s"))).collect()[1][0] == ["a", "c"]
    one = rows(spark, [((0.5, True, ""), False)] * 5, f"v {SIGNAL}, is_error boolean")
    assert fit_scorer(one, ["v"]).weights == ()
    two = rows(spark, [((0.2 if k % 3 == 0 else 0.9, True, ""), k % 3 == 0) for k in range(90)], f"v {SIGNAL}, is_error boolean")
    scorer = fit_scorer(two, ["v"])
    got = two.select(scorer.score().alias("p"), "is_error").collect()
    assert min(r.p for r in got if r.is_error) > max(r.p for r in got if not r.is_error) and len(scorer.named_weights()) == 5


@pytest.mark.parametrize(("got", "want", "agrees"), [('0.5"', "12.7 mm", True), ("25 kg", "25 mm", False), ("12.7", "12.7 mm", False), ("25.0001 mm", "25 mm", True), ("28 mm", "25 mm", False), ("12", "12.0", True), ("x", "25 mm", False)])
def test_agreement(spark, got, want, agrees):
    df = rows(spark, [(got, want, "quantity")], "got string, want string, kind string")
    assert values_agree(df, "got", "want").first().agrees is agrees


ERP = {
    "3 BALL VLV SS 1000WOG SW RP PTFE": ("valve.ball", {"nominal_size": '3"', "pressure_rating": "1000 WOG", "body_material": "316 stainless steel", "seat_material": "PTFE", "end_connection": "socket weld", "port_type": "reduced port", "bore": '2.5"'}),
    "1 BALL VLV 304SS 1000WOG SCRD FP": ("valve.ball", {"nominal_size": '1"', "pressure_rating": "1000 WOG", "body_material": "304 stainless steel", "end_connection": "NPT threaded", "port_type": "full port", "bore": '1"'}),
    "HX CAP SCR 3/8-16X1.5 GR5 ZP": ("fastener.hex_cap_screw", {"nominal_diameter": '0.375"', "threads_per_inch": "16 /in", "length": '1.5"', "grade": "SAE Grade 5", "material": "medium carbon steel", "tensile_strength": "120000 psi", "finish": "zinc plated"}),
    "BRG BALL 6205-2RS C3": ("bearing.ball", {"bore_diameter": "25 mm", "outside_diameter": "52 mm", "width": "15 mm", "seal_type": "2RS rubber sealed both sides", "internal_clearance": "C3"}),
    "BRG BALL 9999-2RS": ("bearing.ball", {}),
    "": ("valve.ball", {}),
    "x": ("unknown", {}),
}


def test_rules(spark):
    df = rows(spark, [(t, c, t) for t, (c, _) in ERP.items()], "sku string, category_id string, description string")
    found = {t: {} for t in ERP}
    for r in extract_rules(df).collect():
        found[r.sku][r.attribute] = r.raw
        assert r.sku[r.start : r.start + len(r.quote)] == r.quote
    assert found == {t: v for t, (_, v) in ERP.items()}


def test_grounding_and_model(spark):
    d = "1/2 SS Ball Valve 600WOG"
    cases = {"ball valve": ("Ball Valve", 7), "600 WOG": ("600", 18), "zz": None, "valve xx": ("Valve", 12)}
    got = rows(spark, [(k,) for k in cases], "raw string").select("raw", ground(F.col("raw"), F.lit(d)).alias("g")).collect()
    assert {r.raw: r.g and tuple(r.g) for r in got} == cases

    def client(category, description):
        if description == "boom":
            raise RuntimeError
        return {"body": "SS", "fake": "titanium", "n": 5}

    p = rows(spark, [("1", "c", d), ("2", "c", "boom")], "sku string, category_id string, description string")
    out = extract_model(p, client)
    assert [(r.sku, r.attribute, r.quote) for r in out.collect()] == [("1", "body", "SS")]
    more = out.withColumn("proposer", F.lit("other")).unionByName(out.withColumn("attribute", F.lit("seat")))
    assert sorted((r.attribute, r.proposer) for r in merge_values(out, more).collect()) == [("body", "model"), ("seat", "model")]


def test_json_strings(spark):
    texts = ['{"a": "x", "b": 1, "c": "y"}', "[1]", "bad", None]
    got = [r[0] for r in rows(spark, [(t,) for t in texts], "t string").select(string_properties(F.col("t"), ["a", "b"])).collect()]
    assert got == [{"a": "x"}, None, None, None]


def test_generator(spark):
    g = generate_catalog(spark, 40)
    r = g.collect()
    assert len(r) == 120 and all(len(x.description) <= 40 and set(x.recoverable) <= set(x.truth) for x in r)
    assert g.collect() == generate_catalog(spark, 40).collect()
    assert {x.attribute for x in answer_key(g).collect()} >= {"bore", "grade", "seal_type"}
    with pytest.raises(ValueError):
        generate_catalog(spark, 0)


def test_faults(spark):
    specs = spec_table(spark)
    v = extract_rules(generate_catalog(spark, 300)).join(F.broadcast(specs.drop("ordinal")), ["category_id", "attribute"])
    out = inject_faults(v, 0.12).select("fault", "original", "raw").collect()
    hit = [r for r in out if r.fault]
    assert 0.08 < len(hit) / len(out) < 0.14 and {r.fault for r in hit} == set(MIX)
    assert all(r.raw != r.original for r in hit) and all(r.raw == r.original for r in out if not r.fault)


def test_split_is_by_position(spark):
    got = three_way_split(spark.range(100).withColumn("k", 99 - F.col("id")), ["k"]).orderBy("ordinal").collect()
    assert [(r.k, r.ordinal, r.split) for r in got] == [(k, k, k % 3) for k in range(100)]


def test_session_end_to_end(spark, tmp_path):
    s = build_session(spark, 60, path=f"file://{tmp_path}")
    r = s.stats().first()
    assert 0.05 < r.baseline_error < 0.2 and r.auroc > 0.6
    assert s.dial([0.15]).count() == 1 and s.queue(0.005, 5).count() == 5


def test_caches(spark, tmp_path):
    folder, made = f"file://{tmp_path}", []
    make = lambda: made.append(1) or spark.range(3)
    k = cache_key(model="m", n=3)
    assert harvest(spark, folder, k, make).count() == harvest(spark, folder, k, make).count() == 3 and len(made) == 1
    assert load_samples(spark, folder, [k, "none"]).count() == 3 and load_samples(spark, folder, ["none"]) is None
    pairs = rows(spark, [("a", "1"), ("b", "2")], "brand string, product_code string")
    assert [r.brand for r in fetch_many(pairs, lambda b, c: {"x": c} if b == "a" else 1 / 0).collect()] == ["a"]


def test_rule_extraction_plan_stays_small(spark):
    """A description, however it is made, stands in the plan a few times, not once a use; so do numbers that are written."""
    df = generate_catalog(spark, 5)
    plan = extract_rules(df)._jdf.queryExecution().analyzed().toString()
    assert len(plan) < 400_000
    values = {(r.sku, r.attribute): r.raw for r in extract_rules(df).collect()}
    for r in answer_key(df).collect():
        if (r.sku, r.attribute) in values and r.attribute in ("bore", "length", "nominal_diameter", "bore_diameter", "width"):
            assert values[r.sku, r.attribute] == r.expected
