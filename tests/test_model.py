import json

from pyspark.sql import functions as F

from tallymark.operators.certify import certificate, certificate_summary, dial_json, with_provenance
from tallymark.operators.model import answer_counts, answer_format, ask, counts_summary, evidence, model_values, read_answers, requests
from tallymark.operators.verify import ok
from tallymark.plans.harvest import harvest_pass, pass_key
from tallymark.plans.session import assay
from tallymark.sources.catalog import Attribute, Category, get_category, shipped, spec_table

TEXT = "1/2 BALL VLV 600WOG BRASS"


def answers(spark, rows):
    return spark.createDataFrame([(str(k), "valve.ball", TEXT, c, t, f, 0.5) for k, (c, t, f) in enumerate(rows)], "sku string, category_id string, description string, content string, thinking string, failed boolean, seconds double")


def test_requests_name_the_attributes(spark):
    p = spark.createDataFrame([("1", "valve.ball", TEXT), ("2", "nope", TEXT), ("3", "valve.ball", None)], "sku string, category_id string, description string")
    got = {r.sku: r for r in requests(p).collect()}
    assert set(got) == {"1", "3"}
    assert TEXT in got["1"].prompt and "body_material" in got["1"].prompt and "Do not guess" in got["1"].prompt
    form = json.loads(got["1"].format)
    assert form == answer_format(get_category("valve.ball")) and form["required"] == [] and {v["type"] for v in form["properties"].values()} == {"string"}


def test_answers_are_read_and_counted(spark):
    good = json.dumps({"seat_material": "PTFE", "body_material": "brass", "nope": "BRASS", "bore": 3, "pressure_rating": " 600 WOG ", "port_type": " "})
    rows = [(good, None, False), ("", f" {good} ", False), ("  ", "", False), (None, None, True), ("no json", None, False), ("[1]", good, False), ('"x"', None, False), ("{}", None, False)]
    read = read_answers(answers(spark, rows))
    values = [(r.sku, r.val_ord, r.attribute, r.raw, r.quote, r.start) for r in model_values(read).orderBy("sku", "val_ord").collect()]
    assert values == [(s, *v) for s in "01" for v in [(1, "body_material", "brass", "BRASS", 20), (2, "pressure_rating", "600 WOG", "600", 13)]]
    counts = answer_counts(read)
    assert counts.first().asDict() == {"calls": 8, "failures": 1, "empty_responses": 1, "parse_failures": 3, "values_proposed": 8, "values_ungrounded": 4, "seconds": 4.0}
    assert counts.select(counts_summary()).first()[0] == "8 calls in 4.0s, 4 of 8 values grounded, 1 empty, 3 unparseable"
    assert tuple(answer_counts(read.limit(0)).first()) == (0, 0, 0, 0, 0, 0, 0.0)


def test_a_client_that_raises_is_counted(spark):
    def client(prompt, form, options):
        if "BAD" in prompt:
            raise RuntimeError
        return {"content": json.dumps({"body_material": "BRASS", "nominal_size": str(options["temperature"])})}

    p = spark.createDataFrame([("1", "valve.ball", TEXT), ("2", "valve.ball", "BAD")], "sku string, category_id string, description string")
    read = read_answers(ask(requests(p), client, {"temperature": 0.7}))
    assert [(r.sku, r.attribute) for r in model_values(read).collect()] == [("1", "body_material")]
    assert tuple(answer_counts(read).first())[:6] == (2, 1, 0, 0, 2, 1)


def test_evidence(spark):
    assert spark.range(1).select(evidence(F.lit(TEXT)).alias("e")).first().e == [("erp", "erp_record", TEXT)]


def test_passes_are_cached_and_vary(spark, tmp_path):
    def client(prompt, form, options):
        return {"content": json.dumps({"body_material": "BRASS", "seat_material": f"VLV{options['temperature']}"})}

    p = spark.createDataFrame([("1", "valve.ball", TEXT + " VLV0.7"), ("2", "nope", TEXT)], "sku string, category_id string, description string")
    run = lambda **how: harvest_pass(spark, f"file://{tmp_path}", p, client, "m", "two", **how)
    first = {r.attribute: r.proposer for r in run().collect()}
    assert first["body_material"] in ("rules", "m") and "rules" in first.values()
    alone = {r.attribute: (r.raw, r.proposer) for r in run(use_rules=False).collect()}
    assert alone == {"body_material": ("BRASS", "m")}
    assert {r.attribute for r in run(sample=0).collect()} == {"body_material", "seat_material"}
    assert sorted(f.name for f in tmp_path.iterdir()) == sorted({pass_key("two", "m", 20260820, shipped(), s, u) for s, u in [(None, True), (None, False), (0, True)]})
    client = lambda *a: 1 / 0  # noqa: E731, F841
    assert run(sample=0).count() == 2


def test_dial_json_and_provenance(spark):
    columns = "alpha double, delta double, feasible boolean, threshold double, n_calibration long, error_upper_bound double, reason string, n_auto_published long, n_rejected long, n_total long, n_review long, automation_rate double, realized_error double, baseline_error double"
    dial = spark.createDataFrame([(0.1, 0.05, True, 0.5, 9, 0.08, "", 6, 1, 8, 2, 0.75, 0.0, 0.2), (0.01, 0.05, False, float("-inf"), 9, None, "too few", 0, 1, 8, 8, 0.0, 0.0, 0.2)], columns)
    yes, no = (json.loads(r.json) for r in dial_json(dial).orderBy(F.desc("alpha")).collect())
    assert (yes["feasible"], yes["certifiedBound"], yes["automationRate"], yes["nReview"]) == (True, 0.08, 0.75, 2)
    assert no["certifiedBound"] is None and no["threshold"] is None and no["reason"] == "too few"
    cert = with_provenance(certificate(dial), 7, ["dimensional"], shipped().values(), "rules")
    r = cert.withColumn("line", certificate_summary()).collect()
    assert len(r) == 1 and r[0].run_id.startswith("run-7-") and r[0].verifier_versions == {"dimensional": "0.1.0"} and r[0].schema_fingerprint.count(",") == 2 and r[0].issued_at
    assert r[0].line == "auto-published 6 of 8 (75.0%) at a certified error of at most 10.0% with 95% confidence"


def test_assay_takes_other_categories_and_verifiers(spark):
    own = Category("a.b", (Attribute("x", "quantity", "[length]", "millimeter"),), ("x > 5",))
    specs = spec_table(spark, {"a.b": own})
    v = spark.createDataFrame([("1", "a.b", 0, "x", "3 mm"), ("2", "a.b", 0, "x", "7 mm")], "sku string, category_id string, val_ord int, attribute string, raw string").join(specs.drop("ordinal"), ["category_id", "attribute"])
    odd = v.filter("sku = '1'").withColumns({"sku": F.lit("3"), "category_id": F.lit("c.d")})
    got = assay(v.unionByName(odd), ["constraint"], categories={"a.b": own}, further={"mine": lambda df: df.withColumn("mine", ok())})
    assert {r.sku: (r.constraint.trust, r.constraint.applicable, r.mine.trust) for r in got.collect()} == {"1": (0.0, True, 1.0), "2": (1.0, True, 1.0), "3": (0.0, False, 1.0)}
