"""Registered queries over the driver's tables. Catalog texts are derived from keys by whole-number arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallymark.functions.binomial import clopper_pearson_upper, required_sample_size
from tallymark.functions.canonical import canonical_number, normalise, parse_fraction
from tallymark.functions.quantities import convert, dimension_name, dimension_of, format_g, render, unit_symbol, with_quantity
from tallymark.functions.similarity import pairwise_similarity
from tallymark.operators.certify import DIAL_STOPS, certificate, decision, realised_error, review_queue, risk_coverage, select_thresholds
from tallymark.operators.extract import extract_rules, ground, merge_evidence, merge_values, string_properties
from tallymark.operators.faults import fault_mix, inject_faults
from tallymark.operators.model import answer_counts, read_answers
from tallymark.operators.score import applicable_trusts, auroc, features, fit_scorer, heuristic_score, prefix_counts, values_agree
from tallymark.operators.verify import any_hard, ensemble_index, nominal_coherence, nominal_profile, numeric_coherence, numeric_profile, others, spread_report, verify_constraints, verify_dimension, verify_ensemble
from tallymark.plans.session import three_way_split
from tallymark.sources.catalog import Attribute, Category, fingerprint, shipped
from tallymark.sources.feeds import feature_key, feature_rows
from tallymark.sources.synthetic import assemble, generate_catalog, token

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def r6(c: Column) -> Column:
    return F.round(c, 6)


# ---- derived catalog texts -------------------------------------------------------------------------


def quantities(spark: SparkSession, d: str) -> DataFrame:
    """sku, raw, gold: sizes of parts written in ten ways."""
    m, s = F.col("p_partkey") % 10, text("p_size")
    raw = (
        F.when(m == 0, F.concat(s, F.lit(" kg"))).when(m == 1, s).when(m == 2, F.concat(s, F.lit('"'))).when(m == 3, F.concat(s, F.lit("/8 in")))
        .when(m == 4, "1-1/2 in").when(m == 5, "see chart").otherwise(F.concat(s, F.lit(" mm")))
    )
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), raw.alias("raw"), F.concat(s, F.lit(" mm")).alias("gold"), "p_size")


QUANTITIES = """q AS (SELECT p_partkey AS sku, p_size, p_size || ' mm' AS gold,
  CASE p_partkey % 10 WHEN 0 THEN p_size || ' kg' WHEN 1 THEN p_size || '' WHEN 2 THEN p_size || '"' WHEN 3 THEN p_size || '/8 in' WHEN 4 THEN '1-1/2 in' WHEN 5 THEN 'see chart' ELSE p_size || ' mm' END AS raw,
  CASE p_partkey % 10 WHEN 3 THEN p_size / 8.0 WHEN 4 THEN 1.5 WHEN 5 THEN NULL ELSE p_size::DOUBLE END AS magnitude,
  CASE p_partkey % 10 WHEN 0 THEN 'kilogram' WHEN 1 THEN NULL WHEN 2 THEN 'inch' WHEN 3 THEN 'inch' WHEN 4 THEN 'inch' WHEN 5 THEN NULL ELSE 'millimeter' END AS unit
  FROM part)"""

SIZES = Category("derived.sizes", (Attribute("inner", "quantity", "[length]", "millimeter"), Attribute("outer", "quantity", "[length]", "millimeter"), Attribute("width", "quantity", "[length]", "millimeter")), ("inner < outer", "width < outer", "inner > 0"))


def siblings(spark: SparkSession, d: str) -> DataFrame:
    """Three values a part, the width missing for every fifth."""
    p = table(spark, d, "part")
    mm = lambda x: F.concat(text(x), F.lit(" mm"))
    value = lambda k, a, x: F.struct(F.lit(k).alias("val_ord"), F.lit(a).alias("attribute"), mm(x).alias("raw"))
    outer = F.col("p_size") + F.col("p_partkey") % 7 - 1
    every = F.array(value(0, "inner", F.col("p_size")), value(1, "outer", outer), F.when(F.col("p_partkey") % 5 != 0, value(2, "width", F.col("p_size") - 1 + F.col("p_partkey") % 4)))
    rows = p.select(F.col("p_partkey").alias("sku"), F.explode(F.filter(every, lambda v: v.isNotNull())).alias("v"))
    return rows.select("sku", "v.*", F.lit("quantity").alias("kind"), F.lit("[length]").alias("dimension"), F.lit("millimeter").alias("canonical_unit"))


SIBLINGS = """s AS (SELECT p_partkey AS sku, p_size::DOUBLE AS i, (p_size + p_partkey % 7 - 1)::DOUBLE AS o,
  CASE WHEN p_partkey % 5 <> 0 THEN (p_size - 1 + p_partkey % 4)::DOUBLE END AS w FROM part),
c AS (SELECT sku, i, o, w, CASE WHEN i < o THEN 1 ELSE 0 END AS c1, CASE WHEN w IS NULL THEN NULL WHEN w < o THEN 1 ELSE 0 END AS c2, CASE WHEN i > 0 THEN 1 ELSE 0 END AS c3 FROM s),
v AS (
  SELECT sku, 'inner' AS attribute, CASE WHEN c1 = 0 OR c3 = 0 THEN 0.0 ELSE 1.0 END AS trust, true AS applicable FROM c
  UNION ALL SELECT sku, 'outer', CASE WHEN c1 = 0 OR c2 = 0 THEN 0.0 WHEN c2 IS NULL THEN 0.7 ELSE 1.0 END, true FROM c
  UNION ALL SELECT sku, 'width', CASE WHEN c2 = 0 THEN 0.0 ELSE 1.0 END, true FROM c WHERE w IS NOT NULL)"""


def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Line items with a score of few distinct values, an error that is likelier at high scores, and a total order."""
    li = table(spark, d, "lineitem")
    score = F.round((F.round(F.col("l_discount") * 100) + F.round(F.col("l_tax") * 100)) / 20, 2)
    key = F.pmod(F.col("l_orderkey") * 31 + F.col("l_partkey") * 7 + F.col("l_linenumber"), F.lit(100))
    own = li.select("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey", "l_quantity", score.alias("score"), key.alias("k"))
    return own.withColumn("is_error", F.col("k") < F.floor(60 * F.col("score") * F.col("score") * F.col("score") + 1e-9)).withColumn("split", F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(3)))


CALIBRATION = """li AS (SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey, l_quantity, round((round(l_discount * 100) + round(l_tax * 100)) / 20, 2) AS score, (l_orderkey * 31 + l_partkey * 7 + l_linenumber) % 100 AS k FROM lineitem),
cal AS (SELECT *, k < floor(60 * score * score * score + 1e-9) AS is_error, (l_orderkey + l_linenumber) % 3 AS split FROM li)"""


def with_hard(df: DataFrame) -> DataFrame:
    return df.withColumn("hard", F.col("l_partkey") % 97 == 0)


# ---- quantities ------------------------------------------------------------------------------------


@query(f"WITH {QUANTITIES} SELECT sku, raw, round(magnitude, 6) AS magnitude, unit FROM q")
def parse_quantities(spark: SparkSession, d: str) -> DataFrame:
    return with_quantity(quantities(spark, d), "raw", "v").select("sku", "raw", r6(F.col("v.magnitude")).alias("magnitude"), F.col("v.unit").alias("unit"))


@query(f"WITH {QUANTITIES} SELECT sku, round(CASE unit WHEN 'inch' THEN magnitude * 25.4 WHEN 'millimeter' THEN magnitude END, 6) AS mm, round(CASE WHEN unit = 'kilogram' THEN magnitude / 0.45359237 END, 6) AS pounds, CASE unit WHEN 'kilogram' THEN 'mass' WHEN 'inch' THEN 'length' WHEN 'millimeter' THEN 'length' END AS dimension FROM q")
def convert_units(spark: SparkSession, d: str) -> DataFrame:
    q = with_quantity(quantities(spark, d), "raw", "v")
    to = lambda u: r6(convert(F.col("v.magnitude"), F.col("v.unit"), F.lit(u)))
    return q.select("sku", to("millimeter").alias("mm"), to("pound").alias("pounds"), dimension_name(dimension_of(F.col("v.unit"))).alias("dimension"))


@query("SELECT s_suppkey AS id, round(s_acctbal * 9 / 5 + 32, 4) AS fahrenheit, round(s_acctbal + 273.15, 4) AS kelvin FROM supplier")
def convert_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = lambda u: F.round(convert(F.col("s_acctbal"), F.lit("degC"), F.lit(u)), 4)
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), c("degF").alias("fahrenheit"), c("kelvin").alias("kelvin"))


@query("""SELECT p_partkey AS sku, printf('%g', p_retailprice) AS price,
  CASE p_partkey % 4 WHEN 0 THEN printf('%g', p_retailprice / 1000) || ' mm' WHEN 1 THEN p_size || ' to ' || (p_size + 5) || ' °C' WHEN 2 THEN p_type ELSE CASE WHEN p_size > 25 THEN 'yes' ELSE 'no' END END AS shown FROM part""")
def render_values(spark: SparkSession, d: str) -> DataFrame:
    m, c = F.col("p_partkey") % 4, F.col
    kind = F.when(m == 0, "quantity").when(m == 1, "range").when(m == 2, "nominal").otherwise("boolean")
    shown = render(kind, c("p_retailprice") / 1000, F.when(m == 0, "millimeter").otherwise("degC"), c("p_size").cast("double"), (c("p_size") + 5).cast("double"), c("p_type"), c("p_size") > 25, F.lit(None).cast("string"))
    return table(spark, d, "part").select(c("p_partkey").alias("sku"), format_g(c("p_retailprice")).alias("price"), shown.alias("shown"))


@query("""SELECT p_partkey AS sku, CASE p_partkey % 4 WHEN 0 THEN 'degC' WHEN 1 THEN 'psi' WHEN 2 THEN 'degC' ELSE 'bar' END AS unit,
  (CASE p_partkey % 4 WHEN 0 THEN -p_size WHEN 1 THEN least(p_size, 20) WHEN 2 THEN -20 ELSE 0 END)::DOUBLE AS low,
  (CASE p_partkey % 4 WHEN 0 THEN p_size WHEN 1 THEN greatest(p_size, 20) WHEN 2 THEN p_size ELSE p_size END)::DOUBLE AS high FROM part""")
def parse_ranges(spark: SparkSession, d: str) -> DataFrame:
    m, s = F.col("p_partkey") % 4, text("p_size")
    raw = F.when(m == 0, F.concat(F.lit("-"), s, F.lit(" to "), s, F.lit(" C"))).when(m == 1, F.concat(s, F.lit(" .. 20 psi"))).when(m == 2, F.concat(F.lit("-20/+"), s, F.lit("C"))).otherwise(F.concat(F.lit("0 bar...+"), s, F.lit(" bar")))
    q = with_quantity(table(spark, d, "part").select(F.col("p_partkey").alias("sku"), raw.alias("raw")), "raw", "v")
    return q.select("sku", F.col("v.unit").alias("unit"), F.col("v.low").alias("low"), F.col("v.high").alias("high"))


@query("""WITH t AS (SELECT p_partkey AS sku, p_size AS s, p_partkey % 6 AS m FROM part)
SELECT sku, CASE m WHEN 0 THEN s / 8.0 WHEN 1 THEN 1 + s / 64.0 WHEN 2 THEN 3.5 WHEN 3 THEN s / 16.0 END::DOUBLE AS fraction,
  CASE m WHEN 0 THEN printf('%g', s / 8.0) WHEN 1 THEN printf('%g', 1 + s / 64.0) WHEN 2 THEN '3.5' WHEN 3 THEN printf('%g', s / 16.0) WHEN 4 THEN printf('%g', 1 + s / 4.0) || '"' ELSE s || '00 psi' END AS canonical FROM t""")
def fraction_canonical(spark: SparkSession, d: str) -> DataFrame:
    m, s = F.col("p_partkey") % 6, text("p_size")
    raw = F.when(m == 0, F.concat(s, F.lit("/8"))).when(m == 1, F.concat(F.lit("1-"), s, F.lit("/64"))).when(m == 2, "3 1/2").when(m == 3, F.concat(s, F.lit("/16"))).when(m == 4, F.concat(F.lit("1-"), s, F.lit('/4"'))).otherwise(F.concat(s, F.lit("00 psi")))
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), parse_fraction(raw).alias("fraction"), canonical_number(raw).alias("canonical"))


@query("SELECT p_partkey AS sku, ['316 stainless steel', 'brass', '304 stainless steel', 'PVC', 'zinc', 'bronze', 'brz x', '  '][p_partkey % 8 + 1] AS text, ['code-expansion', 'code-expansion', 'synonym', 'code-expansion', 'unchanged', 'vocabulary', 'unchanged', 'empty'][p_partkey % 8 + 1] AS rule FROM part")
def normalise_nominal(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = next(a.vocabulary for a in shipped()["valve.ball"].attributes if a.name == "body_material")
    raw = F.get(F.array(*map(F.lit, ("ss", "BRS", "18-8", "pvc", "zinc", "bron", "brz x", "  "))), (F.col("p_partkey") % 8).cast("int"))
    out, rule = normalise(raw, F.lit("body_material"), F.lit("nominal"), F.array(*map(F.lit, vocabulary)))
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), out.alias("text"), rule.alias("rule"))


# ---- verifiers -------------------------------------------------------------------------------------

DIMENSIONAL = "CASE WHEN magnitude IS NULL THEN 0.0 WHEN unit IS NULL THEN 0.55 WHEN unit = 'kilogram' THEN 0.0 ELSE 1.0 END"


def judged_sizes(spark: SparkSession, d: str) -> DataFrame:
    spec = {"kind": F.lit("quantity"), "dimension": F.lit("[length]"), "canonical_unit": F.lit("millimeter")}
    return verify_dimension(quantities(spark, d).withColumns(spec))


@query(f"WITH {QUANTITIES} SELECT ({DIMENSIONAL})::DOUBLE AS trust, count(*) AS n, count(*) FILTER ({DIMENSIONAL} = 0) AS n_hard FROM q GROUP BY 1")
def dimensional_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("dimensional")
    return judged_sizes(spark, d).groupBy(s["trust"].alias("trust")).agg(F.count("*").alias("n"), F.count_if(s["applicable"] & (s["trust"] == 0)).alias("n_hard"))


@query(f"WITH {SIBLINGS} SELECT attribute, trust::DOUBLE AS trust, applicable, count(*) AS n FROM v GROUP BY ALL")
def constraint_verdicts(spark: SparkSession, d: str) -> DataFrame:
    out = verify_constraints(siblings(spark, d), SIZES)
    return out.groupBy("attribute", F.col("constraint.trust").alias("trust"), F.col("constraint.applicable").alias("applicable")).agg(F.count("*").alias("n"))


@query(f"WITH {SIBLINGS} SELECT sku, attribute, trust::DOUBLE AS trust FROM v WHERE sku % 5 = 0")
def constraint_missing_inputs(spark: SparkSession, d: str) -> DataFrame:
    out = verify_constraints(siblings(spark, d).filter(F.col("sku") % 5 == 0), SIZES)
    return out.select("sku", "attribute", F.col("constraint.trust").alias("trust"))


@query(f"WITH {SIBLINGS} SELECT sku, attribute, trust::DOUBLE AS trust FROM v")
def constraint_trusts_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``constraint_missing_inputs``, of every part."""
    return verify_constraints(siblings(spark, d), SIZES).select("sku", "attribute", F.col("constraint.trust").alias("trust"))


@query("SELECT event_type, round(median(value), 6) AS median, round(mad(value), 6) AS mad, count(value) AS n FROM events GROUP BY 1")
def coherence_profile(spark: SparkSession, d: str) -> DataFrame:
    p = numeric_profile(table(spark, d, "events"), ["event_type"], "value")
    return p.select("event_type", r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"), "n")


@query("""WITH p AS (SELECT event_type, median(value) AS m, mad(value) AS d, count(value) AS n FROM events GROUP BY 1),
z AS (SELECT event_id, n < 12 OR d <= 0 OR m = 0 OR d / abs(m) > 0.75 AS blind, abs(value - m) / (1.4826 * d) AS z FROM events JOIN p USING (event_type))
SELECT event_id, NOT blind AS applicable, round(CASE WHEN blind THEN 0 WHEN z <= 3.5 THEN 1 ELSE greatest(0.05, 1 - (z - 3.5) / 7) END, 6)::DOUBLE AS trust FROM z""")
def coherence_numeric(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type", "value")
    s = numeric_coherence(F.col("value"), F.col("median"), F.col("mad"), F.col("n"))
    joined = e.join(F.broadcast(numeric_profile(e, ["event_type"], "value")), "event_type")
    return joined.select("event_id", s["applicable"].alias("applicable"), r6(s["trust"]).alias("trust"))


@query("""WITH p AS (SELECT c_nationkey, lower(trim(c_mktsegment)) AS term, count(*) AS n FROM customer GROUP BY ALL), t AS (SELECT c_nationkey, sum(n) AS total FROM p GROUP BY 1)
SELECT c_custkey AS id, total >= 12 AS applicable, (CASE WHEN total < 12 THEN 0.0 WHEN n::DOUBLE / total < 0.02 THEN 0.5 ELSE 1.0 END)::DOUBLE AS trust
FROM customer c JOIN p ON p.c_nationkey = c.c_nationkey AND p.term = lower(trim(c.c_mktsegment)) JOIN t ON t.c_nationkey = c.c_nationkey""")
def coherence_nominal(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("term", F.lower(F.trim("c_mktsegment")))
    s = nominal_coherence(F.col("n"), F.col("total"))
    return c.join(F.broadcast(nominal_profile(c, ["c_nationkey"])), ["c_nationkey", "term"], "left").select(F.col("c_custkey").alias("id"), s["applicable"].alias("applicable"), s["trust"].alias("trust"))


@query("""WITH p AS (SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median, mad(l_extendedprice) AS mad, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, l_linestatus, round(median, 6) AS median, round(mad, 6) AS mad, n, CASE WHEN n < 12 THEN 'too few samples' WHEN mad <= 0 THEN 'constant' WHEN median = 0 THEN 'median is zero' WHEN mad / abs(median) > 0.75 THEN 'too wide' ELSE 'usable' END AS status FROM p""")
def spread_by_status(spark: SparkSession, d: str) -> DataFrame:
    keys = ["l_returnflag", "l_linestatus"]
    out = spread_report(numeric_profile(table(spark, d, "lineitem"), keys, "l_extendedprice"), keys)
    return out.select(*keys, r6(F.col("median")).alias("median"), r6(F.col("mad")).alias("mad"), "n", "status")


@query()
def ensemble_agreement(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("sku"), F.col("role").alias("attribute"), "turn", F.col("text").alias("value"))
    index = ensemble_index(turns.filter("turn > 0"), ["turn"])
    first = turns.groupBy("sku", "attribute").agg(F.min_by("value", "turn").alias("raw"))
    return verify_ensemble(first, index).select("sku", "attribute", F.col("ensemble.applicable").alias("applicable"), r6(F.col("ensemble.trust")).alias("trust"))


@query("""WITH i AS (SELECT user_id AS sku, list(event_type ORDER BY event_id) AS s FROM events WHERE event_id % 4 <> 0 GROUP BY 1)
SELECT sku, len(s) AS n, array_to_string(list_sort(list_distinct(list_filter(s, lambda x: x <> 'view')))[1:3], ',') AS others FROM i""")
def ensemble_lists(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").filter(F.col("event_id") % 4 != 0).select(F.col("user_id").alias("sku"), F.lit("event").alias("attribute"), "event_id", F.col("event_type").alias("value"))
    return ensemble_index(e, ["event_id"]).select("sku", F.size("samples").cast("long").alias("n"), F.array_join(others(F.lit("view"), F.col("samples")), ",").alias("others"))


@query("""WITH i AS (SELECT user_id AS sku, list(event_type ORDER BY event_id) AS s FROM events GROUP BY 1)
SELECT sku, len(s) AS n, array_to_string(list_sort(list_distinct(list_filter(s, lambda x: x <> 'view')))[1:3], ',') AS others FROM i""")
def ensemble_lists_all(spark: SparkSession, d: str) -> DataFrame:
    """As ``ensemble_lists``, of every event."""
    e = table(spark, d, "events").select(F.col("user_id").alias("sku"), F.lit("event").alias("attribute"), "event_id", F.col("event_type").alias("value"))
    return ensemble_index(e, ["event_id"]).select("sku", F.size("samples").cast("long").alias("n"), F.array_join(others(F.lit("view"), F.col("samples")), ",").alias("others"))


# ---- extraction ------------------------------------------------------------------------------------


def erp(spark: SparkSession, d: str) -> DataFrame:
    """Terse valve descriptions: size, noun, body, rating glued or not, end, port."""
    pick = lambda xs, k: F.get(F.array(*map(F.lit, xs)), (F.col("p_partkey") % k).cast("int"))
    rating = F.concat(text(F.col("p_size") * 100), F.when(F.col("p_partkey") % 2 == 0, " WOG").otherwise("WOG"))
    words = F.concat_ws(" ", pick(("1/2", "1-1/4", "3", "9"), 4), F.lit("BALL VLV"), F.upper(F.get(F.split("p_name", " "), F.lit(1))), pick(("SS", "304SS", "CS", "XX", "BRS"), 5), rating, pick(("SCRD", "SW", "ZZ"), 3), pick(("FP", "RP", "--"), 3))
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.lit("valve.ball").alias("category_id"), words.alias("description"))


ERP = """e AS (SELECT p_partkey AS sku, p_partkey AS k, p_size, ['1/2', '1-1/4', '3', '9'][p_partkey % 4 + 1] AS size, ['SS', '304SS', 'CS', 'XX', 'BRS'][p_partkey % 5 + 1] AS body,
  ['SCRD', 'SW', 'ZZ'][p_partkey % 3 + 1] AS fin, ['FP', 'RP', '--'][p_partkey % 3 + 1] AS port,
  concat_ws(' ', ['1/2', '1-1/4', '3', '9'][p_partkey % 4 + 1], 'BALL VLV', upper(split_part(p_name, ' ', 2)), ['SS', '304SS', 'CS', 'XX', 'BRS'][p_partkey % 5 + 1], (p_size * 100) || CASE WHEN p_partkey % 2 = 0 THEN ' WOG' ELSE 'WOG' END, ['SCRD', 'SW', 'ZZ'][p_partkey % 3 + 1], ['FP', 'RP', '--'][p_partkey % 3 + 1]) AS description FROM part)"""


@query(f"""WITH {ERP}, x AS (
  SELECT sku, 'nominal_size' AS attribute, size || '"' AS raw, size AS quote, description FROM e
  UNION ALL SELECT sku, 'pressure_rating', (p_size * 100) || ' WOG', regexp_extract(description, '[0-9]+ ?(WOG|PSI|CWP)'), description FROM e
  UNION ALL SELECT sku, 'body_material', CASE body WHEN 'SS' THEN '316 stainless steel' WHEN '304SS' THEN '304 stainless steel' WHEN 'CS' THEN 'carbon steel' ELSE 'brass' END, body, description FROM e WHERE body <> 'XX'
  UNION ALL SELECT sku, 'end_connection', CASE fin WHEN 'SCRD' THEN 'NPT threaded' ELSE 'socket weld' END, fin, description FROM e WHERE fin <> 'ZZ'
  UNION ALL SELECT sku, 'port_type', CASE port WHEN 'FP' THEN 'full port' ELSE 'reduced port' END, port, description FROM e WHERE port <> '--'
  UNION ALL SELECT sku, 'bore', CASE WHEN port = 'FP' THEN CASE size WHEN '1/2' THEN '0.5' WHEN '1-1/4' THEN '1.25' ELSE '3' END ELSE CASE size WHEN '1/2' THEN '0.375' WHEN '1-1/4' THEN '1' ELSE '2.5' END END || '"', size, description FROM e WHERE port <> '--' AND size <> '9')
SELECT sku, attribute, raw, quote, (strpos(description, quote) - 1)::INT AS start FROM x""")
def rule_extract_tokens(spark: SparkSession, d: str) -> DataFrame:
    return extract_rules(erp(spark, d)).select("sku", "attribute", "raw", "quote", "start")


@query("""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS ws FROM documents WHERE length(text) BETWEEN 200 AND 2000),
v AS (SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN ws[2] || ' ' || ws[3] WHEN 1 THEN 'qqqqqqqqqqqq ' || ws[4] ELSE 'zzzzq' END AS raw FROM w WHERE len(ws) >= 5 AND length(ws[2]) >= 2 AND length(ws[4]) >= 2),
h AS (SELECT doc_id, text, CASE WHEN contains(lower(text), lower(raw)) THEN raw WHEN contains(lower(text), lower(string_split(raw, ' ')[1])) AND doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN string_split(raw, ' ')[2] END AS hit, raw FROM v)
SELECT doc_id, lower(hit) AS quote, (strpos(lower(text), lower(hit)) - 1)::INT AS start FROM h WHERE hit IS NOT NULL AND doc_id % 3 = 1""")
def grounding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.length("text").between(200, 2000))
    ws = docs.select("doc_id", "text", F.split(F.regexp_replace("text", r"\s+", " "), " ").alias("ws")).filter((F.size("ws") >= 5) & (F.length(F.get("ws", F.lit(1))) >= 2) & (F.length(F.get("ws", F.lit(3))) >= 2))
    raw = F.concat(F.lit("qqqqqqqqqqqq "), F.get("ws", F.lit(3)))
    g = ws.filter(F.col("doc_id") % 3 == 1).select("doc_id", ground(raw, F.col("text")).alias("g")).filter("g IS NOT NULL")
    return g.select("doc_id", F.lower("g.quote").alias("quote"), "g.start")


@query(r"""WITH w AS (SELECT doc_id, text, string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS ws FROM documents),
v AS (SELECT doc_id, text, 'whole' AS kind, trim(concat_ws(' ', ws[1], ws[2])) AS raw FROM w UNION ALL SELECT doc_id, text, 'part', 'qqqqqqqqqqqq ' || ws[1] FROM w UNION ALL SELECT doc_id, text, 'none', 'zzzzq' FROM w),
t AS (SELECT doc_id, text, kind, trim(raw) AS raw, list_sort(list_transform(list_filter(string_split(trim(raw), ' '), lambda t: length(t) >= 2), lambda t, i: {'n': -length(t), 'i': i, 't': t})) AS ranked FROM v),
h AS (SELECT doc_id, text, kind, list_filter(list_concat([raw], list_transform(ranked, lambda s: s.t), [replace(raw, ' ', '')]), lambda c: c <> '' AND contains(lower(text), lower(c)))[1] AS hit FROM t)
SELECT doc_id, kind, lower(hit) AS quote, (strpos(lower(text), lower(hit)) - 1)::INT AS start FROM h""")
def grounding_all(spark: SparkSession, d: str) -> DataFrame:
    """Every document with a value that its first words support, one of which only a part stands in it, and one foreign to it."""
    ws = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    first = table(spark, d, "documents").select("doc_id", "text", F.trim(F.array_join(F.slice(ws, 1, 2), " ")).alias("whole"), F.concat(F.lit("qqqqqqqqqqqq "), F.get(ws, F.lit(0))).alias("part"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), raw.alias("raw")) for k, raw in (("whole", F.col("whole")), ("part", F.col("part")), ("none", F.lit("zzzzq")))])
    each = first.select("doc_id", "text", F.explode(kinds).alias("v")).withColumn("g", ground(F.col("v.raw"), F.col("text")))
    return each.select("doc_id", "v.kind", F.lower("g.quote").alias("quote"), "g.start")


@query("""WITH p AS (SELECT p_partkey AS sku, 'brand' AS attribute, p_brand AS raw, 'rules' AS proposer FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'type', p_type, 'rules' FROM part WHERE p_partkey % 2 = 0),
s AS (SELECT p_partkey AS sku, 'brand' AS attribute, p_name AS raw, 'model' AS proposer FROM part UNION ALL SELECT p_partkey, 'type', p_name, 'model' FROM part)
SELECT * FROM p UNION ALL SELECT s.* FROM s ANTI JOIN p USING (sku, attribute)""")
def cascade_merge(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    values = lambda df, a, c, who: df.select(F.col("p_partkey").alias("sku"), F.lit(a).alias("attribute"), F.col(c).alias("raw"), F.lit(who).alias("proposer"))
    primary = values(p.filter("p_partkey % 3 = 0"), "brand", "p_brand", "rules").unionByName(values(p.filter("p_partkey % 2 = 0"), "type", "p_type", "rules"))
    return merge_values(primary, values(p, "brand", "p_name", "model").unionByName(values(p, "type", "p_name", "model")))


@query("""WITH a AS (SELECT page_id AS doc_id, url AS source, 'page' AS kind FROM pages), b AS (SELECT doc_id, source, 'document' AS kind FROM documents)
SELECT * FROM a UNION ALL SELECT b.* FROM b ANTI JOIN a USING (doc_id)""")
def evidence_dedup(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("url").alias("source"), F.lit("page").alias("kind"))
    return merge_evidence(a, table(spark, d, "documents").select("doc_id", "source", F.lit("document").alias("kind")))


@query("""SELECT l_partkey AS sku, p_type AS expected, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_returned FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size % 3 <> 0 GROUP BY ALL""")
def answer_key_join(spark: SparkSession, d: str) -> DataFrame:
    key = table(spark, d, "part").filter("p_size % 3 <> 0").select(F.col("p_partkey").alias("sku"), F.col("p_type").alias("expected"))
    li = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("sku")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_returned"))
    return li.join(key, "sku").select("sku", "expected", "n", "n_returned")


@query(f"WITH {QUANTITIES} SELECT sku, CASE WHEN raw = gold THEN true WHEN magnitude IS NULL OR unit IS NULL OR unit = 'kilogram' THEN false ELSE abs(CASE unit WHEN 'inch' THEN magnitude * 25.4 ELSE magnitude END - p_size) / p_size < 1e-3 END AS agrees FROM q")
def agreement(spark: SparkSession, d: str) -> DataFrame:
    return values_agree(quantities(spark, d).withColumn("kind", F.lit("quantity")), "raw", "gold").select("sku", "agrees")


@query("SELECT o_orderkey AS id, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::BIGINT AS ordinal, ((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) % 3)::BIGINT AS split FROM orders")
def split_positions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderdate")
    return three_way_split(o, ["o_orderdate", "id"]).select("id", F.col("ordinal").cast("long").alias("ordinal"), F.col("split").cast("long").alias("split"))


# ---- scores ----------------------------------------------------------------------------------------


def signals(spark: SparkSession, d: str) -> DataFrame:
    """Dimensional and constraint signals of each part's size, and one that mostly abstains."""
    con = verify_constraints(siblings(spark, d), SIZES).filter("attribute = 'outer'").select("sku", "constraint")
    df = judged_sizes(spark, d).join(con, "sku")
    some = F.struct(F.when(F.col("sku") % 4 == 0, 0.8).otherwise(0.0).alias("trust"), (F.col("sku") % 4 == 0).alias("applicable"), F.lit("").alias("detail"))
    return df.withColumn("zother", some)


SIGNALS = f"""{QUANTITIES}, {SIBLINGS}, g AS (SELECT q.sku, {DIMENSIONAL}::DOUBLE AS td, v.trust::DOUBLE AS tc, CASE WHEN q.sku % 4 = 0 THEN 0.8 END AS tz FROM q JOIN v ON v.sku = q.sku AND v.attribute = 'outer')"""


@query(f"WITH {SIGNALS} SELECT sku, round(CASE WHEN least(td, tc) = 0 THEN 1 ELSE 1 - least(td, tc, coalesce(tz, 1)) END, 6)::DOUBLE AS score, least(td, tc) = 0 AS hard FROM g")
def heuristic(spark: SparkSession, d: str) -> DataFrame:
    every = F.array("constraint", "dimensional", "zother")
    return signals(spark, d).select("sku", r6(heuristic_score(every)).alias("score"), any_hard(every).alias("hard"))


@query(f"""WITH {SIGNALS} SELECT sku, tc AS f0, 1.0::DOUBLE AS f1, td AS f2, 1.0::DOUBLE AS f3, coalesce(tz, 0)::DOUBLE AS f4, (CASE WHEN tz IS NULL THEN 0 ELSE 1 END)::DOUBLE AS f5,
  least(tc, td, coalesce(tz, 1))::DOUBLE AS f6, round(CASE WHEN tz IS NULL THEN (tc + td) / 2 ELSE (tc + td + tz) / 3 END, 6)::DOUBLE AS f7, round(CASE WHEN tz IS NULL THEN 2 / 3.0 ELSE 1 END, 6)::DOUBLE AS f8 FROM g""")
def feature_vector(spark: SparkSession, d: str) -> DataFrame:
    f = features([F.col("constraint"), F.col("dimensional"), F.col("zother")])
    return signals(spark, d).withColumn("f", f).select("sku", *[r6(F.get("f", F.lit(k))).alias(f"f{k}") for k in range(9)])


@query()
def learned_score(spark: SparkSession, d: str) -> DataFrame:
    df = signals(spark, d).withColumn("is_error", F.col("sku") % 7 < F.when(F.col("dimensional.trust") < 1, 4).otherwise(1))
    scorer = fit_scorer(df, ["dimensional", "constraint", "zother"])
    return df.select("sku", r6(scorer.score()).alias("score"))


@query("""WITH x AS (SELECT (quality = 0) AS e, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id)), r AS (SELECT e, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS k FROM x)
SELECT round((sum(k) FILTER (e) - count(*) FILTER (e) * (count(*) FILTER (e) + 1) / 2.0) / (count(*) FILTER (e) * count(*) FILTER (NOT e)), 6) AS auroc FROM r""")
def auroc_quality(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return auroc(x.select(F.col("n_chars").cast("double").alias("s"), (F.col("quality") == 0).alias("e")), "s", "e").select(r6(F.col("auroc")).alias("auroc"))


# ---- certification ---------------------------------------------------------------------------------


@query(f"WITH {CALIBRATION} SELECT score, (sum(count(*)) OVER (ORDER BY score))::BIGINT AS cum_n, (sum(count(*) FILTER (is_error)) OVER (ORDER BY score))::BIGINT AS cum_errors FROM cal GROUP BY score")
def calibration_prefix(spark: SparkSession, d: str) -> DataFrame:
    return prefix_counts(calibration(spark, d), "score", "is_error").select("score", F.col("cum_n").cast("long").alias("cum_n"), F.col("cum_errors").cast("long").alias("cum_errors"))


@query("SELECT a AS alpha, ceil(ln(0.05) / ln(1 - a))::BIGINT AS n FROM (SELECT unnest([0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15])::DOUBLE AS a)")
def sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(a,) for a in DIAL_STOPS], "alpha double").select("alpha", required_sample_size(F.col("alpha"), F.lit(0.05)).alias("n"))


#: Bisection on the binomial CDF in log space; macros are not available to a single statement.
BOUND = """b AS (SELECT *, e::DOUBLE / n AS lo, 1.0::DOUBLE AS hi, 0 AS it FROM pts WHERE e < n
  UNION ALL SELECT * EXCLUDE (lo, hi, it, cdf), CASE WHEN cdf > 0.05 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN cdf > 0.05 THEN hi ELSE (lo + hi) / 2 END, it + 1
  FROM (SELECT *, list_sum(list_transform(range(0, e + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln((lo + hi) / 2) + (n - k) * ln(1 - (lo + hi) / 2)))) AS cdf FROM b WHERE it < 45))"""


@query(f"WITH RECURSIVE pts AS (SELECT event_type, count(*) FILTER (user_id % 40 = 0) AS e, count(*) AS n FROM events GROUP BY 1), {BOUND} SELECT event_type, round((lo + hi) / 2, 6) AS upper FROM b WHERE it = 45")
def clopper_pearson(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("user_id") % 40 == 0).alias("e"), F.count("*").alias("n"))
    return g.select("event_type", r6(clopper_pearson_upper(F.col("e").cast("double"), F.col("n").cast("double"), F.lit(0.05))).alias("upper"))


#: The fixed sequence in SQL: quantile points, exact bound by its dual (CDF at alpha), first failure.
THRESHOLDS = f"""{CALIBRATION}, al AS (SELECT unnest([0.005, 0.01, 0.02, 0.03, 0.05, 0.07, 0.10, 0.15])::DOUBLE AS alpha),
h AS (SELECT score, count(*) AS c, count(*) FILTER (is_error) AS er FROM cal WHERE split = 1 GROUP BY 1),
pre AS (SELECT score, c, (sum(c) OVER (ORDER BY score))::BIGINT AS n, (sum(er) OVER (ORDER BY score))::BIGINT AS e FROM h),
tot AS (SELECT sum(c)::BIGINT AS total FROM h),
st AS (SELECT alpha, total, greatest(30, ceil(ln(0.05) / ln(1 - alpha)))::BIGINT AS least_n FROM al, tot),
pt AS (SELECT alpha, total, least_n, i, ceil((CASE WHEN i = 49 THEN 1.0 ELSE least_n::DOUBLE / total + i * ((1 - least_n::DOUBLE / total) / 49) END) * (total - 1)) AS pos FROM st, (SELECT unnest(range(50)) AS i) WHERE least_n <= total),
tried AS (SELECT alpha, total, i, score, n, e, list_sum(list_transform(range(0, e + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(alpha) + (n - k) * ln(1 - alpha)))) > 0.05 AS fails
  FROM pt JOIN pre ON pos >= n - c AND pos < n WHERE n >= least_n),
stop AS (SELECT alpha, min(i) AS stop FROM tried WHERE fails GROUP BY 1),
best AS (SELECT alpha, max_by(score, i) AS threshold, max_by(n, i) AS n_accepted, max_by(e, i) AS n_errors FROM tried LEFT JOIN stop USING (alpha) WHERE stop IS NULL OR i < stop GROUP BY 1),
th AS (SELECT alpha, total, best.threshold IS NOT NULL AS feasible, coalesce(best.threshold, '-Infinity'::DOUBLE) AS threshold, n_accepted, n_errors FROM st LEFT JOIN best USING (alpha))"""


@query(f"WITH {THRESHOLDS} SELECT alpha, feasible, CASE WHEN feasible THEN threshold END AS threshold, total AS n_calibration, n_accepted, round(n_errors::DOUBLE / n_accepted, 6) AS empirical_error, round(n_accepted::DOUBLE / total, 6) AS coverage FROM th")
def select_threshold(spark: SparkSession, d: str) -> DataFrame:
    t = select_thresholds(calibration(spark, d).filter("split = 1"), DIAL_STOPS)
    return t.select("alpha", "feasible", F.when(F.col("feasible"), F.col("threshold")).alias("threshold"), F.col("n_calibration").cast("long").alias("n_calibration"), F.col("n_accepted").cast("long").alias("n_accepted"), r6(F.col("empirical_error")).alias("empirical_error"), r6(F.col("coverage")).alias("coverage"))


@query(f"WITH {CALIBRATION} SELECT CASE WHEN l_partkey % 97 = 0 THEN 'reject' WHEN score <= 0.45 THEN 'auto_publish' ELSE 'review' END AS decision, count(*) AS n, count(*) FILTER (is_error) AS errors FROM cal GROUP BY 1")
def apply_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = with_hard(calibration(spark, d)).withColumn("decision", decision(F.col("hard"), F.col("score"), F.lit(0.45)))
    return df.groupBy("decision").agg(F.count("*").alias("n"), F.count_if("is_error").alias("errors"))


CURVE = f"""{THRESHOLDS}, te AS (SELECT alpha, count(*) FILTER (l_partkey % 97 <> 0 AND score <= threshold) AS pub, count(*) FILTER (l_partkey % 97 = 0) AS rej, count(*) AS n_total,
  count(*) FILTER (l_partkey % 97 <> 0 AND score <= threshold AND is_error) AS wrong, count(*) FILTER (is_error) AS bad FROM th, cal WHERE split = 2 GROUP BY 1)"""


def dial(spark: SparkSession, d: str) -> DataFrame:
    c = with_hard(calibration(spark, d))
    return risk_coverage(c.filter("split = 1"), c.filter("split = 2"))


@query(f"WITH {CURVE} SELECT alpha, feasible, pub AS n_auto_published, n_total - pub AS n_review, n_total, round(pub::DOUBLE / n_total, 6) AS automation_rate, round(coalesce(wrong::DOUBLE / nullif(pub, 0), 0), 6) AS realized_error, round(bad::DOUBLE / n_total, 6) AS baseline_error FROM th JOIN te USING (alpha)")
def risk_coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("n_auto_published", "n_review", "n_total")]
    return dial(spark, d).select("alpha", "feasible", *counts, *[r6(F.col(c)).alias(c) for c in ("automation_rate", "realized_error", "baseline_error")])


@query(f"WITH {CALIBRATION} SELECT l_linenumber, round(coalesce(avg(CASE WHEN score <= 0.45 THEN is_error::INT END), 0), 6) AS realised, round(avg(is_error::INT), 6) AS baseline FROM cal GROUP BY 1")
def realised(spark: SparkSession, d: str) -> DataFrame:
    g = calibration(spark, d).groupBy("l_linenumber")
    return g.agg(r6(realised_error(F.col("score") <= 0.45, F.col("is_error"))).alias("realised"), r6(F.avg(F.col("is_error").cast("double"))).alias("baseline"))


@query(f"""WITH RECURSIVE {CURVE}, pts AS (SELECT alpha, n_errors AS e, n_accepted AS n FROM th WHERE feasible), {BOUND}
SELECT alpha, th.threshold, total AS n_calibration, n_total, pub AS n_auto_published, n_total - pub AS n_review, rej AS n_rejected, round((lo + hi) / 2, 6) AS error_upper_bound, round(coalesce(wrong::DOUBLE / nullif(pub, 0), 0), 6) AS realized_error, 'calibration and published values are exchangeable' AS assumption
FROM th JOIN te USING (alpha) JOIN b USING (alpha) WHERE it = 45""")
def certificates(spark: SparkSession, d: str) -> DataFrame:
    counts = [F.col(c).cast("long").alias(c) for c in ("n_calibration", "n_total", "n_auto_published", "n_review", "n_rejected")]
    return certificate(dial(spark, d)).select("alpha", "threshold", *counts, r6(F.col("error_upper_bound")).alias("error_upper_bound"), r6(F.col("realized_error")).alias("realized_error"), "assumption")


@query(f"WITH {CALIBRATION} SELECT l_orderkey, l_partkey, l_linenumber, CASE WHEN score = 0 THEN 1.0 ELSE score END::DOUBLE AS effective FROM cal WHERE split = 2 AND CASE WHEN score = 0 THEN 1.0 ELSE score END > 0.45 ORDER BY effective DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity LIMIT 25")
def review_top(spark: SparkSession, d: str) -> DataFrame:
    df = calibration(spark, d).filter("split = 2").withColumn("ordinal", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return review_queue(df, 0.45).select("l_orderkey", "l_partkey", "l_linenumber", F.when(F.col("score") == 0, 1.0).otherwise(F.col("score")).alias("effective"))


# ---- generation and feeds --------------------------------------------------------------------------


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS sku, [p_name, p_type, p_brand, p_size || ' MM', 'Q' || p_partkey % 7] AS ws FROM part),
f AS (SELECT sku, ws, 1 AS i, '' AS d FROM t UNION ALL
  SELECT sku, ws, i + 1, CASE WHEN length(d) + length(ws[i]) + CASE WHEN d = '' THEN 0 ELSE 1 END <= 30 THEN CASE WHEN d = '' THEN ws[i] ELSE d || ' ' || ws[i] END ELSE d END FROM f WHERE i <= 5)
SELECT sku, upper(d) AS description FROM f WHERE i = 6""")
def assemble_description(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    tokens = F.array(token(c("p_name"), "name"), token(c("p_type"), "type"), token(c("p_brand"), "brand"), token(F.concat(text("p_size"), F.lit(" MM")), "size"), token(F.concat(F.lit("Q"), text(c("p_partkey") % 7)), "code"))
    return table(spark, d, "part").select(c("p_partkey").alias("sku"), assemble(tokens, 30)["description"].alias("description"))


def faulty(spark: SparkSession, d: str) -> DataFrame:
    return inject_faults(siblings(spark, d).withColumn("vocabulary", F.lit(None).cast("array<string>")), 0.12)


@query()
def fault_injection(spark: SparkSession, d: str) -> DataFrame:
    return faulty(spark, d).filter("fault IS NOT NULL").select("sku", "attribute", "fault", "original", F.col("raw").alias("corrupted"))


@query()
def fault_shares(spark: SparkSession, d: str) -> DataFrame:
    return fault_mix(faulty(spark, d)).select("fault", "n", r6(F.col("share")).alias("share"))


@query(f"WITH {SIBLINGS}, x AS (SELECT sku, 'inner' AS a FROM s UNION ALL SELECT sku, 'outer' FROM s UNION ALL SELECT sku, 'width' FROM s WHERE w IS NOT NULL) SELECT x.sku, x.a AS attribute, string_agg(y.a, ',' ORDER BY y.a) AS partners FROM x JOIN x y ON x.sku = y.sku AND x.a <> y.a GROUP BY ALL")
def attribute_swap_siblings(spark: SparkSession, d: str) -> DataFrame:
    v = siblings(spark, d).select("sku", "attribute", "kind")
    lists = v.groupBy("sku").agg(F.collect_list(F.struct("attribute", "kind")).alias("all"))
    own = F.filter("all", lambda s: (s["attribute"] != F.col("attribute")) & (s["kind"] == F.col("kind")))
    return v.join(lists, "sku").select("sku", "attribute", F.array_join(F.array_sort(F.transform(own, lambda s: s["attribute"])), ",").alias("partners"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS name, (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM events WHERE event_id % 3 <> 0""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"v'), text("event_id"), F.lit('"'))).otherwise(text("event_id"))
    payload = F.when(F.col("event_id") % 3 == 0, "{broken").otherwise(F.concat(F.lit('{"name": '), name, F.lit(', "other": 1, "props": '), F.col("props"), F.lit("}")))
    m = table(spark, d, "events").select("event_id", string_properties(payload, ["name", "other", "props"]).alias("m")).filter("m IS NOT NULL")
    return m.select("event_id", F.try_element_at("m", F.lit("name")).alias("name"), F.size("m").cast("long").alias("n"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    feature = lambda n, v: f'{{"Feature": {{"Name": {{"Value": "{n}"}}}}, "PresentationValue": "{v}", "RawValue": "{v}"}}'
    body = '{"data": {"FeaturesGroups": [{"FeatureGroup": {"Name": {"Value": "Size"}}, "Features": [' + feature("Width", "%s mm") + ", " + feature("", "x") + ", " + feature("Sealed", "Yes") + ']}, {"FeatureGroup": {"Name": {"Value": " Logistics Data "}}, "Features": [' + feature("Weight", "9 kg") + ']}, {"FeatureGroup": {"Name": {"Value": "Type"}}, "Features": [' + feature("Kind", "%s") + "]}]}}"
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.format_string(body, text("p_size"), text("p_size"), F.col("p_type"), F.col("p_type")).alias("payload"))


@query("""SELECT p_partkey AS sku, 'Size' AS feature_group, 'Width' AS name, p_size || ' mm' AS presentation, true AS usable FROM part UNION ALL SELECT p_partkey, 'Size', 'Sealed', 'Yes', false FROM part UNION ALL SELECT p_partkey, 'Type', 'Kind', p_type, true FROM part""")
def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    return feature_rows(payloads(spark, d), "sku").select("sku", "feature_group", "name", "presentation", "usable")


@query("SELECT p_partkey AS sku, p_size || ' mm' AS width, p_type AS kind, 2::BIGINT AS n FROM part")
def feature_answers(spark: SparkSession, d: str) -> DataFrame:
    a = feature_key(feature_rows(payloads(spark, d), "sku"), "sku")
    return a.select("sku", F.element_at("answers", "Width").alias("width"), F.element_at("answers", "Kind").alias("kind"), F.size("answers").cast("long").alias("n"))


@query("SELECT p_partkey AS sku, substr(sha256(p_name || '|' || p_brand || '|' || p_type), 1, 16) AS fingerprint FROM part")
def row_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("sku"), F.substring(F.sha2(F.concat_ws("|", "p_name", "p_brand", "p_type"), 256), 1, 16).alias("fingerprint"))


@query()
def schema_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(c.category_id, fingerprint(c)) for c in shipped().values()], "category_id string, fingerprint string")


@query()
def synthetic_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Rule extraction over the synthetic catalog: values found a category and attribute."""
    return extract_rules(generate_catalog(spark, 500)).groupBy("category_id", "attribute").agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT p_partkey % 6 AS form, concat('BALL VLV ', p_name, ' ', p_type) AS d, json_object('body_material', split_part(p_name, ' ', 1), 'seat_material', p_brand, 'bore', p_size, 'nope', 'x')::VARCHAR AS good FROM part),
a AS (SELECT form, d, coalesce(nullif(trim(CASE form WHEN 0 THEN good WHEN 1 THEN ' ' WHEN 2 THEN '' WHEN 3 THEN 'no json' WHEN 4 THEN '[1]' END), ''), nullif(trim(CASE form WHEN 1 THEN good WHEN 2 THEN ' ' END), '')) AS payload FROM g),
o AS (SELECT form, d, payload, CASE WHEN json_valid(payload) AND json_type(payload) = 'OBJECT' THEN payload END AS object FROM a),
v AS (SELECT form, payload, object, list_filter([CASE WHEN json_type(object, '$.body_material') = 'VARCHAR' THEN object ->> '$.body_material' END, CASE WHEN json_type(object, '$.seat_material') = 'VARCHAR' THEN object ->> '$.seat_material' END, CASE WHEN json_type(object, '$.bore') = 'VARCHAR' THEN object ->> '$.bore' END], lambda x: x IS NOT NULL) AS said, lower(d) AS low FROM o)
SELECT form, count(*) AS calls, count(*) FILTER (form = 5) AS failures, count(*) FILTER (form <> 5 AND payload IS NULL) AS empty_responses, count(*) FILTER (payload IS NOT NULL AND object IS NULL) AS parse_failures,
sum(len(said))::BIGINT AS values_proposed, sum(len(list_filter(said, lambda x: NOT contains(low, lower(x)))))::BIGINT AS values_ungrounded, sum(0.25)::DOUBLE AS seconds FROM v GROUP BY form""")
def model_counters(spark: SparkSession, d: str) -> DataFrame:
    """Answers of six forms, one a part in turn, read and counted."""
    good = F.to_json(F.struct(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("body_material"), F.col("p_brand").alias("seat_material"), F.col("p_size").alias("bore"), F.lit("x").alias("nope")))
    form = F.col("p_partkey") % 6
    content = F.when(form == 0, good).when(form == 1, " ").when(form == 2, "").when(form == 3, "no json").when(form == 4, "[1]")
    thinking = F.when(form == 1, good).when(form == 2, " ")
    answers = table(spark, d, "part").select(text("p_partkey").alias("sku"), F.lit("valve.ball").alias("category_id"), F.concat(F.lit("BALL VLV "), "p_name", F.lit(" "), "p_type").alias("description"), content.alias("content"), thinking.alias("thinking"), (form == 5).alias("failed"), F.lit(0.25).alias("seconds"), form.alias("form"))
    return answer_counts(read_answers(answers), "form")
