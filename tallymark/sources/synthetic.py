"""A synthetic catalog with an answer key, drawn by hashes so that every row is made on its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.quantities import format_g
from tallymark.sources.catalog import BEARINGS, BODIES, ENDS, FINISHES, GRADES, LENGTHS, SEALS, SEATS, THREADS, VALVE_SIZES

SEED, FIELD_WIDTH = 20260820, 40


def draw(seed: int, salt: str, n: int, key: str = "sku") -> Column:
    """A whole number below n, fixed by seed, row and salt."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key), F.lit(salt)), F.lit(n)).cast("int")


def coin(seed: int, salt: str, share: float, key: str = "sku") -> Column:
    return draw(seed, salt, 1_000_000, key) < int(share * 1_000_000)


def pick(rows: list[tuple], seed: int, salt: str) -> Column:
    """One of the rows, as a struct with fields c0, c1, ..."""
    return F.get(F.array(*[F.struct(*[F.lit(float(x) if isinstance(x, int | float) else x).alias(f"c{k}") for k, x in enumerate(r)]) for r in rows]), draw(seed, salt, len(rows)))


def assemble(tokens: Column, width: int = FIELD_WIDTH) -> Column:
    """Tokens array<struct<text, attributes>> fitted into a field: what does not fit is skipped, later tokens may still fit.

    Gives struct<description, survived>; the description is in upper case.
    """
    start = F.expr("named_struct('parts', cast(array() as array<string>), 'used', 0, 'survived', cast(array() as array<string>))")

    def step(acc: Column, token: Column) -> Column:
        text = F.trim(token["text"])
        cost = F.length(text) + F.when(F.size(acc["parts"]) > 0, 1).otherwise(0)
        fits = (text != "") & (acc["used"] + cost <= width)
        taken = F.struct(F.concat(acc["parts"], F.array(text)).alias("parts"), (acc["used"] + cost).alias("used"), F.array_union(acc["survived"], token["attributes"]).alias("survived"))
        return F.when(fits, taken).otherwise(acc)

    return F.aggregate(tokens, start, step, lambda acc: F.struct(F.upper(F.array_join(acc["parts"], " ")).alias("description"), acc["survived"].alias("survived")))


def token(text: Column | str, *attributes: str) -> Column:
    return F.struct((text if isinstance(text, Column) else F.lit(text)).alias("text"), (F.array(*map(F.lit, attributes)) if attributes else F.expr("cast(array() as array<string>)")).alias("attributes"))


def truth(**entries: Column) -> Column:
    return F.map_filter(F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull() & (v != ""))


def _bearing(seed: int) -> tuple[Column, Column]:
    b = pick([(k, *v) for k, v in BEARINGS.items()], seed, "spec")
    s = pick(list(SEALS.items()), seed, "seal")
    clearance = F.get(F.array(*map(F.lit, ("", "C3", "C4"))), draw(seed, "clearance", 3))
    g = lambda k, unit: F.concat(format_g(b[f"c{k}"]), F.lit(unit))
    tokens = F.array(
        token("BRG BALL"), token(F.concat(b["c0"], s["c0"]), "bore_diameter", "outside_diameter", "width", "seal_type"), token(clearance, "internal_clearance"),
        token(g(1, "MM BORE"), "bore_diameter"), token(g(2, "MM OD"), "outside_diameter"), token(g(3, "MM W"), "width"),
    )
    return tokens, truth(bore_diameter=g(1, " mm"), outside_diameter=g(2, " mm"), width=g(3, " mm"), seal_type=s["c1"], dynamic_load_rating=g(4, " N"), static_load_rating=g(5, " N"), internal_clearance=clearance)


def _screw(seed: int) -> tuple[Column, Column]:
    t = pick([(k, *v) for k, v in THREADS.items()], seed, "thread")
    length = F.get(F.array(*[F.lit(float(x)) for x in LENGTHS]), draw(seed, "length", len(LENGTHS)))
    grade, finish = pick([(k, *v) for k, v in GRADES.items()], seed, "grade"), pick(list(FINISHES.items()), seed, "finish")
    inch = lambda x: F.concat(format_g(x), F.lit('"'))
    tokens = F.array(
        token("HX CAP SCR"), token(F.concat(t["c0"], F.lit("X"), format_g(length)), "nominal_diameter", "threads_per_inch", "length"),
        token(grade["c0"], "grade", "material"), token(finish["c0"], "finish"),
    )
    thread_length = F.least(length, 2 * t["c1"] + 0.25)
    return tokens, truth(
        nominal_diameter=inch(t["c1"]), threads_per_inch=F.concat(format_g(t["c2"]), F.lit(" /in")), length=inch(length), thread_length=inch(thread_length), width_across_flats=inch(t["c3"]), head_height=inch(t["c4"]),
        grade=grade["c1"], material=grade["c3"], finish=finish["c1"], tensile_strength=F.concat(format_g(grade["c2"]), F.lit(" psi")), drive_type=F.lit("external hex"),
    )


def _valve(seed: int) -> tuple[Column, Column]:
    v = pick([(k, *x) for k, x in VALVE_SIZES.items()], seed, "size")
    body, seat, end = pick([(k, *x) for k, x in BODIES.items()], seed, "body"), pick([(k, *x) for k, x in SEATS.items()], seed, "seat"), pick(list(ENDS.items()), seed, "end")
    full = coin(seed, "port", 0.6)
    inch = lambda x: F.concat(format_g(x), F.lit('"'))
    rating = F.concat(format_g(body["c2"]), F.lit(" WOG"))
    tokens = F.array(
        token(v["c0"], "nominal_size"), token("BALL VLV"), token(body["c0"], "body_material"), token(rating, "pressure_rating"),
        token(end["c0"], "end_connection"), token(F.when(full, "FP").otherwise("RP"), "port_type"), token(seat["c0"], "seat_material"),
    )
    return tokens, truth(
        nominal_size=F.concat(v["c0"], F.lit('"')), bore=inch(F.when(full, v["c2"]).otherwise(v["c3"])), body_diameter=inch(v["c4"]), end_to_end=inch(v["c5"]), pressure_rating=rating,
        temperature_range=F.concat(format_g(seat["c2"]), F.lit(" to "), format_g(seat["c3"]), F.lit(" F")), body_material=body["c1"], seat_material=seat["c1"], end_connection=end["c1"],
        port_type=F.when(full, "full port").otherwise("reduced port"),
    )


MAKERS = {"bearing.ball": ("BRG", _bearing), "fastener.hex_cap_screw": ("HCS", _screw), "valve.ball": ("BV", _valve)}


def generate_catalog(spark: SparkSession, n_per_category: int, seed: int = SEED) -> DataFrame:
    """Products with their answer key: sku, category_id, rec_ord, description, truth map, recoverable attributes."""
    if n_per_category < 1:
        raise ValueError("n_per_category must be at least 1")
    out = None
    for k, (category, (prefix, maker)) in enumerate(sorted(MAKERS.items())):
        tokens, answers = maker(seed)
        rows = spark.range(n_per_category).select(F.lit(category).alias("category_id"), (F.col("id") + k * n_per_category).alias("rec_ord"), F.format_string(f"{prefix}-%05d", F.col("id")).alias("sku"))
        made = rows.withColumn("truth", answers).withColumn("made", assemble(tokens))
        bare = F.when(coin(seed, "space", 0.5), F.regexp_replace("made.description", " (WOG|PSI)", "$1")).otherwise(F.col("made.description"))
        recoverable = F.array_intersect(F.col("made.survived"), F.map_keys("truth"))
        derived = F.when(F.size(F.array_except(F.array(F.lit("nominal_size"), F.lit("port_type")), recoverable)) == 0, F.array_union(recoverable, F.array(F.lit("bore")))).otherwise(recoverable)
        own = made.select("category_id", "rec_ord", "sku", bare.alias("description"), "truth", (derived if category == "valve.ball" else recoverable).alias("recoverable"))
        out = own if out is None else out.unionByName(own)
    return out


def answer_key(gold: DataFrame) -> DataFrame:
    """(sku, attribute, expected) of what the description can support."""
    return gold.select("sku", F.explode(F.map_filter("truth", lambda k, _: F.array_contains("recoverable", k))).alias("attribute", "expected"))
