"""Extraction by a language model: requests, answers, what of them is kept, and counts of what went wrong.

Only the call itself runs in Python, on Arrow batches. Requests are built and answers are read, checked
against the schema and grounded by column expressions, so an answer table made elsewhere can be read alike.

Defined cases: a call that raises gives an answer with ``failed``, nothing else; blank answers count as empty;
answers that are not one JSON object (repeated keys included) count as parse failures; attributes outside the
schema and values that are no strings are left out and not counted; blank and unsupported values count as ungrounded.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark.functions.quantities import literal_map
from tallymark.operators.extract import ground
from tallymark.sources.catalog import Category, shipped

#: (prompt, format, options) -> the message of the answer, with ``content`` and ``thinking``.
Client = Callable[[str, dict, dict], Mapping[str, str | None]]
#: Options of a pass that is to repeat, and the temperature of passes that are to vary.
FIXED, VARIED = {"temperature": 0.0}, 0.7
ANSWER = "sku string, category_id string, description string, content string, thinking string, failed boolean, seconds double"


def answer_format(category: Category) -> dict:
    """JSON schema of an answer: every attribute may be there, as a string, and none has to."""
    return {"type": "object", "properties": {a.name: {"type": "string"} for a in category.attributes}, "required": []}


def prompt(category: Category, description: Column) -> Column:
    """What the model is asked about one description."""
    head = f"Read attribute values of a product ({category.name or category.category_id}) from its description. Do not guess: leave out what the description does not state.\nAttributes: {', '.join(a.name for a in category.attributes)}\nDescription: "
    return F.concat(F.lit(head), F.coalesce(description, F.lit("")))


def requests(products: DataFrame, categories: dict[str, Category] | None = None) -> DataFrame:
    """(sku, category_id, description, prompt, format); products of unknown categories are not asked about."""
    known = categories or shipped()
    formats = literal_map({k: json.dumps(answer_format(c)) for k, c in known.items()})
    asked = F.coalesce(*[F.when(F.col("category_id") == k, prompt(c, F.col("description"))) for k, c in known.items()])
    own = products.filter(F.col("category_id").isin(*known)).select("sku", "category_id", "description")
    return own.withColumns({"prompt": asked, "format": F.try_element_at(formats, F.col("category_id"))})


def ask(asked: DataFrame, client: Client, options: dict | None = None) -> DataFrame:
    """One call a request. A call that raises is an answer too, so that it can be counted."""
    settings = {**FIXED, **(options or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                began, message, failed = time.monotonic(), {}, False
                try:
                    message = client(r.prompt, json.loads(r.format), settings)
                except Exception:  # noqa: BLE001  whatever a client raises must not stop the batch
                    failed = True
                rows.append((r.sku, r.category_id, r.description, message.get("content"), message.get("thinking"), failed, time.monotonic() - began))
            yield pd.DataFrame(rows, columns=["sku", "category_id", "description", "content", "thinking", "failed", "seconds"])

    return asked.mapInPandas(run, ANSWER)


def payload(content: Column, thinking: Column) -> Column:
    """The text of an answer: its content, or else its thinking, trimmed; NULL if both are blank."""
    trimmed = [F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit("")) for c in (content, thinking)]
    return F.coalesce(*trimmed)


def read_answers(answers: DataFrame, categories: dict[str, Category] | None = None) -> DataFrame:
    """``answers`` with ``payload``, ``parsed`` (is it an object) and ``proposed``: (attribute, raw, g) in the order
    of the answer, for declared attributes with string values; g is the place in the description, NULL if none."""
    declared = literal_map_of_lists({k: [a.name for a in c.attributes] for k, c in (categories or shipped()).items()})
    told = answers.withColumn("payload", payload(F.col("content"), F.col("thinking")))
    told = told.withColumn("__v", F.try_parse_json("payload"))
    told = told.withColumn("parsed", F.coalesce(F.startswith(F.schema_of_variant("__v"), F.lit("OBJECT")), F.lit(False)))
    told = told.withColumn("__m", F.when(F.col("parsed"), F.col("__v").cast("map<string, variant>")))
    names = F.array_intersect(F.json_object_keys("payload"), F.try_element_at(declared, F.col("category_id")))
    strings = F.filter(F.when(F.col("parsed"), names), lambda k: F.schema_of_variant(F.try_element_at("__m", k)) == "STRING")
    values = F.transform(strings, lambda k: F.struct(k.alias("attribute"), F.regexp_replace(F.try_element_at("__m", k).cast("string"), r"^\s+|\s+$", "").alias("raw")))
    told = told.withColumn("__said", F.coalesce(values, F.expr("cast(array() as array<struct<attribute: string, raw: string>>)")))
    placed = F.transform("__said", lambda s: F.struct(s["attribute"].alias("attribute"), s["raw"].alias("raw"), ground(s["raw"], F.col("description")).alias("g")))
    return told.withColumn("proposed", placed).drop("__v", "__m", "__said")


def literal_map_of_lists(entries: dict[str, list[str]]) -> Column:
    return F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])


def model_values(read: DataFrame, proposer: str = "model") -> DataFrame:
    """The grounded values of answers that were read, as long rows."""
    rows = read.select("sku", "category_id", F.posexplode("proposed").alias("val_ord", "v")).filter("v.g IS NOT NULL")
    return rows.select("sku", "category_id", "val_ord", "v.attribute", "v.raw", "v.g.quote", "v.g.start", F.lit(proposer).alias("proposer"))


def answer_counts(read: DataFrame, *by: str) -> DataFrame:
    """What became of the calls: one row, or one a group."""
    ungrounded = F.size(F.filter("proposed", lambda p: p["g"].isNull()))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).cast("long")
    return read.groupBy(*by).agg(
        F.count("*").alias("calls"),
        count(F.col("failed")).alias("failures"),
        count(~F.col("failed") & F.col("payload").isNull()).alias("empty_responses"),
        count(F.col("payload").isNotNull() & ~F.col("parsed")).alias("parse_failures"),
        count(F.size("proposed")).alias("values_proposed"),
        count(ungrounded).alias("values_ungrounded"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )


def counts_summary() -> Column:
    """One line about a row of ``answer_counts``."""
    kept = F.col("values_proposed") - F.col("values_ungrounded")
    return F.format_string("%d calls in %.1fs, %d of %d values grounded, %d empty, %d unparseable", "calls", "seconds", kept, "values_proposed", "empty_responses", "parse_failures")


def evidence(description: Column) -> Column:
    """The description as the one evidence document of a record."""
    return F.array(F.struct(F.lit("erp").alias("doc_id"), F.lit("erp_record").alias("kind"), description.alias("text")))
