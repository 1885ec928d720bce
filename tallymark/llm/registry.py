"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallymark.llm.decontamination import op8_decontamination
from tallymark.llm.html_extraction import op9_html_extraction
from tallymark.llm.language_id import op2_language_id
from tallymark.llm.line_dedup import op10_line_dedup
from tallymark.llm.ngram_join import op1_ngram_jaccard_join
from tallymark.llm.packing import op5_packing
from tallymark.llm.pii import op6_pii
from tallymark.llm.quality_rules import OP4_SQL, op4_quality_rules
from tallymark.llm.toxicity import op3_toxicity
from tallymark.llm.warc import OP7_SQL, op7_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_language_id": op2_language_id,
    "op3_toxicity": op3_toxicity,
    "op4_quality_rules": op4_quality_rules,
    "op5_packing": op5_packing,
    "op6_pii": op6_pii,
    "op7_warc": op7_warc,
    "op8_decontamination": op8_decontamination,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
}

ORACLES: dict[str, str] = {
    "op4_quality_rules": OP4_SQL,
    "op7_warc": OP7_SQL,
}
