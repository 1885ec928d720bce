"""Text similarity that has no built-in: mean pairwise ratio of matching blocks."""

from __future__ import annotations

from difflib import SequenceMatcher
from itertools import combinations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def mean_ratio(values: list[str]) -> float:
    """Over all pairs in order, case and outer white space ignored; 1 for fewer than two values."""
    own = [v.strip().lower() for v in values]
    ratios = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in combinations(own, 2)]
    return sum(ratios) / len(ratios) if ratios else 1.0


@F.pandas_udf(DoubleType())
def pairwise_similarity(values: pd.Series) -> pd.Series:
    return values.map(lambda v: mean_ratio([x for x in v if x is not None]))
