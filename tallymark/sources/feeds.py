"""Product feeds and caches: nested JSON datasheets, harvest folders keyed by content, offline REST payloads."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Groups of features that say nothing about the product, and values that carry nothing.
SKIP_GROUPS = ("packaging data", "logistics data", "packaging content", "other features")
EMPTY_VALUES = ("", "yes", "no", "true", "false", "-")
NAME = "STRUCT<Name: STRUCT<Value: STRING>>"
PAYLOAD = f"data STRUCT<GeneralInfo: STRUCT<IcecatId: BIGINT, Brand: STRING, BrandPartCode: STRING, ProductCode: STRING, Title: STRING, Category: {NAME}>, FeaturesGroups: ARRAY<STRUCT<FeatureGroup: {NAME}, Features: ARRAY<STRUCT<Feature: {NAME}, PresentationValue: STRING, RawValue: STRING>>>>>"


def usable(presentation: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(presentation, F.lit("")))).isin(*EMPTY_VALUES)


def feature_rows(payloads: DataFrame, key: str, payload: str = "payload") -> DataFrame:
    """(key, ordinal, feature_group, name, presentation, raw, usable): groups and features exploded, skipped groups and unnamed features dropped."""
    parsed = payloads.select(key, F.from_json(payload, PAYLOAD).alias("p"))
    groups = parsed.select(key, F.posexplode("p.data.FeaturesGroups").alias("g_ord", "g"))
    group = F.trim(F.coalesce("g.FeatureGroup.Name.Value", F.lit("")))
    rows = groups.filter(~F.lower(group).isin(*SKIP_GROUPS)).select(key, "g_ord", group.alias("feature_group"), F.posexplode("g.Features").alias("f_ord", "f"))
    text = lambda c: F.trim(F.coalesce(c, F.lit("")))
    named = rows.filter(F.coalesce("f.Feature.Name.Value", F.lit("")) != "")
    return named.select(key, (F.col("g_ord") * 100_000 + F.col("f_ord")).alias("ordinal"), "feature_group", F.trim("f.Feature.Name.Value").alias("name"), text("f.PresentationValue").alias("presentation"), text("f.RawValue").alias("raw"), usable(F.col("f.PresentationValue")).alias("usable"))


def feature_key(rows: DataFrame, key: str) -> DataFrame:
    """(key, answers): presentation by name of the usable features; the last of a repeated name wins."""
    last = rows.filter("usable").groupBy(key, "name").agg(F.max_by("presentation", "ordinal").alias("presentation"))
    return last.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "presentation")))).alias("answers"))


def cache_key(**parts: object) -> str:
    """A key that changes with the model, size, seed, rules, schema fingerprints and prompts given."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:16]


def harvest(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table cached under ``folder``/key; made and written if it is absent or cannot be read, or on refresh."""
    path = f"{folder.rstrip('/')}/{key}"
    if not refresh:
        try:
            return spark.read.parquet(path)
        except Exception:  # noqa: BLE001  absent or damaged: make it again
            pass
    make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def load_samples(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame | None:
    """The resampling passes that exist, with ``pass``; passes are never made here. None if there is none."""
    found = []
    for k, key in enumerate(keys):
        try:
            found.append(spark.read.parquet(f"{folder.rstrip('/')}/{key}").withColumn("pass", F.lit(k)))
        except Exception:  # noqa: BLE001  a pass may be missing
            continue
    out = found[0] if found else None
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def fetch_many(pairs: DataFrame, fetch: Callable[[str, str], dict | None]) -> DataFrame:
    """(brand, product_code, payload) by a client called once a pair; pairs that fail are skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.itertuples():
                try:
                    answer = fetch(r.brand, r.product_code)
                except Exception:  # noqa: BLE001
                    answer = None
                if answer is not None:
                    rows.append((r.brand, r.product_code, json.dumps(answer)))
            yield pd.DataFrame(rows, columns=["brand", "product_code", "payload"])

    return pairs.select("brand", "product_code").mapInPandas(run, "brand string, product_code string, payload string")
