from difflib import SequenceMatcher
from itertools import combinations

import duckdb
import pytest

import __spark_entry__ as entry
from tallymark.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    got = [tuple(r) for r in df.collect()]
    if name in ORACLES:
        want = duck.sql(ORACLES[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert canonical(got, df.columns) == canonical(want.fetchall(), want.columns)


def test_ensemble_compares_whole_texts(spark, tmp_path):
    same = "the same long beginning of every answer " * 3
    turns = [(1, 0, "user", same + "red"), (1, 1, "user", same + "an altogether different end"), (1, 2, "user", same + "RED "), (2, 0, "user", "short"), (2, 1, "user", "Short"), (3, 0, "user", "alone")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.sku: (r.applicable, r.trust) for r in QUERIES["ensemble_agreement"](spark, str(tmp_path)).collect()}
    own = [t.strip().lower() for c, _, _, t in turns if c == 1]
    ratios = [1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in combinations(own, 2)]
    assert got == {1: (True, pytest.approx(sum(ratios) / 3, abs=1e-6)), 2: (True, 1.0), 3: (False, 0.0)} and got[1][1] < 0.95


def test_every_document_is_grounded(spark, tmp_path):
    texts = {0: "Steel ball valve", 1: "one\ntwo three", 2: "x", 3: "", 4: None, 5: "Long words " * 400, 6: "a zzzzq b"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.kind): (r.quote, r.start) for r in QUERIES["grounding_all"](spark, str(tmp_path)).collect()}
    none = (None, None)
    want = {0: [("steel ball", 0), ("steel", 0), none], 1: [("one", 0), ("one", 0), none], 2: [("x", 0), none, none], 3: [none] * 3, 4: [none] * 3, 5: [("long words", 0), ("long", 0), none], 6: [("a zzzzq", 0), none, ("zzzzq", 2)]}
    assert got == {(k, kind): x for k, xs in want.items() for kind, x in zip(("whole", "part", "none"), xs, strict=True)}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert QUERIES["grounding_all"](spark, DIR).select("doc_id").distinct().count() == docs


def test_all_events_and_parts_are_covered(spark):
    events, parts = (spark.read.parquet(f"{DIR}/{t}.parquet") for t in ("events", "part"))
    assert QUERIES["ensemble_lists_all"](spark, DIR).agg({"n": "sum"}).first()[0] == events.filter("event_type is not null").count()
    assert QUERIES["constraint_trusts_all"](spark, DIR).select("sku").distinct().count() == parts.count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
