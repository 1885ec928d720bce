from pyspark.sql import functions as F

from tallymark.operators.score import LearnedScorer
from tallymark.sources.catalog import spec_table
from tallymark.streaming.scoring import drift, score_stream


def test_stream_scores_and_drift(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [("1", "valve.ball", "1/2 BALL VLV SS 600WOG SCRD FP"), ("2", "bearing.ball", "BRG BALL 6205-2RS C3")]
    spark.createDataFrame(rows, "sku string, category_id string, description string").write.json(src)
    stream = spark.readStream.schema("sku string, category_id string, description string").json(src)
    scored = score_stream(stream, spec_table(spark), LearnedScorer(("dimensional",)), 0.5)
    q = scored.select("sku", "attribute", "score", "decision").writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored").collect()
    assert len(got) == 11 and {r.decision for r in got} == {"auto_publish", "review"}
    batch = spark.createDataFrame([(0.5,), (1.5,)], "score double").withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:10:00")))
    assert [(r.mean_score, r.n) for r in drift(batch).collect()] == [(1.0, 2)]
