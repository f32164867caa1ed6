import json

from pyspark.sql import functions as F

from leadspark.sources import tables as S
from leadspark.streaming import evidence as stream


def test_envelopes(spark, tmp_path):
    record = {"id": "B-1", "company_name": "unknown", "country": "AE", "moq": {"max": 500}, "oem_odm": "yes", "product_categories": [], "evidence": [{"evidence_id": "EV-001", "claim": "country", "source_tier": 1, "observed_at": "2024-01-05T10:00:00Z", "source_date": "n/a"}]}
    (tmp_path / "a.json").write_text(json.dumps({"records": [record, {"id": "B-2", "moq": "unknown"}], "as_of": "2024-02-01"}))
    df = S.read_envelopes(spark, str(tmp_path / "a.json"))
    r = S.typed(df).orderBy("input_index").collect()
    assert [x.id for x in r] == ["B-1", "B-2"] and r[0].company_name is None and r[0].oem_odm is True and r[0].product_categories == [] and r[1].product_categories is None
    assert (r[0].moq.min, r[0].moq.max) == (0, 500) and r[1].moq.min is None
    e = S.evidence_of(df).first()
    assert str(e.observed_on) == "2024-01-05" and e.source_date is None
    assert S.duplicate_ids(df).count() == 0


def test_review_sheet_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("1", "=cmd", "Accept"), ("2", "b", None)], "record_id string, company_name string, verdict string")
    S.write_sheet(rows, str(tmp_path / "sheet"))
    back = {r.record_id: r for r in S.read_reviews(spark, str(tmp_path / "sheet")).collect()}
    assert back["1"].company_name == "'=cmd" and back["1"].verdict == "accept" and back["2"].verdict is None
    assert S.unknown_reviews(S.read_reviews(spark, str(tmp_path / "sheet")), rows.where("record_id = '1'")).count() == 1


def test_publish_only_what_is_valid(spark, tmp_path):
    rows, path = spark.range(5), str(tmp_path / "out")
    assert S.publish(rows, path) and spark.read.parquet(path).count() == 5
    assert not S.publish(spark.range(9), path, spark.range(1)) and spark.read.parquet(path).count() == 5
    assert S.publish(spark.range(7), path, spark.range(0)) and spark.read.parquet(path).count() == 7


def test_merge(spark):
    old = spark.createDataFrame([(1, 50, "SCORED"), (2, 60, "QUALIFIED"), (3, 70, "SCORED")], "id long, score int, status string")
    new = spark.createDataFrame([(1, 55, "SCORED"), (2, 60, "SCORED"), (4, 10, "SCORED"), (3, 70, "SCORED")], "id long, score int, status string")
    table, outcomes = S.merge(old, new, {"SCORED": 0, "QUALIFIED": 1})
    assert {r.id: r.outcome for r in outcomes.collect()} == {1: "updated", 2: "refused", 3: "unchanged", 4: "created"}
    assert {r.id: (r.score, r.status) for r in table.collect()} == {1: (55, "SCORED"), 2: (60, "QUALIFIED"), 3: (70, "SCORED"), 4: (10, "SCORED")}


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("owner_id"), F.col("event_id").alias("evidence_id"), F.col("event_type").alias("claim"), F.col("ts").cast("timestamp").alias("observed_at"), (F.col("event_id") % 5 + 1).cast("int").alias("source_tier"))
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = stream.windowed_claims(source).writeStream.outputMode("complete").format("memory").queryName("claims").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(items) from claims").first()[0] == events.count()
    best = stream.best_items(source.withColumn("strength", 100 - F.col("source_tier"))).writeStream.outputMode("complete").format("memory").queryName("best").start()
    best.processAllAvailable()
    best.stop()
    assert spark.sql("select count(*) from best").first()[0] == events.select("owner_id", "claim").distinct().count()
