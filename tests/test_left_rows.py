"""Rows that must not get lost: transactions without a model row, and a stream over a table of part files."""

from pyspark.sql import functions as F

from checks.features import AS_OF_US
from moneytrail.plans import online
from moneytrail.sources import views


def test_transactions_without_a_model_row_are_assessed(spark, tiny):
    tx = views.transactions(spark, tiny)
    accounts = views.accounts(spark, tiny).withColumn("customer_id", F.expr("id div 2"))
    model = views.predictions(spark, tiny).select("id", "predicted", "confidence", "anomaly").where("id % 2 = 0")
    rows = online.analyze(tx, accounts, model, AS_OF_US).select("id", "predicted", "assessed_score").collect()
    assert sorted(r.id for r in rows) == sorted(r.id for r in tx.select("id").collect())
    assert all(r.assessed_score is not None for r in rows)
    assert {r.predicted for r in rows if r.id % 2} == {"normal"}


def test_events_stream_from_a_file_and_from_a_folder(spark, tiny, tmp_path):
    events = spark.read.parquet(f"{tiny}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    for n, folder in enumerate((tiny, str(tmp_path))):
        stream = views.event_stream(spark, folder).writeStream.format("memory").queryName(f"events_{n}").trigger(
            availableNow=True).option("checkpointLocation", str(tmp_path / f"state{n}")).start()
        stream.awaitTermination()
        assert spark.table(f"events_{n}").count() == events.count()
