"""A stream's matches are made for each format, none of them held between, and all formats bear one time."""

from pyspark.sql.classic.dataframe import DataFrame

from kindred.operators.encode import records
from kindred.plans.profiles import VALIDATE, Thresholds
from kindred.streaming import matching


def test_a_batch_holds_no_pairs_of_members(spark, tmp_path, monkeypatch):
    held = []
    persist = DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: held.append(1) or persist(self, *a))
    rows = spark.createDataFrame([(f"b{i}", "Ann Lee") for i in range(3)], "id string, name string")
    rows.coalesce(1).write.parquet(str(tmp_path / "rows"))
    peer = records(spark.createDataFrame([("a1", "ann lee"), ("a2", "Ann Lee"), ("a3", "Someone Else")], rows.schema), ["name"], VALIDATE)
    stream = matching.read_rows(spark, str(tmp_path / "rows"), rows.schema)
    matching.start(stream, peer, ["name"], str(tmp_path / "out"), str(tmp_path / "progress"), VALIDATE, Thresholds()).awaitTermination()
    read = [spark.read.csv(str(tmp_path / "out/csv"), header=True).select("Local_ID", "Peer_ID", "Timestamp"), spark.read.json(str(tmp_path / "out/json")).select("local_id", "peer_id", "timestamp")]
    found = [sorted((r[0], r[1]) for r in df.collect()) for df in read]
    assert found[0] == found[1] == sorted((f"b{i}", a) for i in range(3) for a in ("a1", "a2"))
    assert spark.read.json(str(tmp_path / "out/json")).select("timestamp").distinct().count() == 1
    assert not held
