from datetime import datetime, timedelta

from slipweave.streaming import intake

T0 = datetime(2024, 1, 1)


def test_first_seen_activity_and_intake(spark, tmp_path):
    rows = [(f"d{i}", "u", T0 + timedelta(minutes=i), f"{i % 3:064x}", "A" if i % 2 else "B") for i in range(9)]
    kind = "document_id string, user_id string, created_at timestamp, exact_hash string, action string"
    spark.createDataFrame(rows, kind).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(kind).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert sorted(r.document_id for r in run(intake.first_seen(stream()), "append", "seen")) == ["d0", "d1", "d2"]
    counts = {r.action: r.n for r in run(intake.activity(stream()), "complete", "act")}
    assert counts == {"A": 4, "B": 5}
    for _ in range(2):  # a second run finds nothing new
        intake.run_intake(stream(), lambda b, n: b.select("document_id"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 9
