from __future__ import annotations

from siltbed.streaming import molecules as W


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_dedup_over_batches_equals_the_table(spark, tmp_path):
    parts = [[(1, "a", 1), (1, "a", 1)], [(1, "a", 1), (2, "b", 3)], [(2, "b", 4)]]
    for k, p in enumerate(parts):
        spark.createDataFrame(p, "cell long, feature string, umi long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell long, feature string, umi long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen = []
    W.write_each(W.dedup(stream, ["cell", "feature", "umi"]), lambda b, i: seen.extend(tuple(r) for r in b.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(seen) == [(1, "a", 1), (2, "b", 3), (2, "b", 4)]


def test_new_territory(spark, tmp_path):
    for part in ([("c", 0, 10), ("c", 5, 8)], [("c", 8, 12), ("d", 1, 2)], [("c", 0, 12)]):
        spark.createDataFrame(part, "cell string, start long, end long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cell string, start long, end long").parquet(str(tmp_path / "in"))
    q = W.new_territory(stream, "cell", "start", "end").writeStream.format("memory").queryName("territory").outputMode("append").start()
    drain(q)
    rows = [tuple(r) for r in spark.table("territory").collect()]
    assert sum(r[3] for r in rows if r[0] == "c") == 12 and ("d", 1, 2, 1) in rows


def test_windows_and_buffers(spark):
    rows = [(k, f"2024-01-01 00:{m:02d}:00") for k, m in ((1, 0), (1, 1), (1, 9), (2, 3))]
    e = spark.createDataFrame(rows, "k int, t string").selectExpr("k", "cast(t as timestamp) t", "1.0 v")
    assert sorted((r.k, r.n) for r in W.windowed(e, "t", "5 minutes", None, ["k"], "v").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert W.windowed(e, "t", "5 minutes", "1 minute", ["k"], "v").agg({"n": "sum"}).first()[0] == 20
    assert sorted((r.k, r.n) for r in W.sessions(e, "t", "4 minutes", ["k"]).collect()) == [(1, 1), (1, 2), (2, 1)]
    ticks = spark.createDataFrame([("r", 1), ("r", 2), ("r", 9), ("s", 4)], "id string, tick long")
    assert sorted(tuple(r) for r in W.cluster_buffer(ticks, "id", "tick", 3).collect()) == [("r", 1, 2, 2), ("r", 9, 9, 1), ("s", 4, 4, 1)]
