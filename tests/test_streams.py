from pyspark.sql import functions as F

from tessera.operators import lookups as L
from tessera.operators import upserts as U
from tessera.sources.derived import Tables
from tessera.streaming import streams


def parts(df, n, order, path):
    """Files in order of time, so that each micro-batch gets one."""
    rows = df.orderBy(*order).toPandas()
    step = -(-len(rows) // n)
    for i in range(n):
        df.sparkSession.createDataFrame(rows[i * step : (i + 1) * step], df.schema).coalesce(1).write.mode("append").parquet(path)


def run(query, name, mode, path):
    q = query.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", path).start()
    q.processAllAvailable()
    q.stop()
    return query.sparkSession.table(name)


def test_latest_per_chat(spark, sf, tmp_path):
    turns = Tables(spark, sf).turns.cache()
    parts(turns, 3, ["_creationTime"], str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streams.latest_per_chat(stream), "latest", "complete", str(tmp_path / "c"))
    want = L.latest_per(turns, "chatId", F.struct("_creationTime", "body")).select("chatId", F.col("_creationTime").alias("turn"), "body")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_daily_quota_across_batches(spark, sf, tmp_path):
    requests = Tables(spark, sf).quota_requests.cache()
    parts(requests, 3, ["ms", "_id"], str(tmp_path / "in"))
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(streams.daily_quota(stream, 3, "40 days"), "quota", "append", str(tmp_path / "c"))
    want = U.daily_quota(requests, 3).select("_id", "userId", "day", "ok", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_view_and_progress(spark, sf, tmp_path):
    turns = Tables(spark, sf).turns.cache()
    parts(turns, 3, ["_creationTime"], str(tmp_path / "in"))
    stream = spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    shown = []
    view = lambda s: s.read.schema(turns.schema).parquet(str(tmp_path / "in")).groupBy("chatId").count()
    q = streams.live_view(stream, view, lambda df, n: shown.append((n, df.count()))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    got = streams.progress(q)
    q.stop()
    assert shown == [(i, turns.select("chatId").distinct().count()) for i in range(3)]
    assert got["rows"] == turns.count() and got["running"] and not streams.progress(q)["running"]
    q = streams.live_view(stream, lambda s: None, lambda df, n: shown.append(None)).option("checkpointLocation", str(tmp_path / "d")).start()
    q.processAllAvailable()
    q.stop()
    assert None not in shown
