"""Streams over landed files give what their batch twins give."""

from datetime import datetime

from pyspark.sql import functions as F

from plazafeed.streaming import jobs

EVENTS = "/root/testdata/sf0.001/events.parquet"


def landed(spark, tmp_path):
    df = spark.read.parquet(EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    return df, jobs.read_landed(spark, str(tmp_path / "in"), df._jdf.schema().toDDL(), files_per_trigger=1)


def run(df, name, tmp_path, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


def test_toggles(spark, tmp_path):
    df, stream = landed(spark, tmp_path)
    run(jobs.toggles(stream, "user_id", "event_type"), "toggles", tmp_path, "complete")
    want = {(r.user_id, r.event_type, r.active) for r in df.groupBy("user_id", "event_type").agg((F.count("*") % 2 == 1).alias("active")).collect()}
    assert {(r.user_id, r.event_type, r.active) for r in spark.table("toggles").collect()} == want


def test_rate_windows(spark, tmp_path):
    df, stream = landed(spark, tmp_path)
    run(jobs.rate_windows(stream, "user_id", 1, late="60 days"), "rates", tmp_path, "update")
    last = spark.table("rates").groupBy("window_start", "user_id").agg(F.max("requests").alias("n"))
    want = df.groupBy(F.window("ts", "60 seconds").start.alias("window_start"), "user_id").agg(F.count("*").alias("n"))
    assert last.exceptAll(want).isEmpty() and want.exceptAll(last).isEmpty()


def test_flag_requests(spark, tmp_path):
    df, stream = landed(spark, tmp_path)
    run(jobs.flag_requests(stream, "user_id", 1, late="60 days"), "flags", tmp_path, "append")
    assert spark.table("flags").count() == df.count()
    assert spark.table("flags").where("limited").count() == df.count() - df.groupBy(F.window("ts", "60 seconds"), "user_id").count().count()


def test_frontier_and_feedback(spark, tmp_path):
    df, stream = landed(spark, tmp_path)
    log = lambda d: d.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_type").alias("url"), F.lit("collected").alias("event"), F.col("ts").alias("at"))
    run(jobs.frontier_stream(log(stream), late="60 days"), "frontier", tmp_path, "update")
    last = spark.table("frontier").groupBy("source_id", "url").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    want = log(df).groupBy("source_id", "url").agg(F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"))
    ms = lambda d: {(r.source_id, r.url, r.a, r.b) for r in d.select("source_id", "url", F.unix_millis("first_seen_at").alias("a"), F.unix_millis("last_seen_at").alias("b")).collect()}
    assert ms(last) == ms(want)
    fb = stream.select(F.col("event_type").alias("item_key"), F.lit("approved").alias("action"), F.col("user_id").cast("string").alias("url_key"), F.col("ts").alias("reviewed_at"))
    run(jobs.photo_feedback_stream(fb, 3, late="60 days"), "feedback", tmp_path, "update")
    assert spark.table("feedback").select(F.max(F.size("urls")).alias("m")).first().m == 3


def test_state_of_links_goes_after_its_time(spark, tmp_path):
    """A link that comes again after its time starts anew, unless its upload was pending; the state shrinks."""
    schema, day = "source_id string, url string, event string, at timestamp", lambda n: datetime(2026, 1, 1 + n)
    steps = [[("s", "gone", "seen", day(0)), ("s", "held", "collected", day(0)), *(("s", f"l{k}", "seen", day(0)) for k in range(20))], [("s", "late", "seen", day(20))], [("s", "late", "seen", day(21))], [("s", "gone", "seen", day(22)), ("s", "held", "seen", day(22))]]
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        q = jobs.frontier_stream(jobs.read_landed(spark, str(tmp_path / "log"), schema, files_per_trigger=1), keep_days=5).writeStream.foreachBatch(lambda d, k: d.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
    out = spark.read.parquet(str(tmp_path / "out"))
    first = lambda url: [r.first_seen_at for r in out.where(F.col("url") == url).orderBy("last_seen_at").collect()]
    assert first("gone") == [day(0), day(22)] and first("held") == [day(0), day(0)]
    totals = [op.numRowsTotal for p in q.recentProgress for op in p.stateOperators]
    assert totals[-1] < 22


def test_reminders(spark, tmp_path):
    rows = [("1", "u", datetime(2026, 3, 10, 10), datetime(2026, 3, 10, 9)), ("2", "u", datetime(2026, 3, 12), datetime(2026, 3, 10, 9))]
    schema = "id string, user_id string, due_at timestamp, ts timestamp"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "rem"))
    run(jobs.reminder_stream(jobs.read_landed(spark, str(tmp_path / "rem"), schema)), "due", tmp_path, "append")
    assert [r.id for r in spark.table("due").collect()] == []  # event time is still before both
    checkpoint = tmp_path / "cp-due"
    spark.createDataFrame([("3", "v", datetime(2027, 1, 1), datetime(2026, 3, 11))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "rem"))
    q = jobs.reminder_stream(jobs.read_landed(spark, str(tmp_path / "rem"), schema)).writeStream.foreachBatch(lambda d, k: d.write.mode("append").parquet(str(tmp_path / "sent"))).option("checkpointLocation", str(checkpoint)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "sent")).collect()] == ["1"]
    batch = spark.createDataFrame([(*r, "pending", None) for r in rows], schema + ", status string, sent_at timestamp")
    due, after = jobs.due_reminders(batch, "2026-03-10 11:00:00")
    assert [r.id for r in due.collect()] == ["1"] and {r.id: r.status for r in after.collect()} == {"1": "sent", "2": "pending"}


def test_listing_ingest(spark, tmp_path):
    schema = "url string, html string"
    spark.createDataFrame([("https://a", "x"), ("https://a", "x"), ("https://b", "y")], schema).write.parquet(str(tmp_path / "pages"))
    out = str(tmp_path / "out")
    q = jobs.ingest_listings(jobs.read_landed(spark, str(tmp_path / "pages"), schema), lambda d: d, lambda d, k: d.write.mode("overwrite").parquet(f"{out}/batch={k}"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).select("url").distinct().count() == 2


def test_a_replayed_batch_replaces_itself(spark, tmp_path):
    out = str(tmp_path / "out")
    publish = jobs.publish_batches(out)
    rows = lambda *r: spark.createDataFrame(list(r), "url string, title string")
    for batch, k in ((rows(("a", "1"), ("b", "1")), 0), (rows(("a", "2"), ("c", "x")), 1), (rows(("a", "2"), ("c", "2")), 1), (rows(("d", "10")), 10), (rows(("d", "9")), 9)):
        publish(batch, k)
    assert {r.url: r.title for r in jobs.latest_rows(spark, out, "url").collect()} == {"a": "2", "b": "1", "c": "2", "d": "10"}


def test_draft_states(spark):
    log = spark.createDataFrame([("a", "pending", datetime(2026, 3, 1)), ("a", "published", datetime(2026, 3, 2)), ("b", "pending", datetime(2026, 3, 1))], "draft_id string, status string, at timestamp")
    s = jobs.draft_states(log, "2026-03-10 00:00:00")
    assert {r.draft_id: r.status for r in s.collect()} == {"a": "published", "b": "expired"} and jobs.published_history(s).count() == 1
