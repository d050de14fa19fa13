"""Streaming jobs: limiter, ingest, toggles, reminders, link frontier, listing ingest, drafts, photo feedback.

Each takes a streaming DataFrame; late rows are bounded by watermarks, keyed state by
timers. The batch twins are in ``operators``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.time import ts
from ..operators import analytics, dedupe

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_landed(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def rate_windows(ev: DataFrame, subject: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Requests per subject and tumbling window, and whether the limit was passed."""
    w = F.window("ts", f"{seconds} seconds")
    return ev.withWatermark("ts", late).groupBy(w, subject).agg(F.count("*").alias("requests")).select(F.col("window.start").alias("window_start"), subject, "requests", (F.col("requests") > limit).alias("limited"))


def flag_requests(ev: DataFrame, subject: str, limit: int, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Every request with its number in the subject's window; state for a window goes once the watermark has passed it."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        k = state.get[0] if state.exists else 0
        for pdf in pdfs:
            pdf = pdf.sort_values(["ts", "event_id"])
            n = range(k + 1, k + 1 + len(pdf))
            k += len(pdf)
            yield pd.DataFrame({"event_id": pdf["event_id"], "subject": str(key[0]), "k": n, "limited": [x > limit for x in n]})
        state.update((k,))
        state.setTimeoutTimestamp(int(key[1].timestamp() * 1000) + seconds * 1000 + 1)

    keyed = ev.withWatermark("ts", late).select("event_id", "ts", F.col(subject).cast("string").alias("subject"), F.window("ts", f"{seconds} seconds").start.alias("window_start"))
    return keyed.groupBy("subject", "window_start").applyInPandasWithState(run, "event_id long, subject string, k long, limited boolean", "k long", "append", GroupStateTimeout.EventTimeTimeout)


def ingest_events(raw: DataFrame, salt: str, late: str = "1 hour") -> DataFrame:
    """Sanitised events without exact repeats inside the watermark."""
    return analytics.sanitize_events(raw.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), salt)


def toggles(log: DataFrame, user: str, item: str) -> DataFrame:
    """Active after an odd number of toggles; an update stream."""
    return log.groupBy(user, item).agg((F.count("*") % 2 == 1).alias("active"), F.max("ts").alias("last_ts"))


def due_reminders(reminders: DataFrame, as_of: datetime | str) -> tuple[DataFrame, DataFrame]:
    """What is due, and the table with those marked sent."""
    due = (F.col("status") == "pending") & (F.col("due_at") <= ts(as_of))
    return reminders.where(due), reminders.withColumn("sent_at", F.when(due, ts(as_of)).otherwise(F.col("sent_at"))).withColumn("status", F.when(due, "sent").otherwise(F.col("status")))


class ReminderTimers(StatefulProcessor):
    """Emits a user's reminders when event time reaches their due_at, each once; a timer for each time one is due."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "id string", "due_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples():
                ms = int(r.due_at.timestamp() * 1000)
                self.pending.updateValue((str(r.id),), (ms,))
                self.handle.registerTimer(ms)
        yield pd.DataFrame({"user_id": pd.Series([], dtype=str), "id": pd.Series([], dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = [rid for (rid,), (ms,) in self.pending.iterator() if ms <= now]
        for rid in due:
            self.pending.removeKey((rid,))
        yield pd.DataFrame({"user_id": pd.Series([str(key[0])] * len(due), dtype=str), "id": pd.Series(due, dtype=str)})

    def close(self) -> None:
        pass


def reminder_stream(reminders: DataFrame, late: str = "1 minute") -> DataFrame:
    """``reminders(id, user_id, due_at, ts)``; needs the RocksDB state store."""
    return reminders.withWatermark("ts", late).groupBy("user_id").transformWithStateInPandas(ReminderTimers(), "user_id string, id string", "Append", "EventTime")


def frontier_state(log: DataFrame, as_of: datetime | str, keep_days: int = 180) -> DataFrame:
    """The link table from its event log ``(source_id, url, event, at)``; links unseen for ``keep_days`` go unless an upload is pending."""
    at = lambda e, f: f(F.when(F.col("event") == e, F.col("at")))
    g = log.groupBy("source_id", "url").agg(
        F.min("at").alias("first_seen_at"), F.max("at").alias("last_seen_at"), at("collected", F.max).alias("collected_at"), at("uploaded", F.max).alias("uploaded_at"),
        at("blocked", F.max).alias("blocked_at"), F.count_if(F.col("event") == "blocked").alias("blocked_count"), F.max_by("event", "at").alias("state"),
    )
    g = g.withColumn("pending_upload", F.col("collected_at").isNotNull() & (F.col("uploaded_at").isNull() | (F.col("uploaded_at") < F.col("collected_at"))))
    return g.where("pending_upload" if keep_days < 0 else (F.col("last_seen_at") >= ts(as_of) - F.expr(f"INTERVAL '{keep_days}' DAY")) | F.col("pending_upload"))


class KeptState(StatefulProcessor):
    """State of a key that goes ``keep_ms`` of event time after its last row; subclasses say what a row adds and what is put out."""

    SCHEMA, OUT = "", ""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("kept", f"last_ms long, {self.SCHEMA}")

    def add(self, old: tuple | None, rows: pd.DataFrame) -> tuple:
        """The fields after the newest time, from those before (None: a new key)."""
        raise NotImplementedError

    def show(self, key: tuple, last_ms: int, fields: tuple) -> pd.DataFrame:
        raise NotImplementedError

    def stays(self, fields: tuple) -> bool:
        """Whether the state outlives its time."""
        return False

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get() if self.state.exists() else None
        last, fields = (old[0], tuple(old[1:])) if old else (None, None)
        for pdf in rows:
            fields = self.add(fields, pdf)
            newest = int(pdf["ms"].max())
            last = newest if last is None else max(last, newest)
        if old:
            self.handle.deleteTimer(old[0] + self.keep_ms)
        self.handle.registerTimer(last + self.keep_ms)
        self.state.update((last, *fields))
        yield self.show(key, last, fields)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and not self.stays(tuple(self.state.get()[1:])):
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


class FrontierState(KeptState):
    SCHEMA = "first_ms long, state_ms long, state string, blocked long, collected_ms long, uploaded_ms long"
    OUT = "source_id string, url string, first_seen_ms long, last_seen_ms long, state string, blocked_count long"

    def add(self, old, rows):
        first, state_ms, state, blocked, collected, uploaded = old or (1 << 62, -1, "", 0, -1, -1)
        newest = max((int(ms), e) for ms, e in zip(rows["ms"], rows["event"]))
        of = lambda e, was: max([was, *rows.loc[rows["event"] == e, "ms"].astype(int)])
        state_ms, state = max((state_ms, state), newest)
        return min(first, int(rows["ms"].min())), state_ms, state, blocked + int((rows["event"] == "blocked").sum()), of("collected", collected), of("uploaded", uploaded)

    def show(self, key, last_ms, fields):
        return pd.DataFrame({"source_id": [key[0]], "url": [key[1]], "first_seen_ms": [fields[0]], "last_seen_ms": [last_ms], "state": [fields[2]], "blocked_count": [fields[3]]})

    def stays(self, fields):
        return fields[4] >= 0 and fields[5] < fields[4]  # collected, and that not uploaded yet


class FeedbackState(KeptState):
    SCHEMA = "urls array<string>, times array<long>"
    OUT = "item_key string, action string, urls array<string>"

    def __init__(self, keep_ms: int, n: int):
        super().__init__(keep_ms)
        self.n = n

    def add(self, old, rows):
        seen = dict(zip(*old)) if old else {}
        for u, ms in zip(rows["url_key"], rows["ms"]):
            seen[u] = max(int(ms), seen.get(u, -1))
        kept = sorted(seen.items(), key=lambda x: (x[1], x[0]))[-self.n :]
        return [u for u, _ in kept], [ms for _, ms in kept]

    def show(self, key, last_ms, fields):
        return pd.DataFrame({"item_key": [key[0]], "action": [key[1]], "urls": [[*fields[0]][::-1]]})


def _keyed(log: DataFrame, at: str, late: str) -> DataFrame:
    return log.withWatermark(at, late).withColumn("ms", F.unix_millis(at))


def frontier_stream(log: DataFrame, keep_days: int = 180, late: str = "1 day") -> DataFrame:
    """The same fold as an update stream. A link's state goes ``keep_days`` of event time after it was last seen, unless an upload is pending; needs the RocksDB state store."""
    out = _keyed(log, "at", late).groupBy("source_id", "url").transformWithStateInPandas(FrontierState(keep_days * 86_400_000), FrontierState.OUT, "Update", "EventTime")
    return out.select("source_id", "url", F.timestamp_millis("first_seen_ms").alias("first_seen_at"), F.timestamp_millis("last_seen_ms").alias("last_seen_at"), "state", "blocked_count")


def ingest_listings(pages: DataFrame, extract: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame, int], None], checkpoint: str):
    """Micro-batches of landed pages: extract, drop repeats, hand over with the batch's id (publishing by id makes a replay harmless)."""

    def one(batch: DataFrame, batch_id: int) -> None:
        publish(extract(batch).dropDuplicates(["url"]), batch_id)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_batches(root: str) -> Callable[[DataFrame, int], None]:
    """A ``publish`` for ``ingest_listings``: a folder a batch under ``root``. A batch that is replayed replaces its own rows and no others."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return publish


def latest_rows(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Of what was published under ``root`` the row of the latest batch for each ``key``."""
    rows = spark.read.option("basePath", root).parquet(root)
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("batch").cast("long")).alias("r")).select(key, "r.*")


def draft_states(log: DataFrame, as_of: datetime | str, ttl_hours: int = 30, tie: str = "status") -> DataFrame:
    """The latest status of each draft from ``(draft_id, status, at)``, of equal times the one with the largest ``tie``; pending beyond the time to live is expired."""
    g = log.groupBy("draft_id").agg(F.max_by("status", F.struct("at", F.col(tie).alias("tie"))).alias("status"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    old = (F.col("status") == "pending") & (F.col("created_at") < ts(as_of) - F.expr(f"INTERVAL '{max(12, ttl_hours)}' HOUR"))
    return g.withColumn("status", F.when(old, "expired").otherwise(F.col("status")))


def published_history(states: DataFrame) -> DataFrame:
    return states.where("status = 'published'").select("draft_id", F.col("updated_at").alias("posted_at"))


def photo_feedback_history(log: DataFrame, n: int = 25) -> DataFrame:
    """Per item and action the newest ``n`` urls."""
    k = log.withColumn("k", F.concat_ws("|", "item_key", "action"))
    return analytics.bounded_history(k, "k", "url_key", "reviewed_at", n)


def photo_feedback_stream(log: DataFrame, n: int = 25, keep_days: int = 365, late: str = "1 day") -> DataFrame:
    """The same from a stream: the state of an item is its newest ``n`` urls, and goes ``keep_days`` of event time after the last; needs the RocksDB state store."""
    return _keyed(log, "reviewed_at", late).groupBy("item_key", "action").transformWithStateInPandas(FeedbackState(keep_days * 86_400_000, n), FeedbackState.OUT, "Update", "EventTime")


def drop_late(items: DataFrame, as_of: datetime | str) -> DataFrame:
    """Items past their date, left out at every merge."""
    return items.where(F.col("event_date").isNull() | (F.col("event_date") >= ts(as_of)))


def live_items(stream: DataFrame, tz: str, late: str = "1 day") -> DataFrame:
    """Events by exact signature inside the watermark."""
    return dedupe.with_signatures(stream.withWatermark("updated_at", late), tz).dropDuplicatesWithinWatermark(["fingerprint"])
