"""Writers: versions, snapshots, bounded logs, reports, manifests."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import dedupe
from ..operators.staging import shared_folder  # noqa: F401


def write_version(df: DataFrame, root: str, version: int, partition_by: str | None = None) -> str:
    """A new version beside the old ones: readers of those are not disturbed, and a failed write leaves no ``_SUCCESS``."""
    path = f"{root.rstrip('/')}/v={version:08d}"
    w = df.write.mode("errorifexists")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)
    return path


def write_snapshot(prev: DataFrame, nxt: DataFrame, mode: str, path: str, tz: str, as_of: datetime | str) -> dict[str, int]:
    """``replace`` or ``incremental_merge``; counts of new and retained rows. Nothing collected: the previous file stays."""
    if nxt.isEmpty():
        return {"rows": -1, "new": 0, "retained": 0}
    out = dedupe.merge_snapshots(prev if mode == "incremental_merge" else prev.limit(0), nxt, tz, as_of)
    seen = Observation("snapshot")
    counted = out.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("merge_state") == "new").alias("new"), F.count_if(F.col("merge_state") == "retained").alias("retained"))
    counted.drop("merge_state").write.mode("overwrite").parquet(path)
    return dict(seen.get)


def append_events(log: DataFrame, batch: DataFrame, cap: int, tie: str) -> DataFrame:
    """The newest ``cap`` events of log and batch; of equal times those with the larger ``tie``."""
    both = log.unionByName(batch, allowMissingColumns=True)
    return both.orderBy(F.desc("ts"), F.desc(tie)).limit(cap)


class EventLog:
    """A bounded log under ``root``: a folder a batch, in it one a day.

    A batch that is written again replaces itself, so a replay adds nothing. The newest
    events are whole days and a part of one: days are counted from the files' footers, and
    only the rows of the day in which the cap falls are sorted.
    """

    def __init__(self, spark: SparkSession, root: str, cap: int, tie: str):
        self.spark, self.root, self.cap, self.tie = spark, root.rstrip("/"), cap, tie

    def append(self, batch: DataFrame, batch_id: int) -> None:
        day = F.date_format("ts", "yyyy-MM-dd")
        batch.withColumn("day", day).repartition("day").write.mode("overwrite").partitionBy("day").parquet(f"{self.root}/batch={batch_id}")

    def rows(self) -> DataFrame:
        """All that is kept, with ``batch`` and ``day``."""
        return self.spark.read.option("basePath", self.root).option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(self.root).withColumn("day", F.col("day").cast("string"))

    def edge(self) -> tuple[bool, str | None, int]:
        """Whether the cap falls inside a day, which (None: that of events without a time), and how many of its events are within. The driver sees one row a day."""
        left = self.cap
        for r in self.rows().groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc_nulls_last("day")).collect():
            if r["n"] > left:
                return True, r["day"], left
            left -= r["n"]
        return False, None, left

    def newest(self) -> DataFrame:
        """The newest ``cap`` events; those without a time come last."""
        cut, day, left = self.edge()
        rows = self.rows()
        if not cut:
            return rows.drop("batch", "day")
        whole = rows.where("day is not null") if day is None else rows.where(F.col("day") > day)
        part = rows.where(F.col("day").eqNullSafe(F.lit(day))).orderBy(F.desc("ts"), F.desc(self.tie)).limit(left)
        return whole.unionByName(part).drop("batch", "day")

    def retire(self) -> int:
        """Delete the days before the one in which the cap falls; how many folders went."""
        cut, day, _ = self.edge()
        if not cut or day is None:
            return 0
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch=*/day=*")
        store = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        old = [f.getPath() for f in store.globStatus(path) if f.getPath().getName().removeprefix("day=") < day or "__HIVE" in f.getPath().getName()]
        for p in old:
            store.delete(p, True)
        return len(old)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def section_overrides(normalized: DataFrame) -> DataFrame:
    """One row a section: its items as an array, by id."""
    cols = [c for c in normalized.columns if c != "section_id"]
    return normalized.groupBy("section_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("items"))


def preview_manifest(best: DataFrame, existing: DataFrame, as_of: datetime | str) -> DataFrame:
    """One row a preview key that is still wanted: its present url, else the new one; stale keys go."""
    e = existing.select("preview_key", F.col("url").alias("old_url"), F.col("updated_at").alias("old_at"))
    j = best.select("preview_key", "title", "url").join(e, "preview_key", "left")
    return j.select("preview_key", "title", F.coalesce("old_url", "url").alias("url"), F.coalesce("old_at", F.lit(str(as_of)).cast("timestamp")).alias("updated_at"))


def stale_previews(best: DataFrame, existing: DataFrame) -> DataFrame:
    return existing.join(best, "preview_key", "left_anti")


def newest_versions(log: DataFrame, key: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("updated_at"))
    return log.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")
