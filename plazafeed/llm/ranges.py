"""Ranges of rows in order, cut by running sums: the cuts depend on the rows alone, not on partitions or sampling."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions, stage


@dataclass
class Ranges:
    """Ranges 0, 1, ... of rows by (key, tie), rows without key first. Of each the first row and the last: has (a key), key, tie."""

    first: np.ndarray
    last: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def of(self, key: pa.Array, tie: np.ndarray) -> np.ndarray:
        """The range of each row: the last that begins at or before it."""
        has = key.is_valid().to_numpy(zero_copy_only=False)
        starts = int(np.count_nonzero(self.first[:, 0] == 0))
        out = np.searchsorted(self.first[:starts, 2], tie, "right") - 1
        if has.any():
            keys, ties, ids = self.first[starts:, 1], self.first[starts:, 2], key.fill_null(0).to_numpy()
            lo, hi = np.searchsorted(keys, ids), np.searchsorted(keys, ids, "right")
            k = hi - 1
            for i in np.flatnonzero(has & (lo < hi)).tolist():  # keys at which a range begins
                k[i] = lo[i] + np.searchsorted(ties[lo[i] : hi[i]], tie[i], "right") - 1
            out[has] = (starts + k)[has]
        return np.maximum(out, 0)

    def ends(self, key: pa.Array, tie: np.ndarray, no: np.ndarray) -> np.ndarray:
        """Whether each row is the last of its range ``no``."""
        has, end = key.is_valid().to_numpy(zero_copy_only=False), self.last[no] if len(self) else np.zeros((len(no), 3), np.int64)
        return (has == (end[:, 0] == 1)) & (~has | (key.fill_null(0).to_numpy() == end[:, 1])) & (tie == end[:, 2])


def cut(light: DataFrame, room: int) -> Ranges:
    """Ranges of ``light(key, tie, size)`` of about ``room`` in size; rows with one key and tie stay together.

    Running sums are taken inside sorted partitions, from the sum of all before: the driver
    sees one number a partition and two rows a range.
    """
    spark = light.sparkSession
    order = [F.col("key").asc_nulls_first(), F.col("tie").asc()]
    sums = light.groupBy("key", "tie").agg(F.sum("size").alias("size"))
    parts = stage(sums.repartitionByRange(n_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    before, total = {}, 0
    for r in parts.groupBy("part").agg(F.sum("size").alias("size")).orderBy("part").collect():
        before[r["part"]], total = total, total + r["size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total, held, rows = None, 0, None, []
        for b in batches:
            for part, key, tie, size in zip(*(c.to_pylist() for c in b.columns)):
                if part != at:
                    at, total = part, before[part]
                no = total // room
                if held is None or held[:2] != [part, no]:
                    rows.append(held := [part, no, key, tie, key, tie])
                held[4:] = key, tie
                total += size
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*(r[1:] for r in rows)) if rows else [()] * 5)], names=["no", "key", "tie", "last_key", "last_tie"])

    dealt = parts.select("part", "key", "tie", "size").repartition(n_partitions(spark), "part").sortWithinPartitions("part", *order)
    named = lambda key, tie: (int(key is not None), key or 0, tie)
    first, last = {}, {}
    for r in dealt.mapInArrow(run, "no long, key long, tie long, last_key long, last_tie long").toLocalIterator():
        one, two = named(r["key"], r["tie"]), named(r["last_key"], r["last_tie"])
        first[r["no"]], last[r["no"]] = min(one, first.get(r["no"], one)), max(two, last.get(r["no"], two))
    rows = lambda d: np.array([d[k] for k in sorted(d)], np.int64).reshape(-1, 3)
    return Ranges(rows(first), rows(last))
