"""Hard negatives by exact inner products, scored with subset-sum tables (the Four-Russians way).

Vectors are integers. A candidate is kept as bit planes: for each bit of its components, and
each group of eight dimensions, one byte. For an anchor and a group the sums of all 256
subsets of its eight components are laid in a table, so that a byte of a plane is worth one
look-up; planes are added from the top bit down, doubling in between, and the top one
counts negatively (two's complement). The scores are full and exact.

Anchors and candidates meet in cells, a block of either side, dealt by hash: each pair is
scored in one cell, no cell grows with the corpus, and only the best few of a cell leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: Rows of a block of anchors and of candidates; candidates scored at a time.
ANCHORS, CANDIDATES, CHUNK = 512, 2048, 256


def whole_vectors(embeddings: DataFrame, scale: float = 256, shift_every: int = 7, labels: int = 10) -> DataFrame:
    """``id, label, vector array<long>``: components times ``scale``, rounded down; where the id is divisible by ``shift_every`` the label is the next one of ``labels``.

    A row whose id, label or vector is null, or with a component that is null or not finite,
    takes no part. An id that comes again counts once, with its smallest label and vector.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & fine)
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % shift_every == 0, (label + 1) % labels).otherwise(label)
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    once = rows.select(F.col("vec_id").alias("id"), F.struct(label.alias("label"), vector.alias("vector")).alias("x")).groupBy("id").agg(F.min("x").alias("x"))
    return once.select("id", "x.label", "x.vector")


def matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Lists as rows of ``dims`` numbers; what a short one lacks is zero."""
    arrays = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    out, at = np.zeros((len(column), dims), np.int64), 0
    for x in arrays:
        sizes = x.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(x)), sizes)
        out[at + row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = x.flatten().to_numpy(zero_copy_only=False)
        at += len(x)
    return out


def bit_planes(vectors: np.ndarray, planes: int) -> np.ndarray:
    """Bytes (row, plane from the lowest, group of eight dimensions) of integers that fit ``planes`` bits in two's complement."""
    bits = np.stack([(vectors >> b) & 1 for b in range(planes)], 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """Tables (group, byte, anchor), in the narrowest type that holds the sum of all groups."""
    n, dims = anchors.shape
    most = int(np.abs(anchors.astype(float)).sum(1).max()) if n and dims else 0
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    padded = np.zeros((-(-dims // 8) * 8, n), kind)
    padded[:dims] = anchors.T
    tables = np.zeros((len(padded) // 8, 256, n), kind)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + padded[bit::8][:, None]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Inner products (candidate, anchor) as longs."""
    groups, n = len(tables), tables.shape[2]
    out = np.zeros((len(planes), n), np.int64)
    for at in range(0, len(planes), CHUNK):
        own, total = planes[at : at + CHUNK], out[at : at + CHUNK]
        plane, looked = np.empty((len(own), n), tables.dtype), np.empty((len(own), n), tables.dtype)
        for b in range(planes.shape[1] - 1, -1, -1):
            plane[:] = 0
            for g in range(groups):
                plane += np.take(tables[g], own[:, b, g], axis=0, out=looked, mode="clip")
            if b == planes.shape[1] - 1:
                np.negative(plane, out=total, casting="same_kind", dtype=np.int64)
            else:
                total *= 2
                total += plane
    return out


def best_first(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores from the highest, and their columns; of equal ones the first column comes first."""
    n = found.shape[1]
    bits = max(1, (n - 1).bit_length())
    if found.size and max(abs(int(found.min())), abs(int(found.max()))) < 1 << (62 - bits):
        keys = np.sort(-found << bits | np.arange(n), axis=1)
        return -(keys >> bits), keys & ((1 << bits) - 1)
    order = np.argsort(-found, axis=1, kind="stable")
    return np.take_along_axis(found, order, 1), order


def _in_cells(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """``rows`` in ``blocks`` blocks by hash of the id, once for each of the other side's."""
    return rows.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchor_block: int = ANCHORS, candidate_block: int = CANDIDATES) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` over ``vectors(id, label, vector)`` with one row an id.

    Of an anchor's same-label rows the ``positives`` with the highest inner product; for each
    of them the ``negatives`` best rows of other labels whose score lies from ``low`` to
    ``high`` percent of the positive's (both ends included). Ties go to the smaller id. An
    anchor without positives, and a positive without negatives in that band (one of negative
    score has none), give no rows. Components that a shorter vector lacks are zero. Scores
    are longs and wrap as longs do. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    vectors = stage(vectors, "vectors")
    anchors = vectors.where(is_anchor)
    n, dims, least, most = vectors.agg(F.count("*"), F.max(F.size("vector")), F.min(F.array_min("vector")), F.max(F.array_max("vector"))).first()
    n_anchors = anchors.count()
    dims, planes = dims or 0, 1 + max((least or 0, most or 0), key=lambda x: (~x if x < 0 else x).bit_length()).bit_length()
    planes = min(64, planes)
    across, down = max(1, -(-n_anchors // anchor_block)), max(1, -(-n // candidate_block))

    def packed(batches):
        for b in batches:
            bits = bit_planes(matrix(b.column(2), dims), planes).reshape(b.num_rows, -1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in bits], pa.binary())], names=["id", "label", "planes"])

    index = stage(vectors.mapInArrow(packed, "id long, label long, planes binary"), "bit-planes")

    def cell(left: pa.Table, right: pa.Table) -> tuple:
        """Anchors and candidates in order of id: ids, labels, the anchors' table, and the scores (anchor, candidate)."""
        left, right = left.sort_by("id"), right.sort_by("id")
        raw = np.frombuffer(b"".join(right["planes"].to_pylist()), np.uint8).reshape(right.num_rows, planes, -(-dims // 8))
        names = lambda t: (t["id"].to_numpy(), t["label"].to_numpy())
        return *names(left), *names(right), left, matrix(left["vector"], dims), raw

    def best_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, c_id, c_label, _, vectors, raw = cell(left, right)
        out = [np.zeros((0, 3), np.int64)]
        for label in np.intersect1d(a_label, c_label):
            own, theirs = np.flatnonzero(a_label == label), np.flatnonzero(c_label == label)
            found, order = best_first(np.ascontiguousarray(scores(subset_sums(vectors[own]), raw[theirs]).T))
            ids = c_id[theirs][order[:, : positives + 1]]
            for k, i in enumerate(own.tolist()):
                others = np.flatnonzero(ids[k] != a_id[i])[:positives]
                out.append(np.stack([np.full(len(others), a_id[i]), ids[k, others], found[k, others]], 1))
        rows = np.concatenate(out)
        return pa.table({"anchor_id": rows[:, 0], "positive_id": rows[:, 1], "positive_score": rows[:, 2]})

    def best_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        a_id, a_label, c_id, c_label, left, vectors, raw = cell(left, right)
        given, wanted = left["positive_ids"].to_pylist(), left["positive_scores"].to_pylist()
        found = np.ascontiguousarray(scores(subset_sums(vectors), raw).T)
        found, order = best_first(found)
        other, out = c_label[order] != a_label[:, None], []
        for k, i in enumerate(a_id.tolist()):
            at = np.flatnonzero(other[k])
            falling = -found[k, at]
            for p, score in zip(given[k], wanted[k]):
                start = int(np.searchsorted(falling, -(high * score // 100)))
                stop = min(start + negatives, int(np.searchsorted(falling, low * -score // 100, "right")))
                out += [(i, p, score, int(c_id[order[k, j]]), int(found[k, j])) for j in at[start:stop].tolist()]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(names)})

    def meet(side: DataFrame, run, schema: str) -> DataFrame:
        left = _in_cells(side, "row", across, "col", down).groupBy("row", "col")
        return left.cogroup(_in_cells(index, "col", down, "row", across).groupBy("row", "col")).applyInArrow(run, schema)

    if not n_anchors:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pairs = meet(anchors.select("id", "label", "vector"), best_positives, "anchor_id long, positive_id long, positive_score long")
    pairs = pairs.withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives)
    listed = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    listed = listed.select(F.col("anchor_id").alias("id"), F.col("p.positive_id").alias("positive_ids"), F.col("p.positive_score").alias("positive_scores"))
    side = stage(anchors.select("id", "label", "vector").join(listed, "id"), "anchors")
    rows = meet(side, best_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    rows = rows.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
    return rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
