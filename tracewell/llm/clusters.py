"""Centroid clustering of integer vectors with partial-distance search.

Vectors of exactly ``DIMENSIONS`` finite components are scaled to whole numbers and written packed to the shared folder
once. A round is one pass over them: every task assigns its vectors and sends on counts and exact component sums of
each centroid, so what is shuffled and what the driver gets is bounded by centroids x dimensions, whatever the input.

Assignment is a partial-distance search. Dimensions are put in order of falling variance over all vectors; squared
integer differences are accumulated over the first ``HEAD`` of them for every centroid, the centroid nearest so far is
measured in full and becomes the current best, and then each other centroid goes on by ``STEP`` dimensions at a time
only for vectors where its sum is not yet strictly above the best. Survivors finish all dimensions; an equal distance
wins only with a smaller number. Abandoning strictly above the best keeps the result exact.

Defined results: vectors that are null, of another length, with a null or non-finite component (or one that is not
finite when scaled) get no row; repeated rows count and are returned as often as they occur; starting centroids are
distinct rows by the hash of their id, equal ids in order of their components, and null ids are never a start; with
fewer vectors than centroids there are as many centroids as vectors with an id, and with none cluster and distances are
null; components of any size are computed exactly, a distance or sum beyond a long is null; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store

DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
#: Dimensions compared for all centroids at first, and at a time afterwards.
HEAD, STEP = 16, 16
#: Vectors that a kernel holds at a time.
ROWS = 8192
#: Components and centroids below this are computed in 64-bit integers, others in Python's.
NARROW = 1 << 28
#: Sums travel as limbs of this base, so that no size overflows.
BASE = 10**18
LONG = 1 << 63


def _matrix(packed: pa.Array) -> np.ndarray:
    """Rows of packed float64 whole numbers; of int64, or of Python's integers where a component is large."""
    flat = np.frombuffer(b"".join(packed.to_pylist()), dtype="<f8").reshape(len(packed), -1)
    if not flat.size or np.abs(flat).max() < NARROW:
        return flat.astype(np.int64)
    return np.array([[int(x) for x in row] for row in flat.tolist()], dtype=object)


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component as packed float64 whole numbers, which hold them exactly)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            fits = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(lists), dimensions), False).to_numpy(zero_copy_only=False))
            ids, lists = ids.take(pa.array(fits)), lists.take(pa.array(fits))
            flat = pc.list_flatten(lists).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dimensions)  # null becomes NaN
            with np.errstate(all="ignore"):
                whole = np.floor(flat * float(scale))
            good = np.isfinite(whole).all(axis=1)
            data = np.ascontiguousarray(whole[good], dtype="<f8")
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(good)), pa.array([x.tobytes() for x in data], pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def order_of(table: DataFrame, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The dimensions by falling variance over all vectors of ``table`` (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, squares = 0, np.zeros(dimensions), np.zeros(dimensions)
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<f8").reshape(batch.num_rows, -1)
            n, total, squares = n + len(x), total + x.sum(axis=0), squares + (x * x).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions), pa.int32()), pa.array(np.full(dimensions, float(n))), pa.array(total), pa.array(squares)], names=["d", "n", "s", "q"])

    sums = table.select("v").mapInArrow(run, "d int, n double, s double, q double").groupBy("d").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    spread = np.zeros(dimensions)
    for r in sums.collect():  # one row a dimension
        spread[r.d] = r.q / r.n - (r.s / r.n) ** 2
    return np.argsort(-spread, kind="stable")


def nearest(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of the nearest centroid of each row, ties to the smaller number; the columns of both
    are in the order in which dimensions are compared."""
    n, size = v.shape
    head = min(HEAD, size)
    part = np.empty((len(centroids), n), dtype=v.dtype)
    for c, x in enumerate(centroids):
        part[c] = ((v[:, :head] - x[:head]) ** 2).sum(axis=1)
    best = np.argmin(part, axis=0)
    least = ((v - centroids[best]) ** 2).sum(axis=1)
    for c, x in enumerate(centroids):
        live = np.flatnonzero((part[c] <= least) & (best != c))
        far = part[c][live]
        for at in range(head, size, STEP):
            if not live.size:
                break
            far = far + ((v[live, at : at + STEP] - x[at : at + STEP]) ** 2).sum(axis=1)
            keep = far <= least[live]
            live, far = live[keep], far[keep]
        wins = (far < least[live]) | (c < best[live])
        best[live[wins]], least[live[wins]] = c, far[wins]
    return best, least


def _search(v: np.ndarray, centroids: list[list[int]], order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = v.dtype == object or max(abs(x) for c in centroids for x in c) >= NARROW
    kind = object if wide else np.int64
    return nearest(v.astype(kind)[:, order], np.array(centroids, dtype=kind)[:, order])


def limbs(total: int) -> Iterator[tuple[int, int]]:
    """(position, signed digit) of a whole number in base ``BASE``."""
    sign, rest, k = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        rest, digit = divmod(rest, BASE)
        yield k, sign * digit
        k += 1


def moved(table: DataFrame, centroids: list[list[int]], order: np.ndarray) -> list[list[int]]:
    """The centroids after one round over ``table`` (vec_id, v): exact floors of the means; empty ones stay."""
    k, dimensions = len(centroids), len(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                v = _matrix(batch.column(0).slice(at, ROWS))
                best, _ = _search(v, centroids, order)
                rows = np.argsort(best, kind="stable")
                some, starts = np.unique(best[rows], return_index=True)
                counts[some] += np.diff(np.r_[starts, best.size])
                sums[some] += np.add.reduceat(v[rows], starts, axis=0).astype(object)
        out = [(c, -1, 0, int(counts[c])) for c in range(k) if counts[c]]
        out += [(c, d, p, x) for c in range(k) if counts[c] for d in range(dimensions) for p, x in limbs(int(sums[c, d]))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["c", "d", "p", "x"])

    # Sums of a centroid's dimensions: a few thousand rows whatever the input.
    sums = table.select("v").mapInArrow(run, "c int, d int, p int, x long").groupBy("c", "d", "p").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    totals: dict[tuple[int, int], int] = {}
    for r in sums:
        totals[r.c, r.d] = totals.get((r.c, r.d), 0) + int(r.x) * BASE**r.p
    return [[totals.get((c, d), 0) // n for d in range(dimensions)] if (n := totals.get((c, -1))) else centroids[c] for c in range(k)]


def starts(table: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids have the smallest hashes, in that order."""
    by_hash = table.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v").orderBy("h", "v").limit(k)
    return [[int(x) for x in np.frombuffer(r.v, dtype="<f8")] for r in by_hash.collect()]


def assigned(table: DataFrame, centroids: list[list[int]], order: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance for each row of ``table`` (vec_id, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                best, far = _search(_matrix(part.column(1)), centroids, order)
                far = pa.array(far) if far.dtype != object else pa.array([x if x < LONG else None for x in far.tolist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.int32()), far], names=["vec_id", "cluster", "distance"])

    return table.mapInArrow(run, "vec_id long, cluster int, distance long")


def _sum_or_null(values: str) -> F.Column:
    """The sum as a long; null if a value is null or the sum is no long."""
    total = F.sum(F.col(values).cast("decimal(38,0)"))
    return F.when((F.count("*") == F.count(values)) & (total < F.lit(str(LONG)).cast("decimal(38,0)")), total).cast("long")


def cluster(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS, scale: int = SCALE
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of each vector kept, and the final centroids."""
    table = store(integers(vectors, vec_id, embedding, dimensions, scale), "vectors")
    centroids = starts(table, k, seed)
    if not centroids:
        return table.select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("long").alias("distance")), []
    order = order_of(table, dimensions)
    for _ in range(rounds):
        centroids = moved(table, centroids, order)
    return store(assigned(table, centroids, order), "assigned"), centroids


def clusters(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector kept."""
    rows, centroids = cluster(vectors, vec_id, embedding, k, rounds, seed)
    if not centroids:
        nothing = F.lit(None).cast("long")
        return rows.select("vec_id", "cluster", "distance", nothing.alias("cluster_inertia"), nothing.alias("inertia"), F.lit(None).cast("string").alias("centroid_sha256"))
    sums = rows.groupBy("cluster").agg(_sum_or_null("distance").alias("x")).collect()  # one row a centroid
    known = [r.x for r in sums]
    inertia = sum(known) if all(x is not None for x in known) and sum(known) < LONG else None
    said = [(r.cluster, r.x, inertia, hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()) for r in sums]
    kinds = T.StructType([T.StructField("cluster", T.IntegerType()), T.StructField("cluster_inertia", T.LongType()), T.StructField("inertia", T.LongType()), T.StructField("centroid_sha256", T.StringType())])
    # At most k rows, so this side may be broadcast.
    return rows.join(F.broadcast(rows.sparkSession.createDataFrame(said, kinds)), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
