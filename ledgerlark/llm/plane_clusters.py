"""Centroid clustering of integer vectors by bit planes.

A vector's components become whole numbers, and bit ``b`` of its 64 components, in two's
complement, is one 64-bit word: a plane.  A dot product is the sum over pairs of planes of
``weight * popcount(plane & plane)``, which is exact, as are norms and squared distances.

Packed vectors are written once and read once a round.  A task returns a row for each centroid
(count, component sums, distance sum), Spark adds them up, and the driver holds the centroids
alone: ``k`` rows of 64 numbers, whatever the size of the table.

Vectors that are null, have not 64 components, or hold a null or non-finite component are left
out, and so are those with a component outside of [-2^17, 2^17), since then a squared distance
may not fit in a long.  Repeated rows each count.  Rows of equal ids tie as starting centroids
by their components; a null id hashes as an empty one.  With fewer than ``k`` vectors there are
as many centroids as vectors; an empty table gives no rows.  Sums of distances beyond a long are
null.  Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .storage import save

WIDTH, CENTROIDS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Components lie in [-LIMIT, LIMIT) before they are scaled.
LIMIT = 2.0**17
STEP_ROWS = 2048


def pack(values: np.ndarray) -> np.ndarray:
    """Planes [rows, bits] of whole numbers [rows, 64], the sign last."""
    bits = int(np.where(values < 0, ~values, values).max(initial=0)).bit_length() + 1
    return np.stack([np.packbits((values >> b & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")[:, 0] for b in range(bits)], axis=1)


def weights(bits: int) -> np.ndarray:
    """What a bit of each plane counts for."""
    w = np.int64(1) << np.arange(bits, dtype=np.int64)
    w[-1] = -w[-1]
    return w


def dots(planes: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Exact dot products of each vector with one other, by popcounts of ANDed planes."""
    counts = np.bitwise_count(planes[:, :, None] & other).reshape(len(planes), -1)
    return counts.astype(np.int64) @ np.outer(weights(planes.shape[1]), weights(len(other))).ravel()


def unpack_sum(planes: np.ndarray) -> np.ndarray:
    """Component sums of vectors, from the number of set bits in each plane."""
    bits = np.unpackbits(np.ascontiguousarray(planes).view(np.uint8).reshape(len(planes), planes.shape[1], 8), axis=2, bitorder="little")
    return weights(planes.shape[1]) @ bits.sum(axis=0, dtype=np.int64)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not len(batch):
            continue
        values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
        planes = pack(np.floor(values * SCALE).astype(np.int64))
        w = weights(planes.shape[1])
        norm = np.zeros(len(planes), np.int64)
        for i in range(len(w)):
            for j in range(len(w)):
                norm += w[i] * w[j] * np.bitwise_count(planes[:, i] & planes[:, j]).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(planes) + 1) * planes.shape[1], pa.int32()), pa.array(planes.ravel().view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(norm), lists], ["id", "norm", "planes"])


def _planes_of(lists: pa.Array) -> np.ndarray:
    """Planes of a batch; where vectors have fewer than others, the sign is repeated, which changes no value."""
    first = lists.offsets.to_numpy()
    size = np.diff(first)
    at = first[:-1, None] + np.minimum(np.arange(size.max(initial=0)), size[:, None] - 1)
    return lists.values.to_numpy().view(np.uint64)[at]


class Assign:
    """Nearest of ``centroids`` (integer rows) for batches of packed vectors."""

    def __init__(self, centroids: list[list[int]]):
        rows = np.array(centroids, np.int64).reshape(-1, WIDTH)
        self.planes, self.norms = [pack(row[None])[0] for row in rows], [int((row.astype(object) ** 2).sum()) for row in rows]

    def nearest(self, planes: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (the smaller of equals) and the squared distance."""
        distance = np.stack([norm - 2 * dots(planes, c) + n for c, n in zip(self.planes, self.norms)], axis=1)
        best = distance.argmin(axis=1)
        return best, distance[np.arange(len(best)), best]

    def steps(self, batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, len(batch), STEP_ROWS):
                rows = batch.slice(at, STEP_ROWS)
                planes = _planes_of(rows.column("planes"))
                yield rows, planes, *self.nearest(planes, rows.column("norm").to_numpy())

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each centroid that got vectors."""
        k = len(self.norms)
        n, total, inertia = np.zeros(k, np.int64), np.zeros((k, WIDTH), np.int64), [0] * k
        for _, planes, best, distance in self.steps(batches):
            for c in np.unique(best).tolist():
                mine = best == c
                n[c] += mine.sum()
                total[c] += unpack_sum(planes[mine])
                inertia[c] += int(distance[mine].astype(object).sum())
        some = np.flatnonzero(n).tolist()
        yield pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()), pa.array(n[some]), pa.array([Decimal(inertia[c]) for c in some], pa.decimal128(38, 0)), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "inertia", "total"]
        )

    def rows(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, best, distance in self.steps(batches):
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(best, pa.int32()), pa.array(distance)], ["id", "cluster", "distance"])


def _round(packed: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, int, list[int]]]:
    """Count, distance sum and component sums of each centroid's vectors: at most ``k`` rows reach the driver."""
    parts = packed.select("norm", "planes").mapInArrow(Assign(centroids).sums, "cluster int, n long, inertia decimal(38,0), total array<long>")
    sums = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(WIDTH)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *sums).collect()
    return {r.cluster: (r.n, int(r.inertia), [r[f"s{i}"] for i in range(WIDTH)]) for r in rows}


def clusters(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector after ``rounds`` rounds of k-means over whole numbers."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) == WIDTH) & F.forall(v, lambda x: F.coalesce((x >= -LIMIT) & (x < LIMIT) & ~F.isnan(x), F.lit(False)))
    kept = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.coalesce(good, F.lit(False)))
    id_type = vectors.schema[id_col].dataType.simpleString()
    packed = save(kept.mapInArrow(_pack_rows, f"id {id_type}, norm long, planes array<long>"))
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    numbers = F.transform("v", lambda x: F.floor(x * SCALE))
    centroids = [list(r.ints) for r in kept.select(place.alias("place"), numbers.alias("ints")).orderBy("place", "ints").limit(k).collect()]
    for _ in range(rounds if centroids else 0):
        for c, (n, _, total) in _round(packed, centroids).items():
            centroids[c] = [s // n for s in total]
    if not centroids:
        return packed.select("id", F.lit(0).alias("cluster"), F.col("norm").alias("distance"), F.col("norm").alias("cluster_inertia"), F.col("norm").alias("inertia"), F.lit("").alias("centroid_sha256"))
    spread = {c: inertia for c, (_, inertia, _) in _round(packed, centroids).items()}
    number = lambda x: F.lit(x if x < 2**63 else None).cast("long")
    of = lambda values: F.get(F.array(*values), F.col("cluster"))
    digest = [F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids]
    found = packed.mapInArrow(Assign(centroids).rows, f"id {id_type}, cluster int, distance long")
    return found.select("id", "cluster", "distance", of([number(spread.get(c, 0)) for c in range(len(centroids))]).alias("cluster_inertia"), number(sum(spread.values())).alias("inertia"), of(digest).alias("centroid_sha256"))
