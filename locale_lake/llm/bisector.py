"""Centroid clustering whose assignments are tournaments of bisecting hyperplanes."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locale_lake.llm import integers
from locale_lake.session import cut_lineage

# Rows of one tournament: the normals of their champions are gathered at once.
ROWS = 4096
# Sums travel as digits of this many bits, so they have no largest value.
_DIGIT = 60


class Bisectors:
    """Normals and thresholds of all centroid pairs, and the tournament over them.

    For i < j a vector x is nearer to j exactly if 2 (c_j - c_i) x > c_j^2 - c_i^2; at
    equality the smaller number wins. All values are integers.
    """

    def __init__(self, centroids: list[list[int]], large: bool):
        self.large = large or max((abs(v) for c in centroids for v in c), default=0) > integers.NARROW
        kind = object if self.large else np.int64
        self.centroids = np.array(centroids, dtype=kind).reshape(len(centroids), -1)
        squares = (self.centroids * self.centroids).sum(axis=1)
        self.normals = 2 * (self.centroids[None, :, :] - self.centroids[:, None, :])  # [i, j]
        self.thresholds = squares[None, :] - squares[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """Number of the nearest centroid by k - 1 sign tests a vector."""
        out = np.zeros(len(x), dtype=np.int64)
        for start in range(0, len(x), ROWS):
            rows = x[start : start + ROWS]
            champion = out[start : start + ROWS]
            for j in range(1, len(self.centroids)):
                side = np.zeros(len(rows), dtype=self.centroids.dtype)
                for i in np.unique(champion).tolist():  # all vectors of one champion share the test
                    of = np.flatnonzero(champion == i)
                    side[of] = rows[of] @ self.normals[i, j] - self.thresholds[i, j]
                champion[side > 0] = j
        return out

    def distances(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        apart = x - self.centroids[cluster]
        return (apart * apart).sum(axis=1)


def _assigned(batches: Iterator[pa.RecordBatch], centroids: list[list[int]], scale: int):
    """Each batch with its vectors and the number of each one's centroid."""
    dims = len(centroids[0])
    known: dict[bool, Bisectors] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = integers.matrix(batch.column("q"), batch.column("wide"), scale, dims)
        large = x.dtype == object
        if large not in known:
            known[large] = Bisectors(centroids, large)
        if known[large].large:
            x = x.astype(object)
        yield batch, x, known[large], known[large].nearest(x)


def _digits(value: int) -> Iterator[tuple[int, int]]:
    sign, rest, place = (-1 if value < 0 else 1), abs(int(value)), 0
    while rest:
        yield place, sign * (rest & ((1 << _DIGIT) - 1))
        rest, place = rest >> _DIGIT, place + 1


SUMS = "cluster int, place int, digit int, total decimal(38,0)"


def _sums(centroids: list[list[int]], scale: int):
    """Per task and cluster the sum of each component and, at place -1, the number of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [[0] * len(centroids[0]) for _ in centroids]
        counts = [0] * len(centroids)
        for _, x, _, cluster in _assigned(batches, centroids, scale):
            for c in np.unique(cluster).tolist():
                of = x[cluster == c]
                counts[c] += len(of)
                totals[c] = [a + int(b) for a, b in zip(totals[c], of.sum(axis=0), strict=True)]
        rows = [
            (c, place, digit, Decimal(value))
            for c, n in enumerate(counts)
            if n
            for place, total in [(-1, n), *enumerate(totals[c])]
            for digit, value in _digits(total)
        ]
        columns = list(zip(*rows, strict=True)) or [[], [], [], []]
        types = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["cluster", "place", "digit", "total"])

    return run


def _moved(vectors: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Every centroid that has vectors becomes the floor of their mean; k x dims sums reach the driver."""
    sums = vectors.mapInArrow(_sums(centroids, scale), SUMS).groupBy("cluster", "place", "digit").agg(F.sum("total").alias("total"))
    found: dict[tuple[int, int], int] = {}
    for row in sums.collect():
        at = (row["cluster"], row["place"])
        found[at] = found.get(at, 0) + (int(row["total"]) << (_DIGIT * row["digit"]))
    return [
        [found.get((c, d), 0) // found[c, -1] for d in range(len(old))] if (c, -1) in found else old for c, old in enumerate(centroids)
    ]


def _told(centroids: list[list[int]], scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, bisectors, cluster in _assigned(batches, centroids, scale):
            apart = bisectors.distances(x, cluster)
            exact = [Decimal(min(int(d), 10**38 - 1)) for d in apart.tolist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column("vec_id"),
                    "cluster": pa.array(cluster, pa.int32()),
                    "apart": pa.array(exact, pa.decimal128(38, 0)),
                }
            )

    return run


def _long(value):
    return F.least(value, F.lit(Decimal(integers.MOST))).cast("bigint")


def clustered(vectors: DataFrame, k: int = 40, rounds: int = 5, scale: int = 256, dims: int = 64, seed: str = "2") -> DataFrame:
    """Lloyd's rounds over exact integers; each assignment is a tournament over bisectors.

    Vectors with exactly ``dims`` components, none null, NaN or infinite, become
    floor(scale x component). The k of them with the least hex SHA-256 of
    ``seed:vec_id`` are the first centroids (vectors of one id rank by content, those
    without id last; fewer than k vectors are all centroids). In each round every
    vector goes to its nearest centroid, the smaller number at equal distance, and
    every centroid that has vectors becomes the floor of their mean, component by
    component. A last assignment follows.

    Normals and thresholds of the bisecting hyperplanes of all pairs are made once a
    round; a vector passes k - 1 sign tests, and only the winner's distance is worked
    out. Per round k x dims sums, made in the tasks first, reach the driver.

    Returns vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256 for each vector that takes part, repeated rows each; distances and
    sums beyond a BIGINT show its largest value. Other columns are ignored; an empty
    table gives no rows.
    """
    kept = cut_lineage(integers.quantised(vectors, scale, dims=dims))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(digest.asc_nulls_last(), "q", "wide").limit(k).collect()
    centroids = [list(r["q"]) if r["q"] is not None else [integers.exact_floor(v, scale) for v in r["wide"]] for r in first]
    if not centroids:
        centroids = [[0] * dims]  # no vector, so no row either
    for _ in range(rounds):
        centroids = _moved(kept, centroids, scale)
    id_type = kept.schema["vec_id"].dataType.simpleString()
    told = cut_lineage(kept.mapInArrow(_told(centroids, scale), f"vec_id {id_type}, cluster int, apart decimal(38,0)"))
    per_cluster = told.groupBy("cluster").agg(F.sum("apart").alias("cluster_sum"))
    hashes = [(c, sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    sums = {r["cluster"]: int(r["cluster_sum"]) for r in per_cluster.collect()}  # k rows
    of_cluster = kept.sparkSession.createDataFrame(
        [(c, h, min(sums.get(c, 0), integers.MOST), min(sum(sums.values()), integers.MOST)) for c, h in hashes],
        "cluster int, centroid_sha256 string, cluster_inertia bigint, inertia bigint",
    )
    return told.join(F.broadcast(of_cluster), "cluster").select(  # k rows
        "vec_id", "cluster", _long(F.col("apart")).alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )
