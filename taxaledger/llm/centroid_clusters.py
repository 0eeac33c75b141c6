"""Lloyd's clustering of integer vectors with simplex bounds in place of most distances.

Components become ``floor(scale * x)``. A few of the first centroids serve as
pivots: each vector's distances to them are worked out once and kept, as apex
coordinates, in a written table. In every round the bounds between the apexes
of vectors and centroids rule centroids out; those left are compared by exact
integer distance. A task sends the sums and the count of each centroid's
vectors, so what is shuffled in a round does not grow with the rows of a task,
and what reaches the driver is ``k`` rows of sums.

Vectors that many rows share are ordinary rows here: nothing is grouped by
vector, and a round's result is one sum.

Defined results: vectors that are null, of another length, or hold a null or
non-finite component are left out. Components beyond ``MOST`` (2**26 after
scaling) count as ``MOST``, so that no sum of squares leaves 64 bits. Equal ids
are separate rows; null ids come last in the choice of first centroids, equal
ids and null ids among themselves by their components. With fewer kept vectors
than ``k`` each is a centroid; without any the result is empty. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaledger.llm.simplex_bounds import Base, nearest, spread_pivots
from taxaledger.session import write_stage

SCALE = 256
DIMENSIONS = 64
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 8
SALT = "2:"

#: Largest absolute component: (2 * 2**26)**2 * 64 is 2**60.
MOST = 1 << 26

#: Vectors that one Python step holds at once.
ROWS = 8192


@dataclass(frozen=True)
class Model:
    """``base``: simplex of the pivots; ``centroids``: (k, dimensions) integers."""

    base: Base
    centroids: np.ndarray


def integer_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    x = F.col(vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    as_int = F.transform(x, lambda c: F.greatest(F.lit(-MOST).cast("double"), F.least(F.lit(MOST).cast("double"), F.floor(c * SCALE).cast("double"))).cast("int"))
    return vectors.filter((F.size(x) == dimensions) & whole).select(F.col(id_col).cast("long").alias("vec_id"), as_int.alias("v"))


def first_centroids(kept: DataFrame, k: int = CENTROIDS, salt: str = SALT) -> np.ndarray:
    """The ``k`` vectors whose salted ids have the smallest hashes; a top-k, so ``k`` rows of each task move."""
    hashed = kept.select(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("hash"), "v")
    rows = hashed.orderBy(F.col("hash").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(kind)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def with_apexes(kept: DataFrame, base: Base) -> DataFrame:
    """``kept`` with its apex coordinates, written: the distances to the pivots are worked out here only."""
    held = kept.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            apexes = held.value.apexes(_matrix(part.column("v"), np.int64))
            lists = pa.ListArray.from_arrays(np.arange(len(apexes) + 1, dtype=np.int32) * apexes.shape[1], apexes.ravel())
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), lists], ["vec_id", "v", "apex"])

    return write_stage(kept.mapInArrow(run, "vec_id long, v array<int>, apex array<double>"))


def _sums(placed: DataFrame, model: Model) -> DataFrame:
    """(cluster, n, dim, total): one row per task, centroid and dimension, added up."""
    held = placed.sparkSession.sparkContext.broadcast((model.centroids, model.base.apexes(model.centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, apexes = held.value
        k, dims = centroids.shape
        totals, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for part in _parts(batches):
            v = _matrix(part.column("v"), np.int64)
            number, _, _ = nearest(v, _matrix(part.column("apex"), np.float64), centroids, apexes)
            np.add.at(totals, number, v)
            counts += np.bincount(number, minlength=k)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({
            "cluster": pa.array(np.repeat(used, dims), pa.int32()), "dim": pa.array(np.tile(np.arange(dims), len(used)), pa.int32()),
            "n": pa.array(np.repeat(counts[used], dims), pa.int64()), "total": pa.array(totals[used].ravel(), pa.int64()),
        })

    return placed.mapInArrow(run, "cluster int, dim int, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def next_centroids(placed: DataFrame, model: Model) -> Model:
    """Each centroid with vectors moves to the floor of their mean."""
    moved = model.centroids.copy()
    for r in _sums(placed, model).collect():  # at most k * dimensions rows
        moved[r["cluster"], r["dim"]] = int(r["total"]) // r["n"]
    return Model(model.base, moved)


def assign(placed: DataFrame, model: Model) -> DataFrame:
    """(vec_id, cluster, distance) of every row."""
    held = placed.sparkSession.sparkContext.broadcast((model.centroids, model.base.apexes(model.centroids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, apexes = held.value
        for part in _parts(batches):
            number, best, _ = nearest(_matrix(part.column("v"), np.int64), _matrix(part.column("apex"), np.float64), centroids, apexes)
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(number, pa.int32()), pa.array(best, pa.int64())], ["vec_id", "cluster", "distance"])

    return placed.mapInArrow(run, "vec_id long, cluster int, distance long")


def fit(placed: DataFrame, base: Base, centroids: np.ndarray, rounds: int = ROUNDS) -> Model:
    model = Model(base, centroids)
    for _ in range(rounds):
        model = next_centroids(placed, model)
    return model


def cluster(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    k: int = CENTROIDS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, pivots: int = PIVOTS, salt: str = SALT,
) -> tuple[DataFrame, Model | None]:
    """((vec_id, cluster, distance) of every vector that takes part, the model; none without vectors)."""
    kept = write_stage(integer_vectors(vectors, id_col, vector_col, dimensions))
    start = first_centroids(kept, k, salt)
    if not len(start):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), None
    base = Base(start[spread_pivots(start, pivots)])
    placed = with_apexes(kept, base)
    model = fit(placed, base, start, rounds)
    return assign(placed, model), model


def digests(vectors: DataFrame) -> DataFrame:
    """The clustering with inertias and the digest of each row's centroid."""
    found, model = cluster(vectors)
    spark = vectors.sparkSession
    found = write_stage(found)
    per = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).withColumn("inertia", found.agg(F.sum("distance").alias("x")).scalar())
    names = [(c, ",".join(map(str, row.tolist()))) for c, row in enumerate(model.centroids)] if model else []
    per = per.join(spark.createDataFrame(names, "cluster int, text string"), "cluster").select("cluster", "cluster_inertia", "inertia", F.sha2("text", 256).alias("centroid_sha256"))
    # One row per centroid: bounded by k.
    return found.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
