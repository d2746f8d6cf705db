"""Centroid clustering of integer vectors with Yinyang bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, mapped, materialize

#: Components beyond this have squared distances that don't fit a long, for up to 64 of them.
LARGEST = 1 << 27
#: Up to this magnitude sums of 64 products are exact in doubles.
EXACT = 1 << 20
#: Bounds are widened by this share, far more than a square root or a sum is off by.
SLACK = 1e-12


def integer_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """(_id, _v): vectors with exactly ``size`` components, none null or non-finite, as integers floor(scale * x)."""
    scaled = lambda x: F.lit(float(scale)) * x.cast("double")
    # NaN is larger than any number here, and a null component makes the condition null, so neither passes.
    fits = F.forall(vector_col, lambda x: F.abs(scaled(x)) <= F.lit(float(LARGEST)))
    rows = table.select(F.col(id_col).alias("_id"), F.col(vector_col).alias(vector_col))
    return rows.filter((F.size(vector_col) == size) & fits).select("_id", F.transform(vector_col, lambda x: F.floor(scaled(x)).cast("int")).alias("_v"))


def seeds(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The ``k`` vectors with the smallest sha256 of ``<seed>:<id>``, in that order; k rows come to the driver."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit("null"))), 256)
    rows = vectors.select(h.alias("h"), "_v").orderBy("h", "_v").limit(k).collect()
    return np.array([r["_v"] for r in rows], np.int64)


def grouped(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """Numbers of the centroids by group: a few rounds of k-means over the centroids themselves, from ones far apart."""
    x = centroids.astype(np.float64)
    chosen = [0]
    for _ in range(1, min(groups, len(x))):
        chosen.append(int(np.min([((x - x[c]) ** 2).sum(1) for c in chosen], axis=0).argmax()))
    middle = x[chosen]
    for _ in range(5):
        of = ((x[:, None] - middle[None]) ** 2).sum(2).argmin(1)
        middle = np.array([x[of == g].mean(0) if (of == g).any() else middle[g] for g in range(len(middle))])
    return [np.flatnonzero(of == g) for g in range(len(middle)) if (of == g).any()]


def squared(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of every value to every centroid (long)."""
    if max(np.abs(values).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT:
        v, c = values.astype(np.float64), centroids.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)).astype(np.int64)
    return np.stack([((values - c) ** 2).sum(1) for c in centroids], axis=1)


def _over(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK)


def _under(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def scan_all(values: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number), upper bound and a lower bound for each group, of values seen first."""
    d = squared(values, centroids)
    own = d.argmin(1)
    rows = np.arange(len(d))
    upper = _over(np.sqrt(d[rows, own]))
    others = d.astype(np.float64)
    others[rows, own] = np.inf
    return own, upper, np.stack([_under(np.sqrt(others[:, g].min(1))) for g in groups], axis=1)


def reassign(values: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray], drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same after the centroids moved by ``drift``, with distances only where the bounds leave a doubt.

    A lower bound holds for the group's centroids but the vector's own. A tie must be seen, so a centroid is passed
    over only where its bound is strictly above the upper one.
    """
    own, upper = own.copy(), _over(upper + drift[own])
    lower = _under(np.maximum(lower - np.array([drift[g].max() for g in groups]), 0))
    open_ = np.flatnonzero(lower.min(1) <= upper)  # the global filter
    mine = np.empty(len(open_), np.int64)
    for at in range(0, len(open_), 4096):
        part = open_[at : at + 4096]
        mine[at : at + 4096] = ((values[part] - centroids[own[part]]) ** 2).sum(1)
    upper[open_] = _over(np.sqrt(mine))
    still = lower[open_].min(1) <= upper[open_]
    rows, best = open_[still], mine[still]
    before, best_of, at_first = own[rows].copy(), own[rows].copy(), best.copy()
    scanned: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for g, members in enumerate(groups):  # the group filter
        k = np.flatnonzero(lower[rows, g] <= _over(np.sqrt(best)))
        if not len(k):
            scanned.append((k, k, k, k))
            continue
        d = squared(values[rows[k]], centroids[members])
        first = d.argmin(1)
        least, number = d[np.arange(len(k)), first], members[first]
        rest = d.astype(np.float64)
        rest[np.arange(len(k)), first] = np.inf
        scanned.append((k, number, least, rest.min(1)))
        better = (least < best[k]) | ((least == best[k]) & (number < best_of[k]))
        best[k[better]], best_of[k[better]] = least[better], number[better]
    group_of = np.empty(len(centroids), np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g
    left = np.flatnonzero(best_of != before)  # what was their own counts for its group from now on
    lower[rows[left], group_of[before[left]]] = np.minimum(lower[rows[left], group_of[before[left]]], _under(np.sqrt(at_first[left])))
    for g, (k, number, least, second) in enumerate(scanned):
        lower[rows[k], g] = _under(np.sqrt(np.where(number == best_of[k], second, least)))
    own[rows], upper[rows] = best_of, _over(np.sqrt(best))
    return own, upper, lower


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    """A column of lists of ``width`` numbers each as a matrix."""
    return np.asarray(column.flatten()).astype(kind).reshape(-1, width)


def clusters(table: DataFrame, k: int = 8, rounds: int = 10, groups: int | None = None, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, scale: int = 1024) -> DataFrame:
    """Per vector: its id under ``id_col``, cluster int, distance, cluster_inertia, inertia long, centroid_sha256 string.

    Vectors are those of ``integer_vectors``; others give no row, and neither do such with a component beyond 2**27
    after scaling, whose distances don't fit a long. Centroids start as ``seeds`` (null ids hash as "null"; of equal
    hashes the smaller vector comes first). Each of ``rounds`` assigns every vector to the nearest centroid by exact
    squared distance (ties: the smaller number) and replaces each centroid that has vectors by their componentwise
    floor(sum / count); then all are assigned once more. With fewer vectors than ``k`` there are as many centroids as
    vectors. Repeated rows are vectors like any others, each with a row of its own. An empty table gives an empty one.
    Other columns aren't read, so their names can't clash. A sum of distances that doesn't fit a long is null.

    Centroids are put into ``groups`` groups (default: a tenth of them, one at least) once. A vector carries an upper
    bound for its own centroid and a lower bound for each group; each round is one pass that reads the vectors with
    their bounds and writes them anew, without a shuffle. Sums change by the vectors that moved only. What comes to the
    driver is k sums of ``size`` numbers a round.
    """
    spark = table.sparkSession
    vectors = materialize(integer_vectors(table, id_col, vector_col, size, scale))
    centroids = seeds(vectors, k, seed)
    kind = table.schema[id_col].dataType
    ids = T.StructField("_id", kind)
    if not len(centroids):
        out = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())])
        return spark.createDataFrame([], out)
    members = grouped(centroids, groups or max(1, len(centroids) // 10))
    state_schema = T.StructType([ids, *(T.StructField(n, t) for n, t in (("_v", T.ArrayType(T.IntegerType())), ("own", T.IntegerType()), ("was", T.IntegerType()), ("moved", T.BooleanType()), ("upper", T.DoubleType()), ("lower", T.ArrayType(T.DoubleType()))))])
    sums, count = np.zeros((len(centroids), size), object), [0] * len(centroids)
    state, drift = vectors, None

    def assigned(b: pa.RecordBatch, now: np.ndarray, moved_by: np.ndarray | None) -> tuple[np.ndarray, ...]:
        values = _matrix(b.column("_v"), np.int64, size)
        if moved_by is None:
            own, upper, lower = scan_all(values, now, members)
            return values, own, np.full(len(own), -1), upper, lower
        was = np.asarray(b.column("own")).astype(np.int64)
        own, upper, lower = reassign(values, was, np.asarray(b.column("upper")), _matrix(b.column("lower"), np.float64, len(members)), now, members, moved_by)
        return values, own, was, upper, lower

    def bounds(now: np.ndarray, moved_by: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    _, own, was, upper, lower = assigned(b, now, moved_by)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * lower.shape[1]), pa.array(lower.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("_v"), pa.array(own, pa.int32()), pa.array(was, pa.int32()), pa.array(own != was), pa.array(upper), lists], [f.name for f in state_schema])

        return run

    def changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the vectors of a task add to each centroid's sums and count (the place after the components)."""
        total = np.zeros((len(centroids), size + 1), np.int64)
        for b in batches:
            if b.num_rows:
                values = np.hstack([_matrix(b.column("_v"), np.int64, size), np.ones((b.num_rows, 1), np.int64)])
                own, was = np.asarray(b.column("own")), np.asarray(b.column("was"))
                for c in range(len(centroids)):
                    total[c] += values[own == c].sum(0) - values[was == c].sum(0)
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(at, pa.int32()), pa.array(total[c, at])], ["c", "at", "x"])

    for _ in range(rounds):
        new = materialize(mapped(state, bounds(centroids, drift), state_schema))
        discard(state)
        state = new
        moved = mapped(state.filter("moved").select("_v", "own", "was"), changes, "c int, at int, x long")
        for r in moved.groupBy("c", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
            if r["at"] == size:
                count[r["c"]] += int(r["x"])
            else:
                sums[r["c"], r["at"]] += int(r["x"])
        after = np.array([[int(x) // n for x in s] if n else list(old) for s, n, old in zip(sums, count, centroids, strict=True)], np.int64)
        drift = _over(np.sqrt(((after - centroids) ** 2).sum(1)))
        centroids = after

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                values, own, *_ = assigned(b, centroids, drift)
                yield pa.RecordBatch.from_arrays([b.column("_id"), pa.array(own, pa.int32()), pa.array(((values - centroids[own]) ** 2).sum(1))], ["_id", "cluster", "distance"])

    found = materialize(mapped(state, last, T.StructType([ids, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])))
    discard(state)
    inertia = {r["cluster"]: int(r["x"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("x")).collect()}
    long = lambda x: F.lit(x if x < 1 << 63 else None).cast("long")
    by_cluster = F.array(*(long(inertia.get(c, 0)) for c in range(len(centroids))))
    texts = F.array(*(F.sha2(F.lit(",".join(map(str, c))), 256) for c in centroids.tolist()))
    return found.select(F.col("_id").alias(id_col), "cluster", "distance", by_cluster[F.col("cluster")].alias("cluster_inertia"), long(sum(inertia.values())).alias("inertia"), texts[F.col("cluster")].alias("centroid_sha256"))
