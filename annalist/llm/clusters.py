"""Centroid clustering of whole-number vectors with block-norm screening.

Each vector is stored once with its segment norms, a compressed copy of four bits a component, and the norms of what the
compression leaves of each segment. By Cauchy and Schwarz a segment's inner product with a centroid's is at most the
product of their norms, and at most that of the compressed segment plus the product of the rest's norm and the
centroid's. The smaller of both, summed over segments, gives a lower bound of the distance to each centroid. The
centroid of the least bound is measured first; those whose bound is above its distance are pruned, and only the others
receive exact integer distances.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm.common import drop_settled, map_batches, settle, table
from annalist.llm.vectors import LARGEST, finite, matrix, squared_distances, whole

DIMENSIONS, CLUSTERS, ROUNDS, SEED = 64, 40, 5, 2
#: Components of a segment, and bits of a compressed component.
SEGMENT, BITS = 8, 4
#: Vectors measured at once.
AT_ONCE = 4096
#: Bounds give way by this share of the norms, far more than doubles lose.
SLACK = 1e-9
_LOW = 31  # sums of components are held in two halves of so many bits, so that no sum overflows


def segment_norms(x: np.ndarray) -> np.ndarray:
    """The norm of each segment of each row; the last segment may be shorter."""
    starts = np.arange(0, x.shape[1], SEGMENT)
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, starts, axis=1))


def compress(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: its codes of BITS bits, the step that they count, and the segment norms of what the middle of their steps leaves."""
    top = np.abs(x.astype(np.float64)).max(axis=1)
    step = np.exp2(np.maximum(np.frexp(top)[1] - (BITS - 1), 0))
    codes = np.clip(np.floor(x / step[:, None]), -(1 << (BITS - 1)), (1 << (BITS - 1)) - 1)
    return codes.astype(np.int8), step, segment_norms(x - (codes + 0.5) * step[:, None])


def prepare(vectors: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, x, norms, codes, step and rests of the usable rows of vectors (vec_id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            x = matrix(batch.column(1))
            codes, step, rests = compress(x)
            yield {"vec_id": batch.column(0), "x": batch.column(1), "norms": list(segment_norms(x)), "codes": list(codes), "step": step, "rests": list(rests)}

    rows = vectors.where((F.size("vector") == dimensions) & finite(F.col("vector"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole(F.col("vector")).alias("x"))
    return map_batches(rows, run, "vec_id long, x array<long>, norms array<double>, codes array<byte>, step double, rests array<double>")


def lower_bounds(codes: np.ndarray, step: np.ndarray, norms: np.ndarray, rests: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """For each vector and centroid a number that their squared distance isn't below."""
    c = centroids.astype(np.float64)
    c_norms = segment_norms(c)
    inner = np.zeros((len(codes), len(c)))
    for s in range(norms.shape[1]):
        of = slice(s * SEGMENT, (s + 1) * SEGMENT)
        coded = ((codes[:, of] + 0.5) @ c[:, of].T) * step[:, None] + rests[:, s, None] * c_norms[None, :, s]
        inner += np.minimum(coded, norms[:, s, None] * c_norms[None, :, s])
    squares = (norms**2).sum(axis=1)[:, None] + (c_norms**2).sum(axis=1)[None, :]
    return squares * (1 - SLACK) - 2 * inner - 1


def nearest(x: np.ndarray, codes: np.ndarray, step: np.ndarray, norms: np.ndarray, rests: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each vector its nearest centroid (ties: the smaller number), the exact squared distance and how many centroids were measured."""
    bounds = lower_bounds(codes, step, norms, rests, centroids)
    first = bounds.argmin(axis=1)
    reach = squared_distances(x, centroids[first])
    rows, at = np.nonzero(bounds <= reach.astype(np.float64)[:, None] * (1 + SLACK))
    measured = squared_distances(x[rows], centroids[at])
    # of each row the least distance, then the smallest number; every row holds its first centroid at least
    order = np.lexsort((at, measured, rows)) if measured.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (rows[i], measured[i], at[i])))
    found = order[np.searchsorted(rows[order], np.arange(len(x)))]
    return at[found], measured[found], np.bincount(rows, minlength=len(x))


def _assigned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, AT_ONCE):
            ids, x, norms, codes, step, rests = batch.slice(start, AT_ONCE).columns
            x = matrix(x)
            yield (ids, x, *nearest(x, matrix(codes), np.asarray(step), matrix(norms), matrix(rests), centroids))


def moved(prepared: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round. Each task adds up its own vectors; what is shuffled are a row for each task, cluster and component."""
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, high, low = np.zeros(k, dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64), np.zeros((k, dimensions), dtype=np.int64)
        for _, x, cluster, _, _ in _assigned(batches, centroids):
            for c in np.unique(cluster):
                own = x[cluster == c]
                n[c] += len(own)
                high[c] += (own >> _LOW).sum(axis=0)
                low[c] += (own & ((1 << _LOW) - 1)).sum(axis=0)
        of, at = np.repeat(np.arange(k), dimensions), np.tile(np.arange(dimensions), k)
        some = n[of] > 0
        yield {"cluster": of[some].astype(np.int32), "at": at[some].astype(np.int32), "n": n[of][some], "high": high.ravel()[some], "low": low.ravel()[some]}

    sums = map_batches(prepared, run, "cluster int, at int, n long, high long, low long").groupBy("cluster", "at").agg(*(F.sum(c).alias(c) for c in ("n", "high", "low")))
    out = centroids.copy()
    for r in sums.collect():  # clusters by components, at most
        out[r["cluster"], r["at"]] = ((r["high"] << _LOW) + r["low"]) // r["n"]
    return out


def first_centroids(prepared: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors of the smallest hashes of `seed:vec_id`, ties by components; rows without an id come last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    chosen = prepared.select(key.alias("key"), "x").orderBy(F.asc_nulls_last("key"), "x").limit(clusters).collect()
    return np.array([r["x"] for r in chosen], dtype=np.int64)


def cluster_vectors(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 and measured for each usable row of vectors (vec_id, vector).

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Components are
    floor(256 * x), within 2^62 either way; distances and sums over a long's largest value are told as that value.
    measured: the centroids that the vector's last assignment didn't prune. Repeated rows, and rows without an id, each
    count and get a row; rows without an id become first centroids only where others don't suffice. Fewer vectors than
    clusters make fewer clusters, and an empty table gives no rows. Other columns are passed over.
    """
    prepared = settle(prepare(vectors, dimensions), "prepared")
    centroids = first_centroids(prepared, clusters, seed)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(prepared, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for ids, _, cluster, distance, measured in _assigned(batches, centroids):
            told = distance if distance.dtype != object else np.array([min(d, LARGEST) for d in distance], dtype=np.int64)
            yield {"vec_id": ids, "cluster": cluster.astype(np.int32), "distance": told, "measured": measured.astype(np.int32)}

    found = settle(map_batches(prepared, run, "vec_id long, cluster int, distance long, measured int"), "assigned")
    drop_settled(prepared)
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(sums.values()), LARGEST)
    told = [(k, min(s, LARGEST), hashlib.sha256(",".join(map(str, centroids[k].tolist())).encode()).hexdigest()) for k, s in sorted(sums.items())]
    of = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, centroid_sha256 string")
    joined = found.join(F.broadcast(of), "cluster")  # a row for each cluster
    return joined.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256", "measured")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))).drop("measured")
