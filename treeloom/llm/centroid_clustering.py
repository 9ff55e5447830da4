"""Exact integer k-means over subvector dictionaries.

Vectors become integers. Chunks of up to ``CHUNK`` vectors encode each block of ``width`` components
without loss: the chunk keeps the block's distinct subvectors once, and every vector becomes one code
a block. A round works on the dictionaries: the exact squared distance of each distinct subvector to each
centroid's block is computed once in the round, a vector's distance is the sum of its codes' entries,
and the new sums are counts of (cluster, code) times the subvector. Dictionaries belong to a chunk, so a
task's memory depends on CHUNK, width and k alone, whatever the number of distinct subvectors in the table.

Chunks are written once to the shared folder; a round sends k rows of sums from each task, and the driver
holds the k centroids.

Input: (vec_id, embedding). Kept are vectors with exactly ``dims`` components, none null or non-finite; others
have no row in the result. Integers are held within +-LARGEST, so that a distance fits a long: a component
beyond LARGEST / scale counts as that bound. Repeated rows are vectors of their own. A null vec_id is a
vector like any other and hashes as an empty id. Start vectors of equal hash, which only repeated ids can
be, come in the order of their components. A table of fewer vectors than k makes that many centroids, an empty
one an empty result. Further columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMS, SCALE, K, ROUNDS, SEED = 64, 256, 40, 5, 2
WIDTH = 2  # components of a block
CHUNK = 16_384  # vectors that share dictionaries
ROWS = 2_048  # vectors whose distances are held at once
LARGEST = 1 << 27
CHUNKS = "ids binary, nulls binary, subs array<binary>, codes array<binary>"
SUMS = "cluster int, n long, sums array<long>, inertia long"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept_vectors(vectors: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<int>) of the vectors that are kept."""
    x = F.col("embedding")
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    whole = lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int")
    return vectors.filter((F.size(x) == dims) & ~F.exists(x, odd)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("q"))


def start_centroids(kept: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors of the smallest hashes of "seed:vec_id"."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    return np.array([r["q"] for r in kept.select("q", h.alias("h")).orderBy("h", "q").limit(k).collect()], np.int64)


def encoded(q: np.ndarray, ids: pa.Array, width: int) -> tuple:
    """One chunk: the ids, and for each block its distinct subvectors and every vector's code."""
    subs, codes = [], []
    for at in range(0, q.shape[1], width):
        block = np.ascontiguousarray(q[:, at : at + width])
        # one sortable number or byte string for each subvector, so that equal subvectors are equal keys
        key = block.view(np.int64).ravel() if block.shape[1] == 2 else block.view(f"V{4 * block.shape[1]}").ravel()
        _, first, code = np.unique(key, return_index=True, return_inverse=True)
        subs.append(block[first].tobytes())
        codes.append(code.astype(np.uint16 if len(first) <= 1 << 16 else np.uint32).tobytes())
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), np.packbits(ids.is_null().to_numpy(zero_copy_only=False)).tobytes(), subs, codes


def chunked(kept: DataFrame, dims: int = DIMS, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """Chunks of dictionary-encoded vectors; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def row():
            t = pa.Table.from_batches(held).combine_chunks()
            q = t["q"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, dims)
            ids, nulls, subs, codes = encoded(q, t["vec_id"].combine_chunks(), width)
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([nulls], pa.binary()), pa.array([subs], pa.list_(pa.binary())), pa.array([codes], pa.list_(pa.binary()))], names=["ids", "nulls", "subs", "codes"])

        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, chunk - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == chunk:
                    yield row()
                    held, n = [], 0
        if n:
            yield row()

    return kept.mapInArrow(run, CHUNKS)


def opened(row: dict, width: int, dims: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Subvectors and codes of a chunk's blocks."""
    n = len(row["ids"]) // 8
    subs = [np.frombuffer(s, np.int32).reshape(-1, min(width, dims - i * width)).astype(np.int64) for i, s in enumerate(row["subs"])]
    codes = [np.frombuffer(c, np.uint16 if len(c) == 2 * n else np.uint32) for c in row["codes"]]
    return subs, codes


def nearest(subs: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of every vector of a chunk; the smaller number wins a tie."""
    tables, at = [], 0
    for s in subs:
        c = centroids[:, at : at + s.shape[1]]
        tables.append(sum((s[:, d, None] - c[None, :, d]) ** 2 for d in range(s.shape[1])))
        at += s.shape[1]
    n = len(codes[0])
    cluster, distance = np.empty(n, np.int32), np.empty(n, np.int64)
    total = np.empty((ROWS, len(centroids)), np.int64)
    for lo in range(0, n, ROWS):
        hi = min(lo + ROWS, n)
        sums = total[: hi - lo]
        np.take(tables[0], codes[0][lo:hi], axis=0, out=sums, mode="clip")
        for t, c in zip(tables[1:], codes[1:]):
            sums += t[c[lo:hi]]
        cluster[lo:hi] = sums.argmin(axis=1)
        distance[lo:hi] = sums[np.arange(hi - lo), cluster[lo:hi]]
    return cluster, distance


def cluster_sums(chunks: DataFrame, centroids: np.ndarray, width: int, dims: int) -> dict[int, tuple[int, list[int], int]]:
    """{cluster: (vectors, their componentwise sum, their summed distance)} of one assignment; k rows leave a chunk and reach the driver."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                subs, codes = opened(row, width, dims)
                cluster, distance = nearest(subs, codes, centroids)
                sums = []
                for s, c in zip(subs, codes):
                    counts = np.bincount(cluster.astype(np.int64) * len(s) + c, minlength=k * len(s)).reshape(k, len(s))
                    sums.append(counts @ s)
                inertia = np.zeros(k, np.int64)
                np.add.at(inertia, cluster, distance)
                n = np.bincount(cluster, minlength=k)
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(n, pa.int64()), pa.array(list(np.hstack(sums)), pa.list_(pa.int64())), pa.array(inertia)], names=["cluster", "n", "sums", "inertia"])

    rows = chunks.mapInArrow(run, SUMS)
    added = [F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)]]
    return {r["cluster"]: (r["n"], [r[f"s{i}"] for i in range(dims)], r["inertia"]) for r in rows.groupBy("cluster").agg(*added).collect()}


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept vector."""
    kept = written(kept_vectors(vectors, dims, scale), "vectors")
    centroids = start_centroids(kept, k, seed)
    if not len(centroids):
        return kept.sparkSession.createDataFrame([], RESULT)
    chunks = written(chunked(kept, dims, width, chunk), "chunks")
    for _ in range(rounds):
        sums = cluster_sums(chunks, centroids, width, dims)
        centroids = np.array([[s // sums[c][0] for s in sums[c][1]] if sums[c][0] else old.tolist() for c, old in enumerate(centroids)], np.int64)
    inertia = [sums[2] for _, sums in sorted(cluster_sums(chunks, centroids, width, dims).items())]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, distance = nearest(*opened(row, width, dims), centroids)
                n = len(found)
                null = np.unpackbits(np.frombuffer(row["nulls"], np.uint8), count=n).astype(bool)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=null)
                yield pa.RecordBatch.from_arrays([ids, pa.array(found), pa.array(distance), pa.array(np.array(inertia)[found]), pa.array(np.full(n, sum(inertia))), pa.array(np.array(hashes)[found].tolist(), pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    return chunks.mapInArrow(run, RESULT)
