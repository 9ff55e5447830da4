"""Embedding near-dedup on robust-pruned flat graphs.

1. Vectors are scaled to length one; equal directions are one row with a count.
2. Every vector goes to its ``OVERLAP`` nearest clusters, but not to one that no vector
   within the threshold can have as its nearest; centres that are within the threshold of
   each other are one cluster, so a mass of near copies is not cut. A cluster with more
   than ``SHARD_ROWS`` members is cut again by centres of its own. A shard that cutting does
   not thin is compared whole, in pairs of blocks; any other is one task's group.
3. In each shard a flat graph is built: candidates of each vector are pruned robustly (a
   candidate that is closer to a kept neighbour than to the vector itself goes). Adjacency
   lists of one vector from all its shards are united, so a shard's graph also has the
   edges that other shards found.
4. Every vector is searched in each of its shards: a greedy walk from the medoids, and
   from where it ends an expansion through every vector within the range. Cosines are
   computed in double precision, and only those at or above the threshold count.
5. Recall is audited against brute force over all rows for a fixed set of vectors; below
   the target the overlap is raised and the search repeated. If the last overlap finds
   less than ``LEAST_RECALL``, all vectors are compared in pairs of blocks.

A pair that shares several shards is counted in the first of them. Shards send counts and
a spanning forest, never all pairs.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, written
from .components import components
from .simhash import Forest

SHARD_ROWS = 2048
TARGET_ROWS = 600
OVERLAP = 3
MOST_OVERLAP = 5
SAMPLE = 20_000  # rows that the centres are fitted on
MOST_CENTRES = 1024
MOST_LEVELS = 8
PIECE_ROWS = 10_000  # rows that meet a shard's centres in one call
AUDIT = 2000  # vectors searched by brute force over all rows
AUDIT_ROWS = 2048  # that meet them at once
RECALL = 0.98
LEAST_RECALL = 0.9  # of the last overlap
THINNED = 0.9  # a shard that keeps more of the rows it was cut from than this is not cut again
BLOCK_ROWS = 4096  # rows of a shard that is compared whole that meet as many others in one task
WHOLE = "!"  # first letter of such a shard's name, before all others in order
DEGREE, POOL, ALPHA = 24, 48, 1.2
BEAM, MEDOIDS = 16, 8


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, unit): the vector scaled to length one in double precision, null if it has no direction."""
    schema = "id long, unit binary"

    def scaled(x) -> bytes | None:
        if x is None or any(v is None for v in x):
            return None
        v = np.asarray(x, np.float64)
        if not len(v) or not np.isfinite(v).all() or not v.any():
            return None
        v = v / np.abs(v).max()
        return (v / np.sqrt((v * v).sum())).tobytes()

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([scaled(x) for x in part.column(1).to_pylist()], pa.binary())], names=["id", "unit"])

    return vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), F.col(vector_col)).mapInArrow(run, schema)


def matrix(column) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def centres_of(x: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(steps):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-300), c)
    return c


def clusters_of(c: np.ndarray, threshold: float) -> np.ndarray:
    """The cluster of each centre: centres are linked at the threshold, clusters are numbered from 0."""
    near = c @ c.T >= threshold
    np.fill_diagonal(near, True)
    label = np.arange(len(c))
    while True:
        least = np.where(near, label, len(c)).min(axis=1)
        if (least == label).all():
            return np.unique(label, return_inverse=True)[1]
        label = least


def nearest_clusters(x: np.ndarray, c: np.ndarray, cluster: np.ndarray, overlap: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cluster) of each row's nearest clusters.

    A vector y whose nearest centre is b has y (a - b) <= 0 for every centre a, so a row x within the threshold of y
    has x (a - b) <= |x - y| |a - b|. Clusters of which no centre b allows that, a being the row's nearest, are left out.
    """
    order = np.argsort(cluster, kind="stable")
    c, cluster = c[order], cluster[order]
    first = np.flatnonzero(np.concatenate(([True], cluster[1:] != cluster[:-1])))
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) * np.sqrt(np.maximum(0, 2 - 2 * c @ c.T)) + 1e-9
    rows, found = [], []
    for k in range(0, len(x), 1000):
        s = x[k : k + 1000] @ c.T
        home = np.argmax(s, axis=1)
        allowed = np.logical_or.reduceat(s[np.arange(len(s)), home][:, None] - s <= reach[home], first, axis=1)
        best = np.where(allowed, np.maximum.reduceat(s, first, axis=1), -np.inf)
        near = np.argsort(-best, axis=1, kind="stable")[:, :overlap]
        r, at = np.nonzero(np.take_along_axis(allowed, near, 1))
        rows.append(r + k)
        found.append(near[r, at])
    return np.concatenate(rows), np.concatenate(found)


SHARD_ROW = "shard string, id long, unit binary, copies long"


def shards_of(one: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """(shard, id, unit, copies): each vector in several shards, of much more than SHARD_ROWS rows only where the name starts with WHOLE.

    The first level has at most MOST_CENTRES centres, fitted on SAMPLE rows; each level below cuts the
    shards that are too large by centres fitted on SAMPLE / 10 of their own rows. A shard that is cut is
    dealt out in pieces of PIECE_ROWS, each of which meets the shard's centres once. A shard stays whole if
    all its centres are one cluster, if it kept more than THINNED of the rows that it was cut from, or if it is
    still too large after MOST_LEVELS. With overlap 0 nothing is cut.
    """
    base = one.withColumn("shard", F.octet_length("unit").cast("string"))  # vectors of other lengths are other spaces
    if not overlap:
        return base.select(F.concat(F.lit(WHOLE), "shard").alias("shard"), "id", "unit", "copies")

    def centres(key, data):
        x = matrix(data["unit"])
        order = np.argsort(np.array(data["unit"].to_pylist(), object), kind="stable")
        k = int(min(MOST_CENTRES, max(2, -(-data["members"][0].as_py() // TARGET_ROWS))))
        return pa.table({"shard": pa.array([key[0].as_py()]), "members": data["members"].slice(0, 1), "centres": pa.array([centres_of(x[order], k).tobytes()], pa.binary())})

    def dealt(key, rows, fitted):
        x = matrix(rows["unit"])
        if not len(x):
            return rows.select(["shard", "id", "unit", "copies"]).slice(0, 0)
        c = np.frombuffer(fitted["centres"][0].as_py(), np.float64).reshape(-1, x.shape[1]) if fitted.num_rows else x[:1]
        cluster = clusters_of(c, threshold)
        if not cluster.any():
            return pa.table([pa.array([WHOLE + key[0].as_py()] * len(x)), *[rows[n] for n in ("id", "unit", "copies")]], names=["shard", "id", "unit", "copies"])
        take, near = nearest_clusters(x, c, cluster, overlap, threshold)
        names = pa.array([f"{key[0].as_py()}.{k}" for k in near.tolist()])
        return pa.table([names, *[rows[n].take(pa.array(take)) for n in ("id", "unit", "copies")]], names=["shard", "id", "unit", "copies"])

    before = None
    for level in range(MOST_LEVELS + 1):
        large = base.filter(~F.col("shard").startswith(WHOLE)).groupBy("shard").agg(F.count("*").alias("members")).filter(F.col("members") > SHARD_ROWS)
        whole = F.lit(level == MOST_LEVELS)
        if before is not None:
            large = large.withColumn("parent", F.regexp_replace("shard", r"\.[^.]*$", "")).join(before, "parent")
            whole = whole | (F.col("members") > THINNED * F.col("of"))
        large = written(large.select("shard", "members", whole.alias("whole")), "large")
        if large.isEmpty():
            break
        before = large.select(F.col("shard").alias("parent"), F.col("members").alias("of"))
        stays = base.join(large, "shard", "left").filter(F.coalesce("whole", F.lit(True)))
        stays = stays.select(F.when(F.col("whole"), F.concat(F.lit(WHOLE), "shard")).otherwise(F.col("shard")).alias("shard"), "id", "unit", "copies")
        keyed = base.join(large.filter("not whole"), "shard")
        most = SAMPLE if level == 0 else SAMPLE // 10
        share = F.pmod(F.xxhash64("unit"), F.lit(1 << 20)) < F.lit(float(most)) / F.col("members") * (1 << 20)
        fitted = written(keyed.filter(share).groupBy("shard").applyInArrow(centres, "shard string, members long, centres binary"), "centres")
        pieces = F.ceil(F.col("members") / PIECE_ROWS)
        left = keyed.withColumn("piece", F.pmod(F.xxhash64("id"), pieces)).select("shard", "piece", "id", "unit", "copies")
        right = fitted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).select("shard", "piece", "centres")
        cut = left.groupBy("shard", "piece").cogroup(right.groupBy("shard", "piece")).applyInArrow(dealt, SHARD_ROW)
        base = written(stays.unionByName(cut), "shards")
    return base.select("shard", "id", "unit", "copies")


def robust_prune(s: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Neighbour lists (rows of positions, -1: none) from a shard's cosines.

    The nearest candidate is kept, candidates that are alpha times closer to it than to the vector are dropped, and so on.
    """
    n = len(s)
    k = min(pool, n - 1)
    far = 1 - s
    np.fill_diagonal(far, np.inf)
    cand = np.argpartition(far, k - 1, axis=1)[:, :k]
    d = np.take_along_axis(far, cand, 1)
    order = np.argsort(d, axis=1, kind="stable")
    cand, d = np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1)
    np.fill_diagonal(far, 0)
    alive = np.ones(cand.shape, bool)
    out = np.full((n, min(degree, k)), -1, np.int32)
    rows = np.arange(n)
    for r in range(out.shape[1]):
        first = np.argmax(alive, axis=1)
        has = alive[rows, first]
        if not has.any():
            break
        kept = cand[rows, first]
        out[has, r] = kept[has]
        alive[rows, first] = False
        alive &= ~((alpha * far[kept[:, None], cand] <= d) & has[:, None])
    return out


def medoids(s: np.ndarray) -> np.ndarray:
    """Starting points: the vector nearest to all, then those farthest from the ones taken."""
    out = [int(np.argmax(s.sum(axis=1)))]
    near = s[out[0]].copy()
    while len(out) < min(MEDOIDS, len(s)):
        out.append(int(np.argmin(near)))
        near = np.maximum(near, s[out[-1]])
    return np.array(out)


def searched(x: np.ndarray, graph: list[np.ndarray], starts: np.ndarray, threshold: float) -> list[np.ndarray]:
    """For each row of x, the rows within the threshold that the search reaches (itself left out)."""
    out = []
    for q in range(len(x)):
        seen = np.zeros(len(x), bool)
        best, value = starts, x[starts] @ x[q]
        seen[starts] = True
        todo = list(starts)
        while True:  # greedy walk: the beam's best unvisited row is expanded until none is left
            fresh = [b for b in best.tolist() if b in todo] if todo else []
            if not fresh or value[0] >= threshold:
                break
            node = fresh[0]
            todo.remove(node)
            near = graph[node][~seen[graph[node]]]
            if len(near):
                seen[near] = True
                best, value = np.concatenate((best, near)), np.concatenate((value, x[near] @ x[q]))
                keep = np.argsort(-value, kind="stable")[:BEAM]
                todo = [t for t in (*todo, *near.tolist()) if t in set(best[keep].tolist())]
                best, value = best[keep], value[keep]
        front = np.unique(np.append(best[value >= threshold], q))  # the range expands through every row within it
        within = np.zeros(len(x), bool)
        within[front] = True
        seen[front] = True
        while len(front):
            near = np.unique(np.concatenate([graph[f] for f in front.tolist()]))
            near = near[~within[near]]
            front = near[x[near] @ x[q] >= threshold] if len(near) else near
            within[front] = True
        within[q] = False
        out.append(np.flatnonzero(within))
    return out


def spanning(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of a spanning forest of the links between rows and columns."""
    sides = hit, np.ascontiguousarray(hit.T)
    free = [np.ones(n, bool) for n in hit.shape]
    out: tuple[list, list] = ([], [])
    for start in range(len(hit)):
        todo = [(0, start)] if free[0][start] else []
        free[0][start] = False
        while todo:
            side, at = todo.pop()
            got = np.flatnonzero(sides[side][at] & free[1 - side])
            free[1 - side][got] = False
            out[side].append(np.full(len(got), at))
            out[1 - side].append(got)
            todo += [(1 - side, g) for g in got.tolist()]
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def block_links(members: DataFrame, threshold: float) -> DataFrame:
    """(a, b, n) as of ``links`` for shards that are compared whole: every pair of blocks of BLOCK_ROWS is one group."""
    sizes = members.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    rows = members.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("shard", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "block", "id", "unit", "copies", "shards")

    def compare(key, data):
        here, p, q = (k.as_py() for k in key)
        block = data["block"].to_numpy()
        sides = []
        for at in (np.flatnonzero(block == p), np.flatnonzero(block == q)):
            side = data.take(pa.array(at))
            earlier: dict[str, list[int]] = {}  # shards that come first and may hold the same pair
            for i, shards in enumerate(side["shards"].to_pylist()):
                for s in shards:
                    if s < here:
                        earlier.setdefault(s, []).append(i)
            sides.append((matrix(side["unit"]) if len(at) else None, side["id"].to_numpy(), side["copies"].to_numpy(), earlier))
        (x, ids, copies, first), (y, others, other_copies, second) = sides
        if x is None or y is None:
            return pa.table({n: pa.array([], pa.int64()) for n in "abn"})
        hit = np.concatenate([x[k : k + 512] @ y.T >= threshold for k in range(0, len(x), 512)])
        if p == q:
            hit &= ids[:, None] != others[None, :]
        a, b = spanning(hit)
        for s in first.keys() & second.keys():
            hit[np.ix_(first[s], second[s])] = False
        n = [np.concatenate([hit[k : k + 512] @ other_copies for k in range(0, len(hit), 512)])]
        seen = [ids]
        if p != q:
            n.append(sum(copies[k : k + 512] @ hit[k : k + 512] for k in range(0, len(hit), 512)))
            seen.append(others)
        left, right = np.concatenate((*seen, ids[a])), np.concatenate((*seen, others[b]))
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64()), "n": pa.array(np.concatenate((*n, np.zeros(len(a), np.int64))), pa.int64())})

    return rows.groupBy("shard", "p", "q").applyInArrow(compare, "a long, b long, n long")


def links(vectors: DataFrame, threshold: float, overlap: int) -> tuple[DataFrame, DataFrame]:
    """((id, n) linked others by distinct vector, forest edges (a, b)) for vectors(id, unit, copies)."""
    members = shards_of(vectors, overlap, threshold)
    shards = members.groupBy("id").agg(F.array_sort(F.collect_list("shard")).alias("shards"))  # at most overlap ** levels
    members = written(members.join(shards, "id"), "members")
    whole, members = members.filter(F.col("shard").startswith(WHOLE)), members.filter(~F.col("shard").startswith(WHOLE))

    def build(key, data):
        x, ids = matrix(data["unit"]), np.array(data["id"].to_pylist(), np.int64)
        if len(x) < 2:
            return pa.table({"id": pa.array(ids), "near": pa.array([[]] * len(ids), pa.list_(pa.int64()))})
        graph = robust_prune(x @ x.T)
        return pa.table({"id": pa.array(ids), "near": pa.array([ids[g[g >= 0]].tolist() for g in graph], pa.list_(pa.int64()))})

    lists = members.select("shard", "id", "unit").groupBy("shard").applyInArrow(build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))

    def search(key, data):
        order = np.argsort(np.array(data["unit"].to_pylist(), object), kind="stable")
        data = data.take(pa.array(order))
        here = key[0].as_py()
        x, ids = matrix(data["unit"]), np.array(data["id"].to_pylist(), np.int64)
        copies = np.array(data["copies"].to_pylist(), np.int64)
        shards_, place = data["shards"].to_pylist(), {v: i for i, v in enumerate(ids.tolist())}
        both: list[set] = [set() for _ in place]
        for i, near in enumerate(data["near"].to_pylist()):
            for v in near:
                if (j := place.get(v)) is not None and j != i:
                    both[i].add(j)
                    both[j].add(i)
        graph = [np.fromiter(sorted(b), np.int64, len(b)) for b in both]
        s = x @ x.T if len(x) <= 2 * SHARD_ROWS else x @ x[:: len(x) // SHARD_ROWS].T
        starts = medoids(s) if s.shape[0] == s.shape[1] else np.arange(0, len(x), len(x) // MEDOIDS)
        found = searched(x, graph, starts, threshold)
        linked: list[set] = [set() for _ in place]
        for i, f in enumerate(found):  # a pair found from either side is a pair
            for j in f.tolist():
                linked[i].add(j)
                linked[j].add(i)
        forest, pairs, counts = Forest(), [], np.zeros(len(ids), np.int64)
        for i, f in enumerate(linked):
            mine = [j for j in f if here == min(set(shards_[i]) & set(shards_[j]))]
            counts[i] = copies[mine].sum() if mine else 0
            pairs += forest.joins((int(ids[i]), int(ids[j])) for j in f)
        a, b = [*ids.tolist(), *[p[0] for p in pairs]], [*ids.tolist(), *[p[1] for p in pairs]]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array([*counts.tolist(), *[0] * len(pairs)], pa.int64())})

    found = members.join(united, "id").groupBy("shard").applyInArrow(search, "a long, b long, n long")
    found = written(found.unionByName(block_links(whole, threshold)), "found")
    return found.groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), found.filter("a <> b").select("a", "b")


def audit(one: DataFrame, counts: DataFrame, threshold: float) -> float:
    """Links found of AUDIT vectors against every row by brute force: the lesser of the share of all their links and the mean share of a vector's.

    The vectors are drawn by hash among all rows, whatever was found, so links that no search found count too. Of a share r
    among n linked vectors the standard error is sqrt(r (1 - r) / n); where none of the sample is linked the share
    is not known, which is logged, and 1 is returned.
    """
    sample = one.orderBy(F.xxhash64("unit"), "unit").limit(AUDIT).select("id", "unit").collect()
    if not sample:
        return 1.0
    shared = one.sparkSession.sparkContext.broadcast([(r["id"], bytes(r["unit"])) for r in sample])

    def run(batches):
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            t = pa.Table.from_batches([batch])
            units, ids, copies = t["unit"].to_pylist(), np.array(t["id"].to_pylist()), np.array(t["copies"].to_pylist())
            sizes = np.array([len(u) for u in units])
            for size in np.unique(sizes):
                mine = [k for k, (_, u) in enumerate(shared.value) if len(u) == size]
                every = np.flatnonzero(sizes == size)
                for rows in np.array_split(every, -(-len(every) // AUDIT_ROWS)) if mine else ():
                    x = np.frombuffer(b"".join(units[r] for r in rows), np.float64).reshape(len(rows), -1)
                    q = np.frombuffer(b"".join(shared.value[k][1] for k in mine), np.float64).reshape(len(mine), -1)
                    hit = (x @ q.T >= threshold) & (ids[rows][:, None] != np.array([shared.value[k][0] for k in mine]))
                    total[mine] += (hit * copies[rows][:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in shared.value], pa.int64()), pa.array(total)], names=["id", "n"])

    exact = {r["id"]: r["n"] for r in one.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    got = {r["id"]: r["n"] for r in counts.filter(F.col("id").isin(list(exact))).collect()}
    shares = [min(got.get(k, 0), n) / n for k, n in exact.items() if n]
    logging.getLogger(__name__).info("audit: %d of %d vectors are linked, mean share found %s", len(shares), len(exact), sum(shares) / len(shares) if shares else "unknown")
    return min(sum(shares) / len(shares), sum(min(got.get(k, 0), n) for k, n in exact.items()) / sum(exact.values())) if shares else 1.0


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept), one row per row of vectors.

    A vector that is null, empty, zero, or holds a null or non-finite component links with nothing, and so do
    vectors of different lengths with each other. Rows that share an id are separate rows for n_links. A null
    id is larger than any other and stays null.
    """
    rows = written(unit_rows(vectors, id_col, vector_col), "units")
    one = rows.filter("unit is not null").groupBy("unit").agg(F.min("id").alias("vec"), F.count("*").alias("copies"))
    one = written(one.select(F.monotonically_increasing_id().alias("id"), "vec", "unit", "copies"), "vectors")  # id: a row number, ids may repeat
    for overlap in range(OVERLAP, MOST_OVERLAP + 1):
        counts, forest = links(one.drop("vec"), threshold, overlap)
        recall = audit(one, counts, threshold)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        logging.getLogger(__name__).warning("recall %.3f at overlap %d: all vectors are compared", recall, overlap)
        counts, forest = links(one.drop("vec"), threshold, 0)
    joined = components(forest)
    known = one.join(counts.withColumnRenamed("n", "others"), "id", "left").join(joined, one["id"] == joined["node"], "left")
    known = known.select("unit", "vec", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "id").alias("group"))
    least = known.groupBy("group").agg(F.min("vec").alias("component"))
    known = known.join(least, "group").select("unit", "n", "component")
    out = rows.join(known, "unit", "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(back("id").alias(id_col), "n_links", back("component_id").alias("component_id"), (F.col("id") == F.col("component_id")).alias("kept"))
