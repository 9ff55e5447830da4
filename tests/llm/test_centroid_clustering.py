import hashlib
import math
import os
import random

import numpy as np
import pytest

from treeloom.llm import centroid_clustering as cc
from treeloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster int, q string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, -1, "q") for i, v in rows], SCHEMA)


def brute(rows, k=40, rounds=5, dims=64):
    """(id, cluster, distance) and the centroids, by Python integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), q) for i, q in kept)[:k]
    cents = [q for _, q in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [min((far(q, c), n) for n, c in enumerate(cents)) for _, q in kept]
    for _ in range(rounds):
        home = assign()
        for c in range(len(cents)):
            mine = [q for (_, q), (_, n) in zip(kept, home) if n == c]
            if mine:
                cents[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, n, d) for (i, _), (d, n) in zip(kept, assign())], cents


def check(rows, got, **options):
    want, cents = brute(rows, **options)
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cents[r.cluster])).encode()).hexdigest()
        assert r.cluster_inertia == sum(d for _, n, d in want if n == r.cluster)
        assert r.inertia == sum(d for _, _, d in want)


def vectors(n, seed, dims=64):
    rng = np.random.default_rng(seed)
    return [(i, rng.normal(0, 0.125, dims).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("width", [1, 2, 3, 64])
def test_equals_brute_force(spark, width):
    rows = vectors(90, 1)
    check(rows, cc.cluster(table(spark, rows), width=width, chunk=25).collect())


def test_hot_vectors_ties_and_odd_rows(spark):
    rng = random.Random(3)
    rows = vectors(50, 2) + [(1000 + i, [0.25] * 64) for i in range(60)] + [(7, [0.25] * 64), (7, [0.5] * 64), (7, [0.5] * 64), (None, [1.0] * 64), (None, None)]
    rows += [(2000, None), (2001, []), (2002, [0.1] * 63), (2003, [0.1] * 65), (2004, [None] + [0.1] * 63), (2005, [float("nan")] * 64), (2006, [float("inf")] + [0.0] * 63), (2007, [0.0] * 64)]
    rng.shuffle(rows)
    check(rows, cc.cluster(table(spark, rows), chunk=40).collect())


def test_few_vectors_extremes_and_empty_table(spark):
    rows = [(1, [3.4e38] * 64), (2, [-3.4e38] * 64), (3, [0.0] * 64)]
    got = {r.vec_id: r for r in cc.cluster(table(spark, rows)).collect()}
    assert sorted(got) == [1, 2, 3] and all(r.distance == 0 for r in got.values())
    far = cc.cluster(table(spark, rows), k=1, rounds=0).collect()
    assert max(r.distance for r in far) == 64 * (2 * cc.LARGEST) ** 2 or max(r.distance for r in far) == 64 * cc.LARGEST**2
    assert cc.cluster(table(spark, rows).limit(0)).collect() == []
    assert cc.cluster(table(spark, [(1, None)])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_matches_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    q = c.sql(ORACLE_SQL["op13_centroid_clustering"])
    df = QUERIES["op13_centroid_clustering"](spark, "/root/testdata/sf0.001")
    order = sorted(df.columns)
    assert order == sorted(q.columns)
    at = [q.columns.index(n) for n in order]
    assert sorted(tuple(r[n] for n in order) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in q.fetchall())
