import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from treeloom.llm import embedding_dedup as emb

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(ids, rows, threshold=0.95):
    n = len(ids)
    ok = [r is not None and len(r) > 0 and None not in r and np.isfinite(np.array(r, float)).all() and np.any(r) for r in rows]
    links = {i: set() for i in range(n)}
    unit = [np.array(np.array(r, np.float32), float) / np.linalg.norm(np.array(np.array(r, np.float32), float)) if o else None for r, o in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j), links[j].add(i)
    comp = {}
    for i in sorted(range(n), key=lambda k: ids[k]):
        if i not in comp:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in comp:
                    comp[x] = ids[i]
                    todo += links[x]
    return {ids[i]: (len(links[i]), comp[i], comp[i] == ids[i]) for i in range(n)}


@pytest.mark.parametrize("shard_rows", [2048, 60])
def test_against_brute_force(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(emb, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(emb, "TARGET_ROWS", shard_rows // 2)
    rng = np.random.default_rng(3)
    rows = [rng.standard_normal(16).tolist() for _ in range(150)]
    for c in range(10):
        base = rng.standard_normal(16)
        rows += [(base + 0.05 * rng.standard_normal(16)).tolist() for _ in range(rng.integers(2, 25))]
    rows += [rows[0]] * 12 + [(2 * np.array(rows[1])).tolist()] + [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [1.0] * 16]
    order = rng.permutation(len(rows))
    ids = [int(i) * 3 + 1 for i in order]
    df = spark.createDataFrame([(i, r, 0, "x") for i, r in zip(ids, rows)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.near_duplicates(df).collect()}
    want = brute(ids, rows)
    assert set(got) == set(want)
    found, total = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.97 * total
    if shard_rows > len(rows):
        assert got == want


def test_null_ids_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0]), (None, None)], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in emb.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 2, 5), (5, 2, 5), (5, 2, 5), (None, 0, None)], key=repr)
    assert emb.near_duplicates(df.limit(0)).count() == 0


def test_prune_keeps_spread_neighbours():
    x = np.array([[1, 0], [0.99, 0.141], [0.98, 0.199], [0.6, -0.8]])
    near = emb.robust_prune(x @ x.T, degree=2, pool=3)
    assert near[0].tolist() == [1, 3]  # 2 lies behind 1


def test_a_mass_of_near_copies_is_counted_whole(spark):
    rng = np.random.default_rng(8)
    n, d = 20_000, 64
    x = rng.standard_normal((2 * n, d))
    x[:n] = rng.standard_normal(d) + 0.14 * x[:n]  # cosines of about 0.98
    x = x[rng.permutation(2 * n)].astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": np.arange(2 * n), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.concatenate([(unit[k : k + 1000] @ unit.T >= 0.95).sum(axis=1) - 1 for k in range(0, 2 * n, 1000)])
    got = emb.near_duplicates(df).toPandas().sort_values("vec_id")
    assert want.max() > 0.9 * n and (got["n_links"].to_numpy() == want).all()
    mass = got[want > 0]
    assert mass["component_id"].nunique() == 1 and mass["kept"].sum() == 1


def test_two_masses_that_touch(spark, monkeypatch):
    monkeypatch.setattr(emb, "SHARD_ROWS", 100)
    monkeypatch.setattr(emb, "TARGET_ROWS", 50)
    monkeypatch.setattr(emb, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(9)
    a, b = np.zeros(16), np.zeros(16)
    a[0], b[:2] = 1, (0.93, 0.3676)
    rows = [(c + 0.02 * rng.standard_normal(16)).tolist() for c in (a, b) for _ in range(200)] + [rng.standard_normal(16).tolist() for _ in range(200)]
    df = spark.createDataFrame([(i, r, 0, "x") for i, r in enumerate(rows)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.near_duplicates(df).collect()}
    assert got == brute(list(range(len(rows))), rows)


def test_low_recall_falls_back_to_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(emb, "audit", lambda *a: 0.5)
    monkeypatch.setattr(emb, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(10)
    rows = [(c + 0.1 * rng.standard_normal(8)).tolist() for c in rng.standard_normal((10, 8)) for _ in range(8)] + [[1.0, 2.0], [2.0, 4.1]]
    df = spark.createDataFrame([(i, r, 0, "x") for i, r in enumerate(rows)], SCHEMA)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in emb.near_duplicates(df).collect()}
    assert got == brute(list(range(len(rows))), rows)


def test_different_vectors_under_one_id(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0])]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in emb.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()), key=repr)
    assert got == sorted([(1, 1, 1), (1, 1, 1), (2, 1, 1), (None, 1, 1), (None, 0, None)], key=repr)


def test_sparse_links_are_found_and_audited(spark):
    """Pairs just above the threshold among many unlinked vectors: hardly one in forty is linked, so a small sample would see none."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(75):
        r = rng.normal(size=64)
        r -= x[k] * (x[k] @ r)
        x[3_000 + k] = 0.952 * x[k] + np.sqrt(1 - 0.952**2) * r / np.linalg.norm(r)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>")
    linked = {r.vec_id for r in emb.near_duplicates(df).collect() if r.n_links}
    assert len(linked & {*range(75), *range(3_000, 3_075)}) >= 149 and len(linked) <= 150
    one = df.select(F.monotonically_increasing_id().alias("id"), "embedding")
    units = emb.unit_rows(one, "id", "embedding").withColumn("copies", F.lit(1).cast("long"))
    none = spark.createDataFrame([], "id long, n long")
    assert emb.audit(units, none, 0.95) < 0.1  # a search that finds nothing is seen to find nothing
