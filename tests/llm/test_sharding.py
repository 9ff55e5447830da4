import itertools
import random
import zlib

import numpy as np
import pytest

from treeloom.llm import sharding

SCHEMA = "doc_id long, text string, shard string, size int"


def shards(spark, texts, k):
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r for r in sharding.shard_by_bytes(df, k).collect()}


def least_capacity(sizes, k):
    """Over all cuts."""
    n = len(sizes)
    return min(max(sum(sizes[a:b]) for a, b in itertools.pairwise([0, *cuts, n])) for cuts in itertools.combinations_with_replacement(range(n + 1), k - 1))


@pytest.mark.parametrize("seed", range(3))
def test_cut_points_are_minimax(spark, seed):
    rng = random.Random(seed)
    groups = sorted({rng.randrange(-(2**63), 2**63): rng.choice([1, 5, 40, 200]) for _ in range(14)}.items())
    if seed == 2:  # keys that differ only in their last bits
        groups = [((5 << 20) + i, s) for i, (_, s) in enumerate(groups)]
    df = spark.createDataFrame(groups, "key long, size long")
    for k in (1, 2, 3, 4):
        cuts = sharding.cut_points(df, k)
        load = np.bincount([sum(key >= c for c in cuts) for key, _ in groups], [s for _, s in groups])
        assert len(load) <= k and load.max() == least_capacity([s for _, s in groups], k)


def test_contract(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randrange(1, 60) + str(rng.randrange(300)) for _ in range(400)] + ["copy of one text"] * 50 + [None, "", "é" * 30_000]
    got = shards(spark, texts, 8)
    assert len(got) == len(texts)
    by, home = {}, {}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r = got[i]
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert 0 <= r.shard < 8 and home.setdefault(t or "", r.shard) == r.shard
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    loads = sorted(sum(r["size"] for r in rows) for rows in by.values())
    assert len(by) == 8 and loads[-1] == 60_001  # the long text stands alone
    assert loads[-2] - loads[0] < 0.35 * loads[-2]


def test_repeats_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")], "doc_id long, text string")
    rows = sharding.shard_by_bytes(df, 2).collect()
    assert sorted(r["size"] for r in rows) == [1, 2, 2, 2]
    assert sharding.shard_by_bytes(df.limit(0), 8).count() == 0
