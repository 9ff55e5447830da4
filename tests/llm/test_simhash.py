import random

import numpy as np
import pytest
import xxhash

from treeloom.llm import simhash
from treeloom.llm.components import components


def fingerprint(text, width=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(prints, radius):
    ids = sorted(prints)
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_contract(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("alpha Beta gamma delta Épsilon zeta".split()) + str(rng.randrange(60)) for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts = base + base[:5] + [None, "", " \n", "one", "two words", "x " * 40_000]
    for t in base[:25]:
        w = t.split()
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    df = spark.createDataFrame([(i * 2, t, b"x", "y") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint binary, id string")
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = {i * 2: fingerprint(t) for i, t in enumerate(texts)}
    assert {i: int.from_bytes(r.fingerprint, "big") for i, r in got.items()} == prints
    assert {i: r.component_id for i, r in got.items()} == groups(prints, 3)


@pytest.mark.parametrize("limits", [[1, 0, 0], [0, -1, 2], [3, -1, -1]])
def test_every_allocation_finds_every_link(spark, limits):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 60)
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 5), False)) for b in base for _ in range(4)]
    rows = [(i, v.to_bytes(8, "big")) for i, v in enumerate(values)]
    parts = [np.arange(0, 22), np.arange(22, 43), np.arange(43, 64)]
    df = spark.createDataFrame(rows, "id long, fingerprint binary")
    edges = simhash.verified_links(simhash.probe_rows(df, 64, parts, limits), 64, 3)
    got = {r.node: r.component for r in components(edges).collect()}
    want = groups(dict(enumerate(values)), 3)
    assert all(got.get(i, i) == want[i] for i in want)


def test_thresholds_sum_and_prefer_selective_parts():
    together = np.full((1, 64, 64), 250) + np.eye(64, dtype=int) * 250
    together[0, :21, :21] = 990  # almost constant bits
    parts = [np.arange(21), np.arange(21, 43), np.arange(43, 64)]
    t = simhash.thresholds(1000, together, parts, 3)
    assert sum(x + 1 for x in t) == 4 and t[0] == -1
    parts = simhash.correlated_parts(1000, together, 3)
    assert sorted(np.concatenate(parts)) == list(range(64))


@pytest.mark.parametrize("cut", [2, 3])
def test_hot_values_are_split_without_loss(spark, cut):
    rng = np.random.default_rng(5)
    common = int(rng.integers(0, 2**63))
    values = [common ^ int(rng.integers(0, 2**14)) << 40 for _ in range(150)]  # 50 bits are the same in all
    values += [v ^ sum(1 << int(k) for k in rng.choice(64, 3, False)) for v in values[:80]]
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "id long, fingerprint binary")
    parts = [np.arange(64)[k::cut] for k in range(cut)]
    probes = simhash.probe_rows(df, 64, parts, [1, 1] if cut == 2 else [1, 0, 0])
    split = simhash.split_hot(probes, 64, parts, 3, 0.0, 10)
    assert split.groupBy("key").count().agg({"count": "max"}).first()[0] < probes.groupBy("key").count().agg({"count": "max"}).first()[0]
    got = {r.node: r.component for r in components(simhash.verified_links(split, 64, 3)).collect()}
    want = groups(dict(enumerate(values)), 3)
    assert all(got.get(i, i) == want[i] for i in want)


def test_values_are_split_until_no_split_thins_them(spark):
    rng = np.random.default_rng(8)
    common = int(rng.integers(0, 2**40))
    values = [common | int(rng.integers(0, 2**6)) << 40 | int(rng.integers(0, 2**18)) << 46 for _ in range(1500)]
    values += [v ^ sum(1 << int(k) for k in rng.choice(64, 3, False)) for v in values[:60]]
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(values)], "id long, fingerprint binary")
    parts = [np.arange(0, 22), np.arange(22, 43), np.arange(43, 64)]
    probes = simhash.probe_rows(df, 64, parts, [-1, -1, 3])
    hottest = lambda t: t.groupBy("key").count().agg({"count": "max"}).first()[0]
    split = simhash.split_hot(probes, 64, parts, 3, 0.0, 20)
    assert hottest(split) < hottest(probes) / 4
    want = groups(dict(enumerate(values)), 3)
    got = {r.node: r.component for r in components(simhash.verified_links(split, 64, 3)).collect()}
    assert all(got.get(i, i) == want[i] for i in want)
    ball = [common ^ sum(1 << int(k) for k in rng.choice(12, 3, False)) for _ in range(400)]  # no split thins these
    dense = spark.createDataFrame([(i, v.to_bytes(8, "big")) for i, v in enumerate(dict.fromkeys(ball))], "id long, fingerprint binary")
    probes = simhash.probe_rows(dense, 64, parts, [1, 0, 0])
    split = simhash.split_hot(probes, 64, parts, 3, 0.0, 20)
    assert split.count() <= 16 * probes.count()
    links = components(simhash.verified_links(split, 64, 3))
    want = groups(dict(enumerate(dict.fromkeys(ball))), 3)
    got = {r.node: r.component for r in links.collect()}
    assert all(got.get(i, i) == want[i] for i in want)


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_pairs_at_the_radius_meet(spark, hot):
    rng = np.random.default_rng(6)
    radius, pairs = simhash.radius_of(0.79), 400
    table = rng.integers(0, 2, (pairs, 512), dtype=np.uint8)
    other = table.copy()
    for row in other:
        row[rng.choice(512, radius, False)] ^= 1
    rows = [(2 * i + k, np.packbits(x[i]).tobytes()) for i in range(pairs) for k, x in enumerate((table, other))]
    df = spark.createDataFrame(rows, "id long, fingerprint binary")
    found = simhash.groups(df, 512, radius, 5, 0.01, hot).groupBy("component").count()
    assert found.filter("count = 2").count() >= 0.97 * pairs and found.filter("count > 2").count() == 0


def test_wider_partitions_for_more_fingerprints():
    def together(n):
        return np.full((1, 64, 64), n // 4) + np.eye(64, dtype=int) * (n // 4)

    few, many = (simhash.allocation(n, together(n), 3, 3, 0.0) for n in (10**5, 10**12))
    assert len(few[0]) == 3 and len(many[0]) == 2
    assert all(sum(t + 1 for t in limits) == 4 for _, limits in (few, many))


def test_large_groups_are_compared_whole():
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**62))
    values = [centre ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 4), False)) for _ in range(300)]
    prints = np.array(values, np.uint64).reshape(-1, 1)
    forest = simhash.Forest()
    pairs = [e for piece in simhash.links_of(np.zeros(300, np.int64), np.arange(300), prints, 3) for e in forest.joins(piece)]
    want = groups(dict(enumerate(values)), 3)
    assert len(pairs) < 300 and all(forest.root(i) == forest.root(want[i]) for i in range(300))


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    clean = [make(rng.randrange(30, 300)) for _ in range(60)]
    rows, copies = [(i, " ".join(w)) for i, w in enumerate(clean)], []
    for i, w in enumerate(clean[:40]):
        v = list(w)
        for _ in range(max(1, len(w) // 80)):  # similarity of about 0.88
            v[rng.randrange(len(v))] = "edited"
        copies.append(1000 + i)
        rows.append((1000 + i, " ".join(v)))
    rows += [(2000, None), (2001, ""), (2002, rows[3][1]), (2003, None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, component_id int")
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = {r.doc_id for r in out.collect()}
    assert set(range(60)) <= kept and {2000, 2001, 2003} <= kept and 2002 not in kept
    label = exact_groups([t for _, t in rows[:100]])
    near = {rows[k][0] for k in range(60, 100) if label[k] != k}  # copies of short texts are less similar than 0.8
    assert len(kept & near) <= 2 and set(copies) - near <= kept and len(near) > 25


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d"), (3, "a b c d"), (3, "a b c d"), (None, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 3), (3, 3), (3, 3), (None, None)], key=repr)
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 50), (50, 100), (7, 7), (200, 201), (201, 202), (202, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[100] == 50 and got[201] == got[202] == 200
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def exact_groups(texts, similarity=0.8):
    """Smallest position reachable by pairs of five-word-shingle similarity, by comparing every pair."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))})
    label = list(range(len(texts)))
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (n := len(sets[i] & sets[j])) and n >= similarity * (len(sets[i]) + len(sets[j]) - n)]
    while True:
        before = list(label)
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
        if label == before:
            return label


def test_every_pair_is_judged_by_its_shingles(spark):
    rng = random.Random(14)
    make = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(150):
        w = make(rng.choice([1, 3, 5, 6, 8, 9, 10, 14, 30, 60, 120, 400]))
        texts.append(" ".join(w))
        for _ in range(rng.randrange(4)):  # chains of edits around the bound, from one another
            kind, v = rng.randrange(3), list(w)
            if kind == 0:
                v = v[: max(1, int(len(v) * rng.uniform(0.7, 1)))]
            elif kind == 1:
                v += make(rng.randrange(1, 2 + len(v) // 4))
            else:
                for _ in range(max(1, len(v) // rng.choice([25, 40, 50, 100]))):
                    v[rng.randrange(len(v))] = "edited"
            texts.append(" ".join(v))
            w = v if rng.random() < 0.5 else w
    want = exact_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(df).collect()}
    stays = {i for i, g in enumerate(want) if i == g}
    assert stays <= kept  # nothing is dropped that no pair of 0.8 or more joins to an earlier text
    assert len(kept - stays) <= 0.03 * (len(texts) - len(stays))


@pytest.mark.parametrize("block", [1000, 7])
def test_failed_candidates_hide_no_pairs(spark, monkeypatch, block):
    """Texts whose forest failed are compared in blocks of their area; pairs of one group are left out."""
    monkeypatch.setattr(simhash, "BLOCK_TEXTS", block)
    rng = random.Random(15)
    sets = [sorted(rng.sample(range(100), 60)) for _ in range(4)]
    rows = [(10 * k + i, k // 2, 10 * k + i, bytes(64), sorted({*(x for x in s if x % 30 != i), 1000 + i})) for k, s in enumerate(sets) for i in range(9)]
    rows += [(98, 0, 98, b"\xff" * 64, sets[0])]
    df = spark.createDataFrame(rows, "node long, area long, group long, fingerprint binary, set array<long>")
    got = {r.node: r.component for r in components(simhash.block_links(df, 512, 100, 0.8)).collect()}
    for k in range(4):
        assert {got.get(10 * k + i, 10 * k + i) for i in range(9)} == {10 * k}
    assert 98 not in got  # too far by its bits


def test_forest_of_the_nearest_spans():
    rng = np.random.default_rng(2)
    for n in (40, 200):
        prints = rng.integers(0, 2**63, (n, 8)).astype(np.uint64)
        prints[1::2] = prints[::2] ^ np.uint64(5)
        edges = [e for piece in simhash.nearest_links(np.zeros(n, np.int64), np.arange(n), prints, 20) for e in piece]
        assert sorted(tuple(sorted(e)) for e in edges) == [(i, i + 1) for i in range(0, n, 2)]


def test_rows_with_one_id_are_judged_apart(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")
    df = spark.createDataFrame([(1, a), (2, a), (2, b), (2, b), (None, a), (None, "c d e")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, a), (2, b), (2, b), (None, "c d e")], key=repr)


@pytest.mark.parametrize("pieces", [simhash.EDGES_PER_PIECE, 2])
def test_edges_of_hot_texts_are_dealt(spark, monkeypatch, pieces):
    monkeypatch.setattr(simhash, "EDGES_PER_PIECE", pieces)
    sets = {i: set(range(i, i + 10)) for i in range(12)}
    edges = [(0, i) for i in range(1, 12)] + [(i, 11) for i in range(1, 11)]
    got = simhash.similar(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "node long, set array<long>"), 0.8)
    want = {(a, b): len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) for a, b in edges}
    assert got.count() == len(edges) and {(r.a, r.b): r.ok for r in got.collect()} == want
