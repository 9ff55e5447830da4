import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from treeloom.llm import suffix_tree_lm as lm

SCHEMA = "doc_id long, text string, held boolean, score string, n_tokens string"


def corpus(seed=0, n=120):
    rng = random.Random(seed)
    words = "alpha Beta gamma delta éta zeta theta iota".split()
    follow = {w.lower(): rng.sample(words, 2) for w in words}
    rows = []
    for i in range(n):
        w = [rng.choice(words)]
        while rng.random() < 0.95:
            w.append(rng.choice(follow[w[-1].lower()]) if rng.random() < 0.8 else rng.choice(words))
        rows.append((i, " ".join(w) + (f" rare{i}" if i % 5 == 0 else ""), i % 6 == 0))
    return rows


def brute(rows, depth, least, divergence, weight):
    """The same model from its definition."""
    toks = {i: [*(t or "").lower().split(), None] for i, t, _ in rows}
    train = [toks[i] for i, _, held in rows if not held]
    grams = collections.Counter(tuple(t[k : k + m]) for t in train for m in range(1, depth + 2) for k in range(len(t) - m + 1))
    n, v = sum(map(len, train)), len({w for t in train for w in t})
    kept = set()
    for g, c in grams.items():
        s = g[:-1]
        if s and grams[s] >= least and abs(math.log(c / grams[s]) - math.log(grams[g[1:]] / (grams[s[1:]] if s[1:] else n))) * c >= divergence:
            kept |= {s[k:] for k in range(len(s))}
    out = {}
    for i, t in toks.items():
        base = best = 0.0
        for k, x in enumerate(t):
            p = p0 = (grams[x,] + 1) / (n + v + 1)
            longest = max((d for d in range(1, min(depth, k) + 1) if tuple(t[k - d : k]) in kept), default=0)
            for d in range(1, longest + 1):
                s = tuple(t[k - d : k])
                p = (grams[*s, x] + weight * p) / (grams[s] + weight)
            base, best = base + math.log10(p0), best + math.log10(p)
        out[i] = (len(t), sum(grams[x,] > 0 for x in t), n, base, best)
    return out, collections.Counter(map(len, kept))


@pytest.mark.parametrize("depth,least,divergence", [(4, 2, 3.32), (4, 5, 2.0), (1, 3, 1.0), (5, 2, 2.0)])
def test_against_definition(spark, depth, least, divergence):
    settings = dict(depth=depth, least=least, divergence=divergence, weight=lm.WEIGHT)
    rows = [*corpus(), (500, None, False), (501, "", True), (502, "alpha beta " * 5000, False), (503, corpus()[3][1], False), (504, corpus()[3][1], False)]
    df = spark.createDataFrame([(*r, "s", "t") for r in rows], SCHEMA)
    want, kept = brute(rows, **settings)
    assert all(kept[d] > 0 for d in range(1, depth + 1))
    for chunk in (700, 10_000_000):
        got = {r.doc_id: r for r in lm.score(df, F.col("held"), chunk_bytes=chunk, **settings).collect()}
        assert set(got) == set(want)
        for i, w in want.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
            assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9)
    held = [i for i, _, h in rows if h]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_texts_that_occur_twice_score_apart(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choice("abdeilmnorstu") for _ in range(rng.randrange(1, 4))) for _ in range(80))
    rows = [(i, text()) for i in range(200)]
    rows += [(1000 + i, rows[i][1]) for i in range(10)]
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).collect()}
    assert min(got[i] for i in (*range(10), *range(1000, 1010))) > max(got[i] for i in range(10, 200))


def test_distributions_sum_to_one():
    counts = [30, 20, 20, 10, 10, 5, 5, 0]  # seven words and one unknown
    base = [(c + 1) / (100 + 7 + 1) for c in counts]
    assert math.isclose(sum(base), 1)
    nxt = [3, 0, 1, 0, 0, 0, 0, 0]
    assert math.isclose(sum((a + lm.WEIGHT * p) / (sum(nxt) + lm.WEIGHT) for a, p in zip(nxt, base)), 1)


def test_no_training_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.score) for r in lm.score(df, F.lit(True)).collect()), key=repr)
    assert got == sorted([(None, 3, 0, 0, 0.0), (1, 1, 0, 0, 0.0), (1, 1, 0, 0, 0.0)], key=repr)
    assert lm.score(df.limit(0), F.lit(False)).count() == 0
