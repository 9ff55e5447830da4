import random

import numpy as np
import pytest

from treeloom.llm import decontamination as dec

SCHEMA = "doc_id long, text string, id string, place string"


def word(rng):
    return "".join(rng.choice("abdeilmnorstu") for _ in range(rng.randrange(4, 9)))


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    common = "the of and to in is a that it for".split()
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word(rng) for _ in range(n)]
    items = [(k, " ".join(text(rng.randrange(16, 56)))) for k in range(30)] + [(97, None), (98, ""), (99, "...")]
    docs, planted = [], set()
    for i in range(300):
        w = text(rng.randrange(0, 400))
        if i % 5 == 0:
            k = rng.randrange(30)
            leak = items[k][1].split()
            if i % 10 == 0:  # a paraphrase: words replaced, left out and put in
                leak = [x for x in leak if rng.random() > 0.08]
                leak = [word(rng) if rng.random() < 0.08 else x.upper() + rng.choice([",", "."]) for x in leak]
            at = rng.randrange(len(w) + 1)
            w[at:at] = leak
            planted.add((i, k))
        docs.append((i, " ".join(w)))
    return items, docs, planted


@pytest.mark.parametrize("group", [400, 7])
def test_leaks_are_found_and_others_left(spark, data, monkeypatch, group):
    monkeypatch.setattr(dec, "GROUP_ITEMS", group)
    items, docs, planted = data
    extra = [(1000, None), (1001, ""), (1002, "x " * 30_000 + items[4][1] + " y" * 20_000), (None, items[5][1]), (1003, items[6][1]), (1003, items[6][1])]
    df = spark.createDataFrame([(i, t, "a", "b") for i, t in docs + extra], SCHEMA)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = dec.leaks(df, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    want = planted | {(1002, 4), (None, 5), (1003, 6)}
    assert len(rows) == len(got) and len(want - got) <= 2 and not got - want
    assert all(dec.LCS <= r.lcs <= 1 for r in rows)


def test_empty_tables(spark, data):
    docs = spark.createDataFrame(data[1], "doc_id long, text string")
    bench = spark.createDataFrame(data[0], "item_id long, text string")
    assert dec.leaks(docs.limit(0), bench).count() == 0
    assert dec.leaks(docs, bench.limit(0)).count() == 0


def test_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abc").encode() for _ in range(rng.randrange(1, 30))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        masks = {}
        for i, x in enumerate(a):
            masks[x] = masks.get(x, 0) | 1 << i
        assert dec.common_subsequence(masks, len(a), b) == table[-1, -1]


def test_basis_spans_the_passages(spark, data):
    items, docs, _ = data
    base = spark.createDataFrame(docs, "__id long, __text string")
    rows = [(i, dec.terms_of(t)) for i, t in items if dec.terms_of(t)]
    vocabulary = sorted({t for _, w in rows for t in w})
    n, df = dec.half_frequencies(base, vocabulary)
    assert n == sum(-(-len(t.split()) // dec.HALF) for _, t in docs)
    group = dec.items_of(rows, {t: i for i, t in enumerate(vocabulary)}, n, df)
    found = dec.passages(base, [group])
    basis = dec.latent_basis(found, group)
    a = np.zeros((found.count(), len(group.terms)))
    for i, r in enumerate(found.collect()):
        a[i, r.terms] = np.array(r.counts) * group.idf[r.terms]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    best = (np.linalg.svd(a)[1] ** 2)[: basis.shape[1]].sum()
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert ((a @ basis) ** 2).sum() >= 0.8 * best


@pytest.mark.parametrize("group", [400, 3])
def test_long_items_are_found(spark, data, monkeypatch, group):
    monkeypatch.setattr(dec, "GROUP_ITEMS", group)
    rng = random.Random(11)
    common = "the of and to in is a that it for".split()
    text = lambda n: [rng.choice(common) if rng.random() < 0.5 else word(rng) for _ in range(n)]
    items = {k: text(n) for k, n in enumerate([65, 150, 214, 500, 1200])}
    docs, want = [(100 + i, " ".join(text(200))) for i in range(50)], set()
    for k, w in items.items():
        edited = [word(rng) if rng.random() < 0.1 else x for x in w]
        docs += [(3 * k, " ".join(text(45) + w + text(80))), (3 * k + 1, " ".join(edited)), (3 * k + 2, " ".join(text(30) + w[: len(w) * 2 // 5] + text(30)))]
        want |= {(3 * k, k), (3 * k + 1, k)}
    half = len(items[3]) // 2
    docs += [(None, " ".join(items[3][:half])), (None, " ".join(items[3][half:]))]  # two documents
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in dec.leaks(df, bench).collect()}
    assert set(rows) == want
    assert all(rows[3 * k, k].lcs == 1 for k in items)


def test_terms_in_punctuation_and_single_terms_are_found(spark):
    rng = random.Random(12)
    marks = [('"', '"'), ("**", "**"), ("", '."'), ("", "):"), ("`", "`,"), ("((", ""), ("", "?!")]
    common = "the of and to in is a that it for".split()
    items, docs, want = [(90, "zyzzyva"), (91, "quoxal quoxal")], [], {(500, 90), (501, 91)}
    for k in range(20):
        w = [rng.choice(common) if i % 3 else word(rng) for i in range(30)]
        items.append((k, " ".join(x if i % 3 else rng.choice(marks)[0] + x + rng.choice(marks)[1] for i, x in enumerate(w))))
        leak = [x if i % 3 else a + x + b for i, x in enumerate(w) for a, b in [rng.choice(marks)]]
        docs.append((k, " ".join([*(word(rng) for _ in range(50)), *leak, *(word(rng) for _ in range(50))])))
        want.add((k, k))
    docs += [(500, "he said **Zyzzyva**, and left"), (501, "one 'quoxal' and a (quoxal)."), (502, "nothing of it")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want
