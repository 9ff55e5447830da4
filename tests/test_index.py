import math

import pytest

from treeloom.operators import entities as ent
from treeloom.operators import index as idx
from treeloom.operators import refresh as ref
from treeloom.operators import search as sea
from treeloom.schemas import NODES

from .fixtures import SAMPLE, files


@pytest.fixture(scope="module")
def sample(spark):
    s = ref.full_build(files(spark, SAMPLE), ent.extract)
    return s.nodes.cache(), s.postings.cache(), s.idf.cache()


def test_counts(spark, sample):
    got = {}
    for r in idx.term_counts(idx.searchable_texts(sample[0])).collect():
        got.setdefault(r.node_id.split(":")[1], {})[r.term] = r.n
    assert got == {
        "ring": {"ring": 4, "total": 1, "sale": 1},
        "receipt": {"receipt": 4, "total": 1, "paper": 1},
        "Shelf": {"shelf": 3, "boards": 1, "carry": 1, "goods": 1},
        "Shelf.put": {"put": 4, "item": 1, "str": 1, "pieces": 2, "int": 2, "away": 1},
        "Shelf.take": {"take": 4, "item": 1, "str": 1, "pieces": 2, "int": 2, "down": 1},
        "price_tag": {"price": 3, "tag": 3, "cents": 2, "print": 1, "nicely": 1},
        "order_goods": {"order": 4, "goods": 3, "async": 1, "url": 1, "str": 2, "wholesaler": 1},
    }


def test_counts_of_single_texts_are_not_shuffled(spark):
    texts = spark.createDataFrame([("a", "one two two three TWO"), ("b", None), ("c", "the of"), ("d", "word " * 5_000 + "other"), (None, "alone")], "node_id string, text string")
    got = idx.term_counts(texts)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("a", "one", 1), ("a", "two", 3), ("a", "three", 1), ("d", "word", 5_000), ("d", "other", 1), (None, "alone", 1)], key=repr)
    assert "Exchange" not in idx.postings_of(texts)._jdf.queryExecution().executedPlan().toString()
    again = texts.unionByName(spark.createDataFrame([("a", "one four"), (None, "alone")], "node_id string, text string"))
    assert {(r.node_id, r.term): r.tf for r in idx.postings_of(again).collect()} == {("a", "one"): 2 / 3, ("a", "two"): 1.0, ("a", "three"): 1 / 3, ("a", "four"): 1 / 3, ("d", "word"): 1.0, ("d", "other"): 1 / 5_000, (None, "alone"): 1.0}


def test_idf(sample):
    got = {r.term: r.idf for r in sample[2].collect()}
    assert len(got) == 26 and sample[1].count() == 33
    assert math.isclose(got["ring"], 2.386294361119891) and math.isclose(got["int"], 1.980829253011, rel_tol=1e-9)


@pytest.mark.parametrize(
    ("query", "expected"),
    [
        ("Shelf", [("Shelf", 1.0)]),
        ("put pieces away", [("Shelf.put", 0.555), ("Shelf.take", 0.1383)]),
        ("order goods", [("order_goods", 0.8113), ("Shelf", 0.1383)]),
        ("int", [("Shelf.put", 0.415), ("Shelf.take", 0.415)]),
        ("put put nonexistentxyz", [("Shelf.put", 0.3333)]),
        ("def", []),
        ("", []),
    ],
)
def test_search(sample, query, expected):
    rows = sea.search_one(*sample, query).collect()
    got = sorted(((r.node_id.split(":")[1], round(r.score, 4)) for r in rows), key=lambda x: (-x[1], x[0]))
    assert got == expected


def test_batch_ranks_and_bounds(spark, sample):
    queries = spark.createDataFrame([(1, "int put"), (2, "zzz"), (3, "price tag cents"), (4, None)], "query_id long, query string")
    rows = sea.search(*sample, queries, k=1).collect()
    assert {(r.query_id, r.rank, r.name) for r in rows} == {(1, 1, "put"), (3, 1, "price_tag")}
    assert all(0 <= r.score <= 1 for r in rows)


def test_add_and_remove(spark, sample):
    nodes, postings, idf = sample
    extra = spark.createDataFrame([("n:new", "n", "brand_new", "function", "n", 1, 1, "def brand_new()", None, [], [], "python")], NODES)
    ids = extra.select("id")
    merged, fresh = idx.update_index(postings, idf, nodes.unionByName(extra), ids, 1)
    assert {r.term for r in merged.filter("node_id = 'n:new'").collect()} == {"brand", "new"}
    again = idx.remove_nodes(merged, ids)
    assert sorted(again.collect()) == sorted(postings.collect())
    none = spark.createDataFrame([], "id string")
    same, _ = idx.update_index(postings, idf, nodes, none, 0)
    assert sorted(same.collect()) == sorted(postings.collect())


def test_threshold_policy(spark, sample):
    nodes, postings, idf = sample
    extra = spark.createDataFrame([("n:new", "n", "sale", "function", "n", 1, 1, None, "fresh", [], [], "python")], NODES)
    every, ids = nodes.unionByName(extra), extra.select("id")
    old = {r.term: r.idf for r in idf.collect()}
    kept = {r.term: r.idf for r in idx.update_index(postings, idf, every, ids, 1, "threshold", threshold=0.5)[1].collect()}
    assert kept["sale"] == old["sale"] and math.isclose(kept["fresh"], math.log(9 / 2) + 1)
    anew = {r.term: r.idf for r in idx.update_index(postings, idf, every, ids, 1, "threshold")[1].collect()}
    assert math.isclose(anew["sale"], math.log(9 / 3) + 1) and anew["ring"] == old["ring"]
    with pytest.raises(ValueError):
        idx.update_index(postings, idf, every, ids, 1, "other")


def test_empty_index(spark):
    none = spark.createDataFrame([], NODES)
    postings, idf = idx.build_index(none)
    assert postings.count() == 0 and idf.count() == 0
    assert sea.search_one(none, postings, idf, "anything").count() == 0


def test_pruned_search_gives_the_same_rows_from_fewer_postings(spark):
    import random

    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(60)], k=rng.randrange(1, 60))) for _ in range(1_500)]
    rows = [(f"n{i}", "f", "x", "function", "f", 1, 1, None, t, [], [], "python") for i, t in enumerate(texts)]
    n = spark.createDataFrame(rows, NODES)
    postings, idf = idx.build_index(n)
    blocks = sea.term_blocks(postings)
    asked = [(0, "word0 word1 word40"), (1, "word9"), (2, "word59 word58 word0 word0 unknownword"), (3, None), (4, "zzz"), (5, " ".join(words)), (6, texts[7])]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    for k in (1, 3, 10, 5_000):
        want = sorted(map(tuple, sea.ranked(sea.scores(postings, idf, queries), k).select("query_id", "rank", "node_id", "score").collect()))
        assert sorted(map(tuple, sea.top_k(postings, idf, blocks, queries, k).select("query_id", "rank", "node_id", "score").collect())) == want
    terms = sea.weighted_terms(idf, queries)
    every = {r.query_id: r["count"] for r in sea.scores(postings, idf, queries).groupBy("query_id").count().collect()}
    some = {r.query_id: r["count"] for r in sea.candidates(postings, blocks, terms, 10).groupBy("query_id").count().collect()}
    assert all(some[q] <= every[q] for q in every) and some[1] < every[1] / 10 and some[2] < every[2] / 3
