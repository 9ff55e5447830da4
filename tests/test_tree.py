import json

import pytest
from pyspark.sql import functions as F

from treeloom.operators import entities as ent
from treeloom.operators import files as fil
from treeloom.operators import refresh as ref
from treeloom.operators import relations as rel
from treeloom.operators import render, tree
from treeloom.schemas import NODES

from .fixtures import GOODS, SAMPLE, files, nodes


def built(spark, sources):
    return ref.full_build(files(spark, sources), ent.extract)


def counts(df):
    return {r["id"]: tuple(r[c] for c in tree.COUNTS) for r in df.collect()}


def test_stats(spark):
    n = built(spark, SAMPLE).nodes
    got = counts(tree.stats(n))
    assert got["."] == got["shop"] == (4, 1, 4, 2)
    assert got["shop/stock"] == (2, 1, 2, 2)
    assert got["shop/till.py"] == (1, 0, 2, 0)
    assert counts(tree.node_stats(n)) == {".": (4, 1, 4, 2)}
    assert counts(tree.node_stats(n, "nowhere")) == {"nowhere": (0, 0, 0, 0)}
    asked = spark.createDataFrame([("shop",), ("nowhere",)], "id string")
    assert counts(tree.stats_of(n, asked)) == {"shop": (4, 1, 4, 2), "nowhere": (0, 0, 0, 0)}
    assert counts(tree.project_map(n)) == {".": (4, 1, 4, 2), "shop": (4, 1, 4, 2)}


def test_own_counts_and_children_add_up(spark):
    n = built(spark, {**SAMPLE, **{f"m/{k}": v for k, v in GOODS.items()}}).nodes
    got, rows = counts(tree.stats(n)), n.collect()
    own = {r.id: tuple(int(r.type == t) for t in ("file", "class", "function", "method")) for r in rows}
    for r in rows:
        kids = [got[k.id] for k in rows if k.parent_id == r.id]
        assert got[r.id] == tuple(sum(x) for x in zip(own[r.id], *kids))


def test_models(spark):
    n = built(spark, GOODS).nodes
    assert counts(tree.stats(n))["."] == (2, 5, 0, 4)
    names = lambda base: {r.name for r in rel.subclasses(n, base).collect()}
    assert names("Ware") == {"Fruit", "Bread", "Cheese"}
    assert names("Fruit") == {"Apple"}
    assert names("NonexistentBase") == set()


def test_last_definition_wins(spark):
    f = files(spark, {"a.py": "def f(x): pass\ndef f(y): pass\n"})
    n = ref.full_build(f, ent.extract).nodes.filter("type = 'function'").collect()
    assert [(r.id, r.signature) for r in n] == [("a.py:f", "def f(y)")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_read_the_table_a_few_times(spark):
    n = built(spark, SAMPLE).nodes
    documents = render.inspect_json(n, n.select("id"))
    assert plan(documents).count("FileScan") <= 3
    got = {r.id: json.loads(r.json) for r in documents.collect()}
    assert set(got) == {r.id for r in n.collect()}
    kids = {r.id: sorted(k.id for k in n.filter(n.parent_id == r.id).collect()) for r in n.collect()}
    assert {i: d["node"]["children_ids"] for i, d in got.items()} == kids
    calls = {r.name: sorted(c.id for c in rel.callers(n, r.name).collect()) for r in n.collect()}
    assert {i: d["called_by"] for i, d in got.items()} == {i: calls[d["node"]["name"]] for i, d in got.items()}
    shop = [json.loads(r.json) for r in render.expand_json(n, "shop").collect()]
    assert [(d["node"]["id"], [(k["id"], k["stats"]["functions"]) for k in d["children"]]) for d in shop] == [("shop", [("shop/__init__.py", 0), ("shop/stock", 2), ("shop/till.py", 2)])]
    assert render.expand_json(n, "nowhere").count() == 0


def test_children_lookup_orphans(spark):
    n = built(spark, SAMPLE).nodes
    kids = {r.id: r.children_ids for r in tree.children(n, "shop").collect()}
    assert kids == {"shop/__init__.py": [], "shop/till.py": ["shop/till.py:receipt", "shop/till.py:ring"], "shop/stock": ["shop/stock/__init__.py", "shop/stock/shelf.py"]}
    assert {r.id: r.n_children for r in tree.children(n).filter("parent_id = 'shop'").collect()} == {i: len(c) for i, c in kids.items()}
    one = tree.lookup(n, spark.createDataFrame([("shop/stock",), ("x",)], "id string")).collect()
    assert [(r.id, r.children_ids) for r in one] == [("shop/stock", ["shop/stock/__init__.py", "shop/stock/shelf.py"])]
    lost = nodes(spark, [(".", None, ".", "dir", [], []), ("a,b:x", "gone", "x", "class", [], [])])
    assert [r.id for r in tree.orphans(lost).collect()] == ["a,b:x"]
    assert counts(tree.stats(lost))["."] == (0, 0, 0, 0)


def chain(spark, n):
    rows = spark.range(n).select(F.concat(F.lit("n"), "id").alias("id"), F.when(F.col("id") > 0, F.concat(F.lit("n"), F.col("id") - 1)).alias("parent_id"), F.when(F.col("id") % 3 == 0, "file").otherwise("class").alias("type"))
    return rows


def test_a_chain_of_ten_thousand_levels(spark):
    got = counts(tree.stats(chain(spark, 10_000)))
    assert len(got) == 10_000
    for i in (0, 1, 2, 4_999, 9_998, 9_999):
        assert got[f"n{i}"] == (sum(j % 3 == 0 for j in range(i, 10_000)), sum(j % 3 > 0 for j in range(i, 10_000)), 0, 0)


def test_cycles_are_errors(spark):
    for parents in ({".": "."}, {"a": "b", "b": "a", "c": None}, {".": None, "x": "y", "y": "z", "z": "x", "leaf": "x"}):
        n = spark.createDataFrame([(i, p, "dir") for i, p in parents.items()], "id string, parent_id string, type string")
        for run in (tree.stats, tree.node_stats):
            with pytest.raises(ValueError, match="cycle"):
                run(n)


def test_map_and_expand_cost_no_more_than_the_counts(spark):
    n = built(spark, {f"d{i % 5}/e{i % 3}/f{i}.py": "class A:\n    def m(self): pass\n" for i in range(30)}).nodes
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()

    def cost(run):
        before = jobs()
        run().collect()
        return jobs() - before

    whole = cost(lambda: tree.stats(n))
    assert max(cost(lambda: tree.project_map(n)), cost(lambda: tree.node_stats(n))) <= whole + 3
    assert cost(lambda: tree.expand(n, "d1")) <= whole + 8


def test_empty_table(spark):
    none = spark.createDataFrame([], NODES)
    assert tree.stats(none).count() == 0 and rel.edges(none).count() == 0 and tree.children(none).count() == 0


def test_subclasses_and_special_characters(spark):
    n = nodes(spark, [("u", None, "User", "class", [], ["BaseModel"]), ("o", None, "Order", "class", [], ["BaseModel", "Serializable"]), ("x", None, "Other", "class", [], []), ("m", None, "MyClass", "class", [], ["Base_Model", "Generic[K, V]"]), ("f", None, "f", "function", [], ["BaseModel"])])
    ids = lambda b: sorted(r.id for r in rel.subclasses(n, b).collect())
    assert (ids("BaseModel"), ids("Serializable"), ids("Base_Model"), ids("BaseXModel"), ids("basemodel"), ids("Generic[K, V]")) == (["o", "u"], ["o"], ["m"], [], [], ["m"])
    assert sorted((r["count"], r.subclass_id) for r in rel.hierarchy(n).filter("base = 'BaseModel'").collect()) == [(2, "o"), (2, "u")]


def test_callers_at_every_place(spark):
    n = nodes(spark, [(f"f{i}", None, f"f{i}", "function", c, []) for i, c in enumerate([["target", "other"], ["other", "target", "another"], ["other", "target"], ["target"], ["Target"]])] + [("t", None, "target", "function", [], [])])
    assert sorted(r.id for r in rel.callers(n, "target").collect()) == ["f0", "f1", "f2", "f3"]
    seen = {r.id: r.called_by for r in rel.inspect(n, n.select("id").filter("id in ('t', 'f0')")).collect()}
    assert seen == {"t": ["f0", "f1", "f2", "f3"], "f0": []}
    assert {r.id: r.n_callers for r in rel.inspect_all(n).collect()} == {"t": 4, "f0": 0, "f1": 0, "f2": 0, "f3": 0, "f4": 0}
    assert sorted(r.caller_id for r in rel.callers_by_name(n).filter("name = 'target'").collect()) == ["f0", "f1", "f2", "f3"]
    assert {(r.source_id, r.target_id, r.relation) for r in rel.edges(n).collect()} == {(f"f{i}", "t", "calls") for i in range(4)}
    assert {(r.name, r.callers, r.definitions) for r in rel.fan_out(n).collect()} == {("target", 4, 1)}


def test_directories_follow_files(spark):
    got = {r.id for r in fil.directory_nodes(files(spark, {"x.py": ""})).collect()}
    assert got == {"."}


def test_hot_names_are_dealt_to_cells(spark):
    rows = [(f"c{i}", None, f"c{i}", "function", ["hot", f"c{i % 7}"], ["Base"]) for i in range(200)] + [(f"h{i}", None, "hot", "function", [], []) for i in range(90)] + [("b", None, "Base", "class", [], [])]
    n = nodes(spark, rows)
    want = {("c%d" % i, "h%d" % j, "calls") for i in range(200) for j in range(90)} | {(f"c{i}", f"c{i % 7}", "calls") for i in range(200)} | {(f"c{i}", "b", "inherits") for i in range(200)}
    for cell in (1_000, 50, 10):
        got = [tuple(r) for r in rel.edges(n, cell).collect()]
        assert len(got) == len(want) and set(got) == want
    sources, targets = rel.called(n), n.select(F.col("id").alias("target_id"), "name")
    heavy, found = rel.heavy_names(sources, targets, 10)
    a, b = rel.grid_sides(sources, targets, heavy)
    assert found == 8 and max(r["count"] for side in (a, b) for r in side.groupBy("name", "row", "column").count().collect()) <= 25


def test_pairs_of_one_name_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(rel, "TASK_PAIRS", 500, raising=False)
    rows = [(f"c{i}", None, f"c{i}", "function", ["hot"], []) for i in range(200)] + [(f"h{i}", None, "hot", "function", [], []) for i in range(200)]
    dealt = rel.edges(nodes(spark, rows), 25).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in dealt) == 40_000 and max(r["count"] for r in dealt) <= 10_000


def test_both_relations_are_one_loop_over_lists(spark, monkeypatch):
    rows = [(f"c{i}", None, f"c{i % 30}", "function", ["hot", "hot", None, "gone", f"c{i % 7}"], ["Base"]) for i in range(60)] + [(f"h{i}", None, "hot", "class" if i % 2 else None, None, ["hot", "Base"]) for i in range(40)] + [("b", None, "Base", "class", ["Base"], None), ("u", None, None, "class", ["c1"], [None])]
    n = nodes(spark, rows)
    want = sorted((r[0], t[0], relation) for at, relation in ((4, "calls"), (5, "inherits")) for r in rows for x in {*(r[at] or [])} - {None} for t in rows if t[2] == x and (relation == "calls" or t[3] == "class"))
    for most in (0, 1 << 20):
        monkeypatch.setattr(rel, "LISTED_BYTES", most, raising=False)
        for cell in (1_000, 7):
            found = rel.edges(n, cell)
            assert "Union" not in plan(found) and plan(found).count("explode(target_ids") == 1
            assert sorted(map(tuple, found.collect())) == want


def test_links_are_those_of_the_last_definition(spark):
    row = lambda i, parent, kind, position, name="n": (i, parent, name, kind, None, None, None, None, None, [], [], "python", position)
    rows = [row("a", "p", "class", 1), row("a", "q", "function", 2), row("b", "p", "class", 2), row("b", "p", "class", 1, "m"), row("p", None, "dir", 0), row("q", None, "dir", 0), row(None, "p", "class", 1), row(None, "q", "class", 3)]
    t = spark.createDataFrame(rows, NODES + ", position int")
    whole = tree.assemble(t)
    want = sorted(map(repr, whole.select(*tree.LINKS).collect()))
    got = tree.links(t)
    assert sorted(map(repr, got.collect())) == want and counts(tree.stats(got)) == counts(tree.stats(whole))
    for parent in ("p", "q"):
        some = tree.assemble_some(tree.near(got, parent), t)
        assert sorted(map(tuple, tree.expand(some, parent, got).collect()), key=repr) == sorted(map(tuple, tree.expand(whole, parent).collect()), key=repr)
    assert "docstring" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_rows_of_ids_that_repeat_are_compared_alone(spark, monkeypatch):
    f = files(spark, {"a.py": "def f(x): pass\ndef f(y): pass\ndef g(): pass\n", "b.py": "def h(): pass\n"})
    tables = fil.file_nodes(f), ent.entity_nodes(ent.extract(f.selectExpr("*", "'python' AS language")))
    want = sorted(map(repr, tree.assemble(*tables).collect()))
    for most in (0, 10):
        monkeypatch.setattr(tree, "MOST_AGAIN", most)
        assert sorted(map(repr, tree.assemble_written(*tables).collect())) == want
    once = tree.assemble_written(fil.file_nodes(f))
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert once.count() == 2 and "Aggregate" not in plan and "Exchange" not in plan


def test_digests_tell_lists_apart(spark):
    n = nodes(spark, [("a", None, "a", "function", ["t", "u"], []), ("b", None, "b", "function", ["t", "v"], []), ("t", None, "t", "function", [], []), ("u", None, "u", "function", [], []), ("v", None, "v", "function", [], []), ("w", None, "w", "function", [], [])])
    got = {r.name: (r.n_callers, r.digest) for r in rel.inspect_digests(n).collect()}
    assert got["w"] == (0, None) and got["t"][0] == 2 and got["u"][0] == got["v"][0] == 1 and got["u"][1] != got["v"][1]
    assert int(got["t"][1]) == int(got["u"][1]) + int(got["v"][1])
