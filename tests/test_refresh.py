import json

import pytest

from treeloom.operators import entities as ent
from treeloom.operators import refresh as ref
from treeloom.operators import render, tree
from treeloom.operators import search as sea
from treeloom.schemas import POSTINGS
from treeloom.sources import segments, snapshots

from .fixtures import GOODS, SAMPLE, files


def tables(s):
    rounded = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v for v in r) for r in df.collect())
    key = lambda rows: sorted(rows, key=repr)
    return key([repr(tuple(r)) for r in s.nodes.collect()]), rounded(s.postings), rounded(s.idf), sorted((r.path, r.hash) for r in s.file_hashes.collect())


NEW = {
    "shop/__init__.py": "",
    "shop/till.py": "def ring():\n    fresh()\n\n\ndef second(): pass\n\n\ndef third(): pass\n",
    "shop/stock/shelf.py": SAMPLE["shop/stock/shelf.py"],
    "lib/deep/new.py": GOODS["shop/goods.py"],
}


@pytest.fixture(scope="module")
def old(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("snap"))
    snapshots.save(ref.full_build(files(spark, SAMPLE), ent.extract), path)
    return snapshots.load(spark, path)


def test_refresh_equals_full_build(spark, old):
    got = ref.refresh(old, files(spark, NEW), ent.extract)
    assert tables(got) == tables(ref.full_build(files(spark, NEW), ent.extract))
    functions = [r.name for r in got.nodes.filter("file_path = 'shop/till.py' and type = 'function'").collect()]
    assert sorted(functions) == ["ring", "second", "third"]
    assert [r.name for r in sea.search_one(got.nodes, got.postings, got.idf, "shelf").collect()] == ["Shelf"]


def test_nothing_changed(spark, old):
    assert tables(ref.refresh(old, files(spark, SAMPLE), ent.extract)) == tables(old)


def test_directory_goes_with_its_last_file(spark, old):
    got = ref.refresh(old, files(spark, {"shop/till.py": SAMPLE["shop/till.py"]}), ent.extract)
    assert {r.id for r in got.nodes.filter("type = 'dir'").collect()} == {".", "shop"}


def test_threshold_policy_keeps_unchanged_entities_searchable(spark, old):
    got = ref.refresh(old, files(spark, NEW), ent.extract, policy="threshold")
    assert [r.name for r in sea.search_one(got.nodes, got.postings, got.idf, "take").collect()] == ["take"]


def test_classify_and_counts(spark, old):
    edited = {**SAMPLE, "shop/till.py": SAMPLE["shop/till.py"] + "# more\n", "a.py": ""}
    del edited["shop/__init__.py"]
    from treeloom.operators import files as fil

    got = {r.path: r.status for r in ref.classify(fil.hashed(files(spark, edited)), old.file_hashes).collect()}
    assert got == {"shop/till.py": "updated", "a.py": "added", "shop/__init__.py": "removed", "shop/stock/__init__.py": "unchanged", "shop/stock/shelf.py": "unchanged"}
    assert [r.path for r in ref.removed_files(fil.hashed(files(spark, edited)), old.file_hashes).collect()] == ["shop/__init__.py"]


def test_snapshots_keep_lists_and_replace(spark, tmp_path):
    s = ref.full_build(files(spark, {"m.py": "class A(B1, B2, B3): pass\n"}), ent.extract)
    snapshots.save(s, str(tmp_path))
    assert snapshots.load(spark, str(tmp_path)).nodes.filter("name = 'A'").first().base_classes == ["B1", "B2", "B3"]
    snapshots.save(ref.full_build(files(spark, GOODS), ent.extract), str(tmp_path))
    snapshots.prune(spark, str(tmp_path), keep=1)
    assert len(list(tmp_path.glob("v*"))) == 1 and snapshots.prune(spark, str(tmp_path)) == []
    again = snapshots.load(spark, str(tmp_path))
    assert again.nodes.filter("name = 'A'").count() == 0 and again.nodes.filter("name = 'Apple'").count() == 1


def test_upsert_is_idempotent(spark, old):
    from treeloom.operators import files as fil

    new = fil.file_hashes(files(spark, NEW))
    once = ref.upsert_hashes(old.file_hashes, new)
    twice = ref.upsert_hashes(once, new)
    pick = lambda d: sorted((r.path, r.hash) for r in d.collect())
    assert pick(once) == pick(twice) and once.count() == 5


def test_json(spark, old):
    n = old.nodes
    whole = json.loads(render.map_json(n, "proj", "/tmp/proj").first().json)
    assert whole["command"] == "map" and whole["stats"] == {"files": 4, "classes": 1, "functions": 4, "methods": 2} and [c["id"] for c in whole["children"]] == ["shop"]
    node = json.loads(render.expand_json(n, "shop").first().json)
    assert [c["id"] for c in node["children"]] == ["shop/__init__.py", "shop/stock", "shop/till.py"]
    assert set(node["node"]) == set(render.FIELDS) and len(render.FIELDS) == 13 and node["node"]["signature"] is None
    assert node["children"][2]["stats"]["functions"] == 2
    seen = {r.id: json.loads(r.json) for r in render.inspect_json(n, n.select("id")).collect()}
    assert seen["shop/till.py:receipt"]["called_by"] == ["shop/till.py:ring"] and seen["shop/till.py:ring"]["calls"] == ["receipt", "round"]
    kids = json.loads(render.hierarchy_json(n, "Nothing").first().json)
    assert kids["count"] == 0 and kids["subclasses"] == []


def test_search_json(spark, old):
    queries = spark.createDataFrame([(1, 'int "é\\'), (2, "zzz")], "query_id long, query string")
    found = sea.ranked(sea.scores(old.postings, old.idf, queries))
    got = {r.query_id: json.loads(r.json) for r in render.search_json(old.nodes, queries, found).collect()}
    assert got[1]["query"] == 'int "é\\' and got[1]["count"] == 2 and [x["score"] for x in got[1]["results"]] == [0.415, 0.415]
    assert got[2]["count"] == 0 and got[2]["results"] == []


def test_results_do_not_hang_on_partitions(spark, old):
    a = sorted(tuple(r) for r in tree.stats(old.nodes.repartition(1)).collect())
    b = sorted(tuple(r) for r in tree.stats(old.nodes.repartition(7)).collect())
    assert a == b


def test_null_content_is_a_value(spark):
    def given(**sources):
        return spark.createDataFrame([(p.replace("_", ".") , None if c is None else bytearray(c.encode())) for p, c in sources.items()], "path string, content binary")

    for before, after in ((dict(a_py="def a(): pass\n", b_py=None), dict(a_py="def a(): pass\n", b_py="def b(): pass\n")), (dict(a_py="def a(): pass\n", b_py="def b(): pass\n"), dict(a_py="def a(): pass\n", b_py=None)), (dict(b_py=None), dict(b_py=None))):
        new = ref.refresh(ref.full_build(given(**before), ent.extract), given(**after), ent.extract)
        assert tables(new) == tables(ref.full_build(given(**after), ent.extract))
    hashes = spark.createDataFrame([("x", None), ("y", "1"), ("z", None)], "path string, hash string")
    other = spark.createDataFrame([("x", None), ("y", None), ("w", None)], "path string, hash string")
    assert {r.path: r.status for r in ref.classify(other, hashes).collect()} == {"x": "unchanged", "y": "updated", "z": "removed", "w": "added"}
    assert ref.status_counts(ref.classify(other, hashes)).first().asDict() == dict(added=1, updated=1, removed=1, unchanged=1)


def test_delta_sees_values_that_move_between_columns(spark):
    schema = "id string, name string, type string, signature string, docstring string, file_path string"
    old = spark.createDataFrame([("a", "n", "function", "x", None, "p"), ("b", "n", "function", None, None, "p")], schema)
    new = spark.createDataFrame([("a", "n", "function", None, "x", "p"), ("b", "n", "function", None, None, "p")], schema)
    assert [(r.id, r.status) for r in ref.node_delta(old, new).collect()] == [("a", "updated")]


def test_kept_texts_are_not_shuffled(spark, old):
    changed = files(spark, {"shop/till.py": NEW["shop/till.py"]}).selectExpr("*", "'python' AS language")
    got = ref.replace_files(old.nodes, changed, files(spark, SAMPLE), ent.extract).filter("type <> 'dir'")
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


def stored(spark, tmp_path, sources, buckets=8):
    path = str(tmp_path / "snapshots")
    snapshots.save(ref.full_build(files(spark, sources), ent.extract), path, buckets)
    return path


def test_stored_refresh_equals_full_build(spark, tmp_path):
    path = stored(spark, tmp_path, SAMPLE)
    for sources in (NEW, GOODS, SAMPLE, {"a.txt": ""}, NEW):
        snapshots.refresh(spark, path, files(spark, sources), ent.extract)
        got, want = snapshots.load(spark, path), ref.full_build(files(spark, sources), ent.extract)
        assert tables(got) == tables(want)
        assert got.documents == want.documents and sorted(got.frequencies.collect()) == sorted(want.frequencies.collect())
    assert snapshots.refresh(spark, path, files(spark, NEW), ent.extract) == []


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    many = {f"d{i % 50}/f{i}.py": f"def name_{i}(): pass\n" for i in range(10_000)}
    path = stored(spark, tmp_path, many, buckets=16)
    first = snapshots.version(spark, path, 1)
    frozen = snapshots.load(spark, path)
    assert len(snapshots.refresh(spark, path, files(spark, {**many, "d7/f7.py": "def other(): pass\n"}), ent.extract)) == 1
    second = snapshots.version(spark, path, 2)
    for name in snapshots.KEYS:
        new = {b for b, f in second.parts[name].items() if f != first.parts[name].get(b)}
        assert len(new - {str(snapshots.DIRECTORIES)}) == 1 and len(second.parts[name]) >= 16
    assert frozen.nodes.filter("name = 'name_7'").count() == 1 and frozen.nodes.filter("name = 'other'").count() == 0
    now = snapshots.load(spark, path)
    assert now.nodes.filter("name = 'name_7'").count() == 0 and now.nodes.filter("name = 'other'").count() == 1
    n = frozen.nodes.count()
    assert now.nodes.count() == n and now.documents == 10_000
    deleted = snapshots.prune(spark, path, keep=1)
    assert deleted and not any("bucket=" not in d and d.endswith("nodes") for d in deleted)
    assert snapshots.load(spark, path).nodes.count() == n


def test_a_refresh_counts_nothing_anew(spark, old):
    """The new frequencies read the old ones and the changed postings; kept postings are not aggregated."""
    got = ref.refresh(old, files(spark, NEW), ent.extract)
    plan = got.idf._jdf.queryExecution().optimizedPlan().toString()
    assert "node_id" not in plan


def test_of_two_savers_one_fails(spark, tmp_path):
    path = stored(spark, tmp_path, SAMPLE)
    at = snapshots.version(spark, path, 1)
    snapshots.refresh(spark, path, files(spark, NEW), ent.extract)
    with pytest.raises(snapshots.SavedBefore):
        snapshots.publish(spark, path, snapshots.Version(at.number + 1, at.buckets, 0, at.parts))
    assert tables(snapshots.load(spark, path)) == tables(ref.full_build(files(spark, NEW), ent.extract))


def test_threshold_policy_in_store(spark, tmp_path, old):
    path = stored(spark, tmp_path, SAMPLE)
    snapshots.refresh(spark, path, files(spark, NEW), ent.extract, policy="threshold")
    assert tables(snapshots.load(spark, path))[2] == tables(ref.refresh(old, files(spark, NEW), ent.extract, policy="threshold"))[2]


def test_directory_digests(spark):
    from treeloom.operators import files as fil

    of = lambda sources: ref.directory_digests(fil.hashed(files(spark, sources)))
    one, edited = of(SAMPLE), of({**SAMPLE, "shop/till.py": "x = 1\n", "new/a.py": ""})
    assert {r.id: r.n_files for r in one.collect()} == {".": 4, "shop": 4, "shop/stock": 2}
    assert {(r.id, r.status) for r in ref.changed_directories(edited, one).collect()} == {(".", "updated"), ("shop", "updated"), ("new", "added")}
    assert ref.changed_directories(of(SAMPLE), one).count() == 0
    swapped = {**SAMPLE, "shop/__init__.py": "a", "shop/stock/__init__.py": "b"}
    back = {**SAMPLE, "shop/__init__.py": "b", "shop/stock/__init__.py": "a"}
    assert ref.changed_directories(of(swapped), of(back)).count() == 3


def test_an_equal_corpus_reads_nothing_stored(spark, tmp_path, monkeypatch):
    path = stored(spark, tmp_path, SAMPLE)

    def refuse(*a):
        raise AssertionError("a stored table is read")

    monkeypatch.setattr(snapshots, "rows", refuse)
    assert snapshots.refresh(spark, path, files(spark, SAMPLE), ent.extract) == []


def found(df):
    return sorted((r.query_id, r["rank"], r.node_id, r.score, r.name) for r in df.collect())


def test_stored_search_equals_search_after_a_refresh(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    snapshots.save(ref.full_build(files(spark, SAMPLE), ent.extract), path, buckets=4, part_rows=4)
    n = 2 * segments.FEW_TERMS
    new = {**NEW, "m.py": "".join(f"def word{i}(): pass\n" for i in range(n))}
    snapshots.refresh(spark, path, files(spark, new), ent.extract)
    snapshots.prune(spark, path, keep=1)
    want = ref.full_build(files(spark, new), ent.extract)
    few = [(1, "put pieces away int"), (2, "apple fruit"), (3, "zzz"), (4, None), (5, "ring ring second sale")]
    for asked in (few, [*few, (6, " ".join(f"word{i}" for i in range(n)))]):
        queries = spark.createDataFrame(asked, "query_id long, query string")
        assert found(snapshots.search(spark, path, queries)) == found(sea.search(want.nodes, want.postings, want.idf, queries))


def word_postings(spark, rows):
    return spark.createDataFrame([(f"n{i}", w, 0.5) for i, w in rows], POSTINGS)


def test_a_search_opens_the_files_of_its_terms(spark, tmp_path):
    path = str(tmp_path)
    first = segments.write(word_postings(spark, [(i, f"word{i}") for i in range(3_000)]), None, 3_000, path, "v1", 100)
    gone = spark.createDataFrame([("n1",), ("n2",)], "node_id string")
    at = segments.after(spark, path, [first], word_postings(spark, [(1, "other")]), gone, "v2", 100)
    assert at[0] == first and len(first["parts"]) == 30 and len(at[1]["parts"]) == 1 and at[1]["rows"] == 3
    asked = lambda *words: segments.live(spark, path, at, terms=spark.createDataFrame([(w,) for w in words], "term string"))
    assert [r.node_id for r in asked("word7").collect()] == ["n7"]
    assert asked("word1", "word2", "unknown").count() == 0 and asked("other").count() == 1 and asked().count() == 0
    read = [f for f in asked("word7").inputFiles() if "/terms/" in f]
    assert len(read) == 2 and len(segments.live(spark, path, at).inputFiles()) > 30


def test_segments_are_merged_as_they_grow(spark, tmp_path):
    at, holds = [], {}
    for i in range(8):
        new = {j: f"word{i}" for j in (i, i + 1, (3 * i) % 8)}
        lost = [0] if i == 5 else []
        gone = spark.createDataFrame([(f"n{j}",) for j in [*new, *lost]], "node_id string")
        at = segments.after(spark, str(tmp_path), at, word_postings(spark, new.items()), gone, f"v{i}", 2)
        holds = {j: w for j, w in (holds | new).items() if j not in lost}
        assert len(at) <= 3
    assert sorted((r.node_id, r.term) for r in segments.live(spark, str(tmp_path), at).collect()) == sorted((f"n{j}", w) for j, w in holds.items())
    none = spark.createDataFrame([], "node_id string")
    assert segments.after(spark, str(tmp_path), at, word_postings(spark, []), none, "none", 2) == at
