import pytest
from pyspark.sql import functions as F

from treeloom.functions import paths, text
from treeloom.operators import files as fil
from treeloom.sources import trees
from treeloom.sources.trees import SourceTree, read_tree

from .fixtures import SAMPLE, files


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", expression(F.col("x")).alias("y")).collect())]


def test_exclusion(spark):
    given = ["src/a.py", "src/__pycache__/a.py", "pkg.egg-info/x.py", "node_modules/x.js", "dist", "distant/a.py", ".git/x"]
    assert column(spark, given, paths.is_excluded) == [False, True, True, True, True, False, True]
    assert column(spark, given, lambda c: paths.is_excluded(c, ["*.py", "dist"])) == [True, True, True, False, True, True, False]


def test_routing(spark):
    given = ["a.py", "b/A.PYI", "c.d/e", ".py", "x.tar.js", "m.hpp", "n.gemspec", "README", "z.txt"]
    assert column(spark, given, paths.language) == ["python", "python", None, None, "javascript", "c_cpp", "ruby", None, None]


def test_parent_and_ancestors(spark):
    assert column(spark, ["x.py", "a/x.py", "a/b/x.py"], paths.parent) == [".", "a", "a/b"]
    assert column(spark, ["x.py", "a/x.py", "a/b/x.py"], paths.ancestors) == [[], ["a"], ["a", "a/b"]]


def test_decoding(spark):
    given = [b"ab\nc", b"\xff\xfe", b"", "é".encode()]
    assert column(spark, given, text.strict_text, "binary") == ["ab\nc", None, "", "é"]
    assert column(spark, given, text.lenient_text, "binary") == ["ab\nc", "ÿþ", "", "é"]
    assert column(spark, given, lambda c: text.line_count(text.strict_text(c)), "binary") == [2, 0, 1, 1]


@pytest.mark.parametrize(("name", "parts"), [("getUserData", ["get", "user", "data"]), ("get_user_data", ["get", "user", "data"]), ("HTTPServer", ["h", "t", "t", "p", "server"]), ("", [])])
def test_split_identifier(spark, name, parts):
    assert column(spark, [name], text.split_identifier) == [parts]


@pytest.mark.parametrize(("given", "out"), [("the function return a value", ["function", "value"]), ("ab cd efg", ["efg"]), ("getUser_data2 HTTPServer 12abc", ["getuser", "data2", "httpserver", "abc"])])
def test_tokens(spark, given, out):
    assert column(spark, [given], text.tokens) == [out]


def test_read_lines(spark):
    f = files(spark, {"m": "1\n2\n3\n4\n5\n6", "latin": b"\xe9\nx"})
    asked = spark.createDataFrame([("m", 1, 5), ("m", 10, 5), ("m", 5, 99), ("m", -3, 2), ("m", None, 0), ("latin", 1, 1), ("none", 1, 1), ("m", 9, None)], "path string, start int, end int")
    got = {(r.path, r.start, r.end): (r.text, r.error) for r in fil.read_lines(f, asked).collect()}
    assert {(r.path, r.start, r.end): (r.text, r.error) for r in fil.read_lines(f, asked, fil.line_index(f)).collect()} == got
    assert got["m", 1, 5] == ("1\n2\n3\n4\n5", None)
    assert got["m", 10, 5][0] is None and got["m", 10, 5][1]
    assert got["m", 5, 99] == ("5\n6", None)
    assert got["m", -3, 2] == ("1\n2", None)
    assert got["m", None, 0] == ("1\n2\n3\n4\n5\n6", None)
    assert got["latin", 1, 1] == ("é", None)
    assert got["none", 1, 1] == (None, "no such file")
    assert got["m", 9, None][1]


def test_source_tree_keeps_underscored_names(spark, tmp_path):
    for p, s in {**SAMPLE, ".hidden.py": "x", "__pycache__/a.py": "y"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(s)
    spark.dataSource.register(SourceTree)
    got = {r.path: bytes(r.content).decode() for r in spark.read.format("source_tree").load(str(tmp_path)).collect()}
    assert got == {**SAMPLE, ".hidden.py": "x"}
    for most, share in ((1, 5000), (2, 1), (0, 1)):
        planned = spark.read.format("source_tree").option("partitions", most).option("files", share).load(str(tmp_path))
        assert sorted(r.path for r in planned.collect()) == sorted(got)
    everything = spark.read.format("source_tree").option("all", "true").load(str(tmp_path))
    assert everything.count() == len(SAMPLE) + 2


def test_a_range_by_offsets_equals_a_split(spark):
    texts = {"utf": "é\n中文\n\n🙂 x\n", "latin": b"\xe9\nb\xff\n\nz", "empty": "", "one": "no newline", "ends": "\n\n", "null": None, "cr": "a\r\nb"}
    f = spark.createDataFrame([(p, None if t is None else bytearray(t.encode() if isinstance(t, str) else t)) for p, t in texts.items()], "path string, content binary")
    asked = spark.createDataFrame([(p, a, b) for p in texts for a in (None, -1, 0, 1, 2, 3, 9) for b in (None, 0, 1, 2, 4, 9)], "path string, start int, end int")
    plain = sorted(fil.read_lines(f, asked).collect(), key=repr)
    by_offset = fil.read_lines(f, asked, fil.line_index(f))
    assert sorted(by_offset.collect(), key=repr) == plain
    assert "split(" not in by_offset._jdf.queryExecution().optimizedPlan().toString()


def rows_of(df):
    return {r.path: (None if r.content is None else bytes(r.content), r.error) for r in df.collect()}


def test_source_tree_reads_any_name_and_survives_what_it_cannot_read(spark, tmp_path, monkeypatch):
    import os

    root = os.fsencode(str(tmp_path))
    for name in (b"\xff.py", "é.py".encode(), b"sp ace\n.go", b"ok.py"):
        with open(os.path.join(root, name), "wb") as f:
            f.write(name)
    os.mkdir(os.path.join(root, b"d\xfe"))
    with open(os.path.join(root, b"d\xfe", b"in.py"), "wb") as f:
        f.write(b"in")
    os.symlink("/nowhere", tmp_path / "link.py")
    got = rows_of(read_tree(spark, str(tmp_path)))
    assert got == {r"\xff.py": (b"\xff.py", None), "é.py": ("é.py".encode(), None), "sp ace\n.go": (b"sp ace\n.go", None), "ok.py": (b"ok.py", None), r"d\xfe/in.py": (b"in", None)}


def test_errors_are_rows_and_vanished_files_are_none(tmp_path, monkeypatch):
    """Where the tests run as root every file can be opened, so the failures are made."""
    import builtins

    for name in ("a.py", "gone.py", "locked.py"):
        (tmp_path / name).write_text(name)
    (tmp_path / "shut").mkdir()
    reader = trees.SourceTreeReader(bytes(tmp_path), ["path", "content", "error"], False, 4, 10, None)
    real_open, real_scan = builtins.open, trees.os.scandir

    def failing_open(path, *a):
        if isinstance(path, bytes) and path.endswith(b"gone.py"):
            raise FileNotFoundError(2, "No such file")
        if isinstance(path, bytes) and path.endswith(b"locked.py"):
            raise PermissionError(13, "Permission denied")
        return real_open(path, *a)

    def failing_scan(path):
        if path.endswith(b"shut"):
            raise PermissionError(13, "Permission denied")
        return real_scan(path)

    monkeypatch.setattr(builtins, "open", failing_open)
    monkeypatch.setattr(trees.os, "scandir", failing_scan)
    got = sorted(r for p in reader.partitions() for r in reader.read(p))
    assert got == [("a.py", b"a.py", None), ("locked.py", None, "Permission denied"), ("shut", None, "Permission denied")]


def test_only_what_is_asked_for_is_opened(spark, tmp_path, monkeypatch):
    for p in ("src/a.py", "src/b.go", "lib/c.py", "lib/deep/d.py", "readme.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(p)
    opened, entered = [], []
    monkeypatch.setattr(trees.SourceTreeReader, "file", lambda self, path, f=trees.SourceTreeReader.file: (opened.append(self.relative(path)), f(self, path))[1])
    monkeypatch.setattr(trees.SourceTreeReader, "entries", lambda self, walk, f=trees.SourceTreeReader.entries: (entered.append(self.relative(walk.folder)), f(self, walk))[1])

    def run(filters=(), suffixes=None):
        opened.clear(), entered.clear()
        reader = trees.FilteringReader(bytes(tmp_path), ["path", "content", "error"], False, 2, 10, suffixes)
        left = list(reader.pushFilters(list(filters)))
        return sorted(r[0] for p in reader.partitions() for r in reader.read(p)), left

    under = trees.StringStartsWith(("path",), "lib/")
    assert run([under]) == (["lib/c.py", "lib/deep/d.py"], []) and sorted(opened) == ["lib/c.py", "lib/deep/d.py"] and "src" not in entered
    assert run([trees.EqualTo(("path",), "src/a.py")])[0] == ["src/a.py"] and "lib" not in entered
    assert run([trees.In(("path",), ("src/a.py", "lib/c.py", None))])[0] == ["lib/c.py", "src/a.py"] and "lib/deep" not in entered
    assert run([trees.StringEndsWith(("path",), ".py")], [".go"])[0] == []
    assert run([], [".go"])[0] == opened == ["src/b.go"]
    other = trees.EqualTo(("error",), "x")
    assert run([other])[1] == [other]
    monkeypatch.undo()
    spark.conf.set(trees.PUSHDOWN, "true")
    try:
        assert [r.path for r in read_tree(spark, str(tmp_path)).filter("path like 'lib/%' and path like '%d.py'").collect()] == ["lib/deep/d.py"]
    finally:
        spark.conf.unset(trees.PUSHDOWN)
    (tmp_path / "src" / "b.go").unlink()
    (tmp_path / "src" / "b.go").symlink_to("/nowhere")
    paths_only = read_tree(spark, str(tmp_path), columns="path string")
    assert sorted(r.path for r in paths_only.collect()) == ["lib/c.py", "lib/deep/d.py", "readme.md", "src/a.py"]


def test_partitions_are_bounded(tmp_path):
    for i in range(300):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / "x.py").write_text("")
    for most, share in ((7, 5), (7, 5000), (1, 1), (1000, 5000)):
        reader = trees.SourceTreeReader(bytes(tmp_path), ["path", "content", "error"], False, most, share, None)
        planned = reader.partitions()
        assert len(planned) <= most
        assert sorted(r[0] for p in planned for r in reader.read(p)) == sorted(f"p{i}/x.py" for i in range(300))


def test_write_tree_wants_a_mounted_folder(spark):
    from treeloom.plans import adapters as ad

    for folder in ("hdfs://host/x", "s3a://b/x", "relative"):
        with pytest.raises(ValueError):
            ad.write_tree(files(spark, SAMPLE), folder)


def test_hashes(spark):
    import hashlib

    got = {r.path: (r.hash, r.indexed_at) for r in fil.file_hashes(files(spark, SAMPLE)).collect()}
    assert all(got[p][0] == hashlib.sha256(s.encode()).hexdigest() and got[p][1] for p, s in SAMPLE.items())


def test_dir_closure(spark):
    got = {(r.id, r.parent_id) for r in fil.directory_nodes(files(spark, SAMPLE)).collect()}
    assert got == {(".", None), ("shop", "."), ("shop/stock", "shop")}
