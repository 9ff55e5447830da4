from pyspark.sql import functions as F

from treeloom.operators import entities as ent
from treeloom.operators import files as fil

from .fixtures import SAMPLE, files


def extracted(spark, sources):
    f = files(spark, sources).withColumn("language", F.lit("python"))
    return {(r.path, r.qualname): r for r in ent.extract(f).collect()}


def test_sample(spark):
    got = extracted(spark, SAMPLE)
    assert {q for _, q in got} == {"ring", "receipt", "Shelf", "Shelf.put", "Shelf.take", "price_tag", "order_goods"}
    put = got["shop/stock/shelf.py", "Shelf.put"]
    assert (put.type, put.signature, put.docstring, put.parent_qualname, put.line_start, put.line_end) == ("method", "def put(self, item: str, pieces: int) -> int", "Put pieces away.", "Shelf", 4, 6)
    assert got["shop/stock/shelf.py", "order_goods"].signature == "async def order_goods(url: str) -> str"
    assert got["shop/till.py", "ring"].calls == ["receipt", "round"]


def test_forms(spark):
    source = (
        "import x\n\n@x.deco\ndef f(a, /, b: int = 5, *args: str, c, d='q', **kw) -> None:\n    def inner(): hidden()\n    self.save(g()(1))\n\n"
        "@deco\nclass Child(Parent, Mixin[int], metaclass=M):\n    '''Doc.'''\n    class Nested:\n        async def m(self, *, k): pass\n\nif True:\n    def skipped(): pass\n"
    )
    got = {q: r for (_, q), r in extracted(spark, {"a.py": source}).items()}
    assert set(got) == {"f", "Child", "Child.Nested", "Child.Nested.m"}
    assert got["f"].signature == "def f(a, /, b: int=5, *args: str, c, d='q', **kw) -> None"
    assert got["f"].calls == ["g", "hidden", "save"]
    assert got["f"].line_start == 4
    assert (got["Child"].signature, got["Child"].base_classes, got["Child"].calls) == ("class Child(Parent, Mixin[int])", ["Parent", "Mixin[int]"], [])
    assert got["Child.Nested.m"].signature == "async def m(self, *, k)"
    assert [got[q].position for q in ("f", "Child", "Child.Nested", "Child.Nested.m")] == [0, 1, 2, 3]


def test_broken_files_give_nothing(spark):
    broken = {"a.py": "def broken(:\n", "b.py": b"\x80\x81", "c.py": "", "d.py": b"x = '\x00'"}
    assert extracted(spark, broken) == {}
    lines = {r.id: r.line_end for r in fil.file_nodes(files(spark, broken)).collect()}
    assert lines["b.py"] == 0 and lines["a.py"] == 2 and lines["c.py"] == 1


def test_ids(spark):
    f = files(spark, SAMPLE).withColumn("language", F.lit("python"))
    got = {(r.id, r.parent_id) for r in ent.entity_nodes(ent.extract(f)).collect()}
    assert ("shop/stock/shelf.py:Shelf.put", "shop/stock/shelf.py:Shelf") in got
    assert ("shop/till.py:ring", "shop/till.py") in got


def test_other_extractors_plug_in(spark):
    def upper(batches):
        for b in batches:
            yield ent.pd.DataFrame([(p, 0, "X", None, "X", "struct", 1, 1, None, None, [], [], "go") for p in b["path"]], columns=ent.FIELDS).astype({"position": "int32", "line_start": "int32", "line_end": "int32"})

    f = spark.createDataFrame([("a.go", b"", "go"), ("b.py", b"def f(): pass", "python")], "path string, content binary, language string")
    got = ent.extract(f, {**ent.EXTRACTORS, "go": upper}, partitions=2).collect()
    assert {(r.path, r.type) for r in got} == {("a.go", "struct"), ("b.py", "function")}


def test_odd_files_cost_no_others(spark):
    deep = "def f(x=" + "+".join(["1"] * 3000) + "): pass\n"
    surrogate = 'def g():\n    "\\ud800 half"\n\nclass H(B["\\udc00"]): pass\n'
    got = extracted(spark, {"a.py": deep, "b.py": surrogate, "c.py": "def ok(): pass\n", "d.py": "def f(:\n", "e.py": "x = 1\0\n"})
    assert ("c.py", "ok") in got and got["b.py", "g"].docstring == "? half" and ("b.py", "H") in got
    assert {p for p, _ in got} <= {"a.py", "b.py", "c.py"}
