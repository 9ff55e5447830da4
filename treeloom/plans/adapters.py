"""The given tables in the shapes of a code corpus."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import NODE_COLUMNS, NODES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def node_rows(df: DataFrame, **columns) -> DataFrame:
    """Rows of the node schema; what is not given is null or an empty list."""
    kinds = dict(c.split() for c in NODES.split(", "))
    default = lambda c: F.array().cast(kinds[c]) if kinds[c].startswith("array") else F.lit(None).cast(kinds[c])
    return df.select(*[(columns[c] if c in columns else default(c)).cast(kinds[c]).alias(c) for c in NODE_COLUMNS], columns.get("position", F.lit("")).alias("position"))


def order_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node tree: root, regions and nations (directories), customers (files), orders (classes or functions), lineitems (methods).

    Every 97th order is left out, so that its lineitems are orphans; (order, line number) repeats, and the
    later row in ``position`` wins.
    """
    region, nation, customer, orders, lineitem = (table(spark, sf_dir, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    root = node_rows(spark.range(1), id=F.lit("."), name=F.lit("."), type=F.lit("dir"))
    regions = node_rows(region, id=F.col("r_name"), parent_id=F.lit("."), name=F.col("r_name"), type=F.lit("dir"))
    nations = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).withColumn("dir", F.concat_ws("/", "r_name", "n_name"))  # region: 5 rows
    nation_rows = node_rows(nations, id=F.col("dir"), parent_id=F.col("r_name"), name=F.col("n_name"), type=F.lit("dir"))
    customers = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).withColumn("file", F.concat(F.col("dir"), F.lit("/"), "c_name", F.lit(".py")))
    file_rows = node_rows(customers, id=F.col("file"), parent_id=F.col("dir"), name=F.concat("c_name", F.lit(".py")), type=F.lit("file"), file_path=F.col("file"), line_start=F.lit(1), language=F.lit("python"))
    placed = orders.join(customers.select("c_custkey", "file"), F.col("o_custkey") == F.col("c_custkey")).withColumn("entity", F.concat(F.col("file"), F.lit(":O"), "o_orderkey"))
    kind = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "class").otherwise("function")
    order_rows = node_rows(placed.filter("o_orderkey % 97 <> 0"), id=F.col("entity"), parent_id=F.col("file"), name=F.concat(F.lit("O"), "o_orderkey"), type=kind, file_path=F.col("file"), language=F.lit("python"))
    cents = lambda c: F.lpad((F.round(F.col(c) * 100)).cast("long").cast("string"), 12, "0")
    position = F.concat_ws("|", F.date_format("l_shipdate", "yyyyMMdd"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 12, "0"), cents("l_quantity"), cents("l_extendedprice"), cents("l_discount"), cents("l_tax"), "l_returnflag", "l_linestatus")
    lines = lineitem.join(placed.select("o_orderkey", "entity", "file"), F.col("l_orderkey") == F.col("o_orderkey"))
    line_rows = node_rows(
        lines,
        id=F.concat(F.col("entity"), F.lit(".L"), "l_linenumber"),
        parent_id=F.col("entity"),
        name=F.concat(F.lit("L"), "l_linenumber"),
        type=F.lit("method"),
        file_path=F.col("file"),
        line_start=F.col("l_linenumber"),
        signature=F.concat_ws("-", "l_partkey", "l_suppkey"),
        language=F.lit("python"),
        position=position,
    )
    out = root
    for t in (regions, nation_rows, file_rows, order_rows, line_rows):
        out = out.unionByName(t)
    return out


def document_files(docs: DataFrame) -> DataFrame:
    """files(path, content) of documents: eight endings, some unsupported; every eleventh in an excluded directory, some at the top."""
    endings = F.array(*[F.lit(e) for e in (".py", ".js", ".go", ".rs", ".java", ".TXT", ".md", ".PYI")])
    ending = F.element_at(endings, (F.col("doc_id") % 8 + 1).cast("int"))
    folder = F.when(F.col("doc_id") % 50 == 1, "").otherwise(F.concat("source", F.lit("/"), "lang", F.lit("/")))
    hidden = F.when(F.col("doc_id") % 11 == 0, "build/").otherwise("")
    return docs.select(F.concat(folder, hidden, F.lit("d"), "doc_id", ending).alias("path"), F.encode("text", "UTF-8").alias("content"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(table(spark, sf_dir, "documents"))


def old_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(table(spark, sf_dir, "documents").filter("doc_id % 10 <> 3"))


def new_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit(" edited revision"))).otherwise(F.col("text"))
    return document_files(table(spark, sf_dir, "documents").filter("doc_id % 10 <> 7").withColumn("text", edited))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, content): every third document in Latin-1, the others in UTF-8."""
    latin = F.encode(F.regexp_replace("text", r"[^\x00-\xFF]", "?"), "ISO-8859-1")
    content = F.when(F.col("doc_id") % 3 == 0, latin).otherwise(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", content.alias("content"))


def write_tree(files: DataFrame, folder: str) -> str:
    """Every row of files(path, content) as a file below a folder that is mounted everywhere, by the task that holds it; a task that runs again writes the same. Only local paths can be written so."""
    root = re.sub("^file:(//)?", "", folder)
    if not root.startswith("/"):
        raise ValueError(f"{folder} is no mounted folder")

    def write(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with open(target, "wb") as f:
                    f.write(content or b"")
            yield batch[["path"]]

    files.mapInPandas(write, "path string").write.format("noop").mode("overwrite").save()
    return root


def prose_entities(kept: DataFrame) -> DataFrame:
    """An extractor for prose: one function for each file, named after it, with the text as docstring."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    text = F.decode("content", "UTF-8")
    return kept.select(
        "path",
        F.lit(0).alias("position"),
        stem.alias("qualname"),
        none.alias("parent_qualname"),
        stem.alias("name"),
        F.lit("function").alias("type"),
        F.lit(1).alias("line_start"),
        F.size(F.split(text, "\n")).alias("line_end"),
        none.alias("signature"),
        text.alias("docstring"),
        empty.alias("calls"),
        empty.alias("base_classes"),
        "language",
    )


def caller_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as functions that call their parts' names; parts as classes with type and brand as bases; brands as classes."""
    part, lineitem = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    called = lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("p_name")).alias("calls"))
    orders = node_rows(called, id=F.concat(F.lit("orders.py:O"), "l_orderkey"), parent_id=F.lit("orders.py"), name=F.concat(F.lit("O"), "l_orderkey"), type=F.lit("function"), calls=F.col("calls"))
    parts = node_rows(part, id=F.concat(F.lit("parts.py:P"), "p_partkey"), parent_id=F.lit("parts.py"), name=F.col("p_name"), type=F.lit("class"), base_classes=F.array("p_type", "p_brand"))
    brands = node_rows(part.select("p_brand").distinct(), id=F.concat(F.lit("brands.py:"), "p_brand"), parent_id=F.lit("brands.py"), name=F.col("p_brand"), type=F.lit("class"))
    return orders.unionByName(parts).unionByName(brands).drop("position")


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Python source for each customer, by the last digit of its key: 9 does not parse, 8 has decorated, nested and keyword forms, 7 is no UTF-8."""
    # sources are many times larger than the rows that they are made of, so few splits of the table would parse them all
    c = table(spark, sf_dir, "customer").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    good = F.concat(
        F.lit("class C"), key, F.lit("(Base"), nation, F.lit('):\n    """'), "c_mktsegment", F.lit(' customer."""\n    def balance(self, x: int) -> float:\n        """Balance of it."""\n        return fetch(self.load(x))\n\n\nasync def seg_'), key, F.lit("(a, b=1):\n    return C"), key, F.lit("(a)\n"),
    )
    odd = F.concat(
        F.lit("import functools\n\n\nclass C"), key, F.lit("(Base"), nation, F.lit(', metaclass=M):\n    class Inner:\n        async def go(self, *, k=None): pass\n\n\n@functools.cache\ndef pick_'), key, F.lit('(a, /, b: int = 5, *args: str, c, **kw) -> None:\n    """Picks."""\n    self.save(g()(1))\n'),
    )
    digit = F.col("c_custkey") % 10
    source = F.when(digit == 9, F.concat(F.lit("def broken("), key, F.lit(":\n"))).when(digit == 8, odd).otherwise(good)
    content = F.concat(F.when(digit == 7, F.unhex(F.lit("23FF0A"))).otherwise(F.unhex(F.lit(""))), F.encode(source, "UTF-8"))
    return c.select(F.concat(F.lit("crm/n"), nation, F.lit("/c"), key, F.lit(".py")).alias("path"), content.alias("content"), F.lit("python").alias("language"))


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a searchable node: its source is the name, its text the docstring."""
    docs = table(spark, sf_dir, "documents")
    return node_rows(docs, id=F.concat(F.lit("d"), "doc_id"), name=F.col("source"), type=F.lit("function"), docstring=F.col("text")).drop("position")


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
