"""JSON documents of results, one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from . import relations, tree

KEEP_NULLS = {"ignoreNullFields": "false"}
FIELDS = ["id", "name", "type", "file_path", "line_start", "line_end", "signature", "docstring", "parent_id", "children_ids", "calls", "base_classes", "language"]


def node_struct() -> Column:
    return F.struct(*FIELDS)


def stats_struct() -> Column:
    return F.struct(*tree.COUNTS)


def as_json(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), KEEP_NULLS).alias("json")


def map_json(nodes: DataFrame, project: str, root: str) -> DataFrame:
    rows = tree.project_map(nodes).select("id", stats_struct().alias("stats"))
    whole = rows.agg(F.max_by("stats", F.col("id") == ".").alias("stats"), F.array_sort(F.collect_list(F.when(F.col("id") != ".", F.struct("id", "stats")))).alias("children"))
    return whole.select(as_json(F.lit("map").alias("command"), F.lit(project).alias("project"), F.lit(root).alias("root"), "stats", "children"))


def expand_json(nodes: DataFrame, parent: str, links: DataFrame | None = None) -> DataFrame:
    """links: those of the whole table, where ``nodes`` holds the nodes near the parent alone."""
    links = nodes if links is None else links
    ids = written(tree.near(links, parent).select("id"), "near")
    listed = tree.lookup(links.select(*tree.LINKS), ids).select("id", "children_ids")
    rows = written(nodes.join(listed, "id"), "near")
    below = rows.filter(F.col("parent_id") == parent)
    kids = below.join(tree.stats(links, below.select("id")).select("id", stats_struct().alias("stats")), "id")
    node = rows.filter(F.col("id") == parent).select(F.lit(0).alias("k"), node_struct().alias("node"))
    listed = kids.agg(F.array_sort(F.collect_list(F.struct(*FIELDS, "stats"))).alias("children")).withColumn("k", F.lit(0))
    return node.join(listed, "k").select(as_json(F.lit("expand").alias("command"), "node", "children"))


def inspect_json(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, json) for the nodes of ids(id). A document lists all callers, so it is as large as they are many; relations.inspect_all counts them for whole tables."""
    rows = relations.inspect(nodes, ids)
    return rows.select("id", as_json(F.lit("inspect").alias("command"), node_struct().alias("node"), "calls", "called_by"))


def search_json(nodes: DataFrame, queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, json) for every query, also for those that found nothing. found: query_id, rank, node_id, score."""
    hits = found.select("query_id", "rank", F.col("node_id").alias("id"), F.round("score", 4).alias("score"))
    rows = hits.join(tree.lookup(nodes, hits.select("id")), "id")
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", node_struct().alias("node"), "score"))).alias("results"))
    results = F.transform(F.coalesce("results", F.expr("filter(array(results[0]), x -> false)")), lambda r: F.struct(r["node"].alias("node"), r["score"].alias("score")))
    joined = queries.join(listed, "query_id", "left").withColumn("results", results)
    return joined.select("query_id", as_json(F.lit("search").alias("command"), "query", F.size("results").alias("count"), "results"))


def hierarchy_json(nodes: DataFrame, base: str) -> DataFrame:
    found = tree.lookup(nodes, relations.subclasses(nodes, base).select("id"))
    listed = found.agg(F.count("*").alias("count"), F.array_sort(F.collect_list(node_struct())).alias("subclasses"))
    return listed.select(as_json(F.lit("hierarchy").alias("command"), F.lit(base).alias("base_class"), "count", "subclasses"))
