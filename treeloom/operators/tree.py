"""The node table: assembly, children, orphans, and counts of descendants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import COUNTED_TYPES, NODE_COLUMNS, ROOT
from ..sources.scratch import counted, written

COUNTS = list(COUNTED_TYPES)
LINKS = ["id", "parent_id", "type"]
MOST_AGAIN = 100_000  # ids that are broadcast


def last_wins(nodes: DataFrame, position: str = "position") -> DataFrame:
    """One row for each id, that of the largest position.

    One aggregation with map-side combining, which sorts the rows on both sides of its exchange and so lets no task
    get all rows of an id that repeats very often. Refreshes call it for changed files alone.
    """
    row = F.struct(*[F.col(c) for c in NODE_COLUMNS])
    return nodes.groupBy("id").agg(F.max_by(row, F.struct(position, F.hash(row))).alias("n")).select("n.*")


def stacked(*tables: DataFrame) -> DataFrame:
    """The union of node tables, with ``position``; a table without one comes first for its ids."""
    ready = [t if "position" in t.columns else t.withColumn("position", F.lit(-1)) for t in tables]
    return reduce(lambda a, b: a.unionByName(b), [t.select(*NODE_COLUMNS, "position") for t in ready])


def assemble(*tables: DataFrame) -> DataFrame:
    """The union of node tables, one row for each id."""
    return last_wins(stacked(*tables))


def among(rows: DataFrame, other: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose values in all columns of ``other`` are those of a row of it, nulls included; or, by left_anti, the others."""
    few = other.select(*[F.col(c).alias(f"__{c}") for c in other.columns])
    return rows.join(few, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(few[f"__{c}"]) for c in other.columns]), how)


def assemble_written(*tables: DataFrame) -> DataFrame:
    """The rows of assemble, written. Tables are evaluated once, as they are; only ids are compared, and whole rows only of those that repeat."""
    rows = written(stacked(*tables), "nodes")
    again, n = repeated(rows)
    if not n:
        return rows.select(*NODE_COLUMNS)
    if n > MOST_AGAIN:
        return written(last_wins(rows), "nodes")
    won = written(last_wins(among(rows, F.broadcast(again))), "nodes")
    return among(rows, F.broadcast(again), "left_anti").select(*NODE_COLUMNS).unionByName(won)


def repeated(rows: DataFrame) -> tuple[DataFrame, int]:
    """(the ids that several rows have, their number)."""
    again = written(rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"), "again")
    return again, again.count()


def links(*tables: DataFrame) -> DataFrame:
    """(id, parent_id, type) of assemble(*tables), written; all that counts of descendants need.

    Rows of an id mostly agree on these, so they are made distinct without their positions and other columns; only
    where they differ are whole rows compared.
    """
    rows = stacked(*tables)
    seen = written(rows.select(*LINKS).distinct(), "links")
    torn, n = repeated(seen)
    if not n:
        return seen
    won = written(last_wins(among(rows, torn)).select(*LINKS), "links")
    return written(among(seen, torn, "left_anti").unionByName(won), "links")


def assemble_some(some: DataFrame, *tables: DataFrame) -> DataFrame:
    """The nodes of assemble(*tables) of the ids in ``some``, rows of links(*tables). Rows that differ from an id's link have lost, and tables without their types are not read."""
    types = [r[0] for r in some.select("type").distinct().collect()]
    rows = stacked(*tables)
    return last_wins(among(rows if None in types else rows.filter(F.col("type").isin(types)), some))


def listed_children(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, children_ids) of those of ids(id) that have children."""
    kids = nodes.join(ids.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return kids.groupBy(F.col("parent_id").alias("id")).agg(F.array_sort(F.collect_list("id")).alias("children_ids"))


def lookup(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of ids(id), each with its ``children_ids``."""
    found = nodes.join(ids, "id", "left_semi")
    return found.join(listed_children(nodes, ids), "id", "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>")))


def children(nodes: DataFrame, parent: str | None = None) -> DataFrame:
    """(parent_id, id, children_ids) for the children of one parent, or (parent_id, id, n_children) for those of all, which gathers no directory's entries in one row."""
    if parent is not None:
        return lookup(nodes, nodes.filter(F.col("parent_id") == parent).select("id")).select("parent_id", "id", "children_ids")
    kids = nodes.filter("parent_id is not null").select("parent_id", "id")
    below = kids.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_children"))
    return kids.join(below, "id", "left").select("parent_id", "id", F.coalesce("n_children", F.lit(0)).alias("n_children"))


def orphans(nodes: DataFrame) -> DataFrame:
    """Nodes whose parent is named but does not exist."""
    return nodes.filter("parent_id is not null").join(nodes.select(F.col("id").alias("parent_id")), "parent_id", "left_anti")


def added(*columns: str) -> list[Column]:
    """Each count with those of the given suffixes added; a suffix after a minus is taken off."""
    part = lambda c, s: -F.coalesce(f"{c}{s[1:]}", F.lit(0)) if s.startswith("-") else F.coalesce(f"{c}{s}", F.lit(0))
    return [sum((part(c, s) for s in columns), F.col(c)).alias(c) for c in COUNTS]


def summed(rows: DataFrame, key: str, suffix: str) -> DataFrame:
    """Counts summed by a key, which becomes ``id``; combined before the shuffle."""
    return rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.sum(c).alias(f"{c}{suffix}") for c in COUNTS])


def stats(nodes: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, files, classes, functions, methods) below and at every node, or at those of only(id).

    Childless nodes are added to their parents once. Then pointer doubling over the inner nodes: before round k a
    node holds the counts of all inner nodes less than 2^k levels below it and points to the one 2^k
    levels above; the round adds each node's counts to the one it points to and doubles the pointers. So
    rounds grow with the logarithm of the depth, and pointers that are left when 2^k exceeds the number of inner
    nodes run in a cycle, which is an error. A parent that does not exist is no node and gets nothing. What the
    driver sees of a round is the number of pointers left.
    """
    own = nodes.select("id", "parent_id", *[(F.col("type") == t).cast("long").alias(c) for c, t in COUNTED_TYPES.items()])
    kids = summed(own, "parent_id", "_kids")
    inner, seen = counted(own.join(kids, "id").withColumnRenamed("parent_id", "up"), "inner", rows=F.count("*"), left=F.count("up"))
    # inner children climb on their own, so they are taken off their parents' sums
    current = inner.join(summed(inner, "up", "_inner"), "id", "left").select("id", "up", *added("_kids", "-_inner"))
    reach, left = 1, seen["left"]
    while left:
        if reach > seen["rows"]:
            raise ValueError("the parents form a cycle")
        above = current.select(F.col("id").alias("up"), F.col("up").alias("farther"))
        moved = current.join(summed(current, "up", "_below"), "id", "left").select("id", "up", *added("_below"))
        doubled = moved.join(above, "up", "left").select("id", F.col("farther").alias("up"), *COUNTS)
        current, now = counted(doubled, "climb", left=F.count("up"))
        reach, left = 2 * reach, now["left"]
    total = current.select("id", *[F.col(c).alias(f"{c}_total") for c in COUNTS])
    asked = own if only is None else own.join(only.select("id"), "id", "left_semi")
    return asked.join(total, "id", "left").select("id", *[F.coalesce(f"{c}_total", c).alias(c) for c in COUNTS])


def stats_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Counts for ids(id); zeros for unknown ones."""
    return ids.join(stats(nodes, ids), "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])


def node_stats(nodes: DataFrame, root: str = ROOT) -> DataFrame:
    """Counts of one node's subtree; one row of zeros for an unknown id."""
    return stats_of(nodes, nodes.sparkSession.range(1).select(F.lit(root).alias("id")))


def project_map(nodes: DataFrame) -> DataFrame:
    """Counts of the root and of every directory at the top."""
    top = nodes.filter((F.col("id") == ROOT) | ((F.col("parent_id") == ROOT) & (F.col("type") == "dir"))).select("id")
    return stats(nodes, top)


def near(nodes: DataFrame, parent: str) -> DataFrame:
    """A node and its children."""
    return nodes.filter((F.col("id") == parent) | (F.col("parent_id") == parent))


def expand(nodes: DataFrame, parent: str, tree: DataFrame | None = None) -> DataFrame:
    """Children of a node, each with its children's ids and its counts. tree: links of the whole table, where ``nodes`` holds those near the parent alone."""
    tree = nodes if tree is None else tree
    below = written(nodes.filter(F.col("parent_id") == parent).select("parent_id", "id", "name", "type"), "below")
    ids = below.select("id")
    return below.join(listed_children(tree, ids), "id", "left").withColumn("children_ids", F.coalesce("children_ids", F.array().cast("array<string>"))).join(stats(tree, ids), "id")
