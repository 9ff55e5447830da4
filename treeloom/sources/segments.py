"""Postings clustered by term, in segments, so that a search opens the files of its own terms alone.

A segment is a table of postings in folders by a hash of the term, and the ids of the nodes whose postings in
earlier segments no longer hold. A refresh adds one segment of the size of the change; segments that are no more than
twice what follows them are merged into it, so their number grows with the logarithm of the table, and a posting is
rewritten about as often. The folders of a segment grow with its rows; a folder that is larger than the rest, as of a
frequent term, is split over several files, and rows are sorted by term in each, so that row groups are skipped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import POSTINGS
from .scratch import folder_system, written

PART_ROWS = 1 << 20  # postings of a folder
MOST_PARTS = 1 << 14  # folders of a segment: what a search asks of one reaches the driver
FEW_TERMS = 100  # so many are also looked up by value, which skips row groups
GONE = "node_id string"


def term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(parts)).cast("int")


def write_split(rows: DataFrame, path: str, folder: str) -> dict[str, str]:
    """Writes rows by their column ``bucket`` and returns the folder of each that has any. Large ones become several files."""
    rows.write.partitionBy("bucket").parquet(f"{path}/{folder}")
    fs, root = folder_system(rows.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory() and s.getPath().getName().startswith("bucket=")]
    return {n.removeprefix("bucket="): f"{folder}/{n}" for n in names}


def write(postings: DataFrame, gone: DataFrame | None, n: int, path: str, folder: str, part_rows: int) -> dict:
    """A segment of about n postings, below path/folder."""
    spark = postings.sparkSession
    of = min(MOST_PARTS, max(1, -(-n // part_rows)))
    split = postings.withColumn("bucket", term_part(F.col("term"), of)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term")
    out = {"of": of, "parts": write_split(split, path, f"{folder}/terms"), "gone": None}
    if gone is not None:
        out["gone"] = f"{folder}/gone"
        gone.write.parquet(f"{path}/{out['gone']}")
    # both counts come from the files' footers
    out["rows"] = live(spark, path, [out]).count() + (gone_of(spark, path, out).count() if out["gone"] else 0)
    return out


def folders(segment: dict) -> set[str]:
    return {*segment["parts"].values(), *([segment["gone"]] if segment["gone"] else [])}


def gone_of(spark: SparkSession, path: str, segment: dict) -> DataFrame:
    return spark.read.schema(GONE).parquet(f"{path}/{segment['gone']}")


def opened(spark: SparkSession, path: str, segment: dict, terms: DataFrame | None) -> DataFrame:
    """The postings in a segment's folders, or in those that may hold terms(term)."""
    asked = segment["parts"].keys() if terms is None else {str(r[0]) for r in terms.select(term_part(F.col("term"), segment["of"])).distinct().collect()}
    found = [f"{path}/{f}" for b, f in sorted(segment["parts"].items()) if b in asked]
    return spark.read.schema(POSTINGS).parquet(*found) if found else spark.createDataFrame([], POSTINGS)


def live(spark: SparkSession, path: str, segments: list[dict], gone: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Postings of segments, oldest first, each without the nodes that later ones, or ``gone``, replaced; of terms(term) alone where they are given."""
    few = [] if terms is None else [r[0] for r in terms.select("term").distinct().limit(FEW_TERMS + 1).collect()]
    out = spark.createDataFrame([], POSTINGS)
    for s in reversed(segments):
        rows = opened(spark, path, s, terms)
        if terms is not None:
            rows = rows.filter(F.col("term").isin(few)) if len(few) <= FEW_TERMS else rows.join(terms.select("term"), "term", "left_semi").select("node_id", "term", "tf")
        out = out.unionByName(rows if gone is None else rows.join(gone, "node_id", "left_anti"))
        if s["gone"]:
            gone = gone_of(spark, path, s) if gone is None else gone.unionByName(gone_of(spark, path, s))
    return out


def after(spark: SparkSession, path: str, segments: list[dict], fresh: DataFrame, gone: DataFrame, folder: str, part_rows: int) -> list[dict]:
    """The segments once the nodes gone(node_id) lost their postings and ``fresh`` came; both are read twice, so they should be written tables."""
    n = fresh.count() + gone.count()
    if not n:
        return segments
    kept, taken = list(segments), []
    while kept and kept[-1]["rows"] <= 2 * n:
        taken.insert(0, kept.pop())
        n += taken[0]["rows"]
    merged = live(spark, path, taken, gone).unionByName(fresh)
    every = gone
    for s in taken:
        every = every.unionByName(gone_of(spark, path, s)) if s["gone"] else every
    return [*kept, write(merged, every.distinct() if kept else None, n, path, folder, part_rows)]
