"""Snapshots of all tables in one folder, refreshed bucket by bucket.

Rows of nodes, postings and file hashes lie in ``buckets`` buckets by a hash of their file's path; directories
are a bucket of their own, and the vocabulary's two tables are written whole. A version is one small pointer file
that names, for each table and bucket, the folder that holds it. A refresh rewrites the buckets of changed files
and lets the new pointer name the old folders of all others, so its writes grow with the change. Postings are stored
a second time, by term (see segments), for searches.

A pointer is created exclusively, under the number behind the version it came from: of two savers that started
from the same version one fails, and its folder is left for ``prune``. A reader sees the old version until the new
pointer is complete.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as fil
from ..operators import index as idx
from ..operators import refresh as ref
from ..operators import search as sea
from ..operators.refresh import Snapshot
from ..schemas import FILE_HASHES, FREQUENCIES, IDF, NODES, POSTINGS
from . import segments as seg
from .scratch import folder_system, removed, written

BUCKETS = 64
DIRECTORIES = -1
WHOLE = "whole"  # the one part of a table without buckets
KEYS = {"nodes": "id", "postings": "node_id", "file_hashes": "path"}
SCHEMAS = {"nodes": NODES, "postings": POSTINGS, "file_hashes": FILE_HASHES, "idf": IDF, "frequencies": FREQUENCIES}


class SavedBefore(Exception):
    """Another save came first."""


@dataclass
class Version:
    number: int
    buckets: int
    documents: int
    parts: dict[str, dict[str, str]] = field(default_factory=dict)  # table, bucket: folder below the snapshots' path
    digests: dict[str, str] = field(default_factory=dict)  # of the files of each bucket that has any
    segments: list[dict] = field(default_factory=list)  # of the postings by term, oldest first
    part_rows: int = seg.PART_ROWS

    def text(self) -> str:
        return json.dumps({k: v for k, v in asdict(self).items() if k != "number"})

    def folders(self) -> set[str]:
        return {f for parts in self.parts.values() for f in parts.values()}.union(*[seg.folders(s) for s in self.segments])


def bucket(key: Column, buckets: int) -> Column:
    """By the path, which every id begins with up to the first colon."""
    return F.pmod(F.xxhash64(F.substring_index(key, ":", 1)), F.lit(buckets)).cast("int")


def bucket_digests(hashes: DataFrame, buckets: int) -> dict[str, str]:
    """A digest of the paths and hashes in each bucket; at most ``buckets`` rows reach the driver."""
    summed = hashes.groupBy(bucket(F.col("path"), buckets).alias("b")).agg(F.sum(ref.file_digest()).cast("string").alias("d"), F.count("*").alias("n"))
    return {str(r["b"]): f"{r['n']}:{r['d']}" for r in summed.collect()}


def pointers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, newest first."""
    fs, root = folder_system(spark, f"{path}/current")
    found = fs.listStatus(root) if fs.exists(root) else []
    return sorted((int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit() and s.getLen()), reverse=True)


def version(spark: SparkSession, path: str, number: int) -> Version:
    return Version(number, **json.loads(spark.read.text(f"{path}/current/{number:012d}", wholetext=True).first()[0]))


def publish(spark: SparkSession, path: str, new: Version) -> None:
    """Creates the pointer, which fails if there is one of that number."""
    fs, file = folder_system(spark, f"{path}/current/{new.number:012d}")
    try:
        out = fs.create(file, False)
    except Py4JJavaError as e:
        raise SavedBefore(f"version {new.number} of {path} exists") from e
    out.write(bytearray(new.text().encode()))
    out.close()


def write_part(df: DataFrame, path: str, folder: str, name: str, buckets: int) -> dict[str, str]:
    """Writes rows of one table and returns the folder of each bucket that has any. Large buckets are split over several files."""
    if name not in KEYS:
        df.write.parquet(f"{path}/{folder}/{name}")
        return {WHOLE: f"{folder}/{name}"}
    at = bucket(F.col(KEYS[name]), buckets)
    at = F.when(F.col("type") == "dir", DIRECTORIES).otherwise(at) if name == "nodes" else at
    rows = df.withColumn("bucket", at).hint("rebalance", "bucket")
    return seg.write_split(rows, path, f"{folder}/{name}")


def rows(spark: SparkSession, path: str, at: Version, name: str, buckets: set[str] | None = None) -> DataFrame:
    """A table, or those buckets of it."""
    folders = [f"{path}/{f}" for b, f in sorted(at.parts[name].items()) if buckets is None or b in buckets]
    return spark.read.schema(SCHEMAS[name]).parquet(*folders) if folders else spark.createDataFrame([], SCHEMAS[name])


def snapshot_of(spark: SparkSession, path: str, at: Version, buckets: set[str] | None = None) -> Snapshot:
    of = lambda name: rows(spark, path, at, name, buckets if name in KEYS else None)
    return Snapshot(of("nodes"), of("postings"), of("idf"), of("file_hashes"), of("frequencies"), at.documents)


def save(snapshot: Snapshot, path: str, buckets: int = BUCKETS, part_rows: int = seg.PART_ROWS) -> str:
    """Writes every table as the next version and returns its folder. part_rows: postings of a folder of the segments."""
    spark = snapshot.nodes.sparkSession
    number = max(pointers(spark, path), default=0) + 1
    folder = f"v{number:012d}-{uuid.uuid4().hex}"
    new = Version(number, buckets, snapshot.documents, digests=bucket_digests(snapshot.file_hashes, buckets), part_rows=part_rows)
    for name in SCHEMAS:
        new.parts[name] = write_part(getattr(snapshot, name), path, folder, name, buckets)
    stored = rows(spark, path, new, "postings")
    new.segments = [seg.write(stored, None, stored.count(), path, folder, part_rows)]
    publish(spark, path, new)
    return f"{path}/{folder}"


def load(spark: SparkSession, path: str) -> Snapshot:
    """The newest version; list columns are arrays as they were."""
    return snapshot_of(spark, path, version(spark, path, pointers(spark, path)[0]))


def refresh(spark: SparkSession, path: str, files: DataFrame, extract: Callable[[DataFrame], DataFrame], policy: str = "exact") -> list[str]:
    """Makes the next version from the newest one and files(path, content), and returns the buckets that were rewritten.

    Files are hashed and summed by bucket; hashes, nodes and postings of buckets whose sum is as it was are neither
    read nor written. Without a change nothing stored is read and there is no new version. With policy
    "exact" the version equals a full build of files.
    """
    at = version(spark, path, pointers(spark, path)[0])
    kept = fil.supported(files)
    current = written(fil.hashed(kept), "hashes")
    digests = bucket_digests(current, at.buckets)
    touched = sorted((b for b in digests.keys() | at.digests.keys() if digests.get(b) != at.digests.get(b)), key=int)
    if not touched:
        return []
    old = snapshot_of(spark, path, at, set(touched))
    here = bucket(F.col("path"), at.buckets).isin([int(b) for b in touched])
    status = written(ref.classify(current.filter(here), old.file_hashes), "status")
    before, after, net = ref.changes(old.nodes, status, kept.filter(here), extract)
    index = idx.updated(old.index, before, after, net, policy)
    nodes = fil.directory_nodes(current).unionByName(ref.kept_nodes(old.nodes, status)).unionByName(after)
    number = at.number + 1
    folder = f"v{number:012d}-{uuid.uuid4().hex}"
    new = Version(number, at.buckets, index.documents, digests=digests, part_rows=at.part_rows)
    fresh = {"nodes": nodes, "postings": index.postings, "file_hashes": ref.new_hashes(old.file_hashes, current, status), "idf": index.idf, "frequencies": index.frequencies}
    for name, df in fresh.items():
        gone = {*touched, str(DIRECTORIES), WHOLE}
        new.parts[name] = {b: f for b, f in at.parts[name].items() if b not in gone} | write_part(df, path, folder, name, at.buckets)
    gone = written(idx.searchable(before).select(F.col("id").alias("node_id")), "gone")
    new.segments = seg.after(spark, path, at.segments, index.fresh, gone, folder, at.part_rows)
    publish(spark, path, new)
    return touched


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = sea.TOP) -> DataFrame:
    """The rows of search.search over the newest version, for queries(query_id, query). Of the postings only folders that may hold a term of the queries are opened, and of the nodes only buckets of those found."""
    at = version(spark, path, pointers(spark, path)[0])
    terms = written(sea.weighted_terms(rows(spark, path, at, "idf"), queries), "terms")
    postings = seg.live(spark, path, at.segments, terms=terms.select("term").distinct())
    best = written(sea.ranked(sea.summed(postings.join(terms, "term")), k), "best")
    asked = {str(r[0]) for r in best.select(bucket(F.col("node_id"), at.buckets)).distinct().collect()}
    return best.join(rows(spark, path, at, "nodes", asked).withColumnRenamed("id", "node_id"), "node_id")


def prune(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Deletes all but the newest ``keep`` (at least one) versions: their pointers, and the folders that no kept version names. Returns the folders deleted. Readers of an older version must be done; a save that has not ended is not touched."""
    if keep < 1:
        raise ValueError("the current snapshot stays")
    numbers = pointers(spark, path)
    if not numbers:
        return []
    named = set().union(*[version(spark, path, n).folders() for n in numbers[:keep]])
    for n in numbers[keep:]:
        removed(spark, f"{path}/current/{n:012d}")
    deleted = []
    for folder in below(spark, path, ""):
        if not folder.startswith("v") or int(folder[1:13]) > numbers[0]:
            continue
        parts = [f"{folder}/{t}" for t in below(spark, path, folder)]
        parts = [p for part in parts for p in ([f"{part}/{b}" for b in below(spark, path, part) if b.startswith("bucket=")] or [part])]
        unused = [p for p in parts if p not in named]
        deleted += [f"{path}/{p}" for p in ([folder] if len(unused) == len(parts) else unused) if removed(spark, f"{path}/{p}")]
    return deleted


def below(spark: SparkSession, path: str, folder: str) -> list[str]:
    fs, root = folder_system(spark, f"{path}/{folder}" if folder else path)
    return sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory())
