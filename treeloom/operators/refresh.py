"""Incremental refresh: from an old snapshot and the current files to a new snapshot."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import NODE_COLUMNS, ROOT
from ..sources.scratch import written
from . import entities as ent
from . import files as fil
from . import index as idx
from . import tree


@dataclass
class Snapshot:
    nodes: DataFrame
    postings: DataFrame
    idf: DataFrame
    file_hashes: DataFrame
    frequencies: DataFrame
    documents: int

    @property
    def index(self) -> idx.Index:
        return idx.Index(self.postings, self.idf, self.frequencies, self.documents)


def classify(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, status): added, updated, removed or unchanged, from current(path, hash) and stored(path, hash). A null hash, of null content, is a value like any other."""
    now = current.select("path", F.col("hash").alias("now"), F.lit(True).alias("is"))
    was = stored.select("path", F.col("hash").alias("was"), F.lit(True).alias("had"))
    both = now.join(was, "path", "full_outer")
    status = F.when(F.col("had").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "updated").otherwise("unchanged")
    return both.select("path", status.alias("status"))


def file_digest() -> Column:
    """60 bits of the MD5 of a file's path and hash. Sums of it over files do not hang on their order, and tell sets of files apart that were not made to collide."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", "path", F.coalesce("hash", F.lit("")))), 1, 15), 16, 10).cast("decimal(38,0)")


def directory_digests(hashes: DataFrame) -> DataFrame:
    """(id, n_files, digest) of every directory over all files below it, from (path, hash). Equal digests of two corpora mean equal subtrees, so a comparison needs to go on only below those that differ. Directories are summed before the shuffle."""
    above = F.concat(F.array(F.lit(ROOT)), paths.ancestors(F.col("path")))
    rows = hashes.select(F.explode(above).alias("id"), file_digest().alias("d"))
    return rows.groupBy("id").agg(F.count("*").alias("n_files"), F.sum("d").cast("string").alias("digest"))


def changed_directories(current: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status): directories that came, went, or hold other files than before, from two tables of directory_digests."""
    both = current.select("id", F.col("digest").alias("now")).join(stored.select("id", F.col("digest").alias("was")), "id", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "updated")
    return both.select("id", status.alias("status")).filter("status is not null")


def status_counts(status: DataFrame) -> DataFrame:
    """(added, updated, removed, unchanged): how many files of classify's result have each status; one row, of zeros for none."""
    return status.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("added", "updated", "removed", "unchanged")])


def removed_files(current: DataFrame, stored: DataFrame) -> DataFrame:
    return stored.select("path").join(current.select("path"), "path", "left_anti")


def delete_file_nodes(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes without those of paths(path); directories stay."""
    gone = idx.small(written(paths.select(F.col("path").alias("__path")), "gone"))
    return nodes.join(gone, F.coalesce("file_path", "id") == F.col("__path"), "left_anti")


def upsert_hashes(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.join(new.select("path"), "path", "left_anti").unionByName(new)


def replace_files(nodes: DataFrame, changed: DataFrame, every: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The node table after changed(path, content, language) took the place of these files' old nodes.

    Directories are those above the files of every(path): none is left behind, none is missing.
    """
    kept = delete_file_nodes(nodes, changed).filter("type <> 'dir'").select(*NODE_COLUMNS)
    fresh = tree.assemble_written(fil.file_nodes(changed), ent.entity_nodes(extract(changed)))
    return fil.directory_nodes(every).unionByName(kept).unionByName(fresh)


def node_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, status): nodes that appear, go, or belong to both tables and differ in what is indexed; nulls are values. Texts are compared by SHA-256 and not shuffled."""
    compared = F.sha2(F.to_json(F.struct("name", "type", "signature", "docstring", "file_path"), {"ignoreNullFields": "false"}), 256)
    both = old.select("id", compared.alias("was")).join(new.select("id", compared.alias("now")), "id", "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("now")), "updated")
    return both.select("id", status.alias("status")).filter("status is not null")


def changed_nodes(old: DataFrame, new: DataFrame, paths: DataFrame) -> DataFrame:
    """(id): old and new nodes of the changed or removed files, without repeats."""
    of = lambda t: t.join(paths, t["file_path"] == paths["path"], "left_semi").select("id")
    return of(old).unionByName(of(new)).distinct()


def node_table(kept: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The nodes of supported files, written."""
    return tree.assemble_written(fil.directory_nodes(kept), fil.file_nodes(kept), ent.entity_nodes(extract(kept)))


def full_build(files: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> Snapshot:
    """Everything from files(path, content). Nodes and postings are written, so files are parsed and texts tokenised once."""
    kept = fil.supported(files)
    nodes = node_table(kept, extract)
    index = idx.build(nodes)
    return Snapshot(nodes, index.postings, index.idf, fil.file_hashes(kept), index.frequencies, index.documents)


def changes(nodes: DataFrame, status: DataFrame, kept: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, int]:
    """(before, after, net): the nodes that files added, updated or removed had in ``nodes`` and have now, and by how many searchable nodes the table grows. Only changed files are parsed."""
    touched = idx.small(written(status.filter("status <> 'unchanged'").select(F.col("path").alias("__path")), "touched"))
    before = nodes.filter("type <> 'dir'").join(touched, F.coalesce("file_path", "id") == F.col("__path"), "left_semi")
    fresh = kept.join(idx.small(written(status.filter("status in ('added', 'updated')").select("path"), "fresh")), "path", "left_semi")
    after = tree.assemble_written(fil.file_nodes(fresh), ent.entity_nodes(extract(fresh)))
    return before, after, idx.searchable(after).count() - idx.searchable(before).count()


def kept_nodes(nodes: DataFrame, status: DataFrame) -> DataFrame:
    """Nodes of unchanged files, without directories."""
    return delete_file_nodes(nodes, status.filter("status <> 'unchanged'")).filter("type <> 'dir'")


def new_hashes(stored: DataFrame, current: DataFrame, status: DataFrame) -> DataFrame:
    """(path, hash, indexed_at): unchanged files keep their time."""
    changed = status.filter("status <> 'unchanged'").select("path")
    fresh = current.join(changed, "path", "left_semi").withColumn("indexed_at", F.current_timestamp())
    return stored.join(changed, "path", "left_anti").unionByName(fresh)


def refresh(old: Snapshot, files: DataFrame, extract: Callable[[DataFrame], DataFrame], policy: str = "exact") -> Snapshot:
    """The snapshot of files(path, content). With policy "exact" it equals full_build(files).

    Every file is hashed; only changed ones are parsed and tokenised, only their nodes and postings are written, and
    document frequencies change by signed counts. What is kept is read through a filter when the result is read;
    sources.snapshots.refresh also leaves it on disk as it is.
    """
    kept = fil.supported(files)
    current = written(fil.hashed(kept), "hashes")
    status = written(classify(current, old.file_hashes), "status")
    before, after, net = changes(old.nodes, status, kept, extract)
    nodes = fil.directory_nodes(current).unionByName(kept_nodes(old.nodes, status)).unionByName(after)
    index = idx.updated(old.index, before, after, net, policy)
    return Snapshot(nodes, index.postings, index.idf, new_hashes(old.file_hashes, current, status), index.frequencies, index.documents)
