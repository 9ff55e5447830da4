"""Files: exclusion, routing, hashes, line ranges, file nodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..schemas import LINES, ROOT


def supported(files: DataFrame, excluded: list[str] | None = None) -> DataFrame:
    """Files that are neither excluded nor without an extractor, with ``language``."""
    kept = files.filter(~paths.is_excluded(F.col("path"), excluded))
    return kept.withColumn("language", paths.language(F.col("path"))).filter("language is not null")


def hashed(files: DataFrame) -> DataFrame:
    """(path, hash): SHA-256 of the raw bytes. Content goes no further than this projection."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def file_hashes(files: DataFrame) -> DataFrame:
    return hashed(files).withColumn("indexed_at", F.current_timestamp())


def file_nodes(files: DataFrame) -> DataFrame:
    """One node for each file; an undecodable file has 0 lines."""
    path = F.col("path")
    return files.select(
        path.alias("id"),
        paths.parent(path).alias("parent_id"),
        paths.base_name(path).alias("name"),
        F.lit("file").alias("type"),
        path.alias("file_path"),
        F.lit(1).alias("line_start"),
        text.line_count(text.strict_text(F.col("content"))).alias("line_end"),
        F.lit(None).cast("string").alias("signature"),
        F.lit(None).cast("string").alias("docstring"),
        F.array().cast("array<string>").alias("calls"),
        F.array().cast("array<string>").alias("base_classes"),
        (F.col("language") if "language" in files.columns else paths.language(path)).alias("language"),
    )


def line_range(content: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """(lines, error) of a 1-based inclusive range, clamped to the file; null and 0 stand for the first and last line."""
    lines = F.split(text.lenient_text(content), "\n")
    n = F.size(lines)
    first = F.greatest(F.coalesce(F.nullif(start, F.lit(0)), F.lit(1)), F.lit(1))
    last = F.least(F.coalesce(F.nullif(end, F.lit(0)), n), n)
    bad = first > last
    got = F.array_join(F.slice(lines, F.least(first, n), F.greatest(last - first + 1, F.lit(0))), "\n")
    return F.when(~bad, got), F.when(bad, F.lit("start is after end"))


def line_index(files: DataFrame) -> DataFrame:
    """(path, utf8, starts): whether the bytes are UTF-8, and the byte at which each line starts, closed by the place behind an added last newline. Made once, it turns a range of lines into a slice of bytes."""

    def run(batches):
        for batch in batches:
            contents = batch.column("content")
            starts = []
            for c in contents:
                raw = np.frombuffer(c.as_buffer() or b"", np.uint8) if c.is_valid else np.zeros(0, np.uint8)
                starts.append(np.concatenate(([0], np.flatnonzero(raw == 10) + 1, [len(raw) + 1])))
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("utf8"), pa.array(starts, pa.list_(pa.int64()))], names=["path", "utf8", "starts"])

    return files.select("path", F.is_valid_utf8("content").alias("utf8"), "content").mapInArrow(run, LINES)


def byte_range(start: Column, end: Column) -> tuple[Column, Column]:
    """(text, error) of line_range by ``starts``, ``utf8`` and ``content``."""
    n = F.size("starts") - 1
    first = F.greatest(F.coalesce(F.nullif(start, F.lit(0)), F.lit(1)), F.lit(1))
    last = F.least(F.coalesce(F.nullif(end, F.lit(0)), n), n)
    bad = first > last
    at = F.element_at("starts", F.least(first, n))
    size = F.element_at("starts", F.greatest(last, F.lit(1)) + 1) - 1 - at
    raw = F.substring(F.col("content"), (at + 1).cast("int"), F.greatest(size, F.lit(0)).cast("int"))
    got = F.when(F.col("utf8"), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, "ISO-8859-1"))
    return F.when(~bad, got), F.when(bad, F.lit("start is after end"))


def with_lines(files: DataFrame, lines: DataFrame) -> DataFrame:
    return files.select("path", "content").join(lines, "path")


def read_lines(files: DataFrame, requests: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """requests(path, start, end) with ``text`` and ``error``; an unknown path is an error too. With a line_index no file is split."""
    source = files.select("path", "content") if lines is None else with_lines(files, lines)
    got, error = line_range(F.col("content"), F.col("start"), F.col("end")) if lines is None else byte_range(F.col("start"), F.col("end"))
    known = F.col("content").isNotNull()
    joined = requests.join(source, "path", "left")
    return joined.select(*requests.columns, F.when(known, got).alias("text"), F.when(known, error).otherwise(F.lit("no such file")).alias("error"))


def snippets(nodes: DataFrame, files: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(id, text): the source lines of every entity. With a line_index no file is split."""
    entities = nodes.filter(~F.col("type").isin("dir", "file")).select("id", "file_path", "line_start", "line_end")
    source = files.select("path", "content") if lines is None else with_lines(files, lines)
    got, _ = line_range(F.col("content"), F.col("line_start"), F.col("line_end")) if lines is None else byte_range(F.col("line_start"), F.col("line_end"))
    return entities.join(source.withColumnRenamed("path", "file_path"), "file_path").select("id", got.alias("text"))


def directory_nodes(files: DataFrame) -> DataFrame:
    """A node for the root and for every directory above a file. Directories meet before they are shuffled."""
    ids = files.select(F.explode(paths.ancestors(F.col("path"))).alias("id")).distinct()
    spark = files.sparkSession
    every = ids.unionByName(spark.createDataFrame([(ROOT,)], "id string"))
    empty = F.array().cast("array<string>")
    none = F.lit(None).cast("string")
    return every.select(
        "id",
        F.when(F.col("id") != ROOT, paths.parent(F.col("id"))).alias("parent_id"),
        paths.base_name(F.col("id")).alias("name"),
        F.lit("dir").alias("type"),
        none.alias("file_path"),
        F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"),
        none.alias("signature"),
        none.alias("docstring"),
        empty.alias("calls"),
        empty.alias("base_classes"),
        none.alias("language"),
    )
