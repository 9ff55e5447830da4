"""A source tree as a table: (path, content, error), names that start with ``_`` or ``.`` included.

Spark's own file readers skip such names, so this is a Python data source:

    files = read_tree(spark, "/mnt/corpus", languages=["python"])

What is not asked for is not read: with a schema of ``path`` alone no file is opened, with ``languages`` only files
with their suffixes are, and where ``PUSHDOWN`` is on, filters on ``path`` (=, IN, LIKE
'x%' and '%x') are tested before a file is opened, and directories that cannot hold a match are not entered.

The driver opens directories from the top until there are a few for every partition, and holds no more names than
these; they are packed into at most ``PARTITIONS`` partitions, and each task walks what is below its own. A directory of
more than ``FILES_PER_TASK`` entries is dealt to several tasks by a hash of the names. The folder must be mounted
at the same path on every executor; a corpus in object storage is better kept as a Parquet table of the same schema.

Bytes of a name that are no UTF-8 are written as \\xNN. A file or directory that cannot be read is a row with a null
content and the reason in ``error``; one that vanished since it was listed has no row. Links are not followed.
Directories that are excluded by name are not entered, unless ``everything`` is asked for.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith

from ..schemas import EXCLUDED_NAMES, EXCLUDED_SUFFIX, EXTENSIONS, TREE_FILES

PARTITIONS = 1_000
FILES_PER_TASK = 5_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
SPREAD = 4  # directories to a partition before the driver stops opening them


@dataclass(frozen=True)
class Walk:
    """A directory: all below it, or its own files alone; of its entries those whose names hash to ``share``."""

    folder: bytes
    deep: bool
    share: int = 0
    shares: int = 1

    def has(self, name: bytes) -> bool:
        return self.shares == 1 or zlib.crc32(name) % self.shares == self.share


class Walks(InputPartition):
    def __init__(self, walks: list[Walk]):
        self.walks = walks


def shown(path: bytes) -> str:
    return path.decode("utf-8", "backslashreplace")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE_FILES

    def reader(self, schema) -> SourceTreeReader:
        o = self.options
        suffixes = [s for name in o["languages"].split(",") for s in EXTENSIONS[name]] if o.get("languages") else None
        reader = FilteringReader if o.get("pushdown", "false") == "true" else SourceTreeReader
        return reader(os.fsencode(o["path"]), schema.names, o.get("all", "false") == "true", int(o.get("partitions", PARTITIONS)), int(o.get("files", FILES_PER_TASK)), suffixes)


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: bytes, columns: list[str], everything: bool, partitions: int, files: int, suffixes: list[str] | None):
        self.root = root.rstrip(b"/") or b"/"
        self.columns, self.everything, self.most, self.files, self.suffixes = columns, everything, max(1, partitions), max(1, files), suffixes
        self.starts: list[list[str]] = []  # of each filter, prefixes of which a path must have one
        self.tests: list[Filter] = []

    def relative(self, path: bytes) -> str:
        return shown(os.path.relpath(path, self.root))

    def wanted(self, path: str) -> bool:
        """Whether a file may be in the result."""
        if self.suffixes is not None and os.path.splitext(path)[1].lower() not in self.suffixes:
            return False
        for f in self.tests:
            if isinstance(f, EqualTo):
                ok = path == f.value
            elif isinstance(f, In):
                ok = path in f.value
            else:
                ok = path.startswith(f.value) if isinstance(f, StringStartsWith) else path.endswith(f.value)
            if not ok:
                return False
        return True

    def entered(self, folder: bytes, name: bytes) -> bool:
        """Whether a directory may hold files of the result."""
        if not self.everything and (shown(name) in EXCLUDED_NAMES or shown(name).endswith(EXCLUDED_SUFFIX)):
            return False
        here = self.relative(os.path.join(folder, name)) + "/"
        return all(any(here.startswith(s) or s.startswith(here) for s in starts) for starts in self.starts)

    def entries(self, walk: Walk) -> Iterator[tuple[bool, bytes]]:
        """(is a directory, name) of what is to be entered or read in one directory."""
        with os.scandir(walk.folder) as found:
            for e in found:
                if walk.has(e.name):
                    if e.is_dir(follow_symlinks=False):
                        if self.entered(walk.folder, e.name):
                            yield True, e.name
                    elif e.is_file(follow_symlinks=False):
                        yield False, e.name

    def partitions(self) -> list[Walks]:
        closed, walks = deque([self.root]), []
        while closed and len(closed) + len(walks) < SPREAD * self.most:
            folder = closed.popleft()
            inner, own, n = [], 0, 0
            try:
                for is_dir, name in self.entries(Walk(folder, False)):
                    n += 1
                    own += not is_dir
                    if is_dir and n <= max(self.files, SPREAD * self.most):
                        inner.append(name)
            except OSError:
                walks.append(Walk(folder, False))  # the task tells the reason
                continue
            if n > max(self.files, SPREAD * self.most):
                shares = min(self.most, -(-n // self.files))
                walks += [Walk(folder, True, i, shares) for i in range(shares)]
                continue
            shares = -(-own // self.files)
            walks += [Walk(folder, False, i, shares) for i in range(shares)]
            closed += [os.path.join(folder, name) for name in sorted(inner)]
        walks += [Walk(f, True) for f in closed]
        return [Walks(walks[i :: self.most]) for i in range(min(self.most, len(walks)))] or [Walks([])]

    def row(self, path: str, content: bytes | None, error: str | None) -> tuple:
        values = {"path": path, "content": content, "error": error}
        return tuple(values[c] for c in self.columns)

    def read(self, partition: Walks) -> Iterator[tuple]:
        for start in partition.walks:
            todo = [start]
            while todo:
                walk = todo.pop()
                try:
                    found = sorted(self.entries(walk), key=lambda e: e[1])
                except FileNotFoundError:
                    continue
                except OSError as e:
                    yield self.row(self.relative(walk.folder), None, e.strerror or str(e))
                    continue
                for is_dir, name in found:
                    path = os.path.join(walk.folder, name)
                    if is_dir:
                        todo += [Walk(path, True)] if walk.deep else []
                    elif self.wanted(self.relative(path)):
                        yield from self.file(path)

    def file(self, path: bytes) -> Iterator[tuple]:
        if "content" not in self.columns:
            yield self.row(self.relative(path), None, None)
            return
        try:
            with open(path, "rb") as f:
                yield self.row(self.relative(path), f.read(), None)
        except FileNotFoundError:
            return
        except OSError as e:
            yield self.row(self.relative(path), None, e.strerror or str(e))


class FilteringReader(SourceTreeReader):
    """A reader of its own, since Spark refuses readers with pushFilters where the session has pushdown turned off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)) and f.attribute == ("path",):
                self.tests.append(f)
                if isinstance(f, (EqualTo, StringStartsWith)):
                    self.starts.append([f.value])
                elif isinstance(f, In):
                    self.starts.append([v for v in f.value if v is not None])
            else:
                yield f


def read_tree(spark: SparkSession, path: str, languages: list[str] | None = None, columns: str = TREE_FILES, everything: bool = False, partitions: int = PARTITIONS, files: int = FILES_PER_TASK) -> DataFrame:
    """The tree below ``path``: only files of ``languages`` if these are given, and only the columns that are asked for."""
    spark.dataSource.register(SourceTree)
    options = {"all": str(everything).lower(), "partitions": partitions, "files": files, "pushdown": spark.conf.get(PUSHDOWN, "false")}
    reader = spark.read.format("source_tree").schema(columns).options(**options)
    return (reader.option("languages", ",".join(languages)) if languages else reader).load(path)
