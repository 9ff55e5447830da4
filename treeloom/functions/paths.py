"""Column expressions over relative paths."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import EXCLUDED_NAMES, EXCLUDED_SUFFIX, EXTENSIONS, ROOT


def parts(path: Column) -> Column:
    return F.split(path, "/")


def is_excluded(path: Column, names: list[str] | None = None) -> Column:
    """Whether any component of the path is excluded; names may be globs."""
    if names is None:
        return F.exists(parts(path), lambda c: c.isin(EXCLUDED_NAMES) | c.endswith(EXCLUDED_SUFFIX))
    patterns = [fnmatch.translate(n).replace(r"\z", r"\Z") for n in names]
    test = lambda c: reduce(lambda a, p: a | c.rlike(p), patterns, F.lit(False))
    return F.exists(parts(path), test)


def base_name(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def suffix(path: Column) -> Column:
    """Last suffix in lower case, '' if there is none; a leading dot starts no suffix."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """The extractor of a file, null if it is not supported."""
    last = suffix(path)
    out = F.lit(None).cast("string")
    for name, endings in EXTENSIONS.items():
        out = F.when(last.isin(endings), F.lit(name)).otherwise(out)
    return out


def parent(path: Column) -> Column:
    """Directory of a path, '.' at the top."""
    up = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit(ROOT)).otherwise(up)


def ancestors(path: Column) -> Column:
    """Every directory above a path, shortest first, without the root."""
    p = parts(path)
    n = F.size(p)
    up = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(p, F.lit(1), i), "/"))
    return F.when(n > 1, up).otherwise(F.array().cast("array<string>"))
