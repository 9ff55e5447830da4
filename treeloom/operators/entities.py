"""Entities: extraction from Python source, and their node ids.

An extractor takes files(path, content) and returns rows of schemas.ENTITIES. Python ships;
others plug in through ``extract(files, extractors)`` or enter as a table of that schema.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import ENTITIES

FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
FIELDS = [c.split()[0] for c in ENTITIES.split(", ")]


def called_names(function) -> list[str]:
    """Distinct names called in the body, sorted: a plain name, or the last part of an attribute."""
    found = set()
    for statement in function.body:
        for n in ast.walk(statement):
            if isinstance(n, ast.Call):
                if isinstance(n.func, ast.Name):
                    found.add(n.func.id)
                elif isinstance(n.func, ast.Attribute):
                    found.add(n.func.attr)
    return sorted(found)


def function_signature(node) -> str:
    word = "async def" if isinstance(node, ast.AsyncFunctionDef) else "def"
    returns = f" -> {ast.unparse(node.returns)}" if node.returns else ""
    return f"{word} {node.name}({ast.unparse(node.args)}){returns}"


def definitions(content: bytes | None) -> Iterator[tuple]:
    """Definitions at the top level and in class bodies, in source order."""
    todo = [(n, None) for n in reversed(ast.parse((content or b"").decode("utf-8")).body)]
    while todo:
        node, outer = todo.pop()
        if not isinstance(node, (*FUNCTIONS, ast.ClassDef)):
            continue
        qualname = f"{outer}.{node.name}" if outer else node.name
        doc = ast.get_docstring(node)
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            signature = f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"
            kind, calls = "class", []
            todo += [(n, qualname) for n in reversed(node.body)]
        else:
            kind, calls, bases, signature = "method" if outer else "function", called_names(node), [], function_signature(node)
        yield qualname, outer, node.name, kind, node.lineno, node.end_lineno, signature, doc, calls, bases


def storable(x):
    """Text without lone surrogates, which a source may spell in a literal and no table can hold."""
    if isinstance(x, list):
        return [storable(v) for v in x]
    return x.encode("utf-8", "replace").decode("utf-8") if isinstance(x, str) else x


def python_entities(path: str, content: bytes | None) -> list[tuple]:
    """Rows of schemas.ENTITIES; none if the source does not parse, or nests too deep to be written out. One odd file costs no other."""
    try:
        found = list(definitions(content))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    return [(path, position, *map(storable, row), "python") for position, row in enumerate(found)]


def extract_python(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [r for path, content in zip(batch["path"], batch["content"]) for r in python_entities(path, content)]
        out = pd.DataFrame(rows, columns=FIELDS)
        for c in ("position", "line_start", "line_end"):
            out[c] = out[c].astype("int32")
        yield out


EXTRACTORS: dict[str, Callable] = {"python": extract_python}


def extract(files: DataFrame, extractors: dict[str, Callable] | None = None, partitions: int | None = None) -> DataFrame:
    """Entities of files(path, content, language). ``partitions`` deals the files out anew, where a few inputs hold large files."""
    out = files.sparkSession.createDataFrame([], ENTITIES)
    for language, run in (extractors or EXTRACTORS).items():
        mine = files.filter(F.col("language") == language).select("path", "content")
        out = out.unionByName((mine.repartition(partitions) if partitions else mine).mapInPandas(run, ENTITIES))
    return out


def entity_nodes(entities: DataFrame) -> DataFrame:
    """Nodes with ``position``; ids are path:qualname, parents the enclosing entity or the file."""
    inner = F.concat_ws(":", "path", "parent_qualname")
    return entities.select(
        F.concat_ws(":", "path", "qualname").alias("id"),
        F.when(F.col("parent_qualname").isNull(), F.col("path")).otherwise(inner).alias("parent_id"),
        "name",
        "type",
        F.col("path").alias("file_path"),
        "line_start",
        "line_end",
        "signature",
        "docstring",
        "calls",
        "base_classes",
        "language",
        "position",
    )
