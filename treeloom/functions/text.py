"""Column expressions over text: decoding, identifiers, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STOP_WORDS


def strict_text(content: Column) -> Column:
    """UTF-8 text, null if the bytes are not valid."""
    return F.when(F.is_valid_utf8(content), F.decode(content, "UTF-8"))


def lenient_text(content: Column) -> Column:
    """UTF-8 text, or Latin-1 if the bytes are not valid UTF-8."""
    return F.coalesce(strict_text(content), F.decode(content, "ISO-8859-1"))


def line_count(text: Column) -> Column:
    """Newlines plus one; 0 for null."""
    return F.coalesce(F.size(F.split(text, "\n")), F.lit(0))


def split_identifier(name: Column) -> Column:
    """Parts of a name, cut at underscores and before every capital, in lower case."""
    spaced = F.regexp_replace(name, "([A-Z])", " $1")
    return F.filter(F.split(F.lower(spaced), r"[\s_]+"), lambda x: x != "")


def searchable_text(name: Column, signature: Column, docstring: Column) -> Column:
    """Name, its parts, signature and docstring, joined by spaces; empty ones are left out."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", some(name), some(F.array_join(split_identifier(name), " ")), some(signature), some(docstring))


def tokens(text: Column) -> Column:
    """Lower-case words of a letter and letters or digits, longer than two and no stop words, in order with repeats."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9]*"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOP_WORDS))
