"""Schemas of the tables, and the fixed lists that give them their meaning."""

from __future__ import annotations

FILES = "path string, content binary"
TREE_FILES = FILES + ", error string"
ENTITIES = (
    "path string, position int, qualname string, parent_qualname string, name string, type string, line_start int, line_end int, "
    "signature string, docstring string, calls array<string>, base_classes array<string>, language string"
)
NODES = (
    "id string, parent_id string, name string, type string, file_path string, line_start int, line_end int, "
    "signature string, docstring string, calls array<string>, base_classes array<string>, language string"
)
NODE_COLUMNS = [c.split()[0] for c in NODES.split(", ")]
FILE_HASHES = "path string, hash string, indexed_at timestamp"
LINES = "path string, utf8 boolean, starts array<long>"
POSTINGS = "node_id string, term string, tf double"
IDF = "term string, idf double"
FREQUENCIES = "term string, df long"

ROOT = "."

# What is left out of a scan, by name of any path component.
EXCLUDED_NAMES = [
    ".git", ".svn", ".hg",
    "__pycache__", ".venv", "venv", ".pytest_cache", ".mypy_cache", ".eggs",
    "node_modules", ".npm", "bower_components",
    "dist", "build", "out", "_build",
    "vendor", "target", ".gradle", ".mvn",
    ".idea", ".vscode", ".tox", ".nox", "coverage", ".coverage", "htmlcov",
]
EXCLUDED_SUFFIX = ".egg-info"

# The extractor that a file goes to, by the last suffix in lower case.
EXTENSIONS = {
    "python": [".py", ".pyi"],
    "javascript": [".js", ".jsx", ".mjs", ".ts", ".tsx"],
    "go": [".go"],
    "rust": [".rs"],
    "java": [".java"],
    "c_cpp": [".c", ".h", ".cpp", ".hpp", ".cc", ".cxx", ".hxx", ".hh"],
    "csharp": [".cs"],
    "php": [".php", ".phtml"],
    "ruby": [".rb", ".rake", ".gemspec"],
}

SEARCHABLE_TYPES = ["function", "method", "class"]
COUNTED_TYPES = {"files": "file", "classes": "class", "functions": "function", "methods": "method"}

# Words that are not indexed.
STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has",
    "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "shall",
    "can", "need", "dare", "ought", "used", "to", "of", "in", "for", "on", "with", "at",
    "by", "from", "as", "into", "through", "during", "before", "after", "above", "below", "between", "under",
    "again", "further", "then", "once", "self", "this", "that", "these", "those", "def", "class", "return",
    "if", "else", "elif", "try", "except", "finally", "and", "or", "not", "none", "true", "false",
]
