"""SQL for DuckDB with the rows of every registered query."""

from __future__ import annotations

from ..operators.render import FIELDS
from ..operators.tree import COUNTS
from ..schemas import EXCLUDED_NAMES, EXTENSIONS, STOP_WORDS
from .queries import SEARCHED


def quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def files_cte(name: str, source: str) -> str:
    ending = "['.py', '.js', '.go', '.rs', '.java', '.TXT', '.md', '.PYI'][CAST(doc_id % 8 + 1 AS INT)]"
    return f"""{name} AS (
SELECT (CASE WHEN doc_id % 50 = 1 THEN '' ELSE source || '/' || lang || '/' END) || (CASE WHEN doc_id % 11 = 0 THEN 'build/' ELSE '' END) || 'd' || doc_id || {ending} AS path,
       text, doc_id FROM ({source}))"""


ALL = "SELECT * FROM documents"
OLD = "SELECT * FROM documents WHERE doc_id % 10 <> 3"
NEW = "SELECT doc_id, source, lang, CASE WHEN doc_id % 10 = 5 THEN text || ' edited revision' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7"
SUFFIX = r"lower(regexp_extract(path, '(?:^|/)[^/]+(\.[^./]+)$', 1))"
LANGUAGE = "CASE " + " ".join(f"WHEN {SUFFIX} IN ({quoted(e)}) THEN '{k}'" for k, e in EXTENSIONS.items()) + " END"
KEPT_PATH = f"len(list_filter(string_split(path, '/'), lambda c: c IN ({quoted(EXCLUDED_NAMES)}) OR ends_with(c, '.egg-info'))) = 0"
PARENT = "CASE WHEN position('/' IN path) = 0 THEN '.' ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END"


def kept_cte(name: str, files: str) -> str:
    return f"{name} AS (SELECT *, {LANGUAGE} AS language, {PARENT} AS parent_id FROM {files} WHERE {KEPT_PATH} AND {LANGUAGE} IS NOT NULL)"


def dirs_cte(name: str, kept: str) -> str:
    return f"""{name} AS (
SELECT '.' AS id, NULL AS parent_id, '.' AS name
UNION ALL SELECT id, CASE WHEN position('/' IN id) = 0 THEN '.' ELSE regexp_extract(id, '^(.*)/[^/]*$', 1) END, string_split(id, '/')[-1]
FROM (SELECT DISTINCT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS id FROM {kept}, range(1, 10) t(i) WHERE i < len(string_split(path, '/'))))"""


def prose_cte(name: str, kept: str, dirs: str) -> str:
    return f"""{name} AS (
SELECT id, parent_id, 'dir' AS type, NULL AS file_path, name, NULL AS docstring FROM {dirs}
UNION ALL SELECT path, parent_id, 'file', path, string_split(path, '/')[-1], NULL FROM {kept}
UNION ALL SELECT path || ':d' || doc_id, path, 'function', path, 'd' || doc_id, text FROM {kept})"""


TREE = """
lines AS (
SELECT r_name || '/' || n_name || '/' || c_name || '.py' AS file, o_orderkey, l.*,
       strftime(l_shipdate, '%Y%m%d') || '|' || lpad(CAST(l_partkey AS VARCHAR), 12, '0') || '|' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') || '|' ||
       lpad(CAST(CAST(round(l_quantity * 100) AS BIGINT) AS VARCHAR), 12, '0') || '|' || lpad(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), 12, '0') || '|' ||
       lpad(CAST(CAST(round(l_discount * 100) AS BIGINT) AS VARCHAR), 12, '0') || '|' || lpad(CAST(CAST(round(l_tax * 100) AS BIGINT) AS VARCHAR), 12, '0') || '|' ||
       l_returnflag || '|' || l_linestatus AS position
FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
SELECT '.' AS id, CAST(NULL AS VARCHAR) AS parent_id, '.' AS name, 'dir' AS type, CAST(NULL AS VARCHAR) AS file_path, CAST(NULL AS INT) AS line_start, CAST(NULL AS VARCHAR) AS signature, '' AS position
UNION ALL SELECT r_name, '.', r_name, 'dir', NULL, NULL, NULL, '' FROM region
UNION ALL SELECT r_name || '/' || n_name, r_name, n_name, 'dir', NULL, NULL, NULL, '' FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name || '.py', r_name || '/' || n_name, c_name || '.py', 'file', r_name || '/' || n_name || '/' || c_name || '.py', 1, NULL, ''
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT r_name || '/' || n_name || '/' || c_name || '.py:O' || o_orderkey, r_name || '/' || n_name || '/' || c_name || '.py', 'O' || o_orderkey,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'class' ELSE 'function' END, r_name || '/' || n_name || '/' || c_name || '.py', NULL, NULL, ''
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderkey % 97 <> 0
UNION ALL SELECT file || ':O' || o_orderkey || '.L' || l_linenumber, file || ':O' || o_orderkey, 'L' || l_linenumber, 'method', file, l_linenumber, l_partkey || '-' || l_suppkey, position FROM lines),
nodes AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position DESC) AS k FROM raw) WHERE k = 1)"""

CHILDREN = """
below AS (SELECT parent_id AS id, string_agg(id, ',' ORDER BY id) AS children_ids FROM nodes WHERE parent_id IS NOT NULL GROUP BY parent_id)"""

CLOSURE = """
closure AS (
SELECT id AS root, id, type FROM nodes
UNION ALL SELECT c.root, n.id, n.type FROM closure c JOIN nodes n ON n.parent_id = c.id),
stats AS (SELECT root AS id, count(*) FILTER (type = 'file') AS files, count(*) FILTER (type = 'class') AS classes, count(*) FILTER (type = 'function') AS functions, count(*) FILTER (type = 'method') AS methods FROM closure GROUP BY root)"""

CALLERS = """
called AS (SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS calls FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
nodes AS (
SELECT 'orders.py:O' || l_orderkey AS id, 'O' || l_orderkey AS name, 'function' AS type, calls, CAST([] AS VARCHAR[]) AS base_classes FROM called
UNION ALL SELECT 'parts.py:P' || p_partkey, p_name, 'class', CAST([] AS VARCHAR[]), [p_type, p_brand] FROM part
UNION ALL SELECT DISTINCT 'brands.py:' || p_brand, p_brand, 'class', CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM part),
pairs AS (SELECT DISTINCT unnest(calls) AS name, id FROM nodes),
named AS (SELECT name, count(*) AS n, list(id ORDER BY id) AS ids FROM pairs GROUP BY name)"""

SOURCE = """
source AS (
SELECT 'crm/n' || c_nationkey || '/c' || c_custkey || '.py' AS path, c_custkey AS k, c_nationkey AS n, c_mktsegment AS s FROM customer WHERE c_custkey % 10 < 7),
odd AS (SELECT 'crm/n' || c_nationkey || '/c' || c_custkey || '.py' AS path, c_custkey AS k, c_nationkey AS n FROM customer WHERE c_custkey % 10 = 8),
entities AS (
SELECT path, 0 AS position, 'C' || k AS qualname, NULL AS parent_qualname, 'C' || k AS name, 'class' AS type, 1 AS line_start, 5 AS line_end, 'class C' || k || '(Base' || n || ')' AS signature, s || ' customer.' AS docstring, '' AS calls, 'Base' || n AS base_classes FROM source
UNION ALL SELECT path, 1, 'C' || k || '.balance', 'C' || k, 'balance', 'method', 3, 5, 'def balance(self, x: int) -> float', 'Balance of it.', 'fetch,load', '' FROM source
UNION ALL SELECT path, 2, 'seg_' || k, NULL, 'seg_' || k, 'function', 8, 9, 'async def seg_' || k || '(a, b=1)', NULL, 'C' || k, '' FROM source
UNION ALL SELECT path, 0, 'C' || k, NULL, 'C' || k, 'class', 4, 6, 'class C' || k || '(Base' || n || ')', NULL, '', 'Base' || n FROM odd
UNION ALL SELECT path, 1, 'C' || k || '.Inner', 'C' || k, 'Inner', 'class', 5, 6, 'class Inner', NULL, '', '' FROM odd
UNION ALL SELECT path, 2, 'C' || k || '.Inner.go', 'C' || k || '.Inner', 'go', 'method', 6, 6, 'async def go(self, *, k=None)', NULL, '', '' FROM odd
UNION ALL SELECT path, 3, 'pick_' || k, NULL, 'pick_' || k, 'function', 10, 12, 'def pick_' || k || '(a, /, b: int=5, *args: str, c, **kw) -> None', 'Picks.', 'g,save', '' FROM odd)"""


def split_parts(name: str) -> str:
    return rf"array_to_string(list_filter(string_split_regex(lower(regexp_replace({name}, '([A-Z])', ' \1', 'g')), '[\s_]+'), lambda x: x <> ''), ' ')"


def token_list(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z][a-z0-9]*'), lambda w: length(w) > 2 AND w NOT IN ({quoted(STOP_WORDS)}))"


def texts_cte(name: str, nodes: str) -> str:
    return f"{name} AS (SELECT id AS node_id, concat_ws(' ', nullif(name, ''), nullif({split_parts('name')}, ''), nullif(docstring, '')) AS text FROM {nodes} WHERE type IN ('function', 'method', 'class'))"


def index_cte(texts: str, at: str = "") -> str:
    return f"""
counts{at} AS (SELECT node_id, term, count(*) AS n FROM (SELECT node_id, unnest({token_list("text")}) AS term FROM {texts}) GROUP BY ALL),
postings{at} AS (SELECT node_id, term, n / max(n) OVER (PARTITION BY node_id) AS tf FROM counts{at}),
idf{at} AS (SELECT term, ln(((SELECT count(*) FROM {texts}) + 1) / (count(*) + 1)) + 1 AS idf FROM postings{at} GROUP BY term)"""


DOCUMENTS = "docs AS (SELECT 'd' || doc_id AS id, source AS name, 'function' AS type, text AS docstring FROM documents), " + texts_cte("texts", "docs")
INDEX = DOCUMENTS + ", " + index_cte("texts")


def scores_cte(queries: str) -> str:
    return f"""
queries AS ({queries}),
words AS (SELECT query_id, {token_list("query")} AS w FROM queries),
terms AS (SELECT query_id, term, idf, n_tokens FROM (SELECT query_id, len(w) AS n_tokens, unnest(list_distinct(w)) AS term FROM words) JOIN idf USING (term)),
scores AS (SELECT query_id, node_id, round(least(sum(tf * terms.idf) / (any_value(n_tokens) * (SELECT max(idf) FROM idf)), 1.0), 9) AS score FROM postings JOIN terms USING (term) GROUP BY query_id, node_id)"""


SEARCH = INDEX + "," + scores_cte("SELECT item_id AS query_id, text AS query FROM benchmark")

CHANGES = ", ".join(
    [
        files_cte("old_files", OLD),
        files_cte("new_files", NEW),
        kept_cte("old_kept", "old_files"),
        kept_cte("new_kept", "new_files"),
        "status AS (SELECT coalesce(o.path, n.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed' WHEN sha256(o.text) <> sha256(n.text) THEN 'updated' ELSE 'unchanged' END AS status FROM old_kept o FULL JOIN new_kept n ON o.path = n.path)",
    ]
)
BUILDS = CHANGES + ", " + ", ".join([dirs_cte("old_dirs", "old_kept"), dirs_cte("new_dirs", "new_kept"), prose_cte("old_nodes", "old_kept", "old_dirs"), prose_cte("new_nodes", "new_kept", "new_dirs")])
BOTH = BUILDS + ", " + texts_cte("old_texts", "old_nodes") + ", " + texts_cte("new_texts", "new_nodes") + "," + index_cte("old_texts", "_old") + "," + index_cte("new_texts", "_new")
DELTA = "delta AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.docstring IS DISTINCT FROM n.docstring THEN 'updated' END AS status FROM old_nodes o FULL JOIN new_nodes n ON o.id = n.id)"
FILES = files_cte("files", ALL)
KEPT = FILES + ", " + kept_cte("kept", "files")
LINES = "string_split(text, chr(10))"

NO_NAMES = "CAST([] AS VARCHAR[])"
STATS = "{" + ", ".join(f"'{c}': {c}" for c in COUNTS) + "}"


def json(**fields: str) -> str:
    return "CAST(to_json({" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}) AS VARCHAR)"


def node_struct(**fields: str) -> str:
    """A node's thirteen fields; what is not given is null, or an empty list."""
    given = {f: NO_NAMES if f in ("children_ids", "calls", "base_classes") else "NULL" for f in FIELDS} | fields
    return "{" + ", ".join(f"'{k}': {v}" for k, v in given.items()) + "}"


CALLER_NODE = node_struct(id="id", name="nodes.name", type="type", parent_id="string_split(id, ':')[1]", calls="calls", base_classes="base_classes")
TREE_NODE = node_struct(id="nodes.id", name="name", type="type", file_path="file_path", line_start="line_start", signature="signature", parent_id="parent_id", children_ids=f"coalesce(string_split(children_ids, ','), {NO_NAMES})", language="CASE WHEN type <> 'dir' THEN 'python' END")
DOCUMENT_NODE = node_struct(id="docs.id", name="name", type="type", docstring="docstring")

SNAPSHOT = f"""WITH {BOTH}
SELECT 'node' AS kind, id, coalesce(parent_id, '') AS detail, CAST(0 AS DOUBLE) AS value FROM new_nodes
UNION ALL SELECT 'posting', node_id, term, round(tf, 6) FROM postings_new
UNION ALL SELECT 'idf', term, '', round(idf, 6) FROM idf_new
UNION ALL SELECT 'hash', path, sha256(text), 0 FROM new_kept"""



def bits(text: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) AS HUGEINT)"


def digests_cte(at: str) -> str:
    above = "['.'] || list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"
    return f"{at}_digests AS (SELECT id, count(*) AS n_files, CAST(sum(d) AS VARCHAR) AS digest FROM (SELECT unnest({above}) AS id, {bits("path || ':' || sha256(text)")} AS d FROM {at}_kept) GROUP BY id)"


SEARCH_BATCH = f"""WITH {SEARCH}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scores)
SELECT query_id, rank, node_id, round(score, 6) AS score, name FROM best JOIN docs ON docs.id = node_id WHERE rank <= 10"""

ORACLE_SQL = {
    "route_files": f"WITH {FILES} SELECT path, {LANGUAGE} AS language FROM files WHERE {LANGUAGE} IS NOT NULL",
    "exclude_paths": f"WITH {FILES} SELECT path FROM files WHERE {KEPT_PATH}",
    "file_nodes": f"WITH {KEPT} SELECT path AS id, parent_id, string_split(path, '/')[-1] AS name, 'file' AS type, 1 AS line_start, len({LINES}) AS line_end, language FROM kept",
    "decode_files": f"""WITH given AS (SELECT doc_id, text, doc_id % 3 = 0 AS latin FROM documents),
decoded AS (SELECT doc_id, CASE WHEN NOT latin OR NOT regexp_matches(text, '[^\\x00-\\x7F]') THEN text END AS strict, CASE WHEN latin THEN regexp_replace(text, '[^\\x00-\\x{{FF}}]', '?', 'g') ELSE text END AS lenient FROM given)
SELECT doc_id, strict, lenient, CASE WHEN strict IS NULL THEN 0 ELSE len(string_split(strict, chr(10))) END AS n_lines FROM decoded""",
    "load_tree": f"WITH {FILES} SELECT path, sha256(text) AS hash FROM files WHERE {KEPT_PATH}",
    "list_tree": f"WITH {FILES} SELECT path, CAST(NULL AS VARCHAR) AS error FROM files WHERE {LANGUAGE} IN ('python', 'go')",
    "content_hash": f"WITH {FILES} SELECT path, sha256(text) AS hash FROM files",
    "read_lines": f"""WITH {FILES},
asked AS (SELECT path, text, CAST(strlen(text) % 5 AS INT) AS s, CAST(strlen(text) % 7 AS INT) AS e, len({LINES}) AS n FROM files),
bounds AS (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END AS f, least(CASE WHEN e = 0 THEN n ELSE e END, n) AS l FROM asked)
SELECT path, s AS start, e AS "end", CASE WHEN f <= l THEN array_to_string(list_slice({LINES}, f, l), chr(10)) END AS text, CASE WHEN f > l THEN 'start is after end' END AS error FROM bounds""",
    "entity_snippets": f"""WITH {SOURCE},
snippets AS (SELECT path || ':C' || k || '.balance' AS id, '    def balance(self, x: int) -> float:' || chr(10) || '        \"\"\"Balance of it.\"\"\"' || chr(10) || '        return fetch(self.load(x))' AS text FROM source)
SELECT * FROM snippets
UNION ALL SELECT path || ':C' || k, 'class C' || k || '(Base' || n || '):' || chr(10) || '    \"\"\"' || s || ' customer.\"\"\"' || chr(10) || text FROM source JOIN snippets ON id = path || ':C' || k || '.balance'
UNION ALL SELECT path || ':seg_' || k, 'async def seg_' || k || '(a, b=1):' || chr(10) || '    return C' || k || '(a)' FROM source
UNION ALL SELECT path || ':C' || k, 'class C' || k || '(Base' || n || ', metaclass=M):' || chr(10) || '    class Inner:' || chr(10) || '        async def go(self, *, k=None): pass' FROM odd
UNION ALL SELECT path || ':C' || k || '.Inner', '    class Inner:' || chr(10) || '        async def go(self, *, k=None): pass' FROM odd
UNION ALL SELECT path || ':C' || k || '.Inner.go', '        async def go(self, *, k=None): pass' FROM odd
UNION ALL SELECT path || ':pick_' || k, 'def pick_' || k || '(a, /, b: int = 5, *args: str, c, **kw) -> None:' || chr(10) || '    \"\"\"Picks.\"\"\"' || chr(10) || '    self.save(g()(1))' FROM odd""",
    "extract_entities": f"WITH {SOURCE} SELECT * EXCLUDE (parent_qualname) FROM entities",
    "entity_ids": f"WITH {SOURCE} SELECT path || ':' || qualname AS id, CASE WHEN parent_qualname IS NULL THEN path ELSE path || ':' || parent_qualname END AS parent_id FROM entities",
    "dir_closure": f"WITH {KEPT}, {dirs_cte('dirs', 'kept')} SELECT id, parent_id, name, 'dir' AS type FROM dirs",
    "assemble_nodes": f"WITH {TREE} SELECT id, parent_id, name, type, file_path, line_start, signature FROM nodes",
    "node_lookup": f"WITH {TREE}, {CHILDREN} SELECT n.id, parent_id, name, coalesce(children_ids, '') AS children_ids FROM nodes n LEFT JOIN below b ON n.id = b.id WHERE type = 'file'",
    "children": f"WITH {TREE}, below AS (SELECT parent_id AS id, count(*) AS n FROM nodes GROUP BY ALL) SELECT parent_id, nodes.id, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN below ON nodes.id = below.id WHERE parent_id IS NOT NULL",
    "orphans": f"WITH {TREE} SELECT id, parent_id FROM nodes WHERE parent_id IS NOT NULL AND parent_id NOT IN (SELECT id FROM nodes)",
    "node_stats": f"WITH RECURSIVE {TREE}, {CLOSURE} SELECT * FROM stats WHERE id = '.'",
    "stats_all": f"WITH RECURSIVE {TREE}, {CLOSURE} SELECT * FROM stats",
    "project_map": f"WITH RECURSIVE {TREE}, {CLOSURE} SELECT * FROM stats WHERE id IN (SELECT id FROM nodes WHERE id = '.' OR parent_id = '.' AND type = 'dir')",
    "expand_node": f"WITH RECURSIVE {TREE}, {CHILDREN}, {CLOSURE} SELECT parent_id, n.id, name, type, coalesce(children_ids, '') AS children_ids, {', '.join(COUNTS)} FROM nodes n JOIN stats USING (id) LEFT JOIN below b ON n.id = b.id WHERE parent_id = 'ASIA'",
    "edges": f"""WITH {CALLERS}
SELECT c.id AS source_id, n.id AS target_id, 'calls' AS relation FROM (SELECT id, unnest(calls) AS name FROM nodes) c JOIN nodes n USING (name)
UNION ALL SELECT c.id, n.id, 'inherits' FROM (SELECT id, unnest(list_distinct(base_classes)) AS name FROM nodes) c JOIN nodes n USING (name) WHERE n.type = 'class'""",
    "callers": f"WITH {CALLERS} SELECT name, id AS caller_id FROM pairs",
    "inspect_all": f"WITH {CALLERS} SELECT id, nodes.name, array_to_string(calls, ',') AS calls, coalesce(n, 0) AS n_callers FROM nodes LEFT JOIN named ON nodes.name = named.name",
    "inspect_digests": f"WITH {CALLERS}, digests AS (SELECT name, count(*) AS n, CAST(sum({bits('id')}) AS VARCHAR) AS digest FROM pairs GROUP BY name) SELECT id, nodes.name, coalesce(n, 0) AS n_callers, digest FROM nodes LEFT JOIN digests ON nodes.name = digests.name",
    "inspect_json": f"WITH {CALLERS} SELECT id, {json(command="'inspect'", node=CALLER_NODE, calls='calls', called_by=f'coalesce(ids, {NO_NAMES})')} AS json FROM nodes LEFT JOIN named ON nodes.name = named.name WHERE id IN (SELECT min(id) FROM nodes GROUP BY nodes.name)",
    "hierarchy_json": f"WITH {CALLERS} SELECT {json(command="'hierarchy'", base_class="'Brand#7'", count='count(*)', subclasses=f'list({CALLER_NODE} ORDER BY id)')} AS json FROM nodes WHERE list_contains(base_classes, 'Brand#7')",
    "map_json": f"WITH RECURSIVE {TREE}, {CLOSURE}, top AS (SELECT id, {STATS} AS s FROM stats WHERE id IN (SELECT id FROM nodes WHERE parent_id = '.' AND type = 'dir')) SELECT {json(command="'map'", project="'orders'", root="'/data'", stats=f"(SELECT {STATS} FROM stats WHERE id = '.')", children="list({'id': id, 'stats': s} ORDER BY id)")} AS json FROM top",
    "expand_json": f"""WITH RECURSIVE {TREE}, {CHILDREN}, {CLOSURE},
full_nodes AS (SELECT nodes.*, {TREE_NODE} AS node, {TREE_NODE[:-1]}, 'stats': {STATS}}} AS listed FROM nodes JOIN stats USING (id) LEFT JOIN below ON nodes.id = below.id)
SELECT {json(command="'expand'", node="(SELECT node FROM full_nodes WHERE id = 'ASIA')", children="list(listed ORDER BY id)")} AS json FROM full_nodes WHERE parent_id = 'ASIA'""",
    "subclasses": "SELECT 'parts.py:P' || p_partkey AS id, p_name AS name FROM part WHERE p_brand = 'Brand#7' OR p_type = 'Brand#7'",
    "hierarchy_all": f"WITH {CALLERS} SELECT base, count(*) OVER (PARTITION BY base) AS count, id AS subclass_id FROM (SELECT id, unnest(list_distinct(base_classes)) AS base FROM nodes WHERE type = 'class')",
    "searchable_text": f"WITH {DOCUMENTS} SELECT node_id, text FROM texts",
    "split_identifier": f"""WITH named AS (SELECT p_partkey, replace(array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ' ', '') || '_' || replace(p_type, ' ', '') || '_v' || p_size AS name FROM part)
SELECT p_partkey, name, {split_parts("name")} AS parts FROM named""",
    "tokenize": f"SELECT doc_id, array_to_string({token_list('text')}, ' ') AS tokens FROM documents",
    "term_counts": f"WITH {INDEX} SELECT node_id, term, n FROM counts",
    "tf": f"WITH {INDEX} SELECT node_id, term, round(tf, 6) AS tf FROM postings",
    "idf": f"WITH {INDEX} SELECT term, round(idf, 6) AS idf FROM idf",
    "build_index": f"WITH {INDEX} SELECT node_id, term, round(tf, 6) AS tf, round(idf, 6) AS idf FROM postings JOIN idf USING (term)",
    "query_terms": f"WITH {SEARCH} SELECT query_id, term, round(idf, 6) AS idf, n_tokens FROM terms",
    "search_scores": f"WITH {SEARCH} SELECT query_id, node_id, round(score, 6) AS score FROM scores",
    "search_top10": f"WITH {INDEX}, {scores_cte(f'''SELECT 0 AS query_id, '{SEARCHED}' AS query''')}, best AS (SELECT * FROM scores ORDER BY score DESC, node_id LIMIT 10) SELECT node_id, round(score, 6) AS score, name FROM best JOIN docs ON docs.id = node_id",
    "search_batch": SEARCH_BATCH,
    "search_pruned": SEARCH_BATCH,
    "search_json": f"""WITH {SEARCH}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scores),
hits AS (SELECT query_id, list({{'node': {DOCUMENT_NODE}, 'score': round(score, 4)}} ORDER BY rank) AS results FROM best JOIN docs ON docs.id = node_id WHERE rank <= 10 GROUP BY query_id)
SELECT query_id, {json(command="'search'", query='query', count='len(coalesce(results, []))', results='coalesce(results, [])')} AS json FROM queries LEFT JOIN hits USING (query_id)""",
    "classify_files": f"WITH {CHANGES} SELECT path, status FROM status",
    "directory_digests": f"WITH {CHANGES}, {digests_cte('new')} SELECT id, n_files, digest FROM new_digests",
    "changed_directories": f"""WITH {CHANGES}, {digests_cte('old')}, {digests_cte('new')}
SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.digest <> n.digest THEN 'updated' END AS status FROM old_digests o FULL JOIN new_digests n ON o.id = n.id) WHERE status IS NOT NULL""",
    "status_counts": f"WITH {CHANGES} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "updated", "removed", "unchanged")) + " FROM status",
    "removed_files": f"WITH {CHANGES} SELECT path FROM status WHERE status = 'removed'",
    "delete_file_nodes": f"WITH {BUILDS} SELECT id, type FROM old_nodes WHERE file_path IS NULL OR file_path NOT IN (SELECT path FROM status WHERE status = 'removed')",
    "upsert_hashes": f"WITH {CHANGES} SELECT path, sha256(text) AS hash FROM new_kept UNION ALL SELECT path, sha256(text) FROM old_kept WHERE path NOT IN (SELECT path FROM new_kept)",
    "replace_files": f"WITH {BUILDS} SELECT id, parent_id, type, md5(docstring) AS docstring_md5 FROM new_nodes",
    "node_delta": f"WITH {BUILDS}, {DELTA} SELECT id, status FROM delta WHERE status IS NOT NULL",
    "remove_postings": f"WITH {BOTH}, {DELTA} SELECT node_id, term, round(tf, 6) AS tf FROM postings_old WHERE node_id NOT IN (SELECT id FROM delta WHERE status IN ('removed', 'updated'))",
    "update_index_threshold": f"""WITH {BOTH},
changed AS (SELECT path FROM status WHERE status <> 'unchanged'),
touched AS (SELECT DISTINCT term FROM postings_new JOIN new_nodes ON id = node_id WHERE file_path IN (SELECT path FROM changed)),
sizes AS (SELECT (SELECT count(*) FROM new_texts) AS n, (SELECT count(*) FROM old_texts) AS o)
SELECT coalesce(a.term, t.term) AS term, round(CASE WHEN t.term IS NOT NULL AND abs(n - o) > 0.05 * n THEN b.idf WHEN a.term IS NOT NULL THEN a.idf ELSE ln((n + 1) / 2) + 1 END, 6) AS idf
FROM idf_old a FULL JOIN touched t ON a.term = t.term LEFT JOIN idf_new b ON b.term = t.term, sizes""",
    "update_index_exact": f"WITH {BOTH} SELECT node_id, term, round(tf, 6) AS tf, round(idf, 6) AS idf FROM postings_new JOIN idf_new USING (term)",
    "refresh": SNAPSHOT,
    "refresh_stored": SNAPSHOT,
    "load_snapshot": SNAPSHOT,
    "search_stored": f"""WITH {BUILDS}, {texts_cte("texts", "new_nodes")}, {index_cte("texts")}, {scores_cte("SELECT item_id AS query_id, text AS query FROM benchmark")},
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rank FROM scores)
SELECT query_id, rank, node_id, round(score, 6) AS score, name FROM best JOIN new_nodes ON id = node_id WHERE rank <= 10""",
}
