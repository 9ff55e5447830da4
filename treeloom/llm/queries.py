"""The subpackage's registered queries, each a thin use of an operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import byte_bpe, centroid_clustering, conversation_trie, decontamination, embedding_dedup, html_extraction, language, pii, suffix_tree_lm, warc
from .common import table
from .sharding import shard_by_bytes
from .simhash import near_duplicates
from .substring_dedup import remove_repeats

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_sharding(spark, sf_dir):
    return shard_by_bytes(table(spark, sf_dir, "documents"), 8)


def op3_substring_dedup(spark, sf_dir):
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_simhash(spark, sf_dir):
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id")


def bpe_digests(docs, *keep):
    """n_tokens and the digests of ids and decoded bytes."""
    import public_tokenizers

    ranks = byte_bpe.ranks_of(public_tokenizers.path(VOCABULARY))
    out = byte_bpe.encode_and_decode(docs, ranks, public_tokenizers.PATTERN)
    return out.select(*keep, (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_byte_bpe(spark, sf_dir):
    return bpe_digests(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def op6_decontamination(spark, sf_dir):
    return decontamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_html_extraction(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = html_extraction.extract(pages, html_extraction.fit(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_suffix_tree_lm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_tree_lm.score(docs, language.fold("doc_id", 7) == 2)


def op9_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold("doc_id", 3) == 1
    model = language.fit(docs.filter(~held_out & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    return language.identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_warc(spark, sf_dir):
    out = warc.archived(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload) AS n, sha256(payload) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

def op11_conversation_trie(spark, sf_dir):
    return conversation_trie.prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of the decimal digits of c: every byte is followed by eight shifts.
CRC32 = "xor(list_reduce([4294967295] || flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"

#: Every node is its prefix, a list of turns; a subtree is found by cutting the prefixes below it.
OP11_SQL = f"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(text, '') AS x, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[:32] AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, k || ':' || length(x) AS k, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS pos FROM t),
e AS (SELECT c, c - c % 100 AS lender, {CRC32} % 6 AS h FROM (SELECT DISTINCT c FROM o)),
r AS (SELECT e.c, pos, k FROM e JOIN o ON o.c = e.lender WHERE pos <= h UNION ALL SELECT e.c, pos, k FROM e JOIN o ON o.c = e.c WHERE pos > h),
s AS (SELECT c, coalesce(l, []) AS l FROM e LEFT JOIN (SELECT c, list(k ORDER BY pos) AS l FROM r GROUP BY c) USING (c)),
p AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM s),
n AS (SELECT l[:d] AS p, d, min(c) AS conv_id, count(*) AS n_convs, coalesce(sha256(string_agg(c, ',' ORDER BY c) FILTER (len(l) = d)), sha256('')) AS ends FROM p GROUP BY ALL),
w AS (SELECT *, CASE WHEN d > 0 THEN (n_convs - 1) * CAST(string_split(p[d], ':')[2] AS BIGINT) ELSE 0 END AS saved FROM n),
kids AS (SELECT p[:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS (SELECT w.*, coalesce(n_children, 0) AS n_children FROM w LEFT JOIN kids USING (p)),
up AS (SELECT p[:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends AS ends_sha256
FROM f JOIN up USING (p) LEFT JOIN f u ON f.d > 0 AND u.p = f.p[:f.d - 1]"""


def op12_pii(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",")
    out = pii.find(table(spark, sf_dir, "documents"))
    return out.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op13_centroid_clustering(spark, sf_dir):
    return centroid_clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_sql(k: int = centroid_clustering.K, rounds: int = centroid_clustering.ROUNDS, dims: int = centroid_clustering.DIMS, seed: int = centroid_clustering.SEED) -> str:
    """Each round is two tables: a<i> (assignments, from the cross of vectors and centroids by component) and c<i> (centroids)."""
    floor_mean = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "x AS MATERIALIZED (SELECT r, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM v)",
        f"s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, unnest(q) AS x, generate_subscripts(q, 1) AS d FROM s)",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, first(c ORDER BY z, c) AS c, min(z) AS z FROM (SELECT r, c, sum((x.x - m.x) * (x.x - m.x)) AS z FROM x JOIN c{i} m USING (d) GROUP BY r, c) GROUP BY r)")
        if i < rounds:
            parts.append(f"m{i} AS MATERIALIZED (SELECT c, d, sum(x) AS s, count(*) AS n FROM a{i} JOIN x USING (r) GROUP BY c, d)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.c, o.d, coalesce({floor_mean}, o.x) AS x FROM c{i} o LEFT JOIN m{i} m ON o.c = m.c AND o.d = m.d)")
    return f"""WITH {", ".join(parts)},
h AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INT) AS cluster, CAST(z AS BIGINT) AS distance, CAST(sum(z) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(z) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN h USING (c)"""


QUERIES = {"op1_sharding": op1_sharding, "op2_embedding_dedup": op2_embedding_dedup, "op4_simhash": op4_simhash, "op5_byte_bpe": op5_byte_bpe, "op6_decontamination": op6_decontamination, "op7_html_extraction": op7_html_extraction, "op8_suffix_tree_lm": op8_suffix_tree_lm, "op9_language": op9_language, "op10_warc": op10_warc, "op3_substring_dedup": op3_substring_dedup, "op11_conversation_trie": op11_conversation_trie, "op12_pii": op12_pii, "op13_centroid_clustering": op13_centroid_clustering}
ORACLE_SQL = {"op10_warc": OP10_SQL, "op11_conversation_trie": OP11_SQL, "op13_centroid_clustering": op13_sql()}
