"""The registered queries over the given tables; lists become comma-separated text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import entities as ent
from ..operators import files as fil
from ..operators import index as idx
from ..operators import refresh as ref
from ..operators import relations as rel
from ..operators import render
from ..operators import search as sea
from ..operators import tree
from ..sources import snapshots
from ..sources.scratch import scratch, written
from ..sources.trees import read_tree
from . import adapters as ad

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def listed(column: str):
    return F.array_join(column, ",").alias(column)


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(tree.assemble(ad.order_tree(spark, sf_dir)), "order-tree")


def tree_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.links(ad.order_tree(spark, sf_dir))


def tree_near(spark: SparkSession, sf_dir: str, links: DataFrame, parent: str) -> DataFrame:
    return tree.assemble_some(written(tree.near(links, parent), "near"), ad.order_tree(spark, sf_dir))


@query
def route_files(spark, sf_dir):
    return ad.files(spark, sf_dir).select("path", paths.language(F.col("path")).alias("language")).filter("language is not null")


@query
def exclude_paths(spark, sf_dir):
    return ad.files(spark, sf_dir).select("path").filter(~paths.is_excluded(F.col("path")))


@query
def file_nodes(spark, sf_dir):
    out = fil.file_nodes(fil.supported(ad.files(spark, sf_dir)))
    return out.select("id", "parent_id", "name", "type", "line_start", "line_end", "language")


@query
def content_hash(spark, sf_dir):
    return fil.hashed(ad.files(spark, sf_dir))


@query
def decode_files(spark, sf_dir):
    content = F.col("content")
    strict = text.strict_text(content)
    return ad.encoded_documents(spark, sf_dir).select("doc_id", strict.alias("strict"), text.lenient_text(content).alias("lenient"), text.line_count(strict).alias("n_lines"))


@query
def load_tree(spark, sf_dir):
    return fil.hashed(read_tree(spark, ad.write_tree(ad.files(spark, sf_dir), scratch(spark, "tree"))))


@query
def list_tree(spark, sf_dir):
    folder = ad.write_tree(ad.files(spark, sf_dir), scratch(spark, "tree"))
    return read_tree(spark, folder, ["python", "go"], "path string, error string", everything=True)


@query
def read_lines(spark, sf_dir):
    docs = ad.table(spark, sf_dir, "documents")
    files = ad.document_files(docs)
    requests = ad.document_files(docs).select("path", (F.octet_length("content") % 5).cast("int").alias("start"), (F.octet_length("content") % 7).cast("int").alias("end"))
    return fil.read_lines(files, requests, written(fil.line_index(files), "lines"))


@query
def entity_snippets(spark, sf_dir):
    files = ad.python_files(spark, sf_dir)
    return fil.snippets(ent.entity_nodes(ent.extract(files)), files, written(fil.line_index(files), "lines"))


@query
def extract_entities(spark, sf_dir):
    out = ent.extract(ad.python_files(spark, sf_dir))
    return out.select("path", "position", "qualname", "name", "type", "line_start", "line_end", "signature", "docstring", listed("calls"), listed("base_classes"))


@query
def entity_ids(spark, sf_dir):
    return ent.entity_nodes(ent.extract(ad.python_files(spark, sf_dir))).select("id", "parent_id")


@query
def dir_closure(spark, sf_dir):
    return fil.directory_nodes(fil.supported(ad.files(spark, sf_dir))).select("id", "parent_id", "name", "type")


@query
def assemble_nodes(spark, sf_dir):
    return tree.assemble(ad.order_tree(spark, sf_dir)).select("id", "parent_id", "name", "type", "file_path", "line_start", "signature")


@query
def node_lookup(spark, sf_dir):
    nodes = tree.assemble(ad.order_tree(spark, sf_dir))
    wanted = nodes.filter("type = 'file'").select("id")
    return tree.lookup(nodes, wanted).select("id", "parent_id", "name", listed("children_ids"))


@query
def children(spark, sf_dir):
    return tree.children(tree_nodes(spark, sf_dir))


@query
def orphans(spark, sf_dir):
    return tree.orphans(tree.assemble(ad.order_tree(spark, sf_dir))).select("id", "parent_id")


@query
def node_stats(spark, sf_dir):
    return tree.node_stats(tree_links(spark, sf_dir))


@query
def stats_all(spark, sf_dir):
    return tree.stats(tree_links(spark, sf_dir))


@query
def project_map(spark, sf_dir):
    return tree.project_map(tree_links(spark, sf_dir))


@query
def expand_node(spark, sf_dir):
    links = tree_links(spark, sf_dir)
    return tree.expand(tree_near(spark, sf_dir, links, "ASIA"), "ASIA", links).select("parent_id", "id", "name", "type", listed("children_ids"), *tree.COUNTS)


@query
def edges(spark, sf_dir):
    return rel.edges(written(ad.caller_nodes(spark, sf_dir), "callers"))


@query
def callers(spark, sf_dir):
    return rel.callers_by_name(ad.caller_nodes(spark, sf_dir))


@query
def inspect_all(spark, sf_dir):
    return rel.inspect_all(ad.caller_nodes(spark, sf_dir)).select("id", "name", listed("calls"), "n_callers")


@query
def inspect_digests(spark, sf_dir):
    return rel.inspect_digests(ad.caller_nodes(spark, sf_dir)).select("id", "name", "n_callers", "digest")


@query
def inspect_json(spark, sf_dir):
    nodes = written(ad.caller_nodes(spark, sf_dir), "callers")
    first = nodes.groupBy("name").agg(F.min("id").alias("id"))  # one document for every name
    return render.inspect_json(nodes, first)


@query
def map_json(spark, sf_dir):
    return render.map_json(tree_links(spark, sf_dir), "orders", "/data")


@query
def expand_json(spark, sf_dir):
    links = tree_links(spark, sf_dir)
    return render.expand_json(tree_near(spark, sf_dir, links, "ASIA"), "ASIA", links)


@query
def hierarchy_json(spark, sf_dir):
    return render.hierarchy_json(written(ad.caller_nodes(spark, sf_dir), "callers"), "Brand#7")


@query
def subclasses(spark, sf_dir):
    return rel.subclasses(ad.caller_nodes(spark, sf_dir), "Brand#7").select("id", "name")


@query
def hierarchy_all(spark, sf_dir):
    return rel.hierarchy(ad.caller_nodes(spark, sf_dir))


@query
def searchable_text(spark, sf_dir):
    return idx.searchable_texts(ad.document_nodes(spark, sf_dir))


@query
def split_identifier(spark, sf_dir):
    part = ad.table(spark, sf_dir, "part")
    name = F.concat(F.regexp_replace(F.initcap("p_name"), " ", ""), F.lit("_"), F.regexp_replace("p_type", " ", ""), F.lit("_v"), "p_size")
    return part.select("p_partkey", name.alias("name")).select("p_partkey", "name", F.array_join(text.split_identifier(F.col("name")), " ").alias("parts"))


@query
def tokenize(spark, sf_dir):
    return ad.table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.tokens(F.col("text")), " ").alias("tokens"))


@query
def term_counts(spark, sf_dir):
    return idx.term_counts(idx.searchable_texts(ad.document_nodes(spark, sf_dir)))


def rounded(column: str, digits: int = 6):
    return F.round(column, digits).alias(column)


def document_index(spark, sf_dir):
    return idx.build_index(ad.document_nodes(spark, sf_dir))


@query
def tf(spark, sf_dir):
    return document_index(spark, sf_dir)[0].select("node_id", "term", rounded("tf"))


@query
def idf(spark, sf_dir):
    return document_index(spark, sf_dir)[1].select("term", rounded("idf"))


@query
def build_index(spark, sf_dir):
    postings, idf_table = document_index(spark, sf_dir)
    return postings.join(idf_table, "term").select("node_id", "term", rounded("tf"), rounded("idf"))


@query
def query_terms(spark, sf_dir):
    return sea.query_terms(ad.benchmark_queries(spark, sf_dir), document_index(spark, sf_dir)[1]).select("query_id", "term", rounded("idf"), F.col("n_tokens").cast("long").alias("n_tokens"))


@query
def search_scores(spark, sf_dir):
    postings, idf_table = document_index(spark, sf_dir)
    return sea.scores(postings, idf_table, ad.benchmark_queries(spark, sf_dir)).select("query_id", "node_id", rounded("score"))


@query
def search_top10(spark, sf_dir):
    postings, idf_table = document_index(spark, sf_dir)
    return sea.search_one(ad.document_nodes(spark, sf_dir), postings, idf_table, SEARCHED).select("node_id", rounded("score"), "name")


#: What search_top10 looks for.
SEARCHED = "licensed under the Apache License version tionerth"


@query
def search_batch(spark, sf_dir):
    nodes = ad.document_nodes(spark, sf_dir)
    postings, idf_table = idx.build_index(nodes)
    return sea.search(nodes, postings, idf_table, ad.benchmark_queries(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", rounded("score"), "name")


@query
def search_pruned(spark, sf_dir):
    nodes = ad.document_nodes(spark, sf_dir)
    postings, idf_table = idx.build_index(nodes)
    best = sea.top_k(postings, idf_table, written(sea.term_blocks(postings), "blocks"), ad.benchmark_queries(spark, sf_dir))
    return best.join(nodes.select(F.col("id").alias("node_id"), "name"), "node_id").select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", rounded("score"), "name")


@query
def search_json(spark, sf_dir):
    nodes, queries = ad.document_nodes(spark, sf_dir), ad.benchmark_queries(spark, sf_dir)
    postings, idf_table = idx.build_index(nodes)
    found = sea.ranked(sea.scores(postings, idf_table, queries))
    return render.search_json(nodes, queries, found)


def stored_hashes(spark, sf_dir):
    return fil.hashed(fil.supported(ad.old_files(spark, sf_dir)))


def current_hashes(spark, sf_dir):
    return fil.hashed(fil.supported(ad.new_files(spark, sf_dir)))


@query
def classify_files(spark, sf_dir):
    return ref.classify(current_hashes(spark, sf_dir), stored_hashes(spark, sf_dir))


@query
def directory_digests(spark, sf_dir):
    return ref.directory_digests(current_hashes(spark, sf_dir))


@query
def changed_directories(spark, sf_dir):
    return ref.changed_directories(ref.directory_digests(current_hashes(spark, sf_dir)), ref.directory_digests(stored_hashes(spark, sf_dir)))


@query
def status_counts(spark, sf_dir):
    return ref.status_counts(classify_files(spark, sf_dir))


@query
def removed_files(spark, sf_dir):
    return ref.removed_files(current_hashes(spark, sf_dir), stored_hashes(spark, sf_dir))


def old_snapshot(spark, sf_dir):
    return ref.full_build(ad.old_files(spark, sf_dir), ad.prose_entities)


def old_nodes(spark, sf_dir):
    return ref.node_table(fil.supported(ad.old_files(spark, sf_dir)), ad.prose_entities)


@query
def delete_file_nodes(spark, sf_dir):
    return ref.delete_file_nodes(old_nodes(spark, sf_dir), removed_files(spark, sf_dir)).select("id", "type")


@query
def upsert_hashes(spark, sf_dir):
    return ref.upsert_hashes(stored_hashes(spark, sf_dir), current_hashes(spark, sf_dir))


def changed_files(spark, sf_dir):
    status = classify_files(spark, sf_dir).filter("status in ('added', 'updated')").select("path")
    return fil.supported(ad.new_files(spark, sf_dir)).join(status, "path", "left_semi")


def replaced(spark, sf_dir, nodes):
    old = ref.delete_file_nodes(nodes, removed_files(spark, sf_dir))
    return ref.replace_files(old, changed_files(spark, sf_dir), current_hashes(spark, sf_dir), ad.prose_entities)


@query
def replace_files(spark, sf_dir):
    return replaced(spark, sf_dir, old_nodes(spark, sf_dir)).select("id", "parent_id", "type", F.md5("docstring").alias("docstring_md5"))


@query
def node_delta(spark, sf_dir):
    nodes = old_nodes(spark, sf_dir)
    return ref.node_delta(nodes, replaced(spark, sf_dir, nodes))


@query
def remove_postings(spark, sf_dir):
    old = old_snapshot(spark, sf_dir)
    gone = ref.node_delta(old.nodes, replaced(spark, sf_dir, old.nodes)).filter("status <> 'added'")
    return idx.remove_nodes(old.postings, gone.select("id")).select("node_id", "term", rounded("tf"))


def updated_index(spark, sf_dir, policy):
    return ref.refresh(old_snapshot(spark, sf_dir), ad.new_files(spark, sf_dir), ad.prose_entities, policy).index


@query
def update_index_threshold(spark, sf_dir):
    return updated_index(spark, sf_dir, "threshold").idf.select("term", rounded("idf"))


@query
def update_index_exact(spark, sf_dir):
    index = updated_index(spark, sf_dir, "exact")
    return index.postings.join(index.idf, "term").select("node_id", "term", rounded("tf"), rounded("idf"))


def snapshot_rows(new):
    nodes = new.nodes.select(F.lit("node").alias("kind"), "id", F.coalesce("parent_id", F.lit("")).alias("detail"), F.lit(0.0).alias("value"))
    postings = new.postings.select(F.lit("posting").alias("kind"), F.col("node_id").alias("id"), F.col("term").alias("detail"), F.round("tf", 6).alias("value"))
    idf_rows = new.idf.select(F.lit("idf").alias("kind"), F.col("term").alias("id"), F.lit("").alias("detail"), F.round("idf", 6).alias("value"))
    hashes = new.file_hashes.select(F.lit("hash").alias("kind"), F.col("path").alias("id"), F.col("hash").alias("detail"), F.lit(0.0).alias("value"))
    return nodes.unionByName(postings).unionByName(idf_rows).unionByName(hashes)


@query
def refresh(spark, sf_dir):
    return snapshot_rows(ref.refresh(old_snapshot(spark, sf_dir), ad.new_files(spark, sf_dir), ad.prose_entities))


@query
def refresh_stored(spark, sf_dir):
    path = scratch(spark, "snapshots")
    snapshots.save(old_snapshot(spark, sf_dir), path)
    snapshots.refresh(spark, path, ad.new_files(spark, sf_dir), ad.prose_entities)
    return snapshot_rows(snapshots.load(spark, path))


@query
def search_stored(spark, sf_dir):
    path = scratch(spark, "snapshots")
    snapshots.save(old_snapshot(spark, sf_dir), path)
    snapshots.refresh(spark, path, ad.new_files(spark, sf_dir), ad.prose_entities)
    found = snapshots.search(spark, path, ad.benchmark_queries(spark, sf_dir))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "node_id", rounded("score"), "name")


@query
def load_snapshot(spark, sf_dir):
    path = scratch(spark, "snapshots")
    snapshots.save(old_snapshot(spark, sf_dir), path)
    snapshots.save(ref.full_build(ad.new_files(spark, sf_dir), ad.prose_entities), path)
    snapshots.prune(spark, path, keep=1)
    return snapshot_rows(snapshots.load(spark, path))
