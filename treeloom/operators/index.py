"""The TF-IDF index: postings(node_id, term, tf) and idf(term, idf)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..schemas import SEARCHABLE_TYPES
from ..sources.scratch import written

THRESHOLD = 0.05
MOST_IDS = 1 << 20  # ids that are broadcast


def searchable(nodes: DataFrame, types: list[str] | None = None) -> DataFrame:
    return nodes.filter(F.col("type").isin(types or SEARCHABLE_TYPES))


def searchable_texts(nodes: DataFrame) -> DataFrame:
    """(node_id, text) of the searchable nodes."""
    return searchable(nodes).select(F.col("id").alias("node_id"), text.searchable_text(F.col("name"), F.col("signature"), F.col("docstring")).alias("text"))


def runs(texts: DataFrame) -> DataFrame:
    """(node_id, runs, most): the terms of each text with their counts, and the largest. Sorted words are cut where they change, in the row that holds the text, so nothing is shuffled."""
    # explode of one array keeps Spark from putting an expression in the place of each mention of its column
    once = lambda c: F.explode(F.array(c))
    words = texts.select("node_id", once(F.sort_array(text.tokens(F.col("text")))).alias("w")).filter(F.size("w") > 0)
    starts = F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2)))
    cut = words.select("node_id", "w", once(starts).alias("at")).select("node_id", "w", "at", once(F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("w") + 1))).alias("ends"))
    run = F.transform("at", lambda s, k: F.struct(F.get("w", s - 1).alias("term"), (F.get("ends", k) - s).cast("long").alias("n")))
    return cut.select("node_id", once(run).alias("runs")).withColumn("most", F.array_max(F.transform("runs", lambda r: r["n"])))


def merged_counts(texts: DataFrame) -> DataFrame:
    """(node_id, term, n) where an id may have several texts."""
    return texts.select("node_id", F.explode(text.tokens(F.col("text"))).alias("term")).groupBy("node_id", "term").agg(F.count("*").alias("n"))


def several(texts: DataFrame) -> DataFrame | None:
    """(node_id) of ids with more than one text, null among them; none in a node table."""
    again = written(texts.groupBy("node_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("node_id").alias("__id")), "again")
    return None if again.isEmpty() else again


def split_repeated(texts: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(texts of ids that have one, texts of the others)."""
    again = several(texts)
    if again is None:
        return texts, None
    same = texts["node_id"].eqNullSafe(again["__id"])
    return texts.join(again, same, "left_anti"), texts.join(again, same, "left_semi")


def term_counts(texts: DataFrame) -> DataFrame:
    """(node_id, term, n). The texts of an id that repeats are counted together."""
    once, rest = split_repeated(texts)
    out = runs(once).select("node_id", F.explode("runs").alias("r")).select("node_id", "r.term", "r.n")
    return out if rest is None else out.unionByName(merged_counts(rest))


def postings_of(texts: DataFrame) -> DataFrame:
    """(node_id, term, tf) of texts(node_id, text): count over the largest count of the node."""
    once, rest = split_repeated(texts)
    out = runs(once).select("node_id", "most", F.explode("runs").alias("r")).select("node_id", "r.term", (F.col("r.n") / F.col("most")).alias("tf"))
    if rest is None:
        return out
    most = F.max("n").over(Window.partitionBy("node_id"))
    return out.unionByName(merged_counts(rest).select("node_id", "term", (F.col("n") / most).alias("tf")))


def document_frequencies(postings: DataFrame) -> DataFrame:
    """(term, df); (node_id, term) is unique, so a plain count with map-side combining does."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def idf_of(frequencies: DataFrame, documents: int) -> DataFrame:
    return frequencies.select("term", (F.log((F.lit(documents) + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def build_index(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, idf) of a node table. Postings are written, so that texts are tokenised once however often the index is read."""
    postings = written(postings_of(searchable_texts(nodes)), "postings")
    return postings, idf_of(document_frequencies(postings), searchable(nodes).count())


@dataclass
class Index:
    """Postings, idf, and what idf comes from: (term, df) and the number of searchable nodes. ``fresh``: the postings that an update added."""

    postings: DataFrame
    idf: DataFrame
    frequencies: DataFrame
    documents: int
    fresh: DataFrame | None = None


def build(nodes: DataFrame) -> Index:
    """The index of a node table, with frequencies written, as they are the size of the vocabulary and read by every update."""
    postings = written(postings_of(searchable_texts(nodes)), "postings")
    frequencies = written(document_frequencies(postings), "frequencies")
    documents = searchable(nodes).count()
    return Index(postings, idf_of(frequencies, documents), frequencies, documents)


def small(ids: DataFrame) -> DataFrame:
    """A written table of ids, to be broadcast if it has at most MOST_IDS, so that postings are not shuffled to meet it."""
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def remove_nodes(postings: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without those of ids(id); idf stays as it is."""
    return postings.join(small(written(ids.select(F.col("id").alias("node_id")), "ids")), "node_id", "left_anti")


def frequencies_after(frequencies: DataFrame, gone: DataFrame, fresh: DataFrame) -> DataFrame:
    """(term, df) after postings went and came: signed counts are combined before they meet the vocabulary, and terms that no node holds any more leave it."""
    minus = gone.groupBy("term").agg((-F.count("*")).alias("df"))
    every = frequencies.select("term", "df").unionByName(minus).unionByName(document_frequencies(fresh))
    return every.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")


def updated(index: Index, before: DataFrame, after: DataFrame, net: int, policy: str = "exact", threshold: float = THRESHOLD) -> Index:
    """The index after the nodes before(id) gave way to ``after``; both hold changed nodes alone, and ``net`` is by how many searchable nodes the table grew.

    Frequencies change by signed counts of the postings that go and come, so nothing is counted anew over
    kept postings, and the new postings are a lazy union with the kept ones. ``index.postings`` may hold less than
    the whole index as long as it holds all postings of ``before``. policy "exact" takes idf from the new
    frequencies. "threshold" keeps it, gives new terms ln((N + 1) / 2) + 1, and renews the terms of ``after`` only
    if the number of documents changed by more than the threshold.
    """
    if policy not in ("exact", "threshold"):
        raise ValueError("policy is exact or threshold")
    ids = small(written(before.select(F.col("id").alias("node_id")).distinct(), "ids"))
    fresh = written(postings_of(searchable_texts(after)), "fresh")
    gone = index.postings.join(ids, "node_id", "left_semi")
    frequencies = written(frequencies_after(index.frequencies, gone, fresh), "frequencies")
    documents = index.documents + net
    merged = index.postings.join(ids, "node_id", "left_anti").unionByName(fresh)
    anew = idf_of(frequencies, documents)
    if policy == "exact":
        return Index(merged, anew, frequencies, documents, fresh)
    touched = fresh.select("term").distinct()
    if abs(net) > threshold * documents:
        anew = anew.join(touched, "term", "left_semi")
        return Index(merged, index.idf.join(anew, "term", "left_anti").unionByName(anew), frequencies, documents, fresh)
    default = F.log((F.lit(documents) + 1) / F.lit(2.0)) + 1
    return Index(merged, index.idf.unionByName(touched.join(index.idf, "term", "left_anti").select("term", default.alias("idf"))), frequencies, documents, fresh)


def update_index(postings: DataFrame, idf: DataFrame, nodes: DataFrame, changed: DataFrame, net_change: int, policy: str = "exact", threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The index after the nodes changed(id) were added, replaced or removed, for callers that kept no frequencies: these are counted over the old postings. nodes is the new table."""
    ids = changed.select("id").distinct()
    whole = Index(postings, idf, document_frequencies(postings), searchable(nodes).count() - net_change)
    out = updated(whole, ids, nodes.join(ids, "id", "left_semi"), net_change, policy, threshold)
    return out.postings, out.idf
