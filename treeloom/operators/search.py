"""Ranked keyword search over an index, for any number of queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from ..sources.scratch import written

TOP = 10
LAST_BLOCK = 15
SLACK = 1e-8  # of the largest score: more than rounding can move
DECIMALS = 9  # scores are rounded before ranking, so that the order of a sum cannot change a rank


def query_terms(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """(query_id, term, idf, n_tokens) of queries(query_id, query): distinct known terms; n_tokens counts repeats and unknown words too."""
    cut = queries.select("query_id", text.tokens(F.col("query")).alias("words"))
    words = cut.select("query_id", F.size("words").alias("n_tokens"), F.explode(F.array_distinct("words")).alias("term"))
    return words.join(idf, "term").select("query_id", "term", "idf", "n_tokens")


def scores(postings: DataFrame, idf: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, node_id, score): sum of tf * idf over matched terms, over tokens times the largest idf, at most 1.

    The largest idf is a single row that every query row takes along as a scalar subquery.
    """
    return summed(postings.join(asked_terms(idf, queries), "term"))


def asked_terms(idf: DataFrame, queries: DataFrame) -> DataFrame:
    """weighted_terms, written: their size is then known, and where they are few they are broadcast rather than all postings shuffled."""
    return written(weighted_terms(idf, queries), "terms")


def weighted_terms(idf: DataFrame, queries: DataFrame) -> DataFrame:
    """query_terms with ``whole``, the score that a node with everything at its largest would have."""
    top = idf.agg(F.max("idf").alias("m")).scalar()
    return query_terms(queries, idf).withColumn("whole", F.col("n_tokens") * top)


def summed(hits: DataFrame) -> DataFrame:
    sums = hits.groupBy("query_id", "node_id").agg(F.sum(F.col("tf") * F.col("idf")).alias("s"), F.first("whole").alias("whole"))
    return sums.select("query_id", "node_id", F.round(F.least(F.col("s") / F.col("whole"), F.lit(1.0)), DECIMALS).alias("score"))


def ranked(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best of every query; ties go to the smaller node id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def impact() -> Column:
    """The block of a posting: 0 for tf over a half, 1 for tf over a quarter, and so on; the last holds the rest."""
    return F.least(F.floor(-F.log2("tf")), F.lit(LAST_BLOCK)).cast("int")


def term_blocks(postings: DataFrame) -> DataFrame:
    """(term, block, n, low, top): how many postings a term has in each block, and their least and largest tf. Combined before the shuffle; a few rows for each term."""
    return postings.groupBy("term", impact().alias("block")).agg(F.count("*").alias("n"), F.min("tf").alias("low"), F.max("tf").alias("top"))


def seeds(blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, term, block): blocks of postings of which every node of a query's k best has one.

    k nodes hold a term with at least tf, so the k-th score is at least idf * tf of the block that completes k postings:
    the largest such product over the query's terms is the floor. Terms whose largest products together stay below
    the floor cannot carry a node alone, and a block whose product stays below it even with the largest of
    all other terms holds none of the best.
    """
    each = blocks.join(terms, "term")
    down = Window.partitionBy("query_id", "term").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("so_far", F.sum("n").over(down))
    of_term = Window.partitionBy("query_id", "term")
    each = each.withColumn("peak", F.max(F.col("idf") * F.col("top")).over(of_term)).withColumn("floor", F.max(F.when(F.col("so_far") >= k, F.col("idf") * F.col("low"))).over(of_term))
    slim = each.groupBy("query_id", "term").agg(F.first("peak").alias("peak"), F.first("floor").alias("floor"), F.first("whole").alias("whole"))
    of_query = Window.partitionBy("query_id")
    rising = of_query.orderBy("peak", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slim = slim.select("query_id", "term", F.sum("peak").over(rising).alias("carried"), F.sum("peak").over(of_query).alias("all"), (F.coalesce(F.max("floor").over(of_query), F.lit(0.0)) - F.col("whole") * SLACK).alias("least"))
    each = each.join(slim, ["query_id", "term"])
    useful = (F.col("carried") >= F.col("least")) & (F.col("idf") * F.col("top") + F.col("all") - F.col("peak") >= F.col("least"))
    return each.filter(useful).select("query_id", "term", "block")


def candidates(postings: DataFrame, blocks: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """(query_id, node_id): the nodes among which a query's k best are."""
    return postings.withColumn("block", impact()).join(written(seeds(blocks, terms, k), "seeds"), ["term", "block"]).select("query_id", "node_id").distinct()


def top_k(postings: DataFrame, idf: DataFrame, blocks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """The rows of ranked(scores(...)), scoring candidates alone. blocks: term_blocks of the postings, kept with them. Short queries of rare and common words gain most: common words are looked up for the candidates of the rare ones only."""
    terms = asked_terms(idf, queries)
    chosen = candidates(postings, blocks, terms, k)
    hits = postings.join(terms, "term").join(chosen, ["query_id", "node_id"], "left_semi")
    return ranked(summed(hits), k)


def search(nodes: DataFrame, postings: DataFrame, idf: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Ranked nodes; one that is missing from the node table is dropped after the cut."""
    best = ranked(scores(postings, idf, queries), k)
    return best.join(nodes.withColumnRenamed("id", "node_id"), "node_id")


def search_one(nodes: DataFrame, postings: DataFrame, idf: DataFrame, query: str, k: int = TOP) -> DataFrame:
    one = nodes.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    best = scores(postings, idf, one).orderBy(F.desc("score"), "node_id").limit(k)
    return best.join(nodes.withColumnRenamed("id", "node_id"), "node_id")
