"""Top-k similarity join: cosine over sparse TF-IDF vectors, inside blocks.

The vocabulary, document frequencies and weights come from the index side of each
block; queries are projected onto it. Terms in more than ``max_df`` of a block's
index rows are dropped, which also keeps hot terms from fanning out; a block so
small that this would drop everything keeps all terms.

Plan: postings of both sides meet on (block, term) and are summed per pair, so the
shuffle carries postings, never vectors or pairs of documents. Similarities are
rounded before they are ranked, so equal ones tie in the same way everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import MAX_DF, MIN_SIMILARITY

DIGITS = 6


def word_terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}#]+"), lambda t: t != "")


def char_terms(text: Column, n: int = 3) -> Column:
    """n-grams inside words, each word between two spaces; a word too short is one term."""

    def grams(word: Column) -> Column:
        s = F.concat(F.lit(" "), word, F.lit(" "))
        many = F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) > n, many).otherwise(F.array(s))

    return F.flatten(F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""), grams))


def term_counts(rows: DataFrame, key: str, terms: Column) -> DataFrame:
    """(block, key, term, tf)."""
    return rows.select("block", key, F.explode(terms).alias("term")).groupBy("block", key, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf_weights(index_terms: DataFrame, index_rows: DataFrame, max_df: float | None = MAX_DF) -> DataFrame:
    """(block, term, idf) of the terms that stay."""
    rows = index_rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    df = index_terms.groupBy("block", "term").agg(F.count(F.lit(1)).alias("df")).join(rows, "block")
    if max_df is not None:
        least = F.min("df").over(W.partitionBy("block"))
        keeps_all = (F.col("n") * max_df < 1) | (least > F.col("n") * max_df)
        df = df.withColumn("keeps_all", keeps_all).where(F.col("keeps_all") | (F.col("df") <= F.col("n") * max_df))
    return df.select("block", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weighted(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(block, key, term, w): sublinear term frequency times idf, at unit length."""
    raw = terms.join(idf, ["block", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("block", key)))
    return raw.select("block", key, "term", (F.col("w") / norm).alias("w"))


def similar_pairs(index: DataFrame, queries: DataFrame, terms, max_df: float | None = MAX_DF, least: float = MIN_SIMILARITY) -> DataFrame:
    """(block, query, s1, sim) above ``least``. ``index``: block, s1, text; ``queries``: block, query, text; ``terms``: text -> array."""
    own = term_counts(index, "s1", terms(F.col("text")))
    idf = idf_weights(own, index, max_df)
    left = weighted(own, idf, "s1")
    right = weighted(term_counts(queries, "query", terms(F.col("text"))), idf, "query").withColumnRenamed("w", "wq")
    sums = left.join(right, ["block", "term"]).groupBy("block", "query", "s1").agg(F.sum(F.col("w") * F.col("wq")).alias("sim"))
    return sums.withColumn("sim", F.round("sim", DIGITS)).where(F.col("sim") > least)


def top_k(pairs: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The ``k`` most similar index rows of each query, with their rank; ties to the smaller id."""
    order = W.partitionBy(*(by or ["block", "query"])).orderBy(F.desc("sim"), "s1")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
