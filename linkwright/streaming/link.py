"""Linking records as they arrive: a stream of queries against a static index.

An extension of our own. The index's postings and weights are static tables; each
micro-batch is projected onto the vocabulary, joined on (block, term) and ranked,
so a batch costs what its own postings meet.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.similarity_join import DIGITS, F, idf_weights, term_counts, top_k, weighted, word_terms


class StreamLinker:
    """``index``: block, s1, text. The postings are kept for the life of the stream."""

    def __init__(self, index: DataFrame, terms=word_terms, k: int = 3, least: float = 0.05):
        own = term_counts(index, "s1", terms(F.col("text")))
        self.idf = idf_weights(own, index).persist()
        self.postings = weighted(own, self.idf, "s1").persist()
        self.terms, self.k, self.least = terms, k, least

    def link(self, batch: DataFrame) -> DataFrame:
        """``batch``: block, query, text; returns block, query, s1, sim, rank."""
        right = weighted(term_counts(batch, "query", self.terms(F.col("text"))), self.idf, "query").withColumnRenamed("w", "wq")
        sums = self.postings.join(right, ["block", "term"]).groupBy("block", "query", "s1").agg(F.round(F.sum(F.col("w") * F.col("wq")), DIGITS).alias("sim"))
        return top_k(sums.where(F.col("sim") > self.least), self.k)

    def start(self, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
        """Link every micro-batch and hand it to ``sink`` with its number; a repeated batch has the same number."""
        handle = lambda batch, number: sink(self.link(batch), number)
        return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).start()
