"""Operator 5: packing documents into length buckets of least padding.

A global histogram of lengths feeds a dynamic programme that chooses the bucket
boundaries with the least total padding. Inside a bucket, batches are filled in
turn up to a budget of padded tokens.

Lengths are numbers of words (runs of characters that are not white space). The
histogram has one cell for each length that occurs, so the boundaries are the
optimum; n different lengths need n * (n + 1) / 2 words at least, which bounds the
cells by the square root of the corpus.

Defined results: a null or empty text has length 0 and joins the first bucket;
every row gets one place, repeated rows too; a row longer than the budget is a
batch of its own; an empty table gives no row. Other columns are carried along
by ``pack_documents`` only if asked for.

Rows of a bucket are numbered in slices of bounded expected size; the slices'
offsets come from a running sum over slices, so batches are filled across them
and no task ever sees a whole bucket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize, read_table

BUCKETS = 12
TOKEN_BUDGET = 65_536
SLICE_ROWS = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def choose_boundaries(cells: list[tuple[int, int, int, int]], buckets: int) -> list[int]:
    """Upper lengths of the best ``buckets`` buckets.

    ``cells``: (cell, rows, sum of lengths, largest length), ascending. The cost of
    a bucket is rows times its largest length, less the lengths themselves.
    """
    n = len(cells)
    if not n:
        return []
    rows = np.concatenate([[0], np.cumsum([c[1] for c in cells])]).astype(np.float64)
    tops = np.array([c[3] for c in cells], dtype=np.float64)
    buckets = min(buckets, n)
    # cost[j]: padded tokens of the first j cells; the sum of the lengths is the same for every choice.
    cost = np.full(n + 1, np.inf)
    cost[0] = 0
    cuts = []
    for _ in range(buckets):
        new, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        new[0] = 0
        # The best cut never moves back as j grows, so the cut of the middle one bounds those on both sides of it.
        open_ = [(1, n, 0, n - 1)]
        while open_:
            low, high, least, most = open_.pop()
            j = (low + high) // 2
            i = np.arange(least, min(most, j - 1) + 1)
            options = cost[i] + (rows[j] - rows[i]) * tops[j - 1]
            cut[j] = i[np.argmin(options)]
            new[j] = options[cut[j] - least]
            open_ += [x for x in ((low, j - 1, least, cut[j]), (j + 1, high, cut[j], most)) if x[0] <= x[1]]
        cost = new
        cuts.append(cut)
    found, j = [], n
    for cut in reversed(cuts):
        if j:
            found.append(int(tops[j - 1]))
            j = cut[j]
    return found[::-1]


def assign_batches(
    lengths: DataFrame,
    id_col: str = "doc_id",
    buckets: int = BUCKETS,
    token_budget: int = TOKEN_BUDGET,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """``lengths``: id and ``n_tokens``. Adds bucket, bucket_len, batch, slot and padding."""
    histogram = (
        lengths.groupBy(F.col("n_tokens").alias("cell"))
        .agg(F.count(F.lit(1)), F.sum("n_tokens"), F.max("n_tokens"))
        .orderBy("cell")
        .collect()
    )  # one row for each length that occurs
    bounds = choose_boundaries([tuple(r) for r in histogram], buckets)
    if not bounds:
        bounds = [0]
    rows_in = [sum(r[1] for r in histogram if lo < r[3] <= hi) for lo, hi in zip([-1, *bounds[:-1]], bounds)]
    bucket, size, slices = F.lit(len(bounds) - 1), F.lit(bounds[-1]), F.lit(1)
    for k in range(len(bounds) - 1, -1, -1):
        here = F.col("n_tokens") <= bounds[k]
        bucket, size = F.when(here, k).otherwise(bucket), F.when(here, bounds[k]).otherwise(size)
        slices = F.when(here, -(-max(rows_in[k], 1) // slice_rows)).otherwise(slices)
    placed = lengths.select(
        id_col,
        "n_tokens",
        bucket.cast("int").alias("bucket"),
        size.cast("long").alias("bucket_len"),
        F.pmod(F.xxhash64(id_col), slices).cast("int").alias("slice"),
    )
    sizes = placed.groupBy("bucket", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("bucket").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col("bucket").alias("b"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")
    )
    inside = W.partitionBy("bucket", "slice").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens")
    numbered = placed.withColumn("row", F.row_number().over(inside)).join(
        offsets, (F.col("bucket") == F.col("b")) & (F.col("slice") == F.col("s"))
    )
    capacity = F.greatest(F.floor(F.lit(token_budget) / F.greatest("bucket_len", F.lit(1))), F.lit(1))
    at = F.col("offset") + F.col("row") - 1
    return numbered.select(
        id_col,
        "n_tokens",
        "bucket",
        "bucket_len",
        F.floor(at / capacity).cast("long").alias("batch"),
        F.pmod(at, capacity).cast("long").alias("slot"),
        (F.col("bucket_len") - F.col("n_tokens")).alias("padding"),
    )


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Lengths of the texts, kept once as a narrow table, and their places."""
    lengths = df.select(F.col(id_col).cast("long").alias(id_col), word_count(F.col(text_col)).alias("n_tokens"))
    return assign_batches(materialize(lengths, "lengths"), id_col, **options)


def op5_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))
