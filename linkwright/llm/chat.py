"""Operator 4: preference formatting of conversations.

A pair holds a chosen and a rejected conversation. The longest common prefix of
turns (same role and text) is rendered once as the prompt; what follows on each
side is rendered as a completion with the spans (in characters of the
completion) on which a model is to be trained: the assistant's turns, end mark
included.

Defined results: null roles and texts count as empty; turns are ordered by turn
number (null first), then role, then text, and repeated rows are repeated turns;
rows without a pair or a side are ignored; a pair with one side only has the
other completion empty and everything of its side in the completion, with an
empty prompt; sides that are equal throughout have both completions empty. Other
columns are ignored; an empty table gives no row.

Turns are numbered inside their conversation and brought together by pair; a
text, first turn or role that many conversations share is never a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import read_table

START, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns``: pair_id, side ('chosen' or 'rejected'), turn, role, text."""
    rows = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected")).select(
        "pair_id", "side", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = W.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = rows.withColumn("k", F.row_number().over(order))
    # Both sides' k-th turns meet; the pair then knows the first k at which they differ.
    side = lambda name, value: F.max(F.when(F.col("side") == name, value))
    met = placed.groupBy("pair_id", "k").agg(
        side("chosen", F.struct("role", "text")).alias("chosen"), side("rejected", F.struct("role", "text")).alias("rejected")
    )
    whole = W.partitionBy("pair_id")
    differ = F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("k"))
    marked = met.withColumn("first", F.min(differ).over(whole)).withColumn("common", F.coalesce("first", F.max("k").over(whole) + 1) - 1)
    rendered = lambda c: F.concat(F.lit(START), F.col(f"{c}.role"), F.lit(MIDDLE), F.col(f"{c}.text"), F.lit(END))
    inside, after = F.col("k") <= F.col("common"), F.col("k") > F.col("common")
    upto = whole.orderBy("k").rowsBetween(W.unboundedPreceding, 0)

    def completion(c: str):
        text = F.when(after, rendered(c))
        end = F.sum(F.coalesce(F.length(text), F.lit(0))).over(upto)
        body = F.length(f"{c}.text") + len(END)
        span = F.when(after & (F.col(f"{c}.role") == TRAINED_ROLE), F.concat_ws("-", (end - body).cast("string"), end.cast("string")))
        return text.alias(c), span.alias(f"{c}_span"), F.when(span.isNotNull(), body).alias(f"{c}_trained")

    pieces = marked.select(
        "pair_id", "k", "common", F.when(inside, rendered("chosen")).alias("prompt"), *completion("chosen"), *completion("rejected")
    )
    joined = lambda c, mark: F.array_join(
        F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("k", F.col(c).alias("v"))))), lambda x: x["v"]), mark
    )
    return pieces.groupBy("pair_id").agg(
        F.max("common").cast("long").alias("common_turns"),
        joined("prompt", "").alias("prompt"),
        joined("chosen", "").alias("chosen"),
        joined("rejected", "").alias("rejected"),
        joined("chosen_span", ",").alias("chosen_mask"),
        joined("rejected_span", ",").alias("rejected_mask"),
        F.coalesce(F.sum("chosen_trained"), F.lit(0)).alias("chosen_trained"),
        F.coalesce(F.sum("rejected_trained"), F.lit(0)).alias("rejected_trained"),
    )


def op4_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k and 2k + 1 are the chosen and the rejected side of pair k."""
    turns = read_table(spark, sf_dir, "conversations")
    side = F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected")
    return format_preferences(
        turns.where(F.col("conv_id").isNotNull()).select(
            F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), side.alias("side"), "turn", "role", "text"
        )
    )


OP4_SQL = """
WITH t AS (
       SELECT conv_id // 2 AS pair_id, CASE WHEN conv_id % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
              coalesce(role, '') AS role, coalesce(text, '') AS text,
              row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
       FROM conversations WHERE conv_id IS NOT NULL),
     m AS (
       SELECT coalesce(c.pair_id, r.pair_id) AS pair_id, coalesce(c.k, r.k) AS k, c.role AS crole, c.text AS ctext, r.role AS rrole, r.text AS rtext,
              NOT (c.role IS NOT DISTINCT FROM r.role AND c.text IS NOT DISTINCT FROM r.text) AS differs
       FROM (SELECT * FROM t WHERE side = 'chosen') c
       FULL JOIN (SELECT * FROM t WHERE side = 'rejected') r ON c.pair_id = r.pair_id AND c.k = r.k),
     n AS (
       SELECT *, coalesce(min(CASE WHEN differs THEN k END) OVER (PARTITION BY pair_id), max(k) OVER (PARTITION BY pair_id) + 1) - 1 AS common,
              '<|' || crole || '|>' || chr(10) || ctext || '<|end|>' || chr(10) AS cr,
              '<|' || rrole || '|>' || chr(10) || rtext || '<|end|>' || chr(10) AS rr
       FROM m),
     e AS (
       SELECT *, sum(CASE WHEN k > common THEN coalesce(length(cr), 0) ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k) AS ce,
              sum(CASE WHEN k > common THEN coalesce(length(rr), 0) ELSE 0 END) OVER (PARTITION BY pair_id ORDER BY k) AS re
       FROM n)
SELECT pair_id, CAST(max(common) AS BIGINT) AS common_turns,
       coalesce(string_agg(CASE WHEN k <= common THEN cr END, '' ORDER BY k), '') AS prompt,
       coalesce(string_agg(CASE WHEN k > common THEN cr END, '' ORDER BY k), '') AS chosen,
       coalesce(string_agg(CASE WHEN k > common THEN rr END, '' ORDER BY k), '') AS rejected,
       coalesce(string_agg(CASE WHEN k > common AND crole = 'assistant' THEN CAST(ce - length(ctext) - 8 AS BIGINT) || '-' || CAST(ce AS BIGINT) END, ',' ORDER BY k), '') AS chosen_mask,
       coalesce(string_agg(CASE WHEN k > common AND rrole = 'assistant' THEN CAST(re - length(rtext) - 8 AS BIGINT) || '-' || CAST(re AS BIGINT) END, ',' ORDER BY k), '') AS rejected_mask,
       CAST(coalesce(sum(CASE WHEN k > common AND crole = 'assistant' THEN length(ctext) + 8 END), 0) AS BIGINT) AS chosen_trained,
       CAST(coalesce(sum(CASE WHEN k > common AND rrole = 'assistant' THEN length(rtext) + 8 END), 0) AS BIGINT) AS rejected_trained
FROM e GROUP BY pair_id
"""
