"""Operator 2: line dedup over overlapping windows of three lines, DataFrame functions only.

A text is split at line feeds; every three consecutive lines form a window, known
by a 128-bit hash. The first occurrence of a window (order: document id, null
first, then a hash of id and text, then position) stays; the lines that later
occurrences cover are removed, after merging positions that touch or overlap.

Defined results: a null text stays null and counts no line; an empty text has one
empty line; texts of fewer than three lines and windows of blank lines alone are
left as they are; occurrences in one text count like others. Rows that repeat
both id and text count as one document and share their result. If all lines go,
the text is empty and the row stays. Other columns are carried along, whatever
their names.

Scale: a window that a third of all documents hold is counted after a partial
aggregation, and the join back to its occurrences is one that adaptive execution
can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh_names, read_table, row_key

WINDOW = 3


def repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, at) of every window that is not the first of its kind."""
    rows = df.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("doc"), F.split(F.col(text_col), "\n").alias("lines"))
    hashes = F.transform(
        F.sequence(F.lit(1), F.size("lines") - (WINDOW - 1)),
        lambda at: F.when(
            F.trim(F.concat_ws("", F.slice("lines", at, WINDOW))) != "",
            F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", at, WINDOW)))),
        ),
    )
    windows = (
        rows.where(F.size("lines") >= WINDOW)
        .select("id", "doc", F.posexplode(hashes).alias("at", "window"))
        .where(F.col("window").isNotNull())
    )
    first = windows.groupBy("window").agg(F.min(F.struct("id", "doc", "at")).alias("first"), F.count(F.lit(1)).alias("n"))
    again = windows.join(first.where(F.col("n") > 1), "window")
    is_first = (F.col("doc") == F.col("first.doc")) & (F.col("at") == F.col("first.at"))
    return again.where(~is_first).select("doc", "at").distinct()


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False) -> DataFrame:
    """``df`` with the later occurrences taken out of ``text_col``; optionally ``n_lines`` and ``n_removed``."""
    order = W.partitionBy("doc").orderBy("at")
    start = F.coalesce(F.lag("at").over(order) + WINDOW, F.lit(0))
    spans = repeated_windows(df, id_col, text_col).select("doc", "at", start.alias("start"))
    gap = F.when(F.col("at") > F.col("start"), F.struct("start", (F.col("at") - F.col("start")).alias("size")))
    merged = spans.groupBy("doc").agg(
        F.array_sort(F.collect_list(gap)).alias("gaps"),
        (F.max("at") + WINDOW).alias("rest"),
        F.sum(F.col("at") + WINDOW - F.greatest("at", "start")).alias("removed"),
    )
    key, lines, gaps, rest, removed = fresh_names(df.columns, "doc", "lines", "gaps", "rest", "removed")
    merged = merged.toDF(key, gaps, rest, removed)
    joined = df.withColumn(key, row_key(id_col, text_col)).join(merged, key, "left").withColumn(lines, F.split(F.col(text_col), "\n"))
    before = F.flatten(F.transform(F.col(gaps), lambda g: F.slice(F.col(lines), g["start"] + 1, g["size"])))
    after = F.slice(F.col(lines), F.col(rest) + 1, F.greatest(F.size(lines) - F.col(rest), F.lit(0)))
    kept = F.when(F.col(rest).isNull(), F.col(text_col)).otherwise(F.array_join(F.concat(before, after), "\n"))
    out = [kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if with_counts:
        n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)).cast("long")
        out += [n_lines.alias("n_lines"), F.coalesce(F.col(removed), F.lit(0)).cast("long").alias("n_removed")]
    return joined.select(*out)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = dedup_lines(documents, with_counts=True)
    return found.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


OP2_SQL = """
WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
     places AS (SELECT doc_id, lines, unnest(generate_series(1, len(lines) - 2)) AS k FROM docs WHERE len(lines) >= 3),
     windows AS (
       SELECT doc_id, k, lines[k] || chr(10) || lines[k + 1] || chr(10) || lines[k + 2] AS w
       FROM places WHERE trim(lines[k] || lines[k + 1] || lines[k + 2], ' ') <> ''),
     again AS (SELECT doc_id, k FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY doc_id, k) AS r FROM windows) WHERE r > 1),
     covered AS (SELECT DISTINCT doc_id, k + unnest([0, 1, 2]) AS i FROM again),
     split AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM docs),
     kept AS (
       SELECT s.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
              coalesce(string_agg(CASE WHEN c.i IS NULL THEN s.line END, chr(10) ORDER BY s.i), '') AS text
       FROM split s LEFT JOIN covered c ON s.doc_id = c.doc_id AND s.i = c.i GROUP BY s.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
       md5(CASE WHEN d.text IS NOT NULL THEN k.text END) AS kept_md5
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
