"""From raw documents to packed batches, in five stages.

Each stage works on all that the one before it kept; ``run`` writes every stage's
rows to the shared folder and reads them back. All stages but the last return the
columns of ``documents``, and carry columns of any other name along.

Defined results: a null text stays null and an empty one empty through all stages
and is packed with length 0; both have the log weight 0, so they stay if that
is above the drawn cut, and they are copies of nothing. Rows that repeat both id and
text stay or go together in ``quality``, share their result in ``lines``, and are
one document from ``near_duplicates`` on. Ties: of a group the smallest id
stays, of a window of lines the first in order of the id, and of a repeated passage
none. Texts of any length are worked on whole. Without labels of both kinds
everything is kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkwright.llm.line_dedup import dedup_lines
from linkwright.llm.near_dedup import keep_one
from linkwright.llm.packing import pack_documents
from linkwright.llm.quality import select_rows
from linkwright.llm.shared import materialize, read_table
from linkwright.llm.substring_dedup import PASSAGE_WORDS, remove_repeats

#: No stage after the first can be put in SQL alone: models, min-hashes and the optimal buckets are not SQL.
ORACLE_SQL = None


def _recount(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return select_rows(docs, read_table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents stay."""
    return _recount(dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return keep_one(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 400 bytes or of over 50 words that stand elsewhere too go; documents stay."""
    return _recount(remove_repeats(docs, words=PASSAGE_WORDS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length bucket, batch and place of every document."""
    return pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
