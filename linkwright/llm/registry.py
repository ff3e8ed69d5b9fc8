"""Queries of this folder and the SQL that expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op1_byte_bpe
from .chat import OP4_SQL, op4_preference_chat
from .line_dedup import OP2_SQL, op2_line_dedup
from .media import op6_media_columns
from .near_dedup import op7_near_dedup
from .neighbours import op3_kmeans_tree
from .packing import op5_length_packing
from .quality import op9_quality_resampling
from .substring_dedup import op8_substring_dedup
from .token_store import op10_token_store


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_byte_bpe,
        op2_line_dedup,
        op3_kmeans_tree,
        op4_preference_chat,
        op5_length_packing,
        op6_media_columns,
        op7_near_dedup,
        op8_substring_dedup,
        op9_quality_resampling,
        op10_token_store,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op4_preference_chat": OP4_SQL}
