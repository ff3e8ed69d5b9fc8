"""Learning the transliteration dictionary from known pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels, text, translit

CUTOFF = 60.0


def aligned_tokens(pairs: DataFrame) -> DataFrame:
    """(source, target): native tokens of ``native`` with tokens of ``latin``; by position if the counts agree, else by likeness."""
    tokens = pairs.where(text.has_native_script(F.col("native"))).select(
        text.script_tokens(F.col("native")).alias("a"), text.script_tokens(F.col("latin")).alias("b")
    )
    even = tokens.where(F.size("a") == F.size("b")).select(F.explode(F.arrays_zip("a", "b")).alias("z")).select(F.col("z.a").alias("source"), F.col("z.b").alias("target"))

    @F.pandas_udf("string")
    def closest(a: pd.Series, b: pd.Series) -> pd.Series:
        found = [kernels.best_match(translit.rough_roman(x), list(y), kernels.ratio, CUTOFF) for x, y in zip(a, b)]
        return pd.Series([f[0] if f else None for f in found], dtype="object")

    uneven = tokens.where((F.size("a") != F.size("b")) & (F.size("b") > 0)).select(F.explode("a").alias("source"), "b")
    guessed = uneven.where(text.has_native_script(F.col("source"))).select("source", closest("source", "b").alias("target"))
    return even.unionByName(guessed).where(text.has_native_script(F.col("source")) & F.col("target").isNotNull())


def select_entries(pairs: DataFrame, least: int = 2, share: float = 0.5) -> DataFrame:
    """The most common target of each source, if common enough."""
    counts = pairs.groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("source")
    ranked = counts.withColumns({"total": F.sum("n").over(w), "r": F.row_number().over(w.orderBy(F.desc("n"), "target"))})
    return ranked.where((F.col("r") == 1) & (F.col("n") >= least) & (F.col("n") / F.col("total") >= share)).select("source", "target", "n")


def component_entries(pairs: DataFrame, least: int = 5, share: float = 0.6) -> DataFrame:
    """Whole address components: native ones with every component of the other side, by occurrences of the source."""
    comps = pairs.select(F.array_distinct(text.address_components(F.col("native"))).alias("a"), F.array_distinct(text.address_components(F.col("latin"))).alias("b"))
    single = comps.select(F.explode("a").alias("source"), "b").where(text.has_native_script(F.col("source")))
    seen = single.groupBy("source").agg(F.count(F.lit(1)).alias("seen"))
    counts = single.select("source", F.explode("b").alias("target")).where("target <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))
    best = W.partitionBy("source").orderBy(F.desc("n"), "target")
    top = counts.withColumn("r", F.row_number().over(best)).where("r = 1").join(seen, "source")
    return top.where((F.col("n") >= least) & (F.col("n") / F.col("seen") >= share)).select("source", "target", "n")
