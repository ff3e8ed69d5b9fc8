"""From scores to owned matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import evaluate

THRESHOLDS = (0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)
RELATIVES = (0.0, 0.5, 0.7)


def one_owner(scored: DataFrame, p: str = "p") -> DataFrame:
    """Each other-record with its best s1; ties to the smaller s1."""
    best = W.partitionBy("other").orderBy(F.desc(p), "s1")
    return scored.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def decide(scored: DataFrame, threshold: float, relative: float = 0.0, p: str = "p") -> DataFrame:
    """Owned pairs at or above the threshold and, if asked, near the best of their s1."""
    kept = one_owner(scored, p).where(F.col(p) >= threshold)
    if relative <= 0:
        return kept
    return kept.withColumn("top", F.max(p).over(W.partitionBy("s1"))).where(F.col(p) >= relative * F.col("top")).drop("top")


def decide_grid(scored: DataFrame, thresholds=THRESHOLDS, relatives=RELATIVES, p: str = "p") -> DataFrame:
    """Decisions for all parameters in one pass: columns thr, rel, s1, other."""
    grid = F.explode(F.array(*[F.struct(F.lit(t).alias("thr"), F.lit(r).alias("rel")) for t in thresholds for r in relatives]))
    rows = one_owner(scored, p).withColumn("g", grid).select("s1", "other", p, "g.thr", "g.rel").where(F.col(p) >= F.col("thr"))
    top = F.max(p).over(W.partitionBy("thr", "rel", "s1"))
    return rows.withColumn("top", top).where(F.col(p) >= F.col("rel") * F.col("top")).select("thr", "rel", "s1", "other")


def _best_prefix(own: DataFrame, by: list[str], power: Column, outside: Column, p: str) -> DataFrame:
    """For each s1 (and parameter set ``by``) the prefix of its owned pairs with the highest expected F0.5, if that beats predicting none."""
    own = own.withColumn("q", F.pow(F.col(p), power))
    whole = W.partitionBy(*by, "s1")
    ordered = whole.orderBy(F.desc("q"), "other").rowsBetween(W.unboundedPreceding, 0)
    none = F.exp(F.sum(F.log(F.greatest(F.least(1 - F.col("q"), F.lit(1.0)), F.lit(1e-9)))).over(whole))
    own = own.withColumns({"hits": F.sum("q").over(ordered), "k": F.row_number().over(whole.orderBy(F.desc("q"), "other")), "total": F.sum("q").over(whole), "none": none})
    hits = 1.25 * F.col("hits")
    own = own.withColumn("ef", F.round(hits / (hits + 0.25 * (F.col("total") - F.col("hits") + outside) + (F.col("k") - F.col("hits"))), 9))
    best = own.groupBy(*by, "s1").agg(F.max("ef").alias("top"), F.max_by("k", F.struct("ef", -F.col("k"))).alias("best_k"), F.first("none").alias("alone"))
    kept = best.where(F.col("top") > F.col("alone") * (1 - outside)).select(*by, "s1", "best_k")
    return own.join(kept, [*by, "s1"]).where(F.col("k") <= F.col("best_k"))


def expected_f_decide(scored: DataFrame, outside: float = 0.02, power: float = 1.0, floor: float = 0.02, p: str = "p") -> DataFrame:
    """For each s1 the prefix of its owned pairs with the highest expected F0.5, if that beats predicting none."""
    own = one_owner(scored, p).where(F.col(p) >= floor)
    return _best_prefix(own, [], F.lit(power), F.lit(outside), p).select("s1", "other", p)


def compare_rules(scored: DataFrame, truth: DataFrame, ids: DataFrame, thresholds, powers, outsides, floor: float = 0.02, p: str = "p") -> DataFrame:
    """(rule, power, m, n, macro_f05) of global thresholds (as power) and of the expected-F rule for every power and m, in one pass."""
    sets = [("threshold", float(t), 0.0) for t in thresholds] + [("expected_f", float(x), float(m)) for x in powers for m in outsides]
    grid = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(x).alias("power"), F.lit(m).alias("m")) for r, x, m in sets])).alias("g")
    spread = one_owner(scored, p).select("s1", "other", p, grid).select("s1", "other", p, "g.*")
    by = ["rule", "power", "m"]
    fixed = spread.where((F.col("rule") == "threshold") & (F.col(p) >= F.col("power"))).select(*by, "s1", "other")
    expected = _best_prefix(spread.where((F.col("rule") == "expected_f") & (F.col(p) >= floor)), by, F.col("power"), F.col("m"), p).select(*by, "s1", "other")
    every = ids.select("s1", grid).select("s1", "g.*")
    return evaluate.macro_f05(evaluate.outcomes(fixed.unionByName(expected), truth, every, by), by)
