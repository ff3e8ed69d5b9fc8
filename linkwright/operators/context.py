"""Competition among the candidates of a record: ranks, gaps, runners-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SIDES = {"o": ("other", "s1"), "s": ("s1", "other")}


def candidate_context(found: DataFrame) -> DataFrame:
    """Ranks and gaps of the blocking similarities, and numbers of candidates, on both sides."""
    out = found
    for side, (key, _) in SIDES.items():
        w = W.partitionBy(key)
        for view in ("name", "addr"):
            sim = f"sim_{view}_blk"
            out = out.withColumn(f"rk_{view}_{side}", F.rank().over(w.orderBy(F.desc(sim))))
            if (view, side) != ("addr", "s"):
                out = out.withColumn(f"gap_{view}_{side}", F.max(sim).over(w) - F.col(sim))
        out = out.withColumn(f"n_cand_{side}", F.count(F.lit(1)).over(w))
    return out.withColumn("is_s3", F.startswith(F.col("other").cast("string"), F.lit("S3")).cast("double"))


def score_context(scored: DataFrame, p: str = "p") -> DataFrame:
    """The 18 columns that compare a score with its rivals' on both sides; windows run over all pairs."""
    clipped = F.greatest(F.least(F.col(p), F.lit(1 - 1e-7)), F.lit(1e-7))
    out = scored.withColumn("logit", F.log(clipped / (1 - clipped)))
    for side, (key, other) in SIDES.items():
        whole = W.partitionBy(key)
        ranked = whole.orderBy(F.desc(p), other)
        full = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        out = (
            out.withColumn(f"pmax_{side}", F.max(p).over(whole))
            .withColumn(f"p2_{side}", F.coalesce(F.nth_value(p, 2).over(full), F.lit(0.0)))
            .withColumn(f"prk_{side}", F.row_number().over(ranked))
            .withColumn(f"psum_{side}", F.sum(p).over(whole))
            .withColumn(f"n05_{side}", F.sum(F.when(F.col(p) >= 0.5, 1).otherwise(0)).over(whole))
            .withColumn(f"n01_{side}", F.sum(F.when(F.col(p) >= 0.1, 1).otherwise(0)).over(whole))
            .withColumn(f"gap_{side}", F.col(p) - F.col(f"pmax_{side}"))
            .withColumn(f"rival_{side}", F.when(F.col(f"prk_{side}") == 1, F.col(f"p2_{side}")).otherwise(F.col(f"pmax_{side}")))
        )
    return out


def prune(contextual: DataFrame, least: float, p: str = "p") -> DataFrame:
    """After the windows, so that rivals that go still count."""
    return contextual.where(F.col(p) >= least)
