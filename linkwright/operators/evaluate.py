"""Quality of a prediction against known pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def outcomes(predicted: DataFrame, truth: DataFrame, ids: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per s1 (and parameter set ``by``): tp, n_pred, n_true, f05. ``ids`` lists every s1 (with every parameter set)."""
    by = list(by)
    known = truth.withColumn("hit", F.lit(1))
    marked = predicted.join(known, ["s1", "other"], "left")
    per_pred = marked.groupBy(*by, "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.sum(F.coalesce("hit", F.lit(0))).alias("tp"))
    per_true = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    rows = ids.join(per_pred, [*by, "s1"], "left").join(per_true, "s1", "left").na.fill(0, ["n_pred", "tp", "n_true"])
    tp, pred, true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    f05 = F.when((pred == 0) & (true == 0), 1.0).when(tp == 0, 0.0).otherwise(1.25 * tp / (pred + 0.25 * true))
    return rows.withColumn("f05", f05)


def macro_f05(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def precision_recall(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """Micro and macro precision and recall; a record rightly left alone counts 1 in the macro means."""
    alone = (F.col("n_pred") == 0) & (F.col("n_true") == 0)
    share = lambda n: F.when(alone, 1.0).when(F.col(n) == 0, 0.0).otherwise(F.col("tp") / F.col(n))
    ratio = lambda n: F.round(F.sum("tp") / F.sum(n), 6)
    return rows.groupBy(*by).agg(
        ratio("n_pred").alias("micro_p"), ratio("n_true").alias("micro_r"),
        F.round(F.avg(share("n_pred")), 6).alias("macro_p"), F.round(F.avg(share("n_true")), 6).alias("macro_r"),
    )


def outcome_class(rows: DataFrame) -> DataFrame:
    tp, pred, true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    name = F.when((true == 0) & (pred == 0), "perfect_singleton").when(true == 0, "false_merge_singleton").when(tp == 0, "total_miss").otherwise("partial_or_full")
    return rows.withColumn("outcome", name)


def loss_class(rows: DataFrame) -> DataFrame:
    """Where F0.5 is lost."""
    tp, pred, true = F.col("tp"), F.col("n_pred"), F.col("n_true")
    name = (
        F.when(F.col("f05") == 1, "ok").when(true == 0, "singleton_fp").when(tp == 0, "missed_all")
        .when((pred > tp) & (true > tp), "fp_and_fn").when(pred > tp, "fp_only").otherwise("fn_only")
    )
    return rows.withColumn("loss_class", name)


def miss_reasons(truth: DataFrame, predicted: DataFrame, found: DataFrame, owners: DataFrame) -> DataFrame:
    """Why true pairs are not predicted: never a candidate, owned by another s1, or below the threshold."""
    missed = truth.join(predicted, ["s1", "other"], "left_anti")
    flagged = missed.join(found.select("s1", "other", F.lit(1).alias("cand")), ["s1", "other"], "left").join(
        owners.select("other", F.col("s1").alias("owner")), "other", "left"
    )
    why = F.when(F.col("cand").isNull(), "not_in_candidates").when(F.col("owner") != F.col("s1"), "stolen_by_other_s1").otherwise("below_thr")
    return flagged.select("s1", "other", why.alias("reason"))


def false_match_reasons(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Why predicted pairs are wrong: the record has no match at all, or belongs elsewhere."""
    wrong = predicted.join(truth, ["s1", "other"], "left_anti")
    homes = truth.select("other", F.lit(1).alias("has_home")).distinct()
    why = F.when(F.col("has_home").isNull(), "other_is_distractor").otherwise("other_belongs_elsewhere")
    return wrong.join(homes, "other", "left").select("s1", "other", why.alias("reason"))


def trait_slices(truth: DataFrame, predicted: DataFrame, found: DataFrame, traits: DataFrame, names: list[str]) -> DataFrame:
    """Truth, missed and not-a-candidate counts for the pairs whose record has a trait, and for all."""
    rows = (
        truth.join(traits, "other")
        .join(predicted.select("s1", "other", F.lit(1).alias("hit")), ["s1", "other"], "left")
        .join(found.select("s1", "other", F.lit(1).alias("cand")), ["s1", "other"], "left")
    )
    having = F.array_compact(F.array(F.lit("all"), *[F.when(F.col(n), n) for n in names]))
    spread = rows.withColumn("slice", F.explode(having))
    n, missed, absent = F.count(F.lit(1)), F.count(F.lit(1)) - F.count("hit"), F.count(F.lit(1)) - F.count("cand")
    return spread.groupBy("slice").agg(
        n.alias("truth"), missed.alias("missed"), absent.alias("not_candidate"),
        F.round(1 - absent / n, 6).alias("block_recall"), F.round(missed / n, 6).alias("miss_rate"),
    )


def split_report(ids: DataFrame, truth: DataFrame, part: Column) -> DataFrame:
    """Records, true pairs and records without a match in each part of a split; ``part``: a condition on s1."""
    counts = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n"))
    rows = ids.select("s1", part.alias("part")).join(counts, "s1", "left")
    n, alone = F.count(F.lit(1)), F.count(F.when(F.col("n").isNull(), 1))
    return rows.groupBy("part").agg(
        n.alias("records"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), alone.alias("singletons"), F.round(alone / n, 6).alias("singleton_rate")
    )
