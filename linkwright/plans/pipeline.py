"""The whole run as a chain of steps, each written once and skipped when its result is there."""

from __future__ import annotations

import dataclasses
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text, translit
from ..operators import blocking, context, decide, evaluate, features, model, translit_learn
from ..sources import tables


class Runner:
    """Steps in order. A step that fails stops the run; a later run starts there.

    ``reuse``: folders of earlier runs. A step that is finished in one of them is read from there, so runs that differ
    only later on share what stands before.
    """

    def __init__(self, spark: SparkSession, folder: str, reuse: tuple[str, ...] = ()):
        self.spark, self.folder, self.reuse = spark, folder, tuple(reuse)
        self.log: list[tuple[str, float]] = []

    def step(self, name: str, build: Callable[[], DataFrame], rows: DataFrame | None = None) -> DataFrame:
        """``rows``: the pairs that a result must hold; an old one with other pairs is built anew."""
        began = time.time()
        found = [f for f in (self.folder, *self.reuse) if tables.exists(self.spark, f"{f}/{name}/_SUCCESS")]
        if found and rows is not None and not tables.same_keys(self.spark.read.parquet(f"{found[0]}/{name}"), rows, ["s1", "other"]):
            build().write.mode("overwrite").parquet(f"{self.folder}/{name}")
            found = []
        out = tables.step_result(self.spark, f"{found[0] if found else self.folder}/{name}", build)
        self.log.append((name, time.time() - began))
        return out


@dataclasses.dataclass(frozen=True)
class Dictionary:
    """Learned spellings of native tokens and of whole address components. Its size follows the vocabulary, and ``most`` bounds it."""

    names: dict[str, str] = dataclasses.field(default_factory=dict)
    components: dict[str, str] = dataclasses.field(default_factory=dict)
    most: int = 200_000

    @classmethod
    def learn(cls, raw: dict[str, DataFrame], truth: DataFrame, most: int = 200_000) -> Dictionary:
        """From true pairs whose second record is written in a native script; the most frequent entries first."""
        other = raw["s2"].unionByName(raw["s3"]).select(F.col("entity_id").alias("other"), F.col("business_name").alias("name2"), F.col("business_address").alias("address2"))
        own = raw["s1"].select(F.col("entity_id").alias("s1"), "business_name", "business_address")
        pairs = truth.join(other, "other").join(own, "s1").na.fill("")
        names = translit_learn.select_entries(translit_learn.aligned_tokens(pairs.select(F.col("name2").alias("native"), F.col("business_name").alias("latin"))))
        components = translit_learn.component_entries(pairs.select(F.col("address2").alias("native"), F.col("business_address").alias("latin")))
        first = lambda df: {r["source"]: r["target"] for r in df.orderBy(F.desc("n"), "source").limit(most).collect()}
        return cls(first(names), first(components), most)


def normalize(raw: DataFrame, dictionary: Dictionary = Dictionary(), french: bool = True) -> DataFrame:
    """Normalized records of a raw source: the name and address columns, states, numbers, script."""
    rows = raw.na.fill("").withColumn("country", F.lower(F.trim("country")))
    name = translit.ascii_column(F.col("business_name"), dictionary.names)
    rows = rows.withColumn("n", text.name_parts(name, F.col("country"), french))
    degrees = F.when(F.lit(french) & (F.col("country") == "france"), F.translate("business_address", "°º", "oo")).otherwise(F.col("business_address"))
    rows = rows.withColumn("a", text.address_parts(translit.address_ascii_column(degrees, dictionary.names, dictionary.components), F.col("country"), french))
    return rows.select(
        "entity_id", "country", "n.*", "a.*", text.lite(name).alias("name_lite"),
        text.lite(translit.address_ascii_column(F.col("business_address"), dictionary.names, dictionary.components)).alias("addr_lite"),
        text.script_of(F.col("business_name")).alias("script"), text.address_components(F.col("business_address")).alias("comps"),
    )


def pair_table(found: DataFrame, s1: DataFrame, other: DataFrame, groups=("base",)) -> DataFrame:
    """Pairs with the string features of ``groups``; every record brings the weights of its words."""
    idf = features.idf_table(s1.unionByName(other, allowMissingColumns=True))
    left = features.word_weights(s1.select("s1", *features.INPUTS), idf, "s1")
    right = features.word_weights(other.select("other", *features.INPUTS), idf, "other")
    right = right.select("other", *[F.col(c).alias(f"{c}2") for c in (*features.INPUTS, "weights")])
    return features.string_features(found.select("s1", "other").join(left, "s1").join(right, "other"), ["s1", "other"], groups)


class Linkage:
    """The steps of a run over raw sources 's1', 's2', 's3' (entity_id, business_name, business_address, country)."""

    def __init__(self, spark: SparkSession, raw: dict[str, DataFrame], config: Config, reuse: tuple[str, ...] = ()):
        self.spark, self.raw, self.config = spark, raw, config
        self.runner = Runner(spark, config.work, reuse)
        settings = {f.name: str(getattr(config, f.name)) for f in dataclasses.fields(config)}
        tables.write_json(spark, f"{config.work}/settings", settings)  # what the run was made with, frozen beside its results

    def prepare(self, dictionary: Dictionary, thin: bool) -> None:
        """Normalized records, candidates and the inputs of the first stage."""
        step, config = self.runner.step, self.config
        self.s1 = step("s1_norm", lambda: normalize(self.raw["s1"], dictionary, config.french_pack)).withColumnRenamed("entity_id", "s1")
        both = self.raw["s2"].unionByName(self.raw["s3"])
        other = step("other_norm", lambda: normalize(both, dictionary, config.french_pack)).withColumnRenamed("entity_id", "other")
        self.other = blocking.fill_states(other, blocking.learned_states(self.s1))
        index = blocking.thinned(self.s1, config.regime) if thin else self.s1
        self.found = step("candidates", lambda: blocking.candidates(index, self.other, config.regime, config.k_no_state))
        self.ids = index.select("s1")
        table = lambda: context.candidate_context(self.found).join(pair_table(self.found, self.s1, self.other), ["s1", "other"])
        self.table = step("features", table)

    @property
    def inputs(self) -> list[str]:
        return [c for c in self.table.columns if c not in ("s1", "other")]

    def extended(self, scored: DataFrame) -> DataFrame:
        """Rows of the second stage with the features that only it uses."""
        rows = model.second_rows(scored)
        return self.runner.step("second", lambda: rows.join(pair_table(rows, self.s1, self.other, ("x", "x2")), ["s1", "other"]), rows)

    def write(self, matched: DataFrame) -> None:
        """The two files of a run: candidates and matches of every record of the first source."""
        tables.write_lists(self.found, self.ids, "candidate_entity_ids", f"{self.config.output}/candidate_pairs")
        tables.write_lists(matched, self.ids, "matched_entity_ids", f"{self.config.output}/matching_results")


def best_decision(scored: DataFrame, truth: DataFrame, ids: DataFrame, p: str = "q") -> dict[str, float]:
    """Threshold and relative bound with the highest macro F0.5 (ties: the smaller ones)."""
    grid = decide.decide_grid(scored, p=p)
    sets = [F.struct(F.lit(t).alias("thr"), F.lit(r).alias("rel")) for t in decide.THRESHOLDS for r in decide.RELATIVES]
    every = ids.select("s1", F.explode(F.array(*sets)).alias("g")).select("s1", "g.*")
    known = truth.join(ids, "s1", "left_semi")
    f05 = evaluate.macro_f05(evaluate.outcomes(grid, known, every, ["thr", "rel"]), ["thr", "rel"])
    best = f05.orderBy(F.desc("macro_f05"), "thr", "rel").first()
    return {"thr": best["thr"], "rel": best["rel"], "macro_f05": best["macro_f05"]}


def train(spark: SparkSession, raw: dict[str, DataFrame], truth: DataFrame, config: Config, reuse: tuple[str, ...] = (), **settings) -> DataFrame:
    """Learn the dictionary, both models and the decision from labelled sources; returns and writes the owned matches (s1, other, q).

    Scores of both stages are out of fold. ``config.work`` then holds what ``predict`` needs.
    """
    link, work = Linkage(spark, raw, config, reuse), config.work
    if not tables.exists(spark, f"{work}/dictionary/_SUCCESS"):
        learned = Dictionary.learn(raw, truth)
        tables.write_json(spark, f"{work}/dictionary", {"names": learned.names, "components": learned.components})
    link.prepare(Dictionary(**tables.read_json(spark, f"{work}/dictionary")), thin=True)
    step, names = link.runner.step, link.inputs
    rows = step("labelled", lambda: model.labelled(link.table, truth))
    scored = step("scored", lambda: model.crossed(rows, names, model.bucket(F.col("s1"), 7, 2), **settings))
    second = link.extended(scored)
    columns = [*names, *features.EXTENDED, *features.SECOND, *model.CONTEXT]
    out = step("scored_second", lambda: model.crossed(second, columns, model.bucket(F.col("other"), 13, 2), name="q", **(model.STAGE_2 | settings)))
    decision = best_decision(out, truth, link.ids)
    tables.write_json(spark, f"{work}/decision", decision)
    for k, fitted in ((1, model.train(rows, names, **settings)), (2, model.train(second, columns, **(model.STAGE_2 | settings)))):
        model.save(fitted, f"{work}/model_{k}")
        tables.write_json(spark, f"{work}/importances_{k}", model.importances(fitted))
    matched = decide.decide(out, decision["thr"], decision["rel"], "q").select("s1", "other", "q")
    link.write(matched)
    return matched


def predict(spark: SparkSession, raw: dict[str, DataFrame], config: Config, trained: str, reuse: tuple[str, ...] = ()) -> DataFrame:
    """Owned matches of unlabelled sources by the dictionary, models and decision in the folder ``trained``; nothing is learned."""
    config = dataclasses.replace(config, regime=config.regime.for_test())
    link = Linkage(spark, raw, config, reuse)
    link.prepare(Dictionary(**tables.read_json(spark, f"{trained}/dictionary")), thin=False)
    first, second = (model.load(f"{trained}/model_{k}") for k in (1, 2))
    scored = link.runner.step("scored", lambda: model.score(first, link.table))
    rows = link.extended(scored)
    out = link.runner.step("scored_second", lambda: model.score(second, rows, "q"))
    decision = tables.read_json(spark, f"{trained}/decision")
    matched = decide.decide(out, decision["thr"], decision["rel"], "q").select("s1", "other", "q")
    link.write(matched)
    return matched
