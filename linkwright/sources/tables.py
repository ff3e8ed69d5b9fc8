"""Readers and writers: tab-separated records, Parquet, list-valued output, JSON, step results."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def all_string(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_tsv(spark: SparkSession, path: str, columns=RECORD_COLUMNS) -> DataFrame:
    """Tab-separated text without quoting, every column a string, null as the empty string."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("escape", "").option("header", True)
    return reader.schema(all_string(columns)).csv(path).na.fill("")


def read_tsv_inferred(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("quote", "").option("header", True).option("inferSchema", True).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    plain = {"sep": "\t", "quote": "", "escapeQuotes": "false", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.options(header="true", **plain).mode("overwrite").csv(path)


def read_table(spark: SparkSession, folder: str, name: str, columns=None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def column_names(spark: SparkSession, path: str) -> list[str]:
    """From the schema alone."""
    return spark.read.parquet(path).columns


def row_count(spark: SparkSession, path: str, condition: Column | None = None) -> int:
    df = spark.read.parquet(path)
    return (df if condition is None else df.where(condition)).count()


def text_profile(spark: SparkSession, path: str) -> DataFrame:
    """Lines, characters and header of a text file."""
    lines = spark.read.text(path)
    return lines.agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"), F.first("value").alias("header"))


def long_truth(lists: DataFrame) -> DataFrame:
    """Ground-truth lists as pairs (s1, other); records without a match have none."""
    parts = F.explode(F.split("matched_entity_ids", ",")).alias("other")
    return lists.select(F.col("source1_entity_id").alias("s1"), parts).where(F.col("other") != "")


def list_rows(pairs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """One row per id of ``ids`` (column s1): its partners once each, sorted, comma-joined; empty if none."""
    lists = pairs.groupBy("s1").agg(F.array_join(F.array_sort(F.collect_set(F.col("other").cast("string"))), ",").alias(column))
    joined = ids.select("s1").join(lists, "s1", "left")
    return joined.select(F.col("s1").alias("source1_entity_id"), F.coalesce(column, F.lit("")).alias(column))


def write_lists(pairs: DataFrame, ids: DataFrame, column: str, path: str) -> None:
    write_tsv(list_rows(pairs, ids, column), path)


def first_rows(df: DataFrame, condition: Column, order: list[str], n: int) -> DataFrame:
    """The first rows, in a stated order, that meet a condition."""
    return df.where(condition).orderBy(*order).limit(n)


def write_json(spark: SparkSession, path: str, value) -> None:
    """One small JSON document (decision, sweep, dictionary) wherever Spark can write."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str):
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def step_result(spark: SparkSession, path: str, build: Callable[[], DataFrame], key: list[str] | None = None) -> DataFrame:
    """The rows of a finished step, or build and write them first.

    A written step has Spark's success mark, which appears only after its whole
    output. With ``key``, an old result whose key columns differ is built anew.
    """
    if exists(spark, f"{path}/_SUCCESS"):
        found = spark.read.parquet(path)
        if not key or set(key) <= set(found.columns):
            return found
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> bool:
    """True if two tables hold the same key rows, whatever their order."""
    state = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*keys).cast("decimal(38,0)"))).first()
    return state(a) == state(b)


def next_run_folder(spark: SparkSession, root: str, stage: str) -> str:
    """``root/NN_stage`` with the number after the highest one there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    taken = [int(m[1]) for name in names if (m := re.match(r"(\d+)_", name))]
    return f"{root}/{max(taken, default=0) + 1:02d}_{stage}"


def seeded_sample(df: DataFrame, keys: list[str], n: int, seed: int, by: list[str] = ()) -> DataFrame:
    """``n`` rows (of each group ``by``) in the order of a seeded hash of their keys: the same rows wherever and however often it runs."""
    mixed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    if not by:
        return df.withColumn("drawn_at", mixed).orderBy("drawn_at", *keys).limit(n).drop("drawn_at")
    order = W.partitionBy(*by).orderBy(mixed, *keys)
    return df.withColumn("drawn_at", F.row_number().over(order)).where(F.col("drawn_at") <= n).drop("drawn_at")


def sample_again(df: DataFrame, share: float, seed: int) -> DataFrame:
    """Rows drawn with replacement, each a Poisson number of times with mean ``share``."""
    return df.sample(withReplacement=True, fraction=share, seed=seed)


def shown_ids(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """(group, n, shown): the first ids of each group for a message, with dots where there are more."""
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(group).orderBy(key)))
    first = F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.col(key)))), ", ")
    total = F.count(F.lit(1))
    return ranked.groupBy(group).agg(total.alias("n"), F.concat(first, F.when(total > n, ", ...").otherwise("")).alias("shown"))
