"""Completions: for every prefix of a name the heaviest names that begin with it, kept in a table sorted by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.sources.readers import swap_in, versions

#: Completions kept for a prefix, and characters of the longest prefix that has a row.
KEEP = 10
LONGEST = 64
#: Parts of a prefix that choose their best names before the prefix does: every name begins with one of few characters.
SALTS = 16


def completions(names: DataFrame, keep: int = KEEP, longest: int = LONGEST) -> DataFrame:
    """prefix, name, weight of the `keep` heaviest names of each prefix (ties: by name); names (name, weight) without their case."""
    rows = names.where("name <> ''").groupBy("name").agg(F.max("weight").alias("weight"))
    cut = F.transform(F.sequence(F.lit(1), F.least(F.length("name"), F.lit(longest))), lambda i: F.substring(F.lower("name"), F.lit(1), i))
    return _best(rows.select(F.explode(F.array_distinct(cut)).alias("prefix"), "name", "weight"), keep)


def _best(rows: DataFrame, keep: int) -> DataFrame:
    order = [F.desc("weight"), F.asc("name")]
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("name"), F.lit(SALTS)))
    some = some.withColumn("_n", F.row_number().over(Window.partitionBy("prefix", "_salt").orderBy(*order))).where(F.col("_n") <= keep)
    return some.withColumn("_n", F.row_number().over(Window.partitionBy("prefix").orderBy(*order))).where(F.col("_n") <= keep).select("prefix", "name", "weight")


def write_completions(names: DataFrame, path: str, keep: int = KEEP, longest: int = LONGEST) -> None:
    """Writes the table of names, or merges them into it: a name's weight only grows, so old rows and new ones hold every best name."""
    spark = names.sparkSession
    fresh = completions(names, keep, longest)
    if versions(spark, path):
        both = completion_table(spark, path).unionByName(fresh)
        fresh = _best(both.groupBy("prefix", "name").agg(F.max("weight").alias("weight")), keep)
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    swap_in(fresh.repartitionByRange(tasks, "prefix").sortWithinPartitions("prefix", F.desc("weight"), "name"), path)


def completion_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("prefix string, name string, weight double").parquet(f"{path}/v-{versions(spark, path)[-1]}")


def complete(table: DataFrame, typed: str, size: int = 5, longest: int = LONGEST) -> DataFrame:
    """The heaviest names that begin with what is typed; reads the row group of one prefix."""
    typed = typed.lower()
    rows = table.where(F.col("prefix") == typed[:longest])
    if len(typed) > longest:
        rows = rows.where(F.lower("name").startswith(typed))
    return rows.select("name", "weight").orderBy(F.desc("weight"), "name").limit(size)
