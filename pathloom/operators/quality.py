"""Declarative quality gates: rules are (code, severity, condition), issues are rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, str, Column]


def issues(df: DataFrame, ids: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One row per violated rule: ids, code, severity. A condition that is null isn't violated."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, c in rules]))
    return df.select(*ids, F.explode(found).alias("_i")).select(*ids, "_i.code", "_i.severity")


def rollup(found: DataFrame) -> DataFrame:
    """Number of issues per code."""
    return found.groupBy("code", "severity").agg(F.count(F.lit(1)).alias("n"))


def verdict(found: DataFrame) -> DataFrame:
    """One row: blocks, warnings and whether the data passes."""
    n = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("bigint")), F.lit(0))
    return found.agg(n("block").alias("n_block"), n("warn").alias("n_warn")).withColumn("passes", F.col("n_block") == 0)


def conflicting_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that name different rows, once exact repeats count as one."""
    return df.distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``, failing at run time on a row that breaks the condition."""
    return df.where(F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def assert_no_test_split(df: DataFrame, split: str) -> DataFrame:
    return require(df, F.lower(F.coalesce(split, F.lit(""))) != "test", "rows of the test split aren't allowed here")
