"""Readers of JSON lines, JSON arrays and CSV files."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.storage import listed, read_text

# File endings and the reader that takes them.
FORMATS = {"csv": "csv", "json": "json", "jsonl": "json", "parquet": "parquet", "orc": "orc", "txt": "text"}


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Tolerant: blank lines are skipped, an undecodable line keeps its text in ``raw`` with ``json_error``."""
    fields = T.StructType([*schema.fields, T.StructField("raw", T.StringType())])
    rows = spark.read.text(path).where(F.trim("value") != "")
    parsed = rows.select(F.from_json("value", fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "raw"}).alias("r"))
    return parsed.select("r.*").withColumn("json_error", F.col("raw").isNotNull())


def json_lines_failfast(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_lines_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Blank lines, broken lines and lines that hold no object are errors that name file and line content."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("_file"))
    ok = F.trim("value").rlike(r"^\{") & F.try_parse_json("value").isNotNull()
    message = F.concat(F.lit("no JSON object in "), "_file", F.lit(": "), F.substring("value", 1, 80))
    checked = rows.where(F.when(F.coalesce(ok, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return checked.select(F.from_json("value", schema).alias("r")).select("r.*")


def json_any(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A JSON array or JSON lines, told apart by the first character of the file."""
    first = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    array = bool(first) and first[0][0].lstrip("﻿ \t")[:1] == "["
    return spark.read.schema(schema).option("multiLine", array).option("mode", "FAILFAST").json(path)


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all strings; a byte order mark is no part of the first name."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def typed(df: DataFrame, numbers: list[str] = (), integers: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """String columns coerced: numbers and whole numbers with 0 on failure, lists from JSON cells."""
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    made = {c: number(c) for c in numbers} | {c: number(c).cast("int") for c in integers}
    made |= {c: F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>")) for c in lists}
    return df.withColumns(made)


def last_per_key(df: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Dimension rows, the last delivery of each key."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), ordinal).alias("_r")).select(key, "_r.*")


def unique_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, failing if a key occurs twice."""
    twice = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"duplicate key {tuple(twice[0])[:-1]}")
    return df


def files(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """Files of one kind, by their ending; mixed endings are refused."""
    names = listed(spark, folder)
    kinds = {os.path.splitext(n)[1].lstrip(".").lower() for n in names if not n.startswith((".", "_"))}
    if len(kinds) != 1 or (kind := kinds.pop()) not in FORMATS:
        raise ValueError(f"files of one known kind are needed, not {sorted(kinds)}")
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.option("header", True).format(FORMATS[kind]).load(folder)


def renamed(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns of a registered data set under their standard names (standard: own); missing ones are null."""
    return df.select(*[(F.col(own) if own in df.columns else F.lit(None)).alias(standard) for standard, own in columns.items()])


def expanded(value, env: dict[str, str] | None = None):
    """``${NAME:-default}`` replaced at every depth of a configuration."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", lambda m: env.get(m[1]) or (m[2] or ""), value)
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    return [expanded(v, env) for v in value] if isinstance(value, list) else value


def load_config(path: str) -> dict:
    """A JSON configuration on any file system, with its environment names filled in."""
    return expanded(json.loads(read_text(SparkSession.getActiveSession(), path)))
