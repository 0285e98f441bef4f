"""Writers: JSON lines, CSV with a byte order mark, appended predictions, merged shards, releases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.storage import cut, exists, read_text, write_text


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Committed as a whole: readers see all files or none."""
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, ids: list[str]) -> int:
    """Append rows whose id isn't stored yet; returns how many (resumable predictions)."""
    spark = df.sparkSession
    if exists(spark, path):
        df = df.join(spark.read.schema(df.schema).parquet(path).select(*ids), ids, "left_anti")
    seen = df.dropDuplicates(ids)
    from pyspark.sql import Observation

    count = Observation()
    seen.observe(count, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
    return count.get["n"]


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV in a fixed column order; the byte order mark leads the header, which also an empty table has."""
    named = df.select(*[F.col(c).alias(("﻿" if i == 0 else "") + c) for i, c in enumerate(columns)])
    named.coalesce(1).write.option("header", True).mode("errorifexists").csv(path)


def merge_shards(tasks: DataFrame, shards: list[DataFrame], key: str, ordinal: str) -> DataFrame:
    """Shards as one table in the tasks' order; duplicate, unknown and missing ids are errors."""
    merged = shards[0]
    for s in shards[1:]:
        merged = merged.unionByName(s)
    wanted = tasks.select(key, ordinal)
    state = merged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).join(wanted.withColumn("known", F.lit(True)), key, "full")
    bad = state.agg(F.count_if(F.col("n") > 1).alias("duplicate"), F.count_if(F.col("known").isNull()).alias("unknown"), F.count_if(F.col("n").isNull()).alias("missing")).first()
    if any(bad):
        raise ValueError(f"shards don't fit the tasks: {bad.asDict()}")
    return merged.join(wanted, key).orderBy(ordinal).drop(ordinal)


def check_provenance(shards: DataFrame, fields: list[str], shard: str, n: int) -> None:
    """All shards 0..n-1 are there and agree in every field."""
    row = shards.agg(*[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit(""))).alias(f) for f in fields], F.array_sort(F.collect_set(shard)).alias("_s")).first()
    if list(row["_s"]) != list(range(n)):
        raise ValueError(f"shards present: {row['_s']}, wanted: 0 to {n - 1}")
    if differing := [f for f in fields if row[f] > 1]:
        raise ValueError(f"shards differ in {differing}")


def _sums(spark: SparkSession, folder: str, names: list[str]) -> dict[str, str]:
    """Sha256 of every data file of a release, taken where the files are read and not by the driver."""
    found = {}
    for name in names:
        data = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{folder}/{name}")
        for r in data.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("sum")).collect():
            found[f"{name}/{r.file}"] = r["sum"]
    return found


def release(tables: dict[str, DataFrame], folder: str, facts: dict, synthetic: bool = False) -> dict:
    """Tables as JSON lines with a manifest and a list of their sha256 sums, on any file system; never overwrites.

    Facts that call the data synthetic are refused unless ``synthetic`` allows it.
    """
    spark = next(iter(tables.values())).sparkSession
    if facts.get("synthetic") and not synthetic:
        raise ValueError("synthetic data isn't released")
    if exists(spark, folder):
        raise FileExistsError(folder)
    for name, df in tables.items():
        write_json_lines(df, f"{folder}/{name}")
    manifest = {**facts, "files": _sums(spark, folder, list(tables))}
    write_text(spark, f"{folder}/SHA256SUMS", "".join(f"{v}  {k}\n" for k, v in sorted(manifest["files"].items())))
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, indent=2, sort_keys=True))
    return manifest


def verify_release(folder: str) -> dict:
    """The manifest, if every file still has its sum and no other file has come."""
    spark = SparkSession.getActiveSession()
    manifest = json.loads(read_text(spark, f"{folder}/manifest.json"))
    try:
        found = _sums(spark, folder, sorted({name.split("/")[0] for name in manifest["files"]}))
    except Exception as error:
        if "ChecksumException" not in str(error):
            raise
        raise ValueError("a file isn't what its file system's own check sums say") from error
    for name in sorted(found.keys() | manifest["files"].keys()):
        if found.get(name) != manifest["files"].get(name):
            raise ValueError(f"{name} isn't what was released")
    return manifest


def write_issues(issues: DataFrame, folder: str, columns: list[str]) -> None:
    """An issue log as CSV in a fixed column order and as JSON lines."""
    write_csv(issues, f"{folder}/csv", columns)
    write_json_lines(issues.select(*columns), f"{folder}/json")


def write_review(candidates: DataFrame, folder: str, group: str, candidate_columns: list[str], group_columns: list[str]) -> None:
    """A reviewer's candidate sheet, and one row per group with the fields its rows share."""
    write_csv(candidates, f"{folder}/candidates", candidate_columns)
    shared = candidates.groupBy(group).agg(*[F.min(c).alias(c) for c in group_columns if c != group], F.count(F.lit(1)).alias("n_candidates"))
    write_csv(shared, f"{folder}/groups", [group, *[c for c in group_columns if c != group], "n_candidates"])


def evict_failed(spark: SparkSession, path: str, failed: Column, schema) -> int:
    """Rewrite stored predictions without the failed rows, so that a resumed run makes them anew; returns how many stay."""
    kept = cut(spark.read.schema(schema).parquet(path).where(~F.coalesce(failed, F.lit(False))), "kept")
    kept.write.mode("overwrite").parquet(path)
    return kept.count()
