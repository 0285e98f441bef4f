"""Training rows out of tasks, pairs and grouped candidates, and their repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.scores import soft_target
from pathloom.functions.text import relative_path


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt(profile: Column, scenario: Column, time: Column, history: Column) -> Column:
    """User turn of a suggestion task: profile as JSON, setting, and history as a list."""
    lines = F.transform(F.coalesce(history, F.array().cast("array<string>")), lambda h: F.concat(F.lit("- "), h))
    return F.concat_ws("\n", F.concat(F.lit("Profile: "), F.coalesce(F.to_json(profile), F.lit("{}"))), F.concat(F.lit("Scene: "), F.coalesce(scenario, F.lit("unknown"))), F.concat(F.lit("Time: "), F.coalesce(time, F.lit("unknown"))), F.array_join(lines, "\n"))


def sft_rows(df: DataFrame, key: str, asked: Column, answer: Column, images: Column | None = None, root: str = "", system: str | None = None) -> DataFrame:
    """``key, messages, images`` of rows that have an answer; one image mark per image leads the user turn."""
    shots = F.transform(images, lambda p: relative_path(p, root)) if images is not None else F.array().cast("array<string>")
    marks = F.array_join(F.transform(shots, lambda _: F.lit("<image>")), "")
    turns = [*([message("system", F.lit(system))] if system else []), message("user", F.concat(marks, asked)), message("assistant", answer)]
    return df.where(F.coalesce(F.trim(answer), F.lit("")) != "").select(key, F.array(*turns).alias("messages"), shots.alias("images"))


def pair_rows(df: DataFrame, key: str, asked: Column, chosen: Column, rejected: Column, gap: Column, margin: float, beta: float) -> DataFrame:
    """Preference rows of pairs whose gap reaches the margin, with weight and soft target."""
    weight = F.least(F.lit(3.0), F.greatest(F.lit(0.5), 0.5 + 2 * gap))
    return df.where(gap >= margin).select(key, F.array(message("user", asked)).alias("messages"), message("assistant", chosen).alias("chosen"), message("assistant", rejected).alias("rejected"), weight.alias("weight"), soft_target(gap, beta).alias("target_probability"))


def grouped(df: DataFrame, group: str, item: str, content: str, source: str, probability: str, most: int = 4) -> DataFrame:
    """One row per group with its candidates in order of probability, the distribution, and the oracle's index.

    Groups with fewer than two candidates, or without exactly one oracle, have no row; only the
    ``most`` likeliest are collected, so a huge group stays a small array.
    """
    place = F.row_number().over(W.partitionBy(group).orderBy((F.col(source) == "oracle").desc(), F.col(probability).desc_nulls_last(), item))
    few = df.where(F.col(group).isNotNull()).withColumn("_n", place).where(F.col("_n") <= most)
    rows = few.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.coalesce(probability, F.lit(0.0))).alias("_o"), F.col(item).alias("candidate_id"), F.col(content).alias("text"), F.col(source).alias("source")))).alias("_c"), F.count_if(F.col(source) == "oracle").alias("_oracles"))
    total = F.aggregate("_c", F.lit(0.0), lambda s, x: s - x["_o"])
    out = rows.where((F.size("_c") >= 2) & (F.col("_oracles") == 1)).withColumn("_t", total).where("_t > 0")
    plain = F.transform("_c", lambda x: F.struct(x.candidate_id, x.text, x.source))
    return out.select(group, plain.alias("candidates"), F.transform("_c", lambda x: -x["_o"] / F.col("_t")).alias("target_distribution"), (F.array_position(F.transform("_c", lambda x: x.source), "oracle") - 1).cast("int").alias("oracle_index"))


def ranked_choices(df: DataFrame, group: str, item: str, content: str, seed: int) -> DataFrame:
    """Candidates lettered in a seeded order, for re-ranking prompts."""
    order = F.md5(F.concat_ws(":", F.lit(seed), group, item))
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order, item))).select(group, item, content, F.char(64 + F.col("_n")).alias("letter"))


def repaired(df: DataFrame, gap: Column, beta: float, weight: str, image_list: str, root: str) -> DataFrame:
    """Exported rows with soft target, usable weight and relative image paths filled in."""
    w = F.coalesce(F.when(F.col(weight) > 0, F.col(weight)), F.least(F.lit(3.0), F.greatest(F.lit(0.5), 0.5 + 2 * gap)))
    return df.withColumn("soft_target", soft_target(gap, beta)).withColumn(weight, w).withColumn(image_list, F.transform(image_list, lambda p: relative_path(p, root)))


def dataset_info(names: dict[str, str]) -> dict:
    """Catalogue entries of exported files by their kind (sft, pairs, grouped)."""
    columns = {"sft": {"messages": "messages", "images": "images"}, "pairs": {"messages": "messages", "chosen": "chosen", "rejected": "rejected"}, "grouped": {"messages": "messages", "candidates": "candidates", "target": "target_distribution"}}
    tags = {"role_tag": "role", "content_tag": "content", "user_tag": "user", "assistant_tag": "assistant", "system_tag": "system"}
    return {name: {"file_name": f"{name}.json", "formatting": "sharegpt", "ranking": kind == "pairs", "columns": columns[kind], "tags": tags} for name, kind in names.items()}
