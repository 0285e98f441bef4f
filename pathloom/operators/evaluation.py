"""Evaluation of predictions, executions, trees and retrieval."""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions.sequence import levenshtein_similarity, text_levenshtein_similarity
from pathloom.functions.text import matching_ratio


def proactive_metrics(df: DataFrame, keys: list[str], target: str, predicted: str, similarity=matching_ratio) -> DataFrame:
    """Mean of a pluggable semantic similarity and the edit similarity, over rows that have both texts."""
    both = (F.coalesce(target, F.lit("")) != "") & (F.coalesce(predicted, F.lit("")) != "")
    scored = df.select(*keys, F.when(both, similarity(F.col(target), F.col(predicted))).alias("s1"), F.when(both, text_levenshtein_similarity(F.col(target), F.col(predicted))).alias("s2"))
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count("s1").alias("n_evaluated"), F.avg("s1").alias("semantic"), F.avg("s2").alias("edit"), F.avg((F.col("s1") + F.col("s2")) / 2).alias("similarity"))


def execution_metrics(df: DataFrame, keys: list[str], agent: str, golden: str, other: str, success: str) -> DataFrame:
    """Success within 2.5 times the golden steps, similarity to golden and to another user type, and their ratio."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = levenshtein_similarity(F.col(agent), F.col(golden))
    cross = F.when(size(other) > 0, levenshtein_similarity(F.col(agent), F.col(other))).otherwise(0.0)
    ok = F.coalesce(F.col(success), F.lit(False)) & (size(agent) <= 2.5 * size(golden))
    rows = df.where((size(agent) > 0) & (size(golden) > 0)).select(*keys, ok.alias("ok"), own.alias("si"), cross.alias("sii"), (size(agent) / size(golden)).alias("ratio"))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_evaluated"), F.avg(F.col("ok").cast("double")).alias("success"), F.avg(F.col("si") / F.greatest("sii", F.lit(1e-8))).alias("similarity"),
        F.avg("si").alias("own_similarity"), F.avg("sii").alias("other_similarity"), F.avg(F.when(F.col("ok"), F.col("ratio"))).alias("step_ratio_of_successes"),
    )


def best_leaves(leaves: DataFrame, tree: str, score: str, second: str, leaf: str) -> DataFrame:
    """Per tree its leaf of highest score, then of highest second score, the first on ties."""
    return leaves.groupBy(tree).agg(F.min(F.struct((-F.coalesce(score, F.lit(0.0))).alias("a"), (-F.coalesce(second, F.lit(0.0))).alias("b"), F.col(leaf).alias("leaf"))).alias("_b")).select(tree, F.col("_b.leaf").alias(leaf), (-F.col("_b.a")).alias(score))


def source_counts(df: DataFrame, sources: str) -> DataFrame:
    """How often each tag of a +-joined list occurs."""
    return df.select(F.explode(F.filter(F.split(F.coalesce(sources, F.lit("")), r"\+"), lambda s: s != "")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def prediction_report(df: DataFrame, variant: str, episode: str, step: str, predicted: str, golden: str) -> DataFrame:
    """Per variant: step accuracy, and the mean similarity of episodes' whole action lists."""
    episodes = df.groupBy(variant, episode).agg(F.avg((F.col(predicted) == F.col(golden)).cast("double")).alias("acc"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(step, predicted, golden))).alias("s"))
    lists = episodes.select(variant, "acc", "n", levenshtein_similarity(F.transform("s", lambda x: x[predicted]), F.transform("s", lambda x: x[golden])).alias("sim"))
    return lists.groupBy(variant).agg(F.sum("n").alias("n_steps"), (F.sum(F.col("acc") * F.col("n")) / F.sum("n")).alias("accuracy"), F.avg("sim").alias("sequence_similarity"))


def accuracy_by_category(df: DataFrame, category: str, predicted: str, label: str) -> DataFrame:
    """Accuracy per category and over all."""
    hit = F.avg((F.col(predicted) == F.col(label)).cast("double")).alias("accuracy")
    whole = df.agg(hit, F.count(F.lit(1)).alias("n")).select(F.lit("average").alias(category), "accuracy", "n")
    return df.groupBy(category).agg(hit, F.count(F.lit(1)).alias("n")).unionByName(whole)


def gains_over_base(df: DataFrame, model: str, level: str, metric: str, base: str) -> DataFrame:
    """Every model's metric per level minus the base model's."""
    own = df.where(F.col(model) != base)
    reference = df.where(F.col(model) == base).select(level, F.col(metric).alias("_base"))
    return own.join(reference, level, "left").select(model, level, metric, (F.col(metric) - F.col("_base")).alias("gain"))


def score_gates(df: DataFrame, key: str) -> DataFrame:
    """Whether a run counts as a result: all rows verified, none missing."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce("success_verified", F.lit(False))).alias("all_verified"), F.bool_or("success").alias("any_success"), F.avg(F.when(F.col("success_verified"), F.col("success").cast("double"))).alias("verified_success"))


def execution_score(df: DataFrame, up: Column, down: Column) -> DataFrame:
    """``similarity`` = own over other similarity, where another similarity of 0 counts as 0.4."""
    floor = F.when(down == 0, 0.4).otherwise(down)
    return df.withColumn("up_sim", up).withColumn("down_sim", floor).withColumn("similarity", up / floor)


def log_anomalies(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of a training log that tell of trouble, by kind; batch or stream."""
    kinds = {"not_finite": r"(?i)\b(nan|inf(inity)?)\b", "out_of_memory": r"(?i)out of memory|\boom\b", "traceback": r"Traceback \(most recent call last\)", "overflow": r"(?i)overflow"}
    found = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), k) for k, p in kinds.items()]))
    return lines.select(text, F.explode(found).alias("kind"))


def uncertainty(df: DataFrame, keys: list[str], value: str, penalty: str) -> DataFrame:
    """Spread of continuations' rewards plus the worst retrieval penalty; one alone has no spread."""
    return df.groupBy(*keys).agg((F.when(F.count(value) > 1, F.stddev_pop(value)).otherwise(0.0) + F.coalesce(F.max(penalty), F.lit(0.0))).alias("uncertainty"))


def pair_accuracy(df: DataFrame, margin: str, target: str, weight: str) -> DataFrame:
    """Weighted share of pairs whose margin has the target's sign; errors and correlation of the two."""
    hit = (F.signum(margin) == F.signum(target)).cast("double")
    d = F.col(margin) - F.col(target)
    guard = lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))
    return df.agg((F.sum(hit * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("accuracy"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"), guard(F.corr(margin, target)).alias("pearson"))


def _grams(tokens: list[str], n: int) -> Counter:
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def _common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one number."""
    at: dict[str, int] = {}
    for j, t in enumerate(b):
        at[t] = at.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(b) - row.bit_count()


def _generation(predicted: str, label: str) -> dict:
    """BLEU-4 with add-one smoothing above order one, and ROUGE-1, 2 and L as F-measures, over characters."""
    p, y = list(predicted), list(label)
    logs = []
    for n in range(1, 5):
        a, b = _grams(p, n), _grams(y, n)
        hit, total = sum((a & b).values()), max(sum(a.values()), 0)
        extra = 1 if n > 1 else 0
        logs.append(math.log((hit + extra) / (total + extra)) if hit + extra and total + extra else -math.inf)
    brevity = 1.0 if len(p) > len(y) else math.exp(1 - len(y) / len(p)) if p else 0.0
    out = {"bleu4": brevity * math.exp(sum(logs) / 4) if p and min(logs) > -math.inf else 0.0}
    for n in (1, 2):
        a, b = _grams(p, n), _grams(y, n)
        hit = sum((a & b).values())
        out[f"rouge{n}"] = 2 * hit / (sum(a.values()) + sum(b.values())) if hit else 0.0
    common = _common(p, y)
    out["rougel"] = 2 * common / (len(p) + len(y)) if common else 0.0
    return out


_SCORES = ("bleu4", "rouge1", "rouge2", "rougel")


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in _SCORES]))
def generation_scores(predicted: pa.Array, label: pa.Array) -> pa.Array:
    """Overlap scores of generated texts with their labels; null counts as empty."""
    rows = [_generation(p or "", y or "") for p, y in zip(predicted.to_pylist(), label.to_pylist())]
    return pa.array(rows, pa.struct([(n, pa.float64()) for n in _SCORES]))


def model_result_table(df: DataFrame, model: str, level: str, metric: str, levels: list[int]) -> DataFrame:
    """One row per model with a column per level and the mean over levels."""
    wide = df.groupBy(model).pivot(level, levels).agg(F.avg(metric))
    return wide.withColumn("macro", sum((F.col(str(x)) for x in levels[1:]), F.col(str(levels[0]))) / len(levels))


def top_changes(df: DataFrame, delta: str, key: str, n: int, worst: bool = True) -> DataFrame:
    """The n largest losses, or gains, in an order that is always the same (a report, hence the limit)."""
    return df.orderBy(F.col(delta).asc() if worst else F.col(delta).desc(), key).limit(n)


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """The n most frequent values (a report); ties in the values' own order."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), value).limit(n)


def running_share(df: DataFrame, order: str, value: str) -> DataFrame:
    """Running share of a small summary table."""
    return df.withColumn("share", F.sum(value).over(W.orderBy(order).rowsBetween(W.unboundedPreceding, 0)) / F.sum(value).over(W.partitionBy()))
