"""Candidate groups: frequencies, negatives, reviews, audits, resampling and policies.

Groups may be of any size: what concerns a whole group is aggregated with map-side combine and
joined back, and only a group's first few rows are ever ranked or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions import scores, text
from pathloom.operators.causal import keep_first, latest_before, top_k
from pathloom.operators.stats import hash_unit

# Precedence of sources among negatives.
NEGATIVE_ORDER = ("model", "cross_user", "same_user")


def answer_frequency(candidates: DataFrame, source: str, key: Column, oracle: str = "oracle") -> DataFrame:
    """``key, n``: how often each answer is given over all groups by anything but the oracle; empty answers don't count."""
    keyed = candidates.where(F.col(source).isNull() | (F.col(source) != oracle)).select(key.alias("key"))
    return keyed.where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def reject_reason(answer: Column, prompt: Column, source: Column, frequency: Column, least: int = 4, most: int = 10, history: Sequence[str] = ()) -> Column:
    """Why a negative can't be used, the first reason that holds; null if none does.

    ``history`` names the sources that are refused as negatives; ``frequency`` is the answer's count over all groups.
    """
    key = text.key_compact(answer)
    return (
        F.when(F.length(key) < least, "too_short").when(F.contains(answer, F.lit("�")), "replacement_character").when(F.contains(text.key_compact(prompt), key), "copied_from_prompt")
        .when(F.lower(F.coalesce(source, F.lit(""))).isin(*history) if history else F.lit(False), "history_source").when(F.coalesce(frequency, F.lit(0)) > most, "too_frequent")
    )


def select_negatives(rows: DataFrame, group: str, source: str, weight: str, answer: str, limit: int) -> DataFrame:
    """The first ``limit`` different negatives of every group by source, weight and text; ``place`` from 1."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in NEGATIVE_ORDER]), F.lower(F.coalesce(source, F.lit("")))), F.lit(0)), F.lit(len(NEGATIVE_ORDER) + 1))
    order = [F.col("_rank"), F.coalesce(weight, F.lit(0.0)).desc(), F.col(answer)]
    keyed = rows.withColumn("_rank", rank).withColumn("_key", text.key_compact(F.col(answer))).where("_key <> ''")
    return top_k(keep_first(keyed, [group, "_key"], order), [group], order, limit, "place").drop("_rank", "_key")


def overridden(results: DataFrame, annotations: DataFrame, key: str, value: str, required: Sequence[str]) -> DataFrame:
    """``results`` with ``value`` replaced where an annotation of that key has it; ``annotated`` tells where.

    An annotation without one of the ``required`` fields, or a second one of a key, is an error.
    """
    bad = annotations.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.bool_or(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").alias(f"no_{c}") for c in required])
    first = bad.where((F.col("n") > 1) | F.greatest(*[F.col(f"no_{c}") for c in required])).limit(1).collect()
    if first:
        raise ValueError(f"annotation repeated or without {', '.join(required)}: {first[0][0]}")
    own = annotations.select(key, F.col(value).alias("_own"))
    return results.join(own, key, "left").withColumn("annotated", F.col("_own").isNotNull()).withColumn(value, F.coalesce("_own", value)).drop("_own")


def reviewed(candidates: DataFrame, key: str, group: str, decision: str, probability: str, dropped: str = "drop_%") -> DataFrame:
    """Candidates that their own decision doesn't drop, with the group's mass shared anew; groups without mass share it evenly."""
    kept = candidates.where(F.col(decision).isNull() | ~F.col(decision).like(dropped)).withColumn("_p", F.greatest(F.coalesce(probability, F.lit(0.0)), F.lit(0.0)))
    total = kept.groupBy(group).agg(F.sum("_p").alias("_t"), F.count(F.lit(1)).alias("_n"))
    share = F.when(F.col("_t") > 0, F.col("_p") / F.col("_t")).otherwise(1.0 / F.col("_n"))
    return kept.join(total, group).withColumn("new_probability", share).drop("_p", "_t", "_n")


def preference_audit(candidates: DataFrame, split: str, group: str, item: str, source: str, score: str, oracle: str = "oracle") -> DataFrame:
    """``split, metric, value``: groups, items, oracle in front, margins over the best negative, repeated items, items per source."""
    rows = candidates.where(F.col(group).isNotNull() & F.col(score).isNotNull() & ~F.isnan(score)).select(F.coalesce(split, F.lit("none")).alias("split"), F.col(group).alias("g"), F.col(item).alias("i"), F.col(source).alias("s"), F.col(score).alias("v"))
    best = lambda c: F.max(F.when(c, F.col("v")))
    own = F.coalesce(F.col("s") == oracle, F.lit(False))
    per = rows.groupBy("split", "g").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("i").alias("items"), best(own).alias("o"), best(~own).alias("b"))
    names = {
        "groups": F.count(F.lit(1)).cast("double"), "candidates": F.sum("n").cast("double"), "mean_group": F.avg("n"), "without_oracle": F.avg(F.col("o").isNull().cast("double")),
        "oracle_leads": F.avg(F.when(F.col("o").isNotNull() & F.col("b").isNotNull(), (F.col("o") >= F.col("b")).cast("double"))), "mean_margin": F.avg(F.col("o") - F.col("b")), "least_margin": F.min(F.col("o") - F.col("b")),
        "repeated_items": F.sum(F.col("n") - F.col("items")).cast("double"),
    }
    wide = per.groupBy("split").agg(*[c.alias(k) for k, c in names.items()])
    long = wide.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in names])))
    return long.unionByName(rows.groupBy("split", F.concat(F.lit("source:"), F.coalesce("s", F.lit("none"))).alias("metric")).agg(F.count(F.lit(1)).cast("double").alias("value")))


def wide_audit(wide: DataFrame, split: str, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """``split, metric, value`` of groups in wide form: per kind of candidate (text column, score column) its share,
    how often its text is the oracle's, mean score; and how many groups have one score throughout."""
    oracle = columns["oracle"][0]
    metrics = {"groups": F.count(F.lit(1)).cast("double")}
    for kind, (words, score) in columns.items():
        metrics[f"{kind}_share"] = F.avg(F.col(words).isNotNull().cast("double"))
        metrics[f"{kind}_mean"] = F.avg(score)
        if kind != "oracle":
            metrics[f"{kind}_is_oracle"] = F.avg(F.when(F.col(words).isNotNull() & F.col(oracle).isNotNull(), (text.key_compact(F.col(words)) == text.key_compact(F.col(oracle))).cast("double")))
    known = F.array_distinct(F.array_compact(F.array(*[F.round(score, 12) for _, score in columns.values()])))
    metrics["one_score"] = F.avg((F.size(known) <= 1).cast("double"))
    out = wide.groupBy(F.coalesce(split, F.lit("none")).alias("split")).agg(*[c.alias(k) for k, c in metrics.items()])
    return out.select("split", F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in metrics])))


def monitor(candidates: DataFrame, group: str, source: str, answer: str, prompt: str, most: int, least: int, oracle: str = "oracle") -> DataFrame:
    """``code, n``: groups with few different answers, without an oracle, answers that copy the prompt, answers beyond ``most`` uses."""
    keyed = candidates.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(source).alias("s"), text.key_compact(F.col(answer)).alias("k"), text.key_compact(F.col(prompt)).alias("p"))
    per = keyed.groupBy("g").agg(F.count_distinct(F.nullif(F.col("k"), F.lit(""))).alias("unique"), F.bool_or(F.col("s") == oracle).alias("has"))
    n = lambda df, code: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(code).alias("code"), "n")
    copied = keyed.where((F.coalesce("s", F.lit("")) != oracle) & (F.length("k") >= 4) & F.contains("p", F.col("k")))
    popular = answer_frequency(keyed, "s", F.col("k"), oracle).where(F.col("n") > most)
    return n(per.where(F.col("unique") < least), "few_answers").unionByName(n(per.where(~F.coalesce("has", F.lit(False))), "no_oracle")).unionByName(n(copied, "copied_from_prompt")).unionByName(n(popular, "popular_answer"))


def candidate_sets(candidates: DataFrame, group: str, source: str, item: str, answer: str, score: str, limits: dict[str, int]) -> DataFrame:
    """The best few of every source in the order of ``limits``, each text once per group: ``place`` from 1."""
    rank = F.array_position(F.array(*[F.lit(s) for s in limits]), F.col(source))
    most = None
    for s, n in limits.items():
        most = (F.when if most is None else most.when)(F.col(source) == s, n)
    order = [F.col(score).desc_nulls_last(), F.col(item)]
    rows = candidates.where(F.col(group).isNotNull() & F.col(source).isin(*limits)).withColumn("_rank", rank).withColumn("_key", text.key_compact(F.col(answer))).where("_key <> ''")
    few = top_k(keep_first(rows, [group, "_rank", "_key"], order), [group, "_rank"], order, max(limits.values()), "_n").where(F.col("_n") <= most)
    once = keep_first(few, [group, "_key"], [F.col("_rank"), F.col("_n")])
    return top_k(once, [group], [F.col("_rank"), F.col("_n")], sum(limits.values()), "place").drop("_rank", "_key", "_n")


def reweighted(df: DataFrame, key: str, weight: str, seed: int) -> DataFrame:
    """Rows drawn with replacement, on average ``weight`` times each (null or negative: never); ``copy`` from 1.

    Whole copies are certain and the fraction is drawn by hash, row by row: nothing is sorted or shuffled.
    """
    w = F.greatest(F.coalesce(weight, F.lit(0.0)), F.lit(0.0))
    times = (F.floor(w) + F.when(hash_unit(F.lit(seed), F.col(key)) < w - F.floor(w), 1).otherwise(0)).cast("int")
    return df.withColumn("_times", times).where("_times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def null_actions(action: Column, pool: Sequence[str], preferred: Column, most: int) -> Column:
    """Up to ``most`` actions that aren't the given one: those of the preferred type first, then the pool in order."""
    every = F.array_distinct(F.concat(F.filter(F.array(*[F.lit(p) for p in pool]), lambda p: F.startswith(p, preferred)), F.array(*[F.lit(p) for p in pool])))
    return F.slice(F.filter(every, lambda p: p != F.coalesce(action, F.lit(""))), 1, most)


def log_frequency_policy(counts: DataFrame, node: Sequence[str], action: str, n: str, smoothing: float = 1.0, kappa: float = 5.0) -> DataFrame:
    """Per node: a Laplace-smoothed policy, one by log frequency, and their mix gated by how much is known of the node."""
    total = counts.groupBy(*node).agg(F.sum(n).alias("_total"), F.count(F.lit(1)).alias("_k"), F.sum(F.log1p(n)).alias("_logs"))
    own = counts.join(total, list(node))
    base = F.log1p(n) / F.col("_logs")
    smooth = (F.col(n) + smoothing) / (F.col("_total") + smoothing * F.col("_k"))
    gate = 1.0 - F.exp(-F.col("_total") / kappa)
    return own.select(*node, action, n, base.alias("log_policy"), smooth.alias("smoothed_policy"), ((1 - gate) * base + gate * smooth).alias("fused_policy"))


def teacher_forced(steps: DataFrame, key: str, episode: str, order: Sequence[Column], action: Column, valid: Column, variants: Sequence[str]) -> DataFrame:
    """One row per step and prompt variant with the actions before it in its episode; only valid steps add to them."""
    prior = latest_before(steps, [episode], order, 0, F.when(valid, action), "_prior")  # collect_list leaves nulls out
    return prior.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in variants]))).select(key, "variant", F.col("_prior").alias("prior"))


def position_shares(df: DataFrame, group: str, item: str, correct: Column, seed: int, most: int = 26) -> DataFrame:
    """``letter, n, share``: where the right candidate comes to stand when every group is put in a seeded order."""
    placed = top_k(df, [group], [F.md5(F.concat_ws(":", F.lit(seed), group, item)), F.col(item)], most, "_n").where(correct)
    counted = placed.groupBy(F.char(64 + F.col("_n")).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))
    return counted.join(F.broadcast(total)).select("letter", "n", (F.col("n") / F.col("_all")).alias("share"))


def window_negatives(wide: DataFrame, oracle: str, kinds: dict[str, dict]) -> DataFrame:
    """Negatives of wide groups whose similarity to the oracle lies in a kind's window.

    ``kinds`` maps a name to ``text``, ``similarity`` (least, most), ``score``, and optionally ``before``:
    columns (source time, target time) of which the first must be earlier. The pair is named a slot
    mismatch where texts are alike and end differently.
    """
    out = None
    grams = lambda c: text.bigrams(text.key_compact(F.col(c)))
    for name, how in kinds.items():
        words, (low, high) = how["text"], how["similarity"]
        s = text.dice(grams(words), grams(oracle))
        ok = (text.key_compact(F.col(words)) != "") & (text.key_compact(F.col(words)) != text.key_compact(F.col(oracle)))
        if "before" in how:
            ok = ok & F.coalesce(F.col(how["before"][0]) < F.col(how["before"][1]), F.lit(False))
        part = wide.where(ok).withColumn("char_similarity", s).where(F.col("char_similarity").between(low, high))
        kind = F.when(text.slot_mismatch(F.col(oracle), F.col(words), F.col("char_similarity")), f"slot_mismatch_{name}").otherwise(name)
        part = part.select(*wide.columns, kind.alias("negative_type"), F.col(words).alias("negative"), "char_similarity", F.col(how["score"]).alias("negative_score"))
        out = part if out is None else out.unionByName(part)
    return out


def context_is_hard(oracle: Column, context: Column, threshold: float) -> Column:
    """Whether a context answer is other than, and yet alike to, the oracle's."""
    a, b = text.key_compact(oracle), text.key_compact(context)
    return (a != "") & (b != "") & (a != b) & (text.dice(text.bigrams(a), text.bigrams(b)) >= threshold)


def preference_rows(best: DataFrame, negatives: DataFrame, group: str, answer: str, score: str, temperature: float) -> DataFrame:
    """Each group's oracle against its selected negatives: chosen, rejected, gap and soft target."""
    other = negatives.select(group, F.col(answer).alias("rejected"), F.col(score).alias("_s"), "place")
    gap = F.col(score) - F.col("_s")
    return best.select(group, F.col(answer).alias("chosen"), score).join(other, group).select(group, "place", "chosen", "rejected", gap.alias("gap"), scores.soft_target(gap, temperature, 0.0, 1.0).alias("target_probability"))
