"""Queries over candidate groups, reviews, resampling and policies, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.operators import causal, groups, sampling
from pathloom.plans import sql
from pathloom.storage import table

_SCORED = "reward_total IS NOT NULL AND NOT isnan(reward_total)"


def _compact(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[\t-\r\x{{85}}\p{{Z}}]', '', 'g'))"


def _r(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def answer_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that occur more than once over all groups, the oracles' left out, by their alphanumeric key."""
    rows = table(spark, sf_dir, "review_candidates").select("candidate_source", "candidate_text")
    return groups.answer_frequency(rows, "candidate_source", text.key_alnum("candidate_text")).where("n > 1")


FREQUENCY = f"SELECT {sql.key('candidate_text')} AS key, count(*) AS n FROM review_candidates WHERE (candidate_source IS NULL OR candidate_source <> 'oracle') AND candidate_text IS NOT NULL GROUP BY 1 HAVING count(*) > 1 AND key <> ''"


def rejected_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected answers of the pairs with the first reason against their use."""
    rows = table(spark, sf_dir, "preference_pairs").select("row_id", "candidate_source", F.col("rejected.content").alias("answer"), F.array_join(F.transform("messages", lambda m: F.coalesce(m.content, F.lit(""))), "\n").alias("prompt"))
    rows = rows.withColumn("key", text.key_compact(F.col("answer")))
    often = groups.answer_frequency(rows, "candidate_source", F.col("key"))
    reason = groups.reject_reason(F.col("answer"), F.col("prompt"), F.col("candidate_source"), F.col("n"), most=1, history=("same_user",))
    return rows.join(often, "key", "left").select("row_id", reason.alias("reason")).where("reason IS NOT NULL")


REJECTED = f"""
WITH r AS (SELECT row_id, candidate_source AS s, rejected.content AS a, {_compact('rejected.content')} AS k, {_compact("array_to_string(list_transform(messages, lambda m: coalesce(m.content, '')), chr(10))")} AS p FROM preference_pairs),
f AS (SELECT k, count(*) AS n FROM r WHERE k <> '' AND (s IS NULL OR s <> 'oracle') GROUP BY k),
x AS (SELECT row_id, CASE WHEN length(k) < 4 THEN 'too_short' WHEN contains(a, chr(65533)) THEN 'replacement_character' WHEN contains(p, k) THEN 'copied_from_prompt' WHEN lower(coalesce(s, '')) = 'same_user' THEN 'history_source' WHEN coalesce(n, 0) > 1 THEN 'too_frequent' END AS reason FROM r LEFT JOIN f USING (k))
SELECT row_id, reason FROM x WHERE reason IS NOT NULL
"""


def _negatives(rows: DataFrame) -> DataFrame:
    return groups.select_negatives(rows.where("group_id IS NOT NULL AND (candidate_source IS NULL OR candidate_source <> 'oracle')"), "group_id", "candidate_source", "current_target_probability", "candidate_text", 2)


def selected_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two different negatives of every group by source, probability and text."""
    rows = table(spark, sf_dir, "review_candidates").select("group_id", "candidate_source", "current_target_probability", "candidate_text")
    return _negatives(rows).select("group_id", "candidate_source", "candidate_text", "place")


_SELECTED = f"""
n0 AS (SELECT group_id, candidate_source, candidate_text, reward_total, {_compact('candidate_text')} AS k, coalesce(current_target_probability, 0) AS w, CASE lower(coalesce(candidate_source, '')) WHEN 'model' THEN 1 WHEN 'cross_user' THEN 2 WHEN 'same_user' THEN 3 ELSE 4 END AS r
  FROM review_candidates WHERE group_id IS NOT NULL AND (candidate_source IS NULL OR candidate_source <> 'oracle')),
n1 AS (SELECT *, row_number() OVER (PARTITION BY group_id, k ORDER BY r, w DESC, candidate_text) AS c FROM n0 WHERE k <> ''),
n2 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY r, w DESC, candidate_text) AS place FROM n1 WHERE c = 1)
"""
SELECTED = f"WITH {_SELECTED} SELECT group_id, candidate_source, candidate_text, CAST(place AS INTEGER) AS place FROM n2 WHERE place <= 2"


def preference_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best oracle of every group against its selected negatives, with gap and soft target."""
    rows = table(spark, sf_dir, "review_candidates").where(_SCORED).select("group_id", "candidate_id", "candidate_source", "current_target_probability", "candidate_text", F.round("reward_total", 9).alias("reward_total"))
    best = causal.keep_first(rows.where("candidate_source = 'oracle' AND group_id IS NOT NULL"), ["group_id"], [F.col("reward_total").desc(), F.col("candidate_id"), F.col("candidate_text")])
    least = rows.where("group_id IS NOT NULL AND (candidate_source IS NULL OR candidate_source <> 'oracle')").groupBy("group_id", "candidate_source", "candidate_text").agg(F.max("current_target_probability").alias("current_target_probability"), F.max("reward_total").alias("reward_total"))
    out = groups.preference_rows(best, _negatives(least), "group_id", "candidate_text", "reward_total", 0.1)
    return out.select("group_id", "place", F.md5("chosen").alias("chosen"), F.md5("rejected").alias("rejected"), *_r("gap", "target_probability"))


TARGETS = f"""
WITH c AS (SELECT group_id, candidate_id, candidate_source, current_target_probability, candidate_text, round(reward_total, 9) AS v FROM review_candidates WHERE {_SCORED} AND group_id IS NOT NULL),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY v DESC, candidate_id NULLS FIRST, candidate_text NULLS FIRST) AS r FROM c WHERE candidate_source = 'oracle') WHERE r = 1),
d AS (SELECT group_id, candidate_source, candidate_text, max(current_target_probability) AS p, max(v) AS v FROM c WHERE candidate_source IS NULL OR candidate_source <> 'oracle' GROUP BY ALL),
n0 AS (SELECT *, {_compact('candidate_text')} AS k, coalesce(p, 0) AS w, CASE lower(coalesce(candidate_source, '')) WHEN 'model' THEN 1 WHEN 'cross_user' THEN 2 WHEN 'same_user' THEN 3 ELSE 4 END AS s FROM d),
n1 AS (SELECT *, row_number() OVER (PARTITION BY group_id, k ORDER BY s, w DESC, candidate_text) AS x FROM n0 WHERE k <> ''),
n2 AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY s, w DESC, candidate_text) AS place FROM n1 WHERE x = 1)
SELECT group_id, CAST(place AS INTEGER) AS place, md5(o.candidate_text) AS chosen, md5(n2.candidate_text) AS rejected, round(o.v - n2.v, 9) AS gap, round(1 / (1 + exp(-(o.v - n2.v) / 0.1e0)), 9) AS target_probability FROM n2 JOIN o USING (group_id) WHERE place <= 2
"""


def preference_set_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of the candidate groups per split, one metric a row."""
    return groups.preference_audit(table(spark, sf_dir, "review_candidates"), "split", "group_id", "candidate_id", "candidate_source", "reward_total").select("split", "metric", *_r("value"))


SET_AUDIT = f"""
WITH c AS (SELECT coalesce(split, 'none') AS split, group_id AS g, candidate_id AS i, candidate_source AS s, reward_total AS v FROM review_candidates WHERE group_id IS NOT NULL AND {_SCORED}),
p AS (SELECT split, g, count(*) AS n, count(DISTINCT i) AS items, max(v) FILTER (s = 'oracle') AS o, max(v) FILTER (coalesce(s, '') <> 'oracle') AS b FROM c GROUP BY ALL),
w AS (SELECT split, CAST(count(*) AS DOUBLE) AS groups, CAST(sum(n) AS DOUBLE) AS candidates, avg(n) AS mean_group, avg(CASE WHEN o IS NULL THEN 1e0 ELSE 0e0 END) AS without_oracle, avg(CASE WHEN o IS NULL OR b IS NULL THEN NULL WHEN o >= b THEN 1e0 ELSE 0e0 END) AS oracle_leads,
  avg(o - b) AS mean_margin, min(o - b) AS least_margin, CAST(sum(n - items) AS DOUBLE) AS repeated_items FROM p GROUP BY split)
SELECT split, metric, round(value, 9) AS value FROM w UNPIVOT INCLUDE NULLS (value FOR metric IN (groups, candidates, mean_group, without_oracle, oracle_leads, mean_margin, least_margin, repeated_items))
UNION ALL SELECT split, 'source:' || coalesce(s, 'none'), CAST(count(*) AS DOUBLE) FROM c GROUP BY ALL
"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per group: the best oracle, same-user and context candidate with text, score and source time."""
    rows = table(spark, sf_dir, "review_candidates").where(f"group_id IS NOT NULL AND {_SCORED}")
    best = lambda s: F.max(F.when(F.col("candidate_source") == s, F.struct("reward_total", "row_id", "candidate_text", "source_time")))
    wide = rows.groupBy("group_id").agg(F.min("split").alias("split"), F.min("reviewed_at").alias("_"), *[best(s).alias(s) for s in ("oracle", "same_user", "context")])
    return wide.select("group_id", "split", *[c for s in ("oracle", "same_user", "context") for c in (F.col(f"{s}.candidate_text").alias(f"{s}_text"), F.col(f"{s}.reward_total").alias(f"{s}_score"), F.col(f"{s}.source_time").alias(f"{s}_time"))])


_WIDE = f"""
b AS (SELECT group_id, candidate_source AS s, min(split) OVER (PARTITION BY group_id) AS split, reward_total AS v, candidate_text AS t, source_time AS m, row_number() OVER (PARTITION BY group_id, candidate_source ORDER BY reward_total DESC, row_id DESC) AS r FROM review_candidates WHERE group_id IS NOT NULL AND {_SCORED}),
w AS (SELECT group_id, min(split) AS split, {', '.join(f"max({c}) FILTER (r = 1 AND s = '{s}') AS {s}_{n}" for s in ('oracle', 'same_user', 'context') for c, n in (('t', 'text'), ('v', 'score'), ('m', 'time')))} FROM b GROUP BY group_id)
"""


def wide_group_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distributions of the groups in wide form per split, one metric a row."""
    kinds = {s: (f"{s}_text", f"{s}_score") for s in ("oracle", "same_user", "context")}
    return groups.wide_audit(_wide(spark, sf_dir), "split", kinds).select("split", "metric", *_r("value"))


def _is_oracle(s: str) -> str:
    return f"avg(CASE WHEN {s}_text IS NULL OR oracle_text IS NULL THEN NULL WHEN {_compact(f'{s}_text')} = {_compact('oracle_text')} THEN 1e0 ELSE 0e0 END) AS {s}_is_oracle"


_METRICS = [f"{s}_{m}" for s in ("oracle", "same_user", "context") for m in ("share", "mean")] + ["same_user_is_oracle", "context_is_oracle", "one_score", "groups"]
WIDE_AUDIT = f"""
WITH {_WIDE}, a AS (SELECT coalesce(split, 'none') AS split, CAST(count(*) AS DOUBLE) AS groups, {', '.join(f"avg(CASE WHEN {s}_text IS NOT NULL THEN 1e0 ELSE 0e0 END) AS {s}_share, avg({s}_score) AS {s}_mean" for s in ('oracle', 'same_user', 'context'))}, {_is_oracle('same_user')}, {_is_oracle('context')},
  avg(CASE WHEN len(list_distinct([round(oracle_score, 12), round(same_user_score, 12), round(context_score, 12)])) <= 1 THEN 1e0 ELSE 0e0 END) AS one_score FROM w GROUP BY ALL)
SELECT split, metric, round(value, 9) AS value FROM a UNPIVOT INCLUDE NULLS (value FOR metric IN ({', '.join(_METRICS)}))
"""


def window_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Same-user and context answers whose likeness to the oracle's lies in their window."""
    kinds = {"same_user": {"text": "same_user_text", "similarity": (0.05, 0.95), "score": "same_user_score", "before": ("same_user_time", "oracle_time")}, "context": {"text": "context_text", "similarity": (0.1, 0.9), "score": "context_score"}}
    wide = _wide(spark, sf_dir).withColumn("oracle_time", F.coalesce("oracle_time", F.lit("9")))
    return groups.window_negatives(wide, "oracle_text", kinds).select("group_id", "negative_type", *_r("char_similarity", "negative_score"))


def _grams(x: str) -> str:
    return sql.GRAMS.replace("(k)", f"({x})").replace("substr(k,", f"substr({x},")


def _tail(x: str) -> str:
    return f"right(array_to_string(regexp_extract_all({x}, '[一-鿿]'), ''), 8)"


def _window(s: str, low: float, high: float, more: str) -> str:
    d = "(CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN 2e0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) ELSE 0e0 END)"
    return f"""SELECT group_id, CASE WHEN {d} >= 0.7e0 AND {d} < 1 AND {_tail('oracle_text')} <> {_tail('t')} THEN 'slot_mismatch_{s}' ELSE '{s}' END AS negative_type, round({d}, 9) AS char_similarity, round(v, 9) AS negative_score
FROM (SELECT *, {_grams('a')} AS ga, {_grams('b')} AS gb FROM (SELECT group_id, oracle_text, {s}_text AS t, {s}_score AS v, {s}_time AS m, oracle_time AS om, {_compact(f'{s}_text')} AS a, {_compact('oracle_text')} AS b FROM w)) WHERE a <> '' AND a <> b AND oracle_text IS NOT NULL {more} AND {d} BETWEEN {low}e0 AND {high}e0"""


WINDOWS = "WITH " + _WIDE + _window("same_user", 0.05, 0.95, "AND m < coalesce(om, '9')") + " UNION ALL " + _window("context", 0.1, 0.9, "")


def hard_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split how many groups have a context answer, and how many of these are hard to tell from the oracle's."""
    hard = groups.context_is_hard(F.col("oracle_text"), F.col("context_text"), 0.3)
    return _wide(spark, sf_dir).where("context_text IS NOT NULL").groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(hard, F.lit(False)).cast("bigint")).alias("n_hard"))


HARD = f"""
WITH {_WIDE}, x AS (SELECT split, {_compact('oracle_text')} AS a, {_compact('context_text')} AS b FROM w WHERE context_text IS NOT NULL), y AS (SELECT split, a, b, {_grams('a')} AS ga, {_grams('b')} AS gb FROM x)
SELECT split, count(*) AS n, CAST(sum(CASE WHEN a <> '' AND b <> '' AND a <> b AND 2e0 * len(list_intersect(ga, gb)) / (len(ga) + len(gb)) >= 0.3e0 THEN 1 ELSE 0 END) AS BIGINT) AS n_hard FROM y GROUP BY split
"""


def candidate_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many groups and answers show each sign of poor generation."""
    return groups.monitor(table(spark, sf_dir, "review_candidates"), "group_id", "candidate_source", "candidate_text", "oracle_text", 3, 3)


MONITOR = f"""
WITH c AS (SELECT group_id AS g, candidate_source AS s, {_compact('candidate_text')} AS k, {_compact('oracle_text')} AS p FROM review_candidates WHERE group_id IS NOT NULL),
e AS (SELECT g, count(DISTINCT nullif(k, '')) AS u, coalesce(bool_or(s = 'oracle'), false) AS has FROM c GROUP BY g)
SELECT 'few_answers' AS code, count(*) AS n FROM e WHERE u < 3 UNION ALL SELECT 'no_oracle', count(*) FROM e WHERE NOT has UNION ALL SELECT 'copied_from_prompt', count(*) FROM c WHERE coalesce(s, '') <> 'oracle' AND length(k) >= 4 AND contains(p, k)
UNION ALL SELECT 'popular_answer', count(*) FROM (SELECT k FROM c WHERE k <> '' AND (s IS NULL OR s <> 'oracle') GROUP BY k HAVING count(*) > 3)
"""

_LIMITS = {"oracle": 1, "same_user": 2, "context": 1, "cross_user": 2, "model": 3}


def candidate_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's candidates put together from its sources, the best few of each, every text once."""
    rows = table(spark, sf_dir, "review_candidates").where(f"candidate_id IS NOT NULL AND {_SCORED}").select("group_id", "candidate_source", "candidate_id", "candidate_text", F.round("reward_total", 9).alias("reward_total"), "row_id")
    first = causal.keep_first(rows, ["group_id", "candidate_source", "candidate_id"], [F.col("reward_total").desc(), F.col("row_id")])
    return groups.candidate_sets(first, "group_id", "candidate_source", "candidate_id", "candidate_text", "reward_total", _LIMITS).select("group_id", "place", "candidate_source", "candidate_id")


_RANKS = " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(_LIMITS))
_MOST = " ".join(f"WHEN '{s}' THEN {n}" for s, n in _LIMITS.items())
SETS = f"""
WITH c AS (SELECT *, round(reward_total, 9) AS v, row_number() OVER (PARTITION BY group_id, candidate_source, candidate_id ORDER BY round(reward_total, 9) DESC, row_id) AS f FROM review_candidates WHERE candidate_id IS NOT NULL AND group_id IS NOT NULL AND candidate_source IS NOT NULL AND {_SCORED}),
k AS (SELECT group_id, candidate_source AS s, candidate_id, v, {_compact('candidate_text')} AS k, CASE candidate_source {_RANKS} END AS r FROM c WHERE f = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, s, k ORDER BY v DESC, candidate_id) AS x FROM k WHERE k <> ''),
n AS (SELECT *, row_number() OVER (PARTITION BY group_id, s ORDER BY v DESC, candidate_id) AS n FROM o WHERE x = 1),
u AS (SELECT *, row_number() OVER (PARTITION BY group_id, k ORDER BY r, n) AS y FROM n WHERE n <= CASE s {_MOST} END)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY r, n) AS INTEGER) AS place, s AS candidate_source, candidate_id FROM u WHERE y = 1
"""


def reviewed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates after their review: dropped ones gone, the mass of every group shared anew."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL").select("row_id", "group_id", "decision", "current_target_probability")
    return groups.reviewed(rows, "row_id", "group_id", "decision", "current_target_probability").select("row_id", "group_id", *_r("new_probability"))


REVIEWED = """
WITH k AS (SELECT row_id, group_id, greatest(coalesce(current_target_probability, 0), 0) AS p FROM review_candidates WHERE group_id IS NOT NULL AND (decision IS NULL OR decision NOT LIKE 'drop!_%' ESCAPE '!')),
t AS (SELECT group_id, sum(p) AS t, count(*) AS n FROM k GROUP BY group_id)
SELECT row_id, group_id, round(CASE WHEN t > 0 THEN p / t ELSE 1e0 / n END, 9) AS new_probability FROM k JOIN t USING (group_id)
"""


def annotated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success of every trajectory, replaced where its task has a dated review by somebody: kept counts 1, anything else 0."""
    done = table(spark, sf_dir, "gui_step_examples").where("task_id IS NOT NULL").groupBy("task_id").agg(F.avg("task_success").alias("task_success"))
    first = causal.keep_first(table(spark, sf_dir, "gui_step_examples").where("task_id IS NOT NULL AND split IS NOT NULL AND user_id IS NOT NULL AND trim(user_id) <> '' AND progress IS NOT NULL"), ["task_id"], [F.col("ingested_at").desc(), F.col("row_id").desc()])
    notes = first.select("task_id", F.round("progress", 3).alias("task_success"), F.col("user_id").alias("annotator"), F.col("split").alias("evidence"))
    return groups.overridden(done, notes, "task_id", "task_success", ["annotator", "evidence"]).select("task_id", "annotated", *_r("task_success"))


ANNOTATED = """
WITH d AS (SELECT task_id, avg(task_success) AS s FROM gui_step_examples WHERE task_id IS NOT NULL GROUP BY task_id),
n AS (SELECT task_id, round(progress, 3) AS p FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ingested_at DESC NULLS LAST, row_id DESC) AS r FROM gui_step_examples WHERE task_id IS NOT NULL AND split IS NOT NULL AND user_id IS NOT NULL AND trim(user_id, ' ') <> '' AND progress IS NOT NULL) WHERE r = 1)
SELECT task_id, p IS NOT NULL AS annotated, round(coalesce(p, s), 9) AS task_success FROM d LEFT JOIN n USING (task_id)
"""


def reweighted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs drawn with replacement by their weight."""
    return groups.reweighted(table(spark, sf_dir, "preference_pairs").select("row_id", "papo_weight"), "row_id", "papo_weight", 11).select("row_id", "copy")


REWEIGHTED = """
WITH t AS (SELECT row_id, CAST(floor(w) + CASE WHEN u < w - floor(w) THEN 1 ELSE 0 END AS INTEGER) AS n FROM (SELECT row_id, greatest(coalesce(papo_weight, 0), 0) AS w, CAST('0x' || substr(md5('11:' || row_id), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM preference_pairs))
SELECT row_id, CAST(unnest(range(1, n + 1)) AS INTEGER) AS copy FROM t WHERE n > 0
"""

# Actions that stand for anything else that could have been done.
_POOL = ("click:ok", "click:back", "scroll:down", "scroll:up", "type:hello", "wait", "press_home")


def null_action_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three actions for every step that it didn't take, those of its own type first."""
    rows = table(spark, sf_dir, "gui_step_examples").select("row_id", F.lower("current_action.action_type").alias("kind"), "current_action.target")
    action = F.concat_ws(":", "kind", F.lower("target"))
    return rows.select("row_id", F.array_join(groups.null_actions(action, _POOL, F.coalesce("kind", F.lit("~")), 3), "|").alias("negatives"))


_LIST = "[" + ", ".join(f"'{p}'" for p in _POOL) + "]"
NULLS = f"""
WITH r AS (SELECT row_id, coalesce(lower(current_action.action_type), '~') AS k, concat_ws(':', lower(current_action.action_type), lower(current_action.target)) AS a FROM gui_step_examples)
SELECT row_id, array_to_string((list_filter({_LIST}, lambda p: starts_with(p, k) AND p <> a) || list_filter({_LIST}, lambda p: NOT starts_with(p, k) AND p <> a))[1 : 3], '|') AS negatives FROM r
"""


def fused_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the policies over their actions by log frequency, smoothed, and mixed."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return groups.log_frequency_policy(counts, ["user_id"], "event_type", "n").select("user_id", "event_type", "n", *_r("log_policy", "smoothed_policy", "fused_policy"))


FUSED = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT user_id, sum(n) AS s, count(*) AS k, sum(ln(1 + n)) AS l FROM c GROUP BY user_id),
p AS (SELECT user_id, event_type, n, ln(1 + n) / l AS a, (n + 1e0) / (s + k) AS b, 1 - exp(-s / 5e0) AS g FROM c JOIN t USING (user_id))
SELECT user_id, event_type, n, round(a, 9) AS log_policy, round(b, 9) AS smoothed_policy, round((1 - g) * a + g * b, 9) AS fused_policy FROM p
"""


def teacher_forced_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every step of every episode in three prompt variants, with the actions of the valid steps before it."""
    steps = table(spark, sf_dir, "gui_step_examples").where("source_trajectory_id IS NOT NULL").select("row_id", "source_trajectory_id", F.coalesce(F.size("action_history"), F.lit(0)).alias("n"), F.concat_ws(":", "current_action.action_type", "current_action.target").alias("action"), "ui_tree")
    out = groups.teacher_forced(steps, "row_id", "source_trajectory_id", [F.col("n"), F.col("row_id")], F.col("action"), F.col("ui_tree").isNotNull(), ("plain", "with_history", "with_profile"))
    return out.select("row_id", "variant", F.size("prior").alias("n_prior"), F.md5(F.array_join("prior", ">")).alias("prior"))


FORCED = """
WITH s AS (SELECT row_id, list(CASE WHEN ui_tree IS NOT NULL THEN concat_ws(':', current_action.action_type, current_action.target) END) OVER (PARTITION BY source_trajectory_id ORDER BY coalesce(len(action_history), 0), row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM gui_step_examples WHERE source_trajectory_id IS NOT NULL),
q AS (SELECT row_id, list_filter(coalesce(p, []), lambda x: x IS NOT NULL) AS p FROM s)
SELECT row_id, variant, CAST(len(p) AS INTEGER) AS n_prior, md5(array_to_string(p, '>')) AS prior FROM q, (VALUES ('plain'), ('with_history'), ('with_profile')) v(variant)
"""


def target_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every position of every trajectory: progress, what lies ahead, and the next three actions as target."""
    lists = table(spark, sf_dir, "trajectory_records").select("row_id", F.transform("actions", lambda a: F.coalesce(a.action_type, F.lit("?"))).alias("types"))
    at = lists.select("row_id", "types", F.posexplode("types").alias("pos", "_"))
    return at.select("row_id", "pos", F.round((F.col("pos") + 1) / F.size("types"), 9).alias("progress"), (F.size("types") - F.col("pos") - 1).alias("n_future"), F.array_join(F.slice("types", F.col("pos") + 1, F.lit(3)), ">").alias("target"))


SLICES = """
WITH r AS (SELECT row_id, list_transform(actions, lambda a: coalesce(a.action_type, '?')) AS t, unnest(range(len(actions))) AS pos FROM trajectory_records WHERE actions IS NOT NULL)
SELECT row_id, CAST(pos AS INTEGER) AS pos, round((pos + 1) / CAST(len(t) AS DOUBLE), 9) AS progress, CAST(len(t) - pos - 1 AS INTEGER) AS n_future, array_to_string(t[pos + 1 : pos + 3], '>') AS target FROM r
"""


def oracle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which letter the oracles stand when groups are put in a seeded order."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND candidate_id IS NOT NULL")
    first = causal.keep_first(rows.select("group_id", "candidate_id", "candidate_source", "row_id"), ["group_id", "candidate_id"], [F.col("row_id")])
    return groups.position_shares(first, "group_id", "candidate_id", F.col("candidate_source") == "oracle", 5).select("letter", "n", *_r("share"))


POSITIONS = """
WITH f AS (SELECT group_id, candidate_id, candidate_source, row_number() OVER (PARTITION BY group_id, candidate_id ORDER BY row_id) AS c FROM review_candidates WHERE group_id IS NOT NULL AND candidate_id IS NOT NULL),
p AS (SELECT candidate_source, row_number() OVER (PARTITION BY group_id ORDER BY md5('5:' || group_id || ':' || candidate_id), candidate_id) AS n FROM f WHERE c = 1), o AS (SELECT chr(CAST(64 + n AS INTEGER)) AS letter, count(*) AS n FROM p WHERE n <= 26 AND candidate_source = 'oracle' GROUP BY ALL)
SELECT letter, n, round(n / CAST(sum(n) OVER () AS DOUBLE), 9) AS share FROM o
"""


def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's sheet: all candidates of 100 groups, one of every split and class of decision in turn."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL").select("group_id", "row_id", "split", "decision", "candidate_source", "current_target_probability")
    each = rows.groupBy("group_id").agg(F.min("split").alias("split"), F.coalesce(F.max("decision"), F.lit("open")).alias("state"))
    chosen = sampling.round_robin(each, ["split", "state"], "group_id", 100, 3).select("group_id", F.col("turn").cast("int").alias("turn"))
    return rows.join(F.broadcast(chosen), "group_id").select("row_id", "group_id", "turn", "candidate_source")


SHEET = """
WITH e AS (SELECT group_id, min(split) AS split, coalesce(max(decision), 'open') AS state FROM review_candidates WHERE group_id IS NOT NULL GROUP BY group_id),
r AS (SELECT *, row_number() OVER (PARTITION BY split, state ORDER BY md5('3:' || group_id), group_id) AS turn FROM e), c AS (SELECT * FROM r ORDER BY turn, coalesce(split, ''), state, group_id LIMIT 100)
SELECT row_id, group_id, CAST(turn AS INTEGER) AS turn, candidate_source FROM review_candidates JOIN c USING (group_id)
"""

QUERIES = {
    "answer_frequency": (answer_frequency, FREQUENCY), "rejected_negatives": (rejected_negatives, REJECTED), "selected_negatives": (selected_negatives, SELECTED), "preference_targets": (preference_targets, TARGETS), "preference_set_audit": (preference_set_audit, SET_AUDIT),
    "wide_group_audit": (wide_group_audit, WIDE_AUDIT), "window_negatives": (window_negatives, WINDOWS), "hard_contexts": (hard_contexts, HARD), "candidate_monitor": (candidate_monitor, MONITOR), "candidate_sets": (candidate_sets, SETS), "reviewed_groups": (reviewed_groups, REVIEWED),
    "annotated_results": (annotated_results, ANNOTATED), "reweighted_pairs": (reweighted_pairs, REWEIGHTED), "null_action_samples": (null_action_samples, NULLS), "fused_policies": (fused_policies, FUSED), "teacher_forced_prompts": (teacher_forced_prompts, FORCED), "target_slices": (target_slices, SLICES),
    "oracle_positions": (oracle_positions, POSITIONS), "review_sheet": (review_sheet, SHEET),
}
