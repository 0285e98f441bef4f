"""Queries that run single functions and small operators over whole tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.functions import actions, scores, text
from pathloom.operators import causal, evaluation, exports, preference, quality, retrieval, sampling, stats, steps, training
from pathloom.plans.sql import GRAMS, key
from pathloom.sources import readers, screens, sinks
from pathloom.storage import shared_dir, table

_SCORED = "reward_total IS NOT NULL AND NOT isnan(reward_total)"
_BLANKS = r"[\t-\r\x{85}\p{Z}]"


def _r(*names: str) -> list:
    return [F.round(n, 9).alias(n) for n in names]


def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate text collapsed, compact and clean (as digests), and its last ideographs."""
    c = F.col("candidate_text")
    rows = table(spark, sf_dir, "review_candidates").where("candidate_text IS NOT NULL")
    return rows.select("row_id", F.md5(text.collapse(c)).alias("collapsed"), F.md5(text.key_compact(c)).alias("compact"), F.md5(text.key_clean(c)).alias("clean"), text.tail_ideographs(c).alias("tail"))


KEYS = f"""
SELECT row_id, md5(trim(regexp_replace(candidate_text, '{_BLANKS}+', ' ', 'g'), ' ')) AS collapsed, md5(lower(regexp_replace(candidate_text, '{_BLANKS}+', '', 'g'))) AS compact,
  md5(replace(lower(regexp_replace(candidate_text, '{_BLANKS}+', '', 'g')), chr(65533), '')) AS clean, right(array_to_string(regexp_extract_all(candidate_text, '[一-鿿]'), ''), 8) AS tail FROM review_candidates WHERE candidate_text IS NOT NULL
"""


def action_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre, area and ninth of the screen of every action with a box, and its key."""
    rows = table(spark, sf_dir, "trajectory_records").select("row_id", F.posexplode("actions").alias("pos", "a")).where("size(a.bbox) = 4 AND NOT exists(a.bbox, x -> x IS NULL)")
    at = actions.center(F.col("a.bbox"))
    key = actions.action_key(F.col("a.action_type"), F.col("a.target"), F.col("a.text"))
    return rows.select("row_id", "pos", at.x.alias("x"), at.y.alias("y"), F.round(actions.area(F.col("a.bbox")).cast("double"), 3).alias("area"), actions.region(at.x, at.y).alias("region"), actions.inside(at.x, at.y, F.col("a.bbox")).alias("inside"), key.alias("key"))


GEOMETRY = """
WITH a AS (SELECT row_id, unnest(range(len(actions))) AS pos, actions FROM trajectory_records WHERE actions IS NOT NULL), b AS (SELECT row_id, pos, actions[pos + 1] AS a, actions[pos + 1].bbox AS b FROM a),
c AS (SELECT *, CAST(trunc((b[1] + b[3]) / 2) AS INTEGER) AS x, CAST(trunc((b[2] + b[4]) / 2) AS INTEGER) AS y FROM b WHERE len(b) = 4 AND len(list_filter(b, lambda v: v IS NULL)) = 0),
d AS (SELECT *, CASE WHEN y < 600 THEN 'top' WHEN y > 1800 THEN 'bottom' ELSE 'middle' END AS v, CASE WHEN x < 1080 * 0.33e0 THEN 'left' WHEN x > 1080 * 0.67e0 THEN 'right' ELSE 'center' END AS h FROM c)
SELECT row_id, CAST(pos AS INTEGER) AS pos, x, y, round(CAST(trunc(greatest(0, b[3] - b[1])) AS BIGINT) * greatest(0, b[4] - b[2]), 3) AS area, CASE WHEN v = 'middle' AND h = 'center' THEN 'center' ELSE v || '_' || h END AS region,
  x BETWEEN b[1] AND b[3] AND y BETWEEN b[2] AND b[4] AS inside, lower(trim(coalesce(a.action_type, ''), ' ')) || '|' || lower(trim(coalesce(a.target, ''), ' ')) || '|' || lower(trim(coalesce(a.text, ''), ' ')) AS key FROM d
"""


def screen_affordances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many actions every screen offers (at most six), and the first of them."""
    rows = table(spark, sf_dir, "gui_step_examples").where("ui_tree IS NOT NULL").select("row_id", actions.affordances(F.col("ui_tree")).alias("a"))
    return rows.select("row_id", F.size("a").alias("n"), F.get("a", F.lit(0)).action_type.alias("first_type"), F.get("a", F.lit(0)).target.alias("first_target"))


AFFORDANCES = r"""
WITH l AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(ui_tree, '\r?\n'), lambda x: trim(x, ' ')), lambda x: regexp_matches(x, '(?i)(button|clickable|link|tab|checkbox|input|search|textbox)')) AS l FROM gui_step_examples WHERE ui_tree IS NOT NULL),
n AS (SELECT row_id, list_transform(l, lambda x: {'f': regexp_matches(x, '(?i)(input|textbox|search)'), 's': regexp_matches(x, '(?i)scroll'), 't': coalesce(nullif(trim(regexp_extract(x, '([A-Za-z0-9][A-Za-z0-9 _-]{1,40})', 1), ' '), ''), substr(x, 1, 40))}) AS l FROM l),
b AS (SELECT row_id, list_transform(l, lambda x: CASE WHEN x.f THEN 'type|' ELSE 'click|' END || x.t) AS a, list_transform(list_filter(l, lambda x: x.s), lambda x: 'scroll|' || x.t) AS s FROM n)
SELECT row_id, CAST(least(6, len(list_distinct(a || s))) AS INTEGER) AS n, split_part(a[1], '|', 1) AS first_type, substr(a[1], instr(a[1], '|') + 1) AS first_target FROM b
"""


def reward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reward of every candidate put together anew, its evidence, pair weight and class as a negative."""
    rows = table(spark, sf_dir, "review_candidates").select("row_id", F.coalesce("candidate_text", F.lit("")).alias("t"), "reward_task", "reward_user")
    task, user, key = F.col("reward_task"), F.col("reward_user"), text.key_compact(F.col("t"))
    ratio = F.ln((F.coalesce(user, F.lit(0.0)) + 1e-6) / (F.coalesce(task, F.lit(0.0)) + 1e-6))
    reward = scores.weighted_reward(task=task, user=user, context=F.lit(0.5), specificity=scores.specificity(key))
    kind = retrieval.negative_class(F.filter(F.array(F.when(key == "", "empty")), lambda x: x.isNotNull()), F.coalesce(task, F.lit(0.0)), F.coalesce(user, F.lit(0.0)))
    return rows.select("row_id", F.round(reward, 9).alias("reward"), F.round(scores.evidence(ratio, 0.7), 9).alias("evidence"), F.round(scores.pair_weight(F.coalesce(task - user, F.lit(0.0)), F.lit(0.2), 0.5, 0.3), 9).alias("pair_weight"), kind.alias("kind"))


REWARD = f"""
WITH r AS (SELECT row_id, lower(regexp_replace(coalesce(candidate_text, ''), '{_BLANKS}+', '', 'g')) AS k, reward_task AS t, reward_user AS u FROM review_candidates),
s AS (SELECT *, CASE WHEN length(k) < 4 THEN length(k) / 4e0 WHEN length(k) <= 48 THEN 1e0 ELSE greatest(0e0, 1 - (length(k) - 48) / 96e0) END AS s, (abs(coalesce(t - u, 0)) - 0.1e0) / 0.3e0 AS m FROM r)
SELECT row_id, round(0.55e0 * coalesce(t, 0) + 0.2e0 * coalesce(u, 0) + 0.15e0 * 0.5e0 + 0.1e0 * s, 9) AS reward, round(tanh(ln((coalesce(u, 0) + 1e-6) / (coalesce(t, 0) + 1e-6)) / 0.7e0), 9) AS evidence, round(1 / (1 + exp(-m)), 9) AS pair_weight,
  CASE WHEN k = '' THEN 'invalid' WHEN coalesce(t, 0) >= 0.92e0 THEN 'pseudo_negative' WHEN coalesce(t, 0) <= 0.2e0 AND coalesce(u, 0) <= 0.2e0 THEN 'easy_negative' ELSE 'valid_hard_negative' END AS kind FROM s
"""


def execution_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, the logged history of every step against its source trajectory and against the screen states' number of actions."""
    one = lambda c: F.transform(c, lambda a: F.substring(F.lower(F.coalesce(a.action_type, F.lit("?"))), 1, 1))
    golden = causal.keep_first(table(spark, sf_dir, "trajectory_records").where("trajectory_id IS NOT NULL"), ["trajectory_id"], [F.col("ingested_at"), F.col("row_id")]).select(F.col("trajectory_id").alias("source_trajectory_id"), one("actions").alias("golden"))
    rows = table(spark, sf_dir, "gui_step_examples").select("source_trajectory_id", "split", one("action_history").alias("agent"), (F.col("task_success") >= 0.5).alias("done"), F.array(F.lit("c"), F.lit("s")).alias("other")).join(golden, "source_trajectory_id")
    return evaluation.execution_metrics(rows, ["split"], "agent", "golden", "other", "done").select("split", "n_evaluated", F.round("similarity", 2).alias("similarity"), *_r("success", "own_similarity", "other_similarity", "step_ratio_of_successes"))


EXECUTION = """
WITH g AS (SELECT trajectory_id AS j, list_transform(actions, lambda a: substr(lower(coalesce(a.action_type, '?')), 1, 1)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY ingested_at NULLS FIRST, row_id) AS r FROM trajectory_records WHERE trajectory_id IS NOT NULL) WHERE r = 1),
x AS (SELECT split, array_to_string(list_transform(action_history, lambda a: substr(lower(coalesce(a.action_type, '?')), 1, 1)), '') AS a, array_to_string(g, '') AS g, coalesce(task_success >= 0.5e0, false) AS d FROM gui_step_examples JOIN g ON j = source_trajectory_id),
y AS (SELECT split, d AND length(a) <= 2.5e0 * length(g) AS ok, 1 - levenshtein(a, g) / CAST(greatest(length(a), length(g)) AS DOUBLE) AS si, 1 - levenshtein(a, 'cs') / CAST(greatest(length(a), 2) AS DOUBLE) AS sii, length(a) / CAST(length(g) AS DOUBLE) AS ratio FROM x WHERE length(a) > 0 AND length(g) > 0)
SELECT split, count(*) AS n_evaluated, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 9) AS success, round(avg(si / greatest(sii, 1e-8)), 2) AS similarity, round(avg(si), 9) AS own_similarity, round(avg(sii), 9) AS other_similarity, round(avg(ratio) FILTER (ok), 9) AS step_ratio_of_successes FROM y GROUP BY split
"""


def model_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of every source per split as a table with one column a split, and their mean."""
    rows = table(spark, sf_dir, "review_candidates").where(f"{_SCORED} AND candidate_source IS NOT NULL")
    out = evaluation.model_result_table(rows, "candidate_source", "split", "reward_total", ["train", "validation", "test"])
    return out.select("candidate_source", *_r("train", "validation", "test", "macro"))


RESULTS = f"""
WITH m AS (SELECT candidate_source, avg(reward_total) FILTER (split = 'train') AS a, avg(reward_total) FILTER (split = 'validation') AS b, avg(reward_total) FILTER (split = 'test') AS c FROM review_candidates WHERE {_SCORED} AND candidate_source IS NOT NULL GROUP BY ALL)
SELECT candidate_source, round(a, 9) AS train, round(b, 9) AS validation, round(c, 9) AS test, round((a + b + c) / 3, 9) AS macro FROM m
"""


def source_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reward of every source per split less the oracle's."""
    rows = table(spark, sf_dir, "review_candidates").where(f"{_SCORED} AND candidate_source IS NOT NULL").groupBy("candidate_source", "split").agg(F.avg("reward_total").alias("reward"))
    return evaluation.gains_over_base(rows, "candidate_source", "split", "reward", "oracle").select("candidate_source", "split", *_r("reward", "gain"))


GAINS = f"""
WITH m AS (SELECT candidate_source, split, avg(reward_total) AS r FROM review_candidates WHERE {_SCORED} AND candidate_source IS NOT NULL GROUP BY ALL)
SELECT m.candidate_source, m.split, round(m.r, 9) AS reward, round(m.r - b.r, 9) AS gain FROM m LEFT JOIN m b ON b.split = m.split AND b.candidate_source = 'oracle' WHERE m.candidate_source <> 'oracle'
"""


def decision_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a dated review keeps a candidate that ranks first, per source and over all."""
    rows = table(spark, sf_dir, "review_candidates").where("decision IS NOT NULL AND current_rank IS NOT NULL AND candidate_source IS NOT NULL")
    rows = rows.select("candidate_source", (F.col("current_rank") == 1).alias("first"), (F.col("decision") == "keep").alias("kept"))
    return evaluation.accuracy_by_category(rows, "candidate_source", "first", "kept").select("candidate_source", "n", *_r("accuracy"))


ACCURACY = """
WITH r AS (SELECT candidate_source, CASE WHEN (current_rank = 1) = (decision = 'keep') THEN 1e0 ELSE 0e0 END AS hit FROM review_candidates WHERE decision IS NOT NULL AND current_rank IS NOT NULL AND candidate_source IS NOT NULL)
SELECT candidate_source, count(*) AS n, round(avg(hit), 9) AS accuracy FROM r GROUP BY candidate_source UNION ALL SELECT 'average', count(*), round(avg(hit), 9) FROM r
"""


def log_anomaly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that read like trouble in a training log, per kind."""
    return evaluation.log_anomalies(table(spark, sf_dir, "documents"), "text").groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


ANOMALIES = r"""
SELECT kind, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)(^|[^\p{L}\p{N}_])(nan|inf(inity)?)($|[^\p{L}\p{N}_])') THEN 'not_finite' END, CASE WHEN regexp_matches(text, '(?i)out of memory|(^|[^\p{L}\p{N}_])oom($|[^\p{L}\p{N}_])') THEN 'out_of_memory' END,
  CASE WHEN regexp_matches(text, 'Traceback \(most recent call last\)') THEN 'traceback' END, CASE WHEN regexp_matches(text, '(?i)overflow') THEN 'overflow' END], lambda x: x IS NOT NULL)) AS kind FROM documents) GROUP BY kind
"""


def margin_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the user's reward margins follow the task's, weighted by probability."""
    rows = table(spark, sf_dir, "review_candidates").where("reward_task IS NOT NULL AND reward_user IS NOT NULL AND current_target_probability IS NOT NULL")
    out = evaluation.pair_accuracy(rows.select((F.col("reward_user") - 0.5).alias("margin"), (F.col("reward_task") - 0.5).alias("target"), F.col("current_target_probability").alias("weight")), "margin", "target", "weight")
    return out.select(*_r("accuracy", "mae", "mse", "rmse"))


AGREEMENT = """
WITH r AS (SELECT reward_user - 0.5e0 AS m, reward_task - 0.5e0 AS t, current_target_probability AS w FROM review_candidates WHERE reward_task IS NOT NULL AND reward_user IS NOT NULL AND current_target_probability IS NOT NULL)
SELECT round(sum(CASE WHEN sign(m) = sign(t) THEN w ELSE 0 END) / greatest(sum(w), 1e-8), 9) AS accuracy, round(avg(abs(m - t)), 9) AS mae, round(avg((m - t) * (m - t)), 9) AS mse, round(sqrt(avg((m - t) * (m - t))), 9) AS rmse FROM r
"""


def group_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of a group's user rewards plus its worst distance from certainty."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND reward_user IS NOT NULL").withColumn("penalty", 1 - F.col("reward_task"))
    return evaluation.uncertainty(rows, ["group_id"], "reward_user", "penalty").select("group_id", *_r("uncertainty"))


UNCERTAINTY = "SELECT group_id, round(CASE WHEN count(reward_user) > 1 THEN stddev_pop(reward_user) ELSE 0 END + coalesce(max(1 - reward_task), 0), 9) AS uncertainty FROM review_candidates WHERE group_id IS NOT NULL AND reward_user IS NOT NULL GROUP BY group_id"


def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group's candidate of highest reward, then of highest user reward, the first on ties."""
    rows = table(spark, sf_dir, "review_candidates").where(f"group_id IS NOT NULL AND candidate_id IS NOT NULL AND {_SCORED}")
    return evaluation.best_leaves(rows, "group_id", "reward_total", "reward_user", "candidate_id").select("group_id", "candidate_id")


BEST = f"SELECT group_id, first(candidate_id ORDER BY reward_total DESC, coalesce(reward_user, 0) DESC, candidate_id) AS candidate_id FROM review_candidates WHERE group_id IS NOT NULL AND candidate_id IS NOT NULL AND {_SCORED} GROUP BY group_id"


def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source or decision tag occurs in the joined tags of all candidates."""
    rows = table(spark, sf_dir, "review_candidates").select(text.merge_sources(F.concat_ws("+", "candidate_source", "decision"), F.col("candidate_source")).alias("tags"))
    return evaluation.source_counts(rows, "tags")


TAGS = "SELECT t AS source, count(*) AS n FROM (SELECT unnest(list_distinct([candidate_source, decision])) AS t FROM review_candidates) WHERE t IS NOT NULL GROUP BY t"


def common_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty most frequent instructions (a report)."""
    return evaluation.most_common(table(spark, sf_dir, "gui_step_examples").where("instruction IS NOT NULL"), "instruction", 20)


COMMON = "SELECT instruction, count(*) AS n FROM gui_step_examples WHERE instruction IS NOT NULL GROUP BY instruction ORDER BY n DESC, instruction LIMIT 20"


def largest_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty candidates whose reward falls furthest below their probability (a report)."""
    rows = table(spark, sf_dir, "review_candidates").where(f"{_SCORED} AND current_target_probability IS NOT NULL").select("row_id", F.round(F.col("reward_total") - F.col("current_target_probability"), 9).alias("delta"))
    return evaluation.top_changes(rows, "delta", "row_id", 50)


LOSSES = f"SELECT row_id, round(reward_total - current_target_probability, 9) AS delta FROM review_candidates WHERE {_SCORED} AND current_target_probability IS NOT NULL ORDER BY delta, row_id LIMIT 50"


def upsampled_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chats drawn up to one and a half times their number."""
    chats = table(spark, sf_dir, "sft_messages").select("row_id")
    return sampling.resampled(chats, "row_id", chats.count() * 3 // 2, 9)


UPSAMPLED = """
WITH r AS (SELECT row_id, row_number() OVER (ORDER BY md5('9:' || row_id), row_id) AS n, count(*) OVER () AS t FROM sft_messages)
SELECT row_id, 1 AS copy FROM r UNION ALL SELECT row_id, 2 FROM r WHERE n <= t * 3 // 2 - t
"""


def sliced_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third chat from place 10 to 200 of their order."""
    return sampling.at_positions(table(spark, sf_dir, "sft_messages").select("row_id", "sample_id"), [F.col("row_id")], 10, 200, 3)


SLICED = "SELECT row_id, sample_id FROM (SELECT row_id, sample_id, row_number() OVER (ORDER BY row_id) - 1 AS p FROM sft_messages) WHERE p >= 10 AND p < 200 AND (p - 10) % 3 = 0"


def merged_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the three best supported actions with the sources they come from."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.when(F.col("value") > 50, "high").otherwise("low").alias("source"))
    return preference.merge_candidates(rows, ["user_id"], "event_type", "source", 3)


MERGED = """
WITH m AS (SELECT user_id, event_type, count(*) AS support, array_to_string(list_sort(list(DISTINCT CASE WHEN value > 50 THEN 'high' ELSE 'low' END)), '+') AS sources FROM events GROUP BY ALL)
SELECT user_id, event_type, support, sources, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type = 'unknown', support DESC, sources, event_type) AS place FROM m) WHERE place <= 3
"""


def gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the number and size of its margins."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND reward_task IS NOT NULL AND reward_user IS NOT NULL").select("group_id", F.col("reward_user").alias("m"), (F.col("reward_user") - 0.5 * F.col("reward_task")).alias("z"), (0.1 + 0.1 * F.col("reward_task")).alias("u"))
    out = steps.gate_features(rows, "group_id", "m", "z", "u")
    return out.select("group_id", "n_pairs", *[F.round(c, 9).alias(c) for c in ("mean_margin", "max_margin", "mean_null_margin", "mean_uncertainty")])


FEATURES = """
SELECT group_id, count(*) AS n_pairs, round(avg(abs(reward_user)), 9) AS mean_margin, round(max(abs(reward_user)), 9) AS max_margin, round(avg(abs(reward_user - 0.5e0 * reward_task)), 9) AS mean_null_margin, round(avg(0.1e0 + 0.1e0 * reward_task), 9) AS mean_uncertainty
FROM review_candidates WHERE group_id IS NOT NULL AND reward_task IS NOT NULL AND reward_user IS NOT NULL GROUP BY group_id
"""


def observed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action with the state logged at its stamp, or else the one at its place."""
    rows = table(spark, sf_dir, "trajectory_records")
    own = rows.select("row_id", F.posexplode("actions").alias("pos", "a")).select("row_id", "pos", F.format_string("%05d", F.col("pos") * 3).alias("stamp"))
    seen = rows.select("row_id", F.posexplode("states").alias("i", "state")).select("row_id", F.format_string("%05d", F.col("i") * 2).alias("stamp"), "state")
    return steps.matched_observations(own, seen, "row_id", "pos", "stamp", "state").select("row_id", "pos", "state", "matched_by")


OBSERVED = """
WITH a AS (SELECT row_id, unnest(range(len(actions))) AS pos, states FROM trajectory_records WHERE actions IS NOT NULL),
m AS (SELECT row_id, pos, CASE WHEN (pos * 3) % 2 = 0 AND pos * 3 // 2 < coalesce(len(states), 0) THEN states[pos * 3 // 2 + 1] END AS e, CASE WHEN pos < coalesce(len(states), 0) THEN states[pos + 1] END AS p FROM a)
SELECT row_id, CAST(pos AS INTEGER) AS pos, coalesce(e, p) AS state, CASE WHEN e IS NOT NULL THEN 'timestamp' WHEN p IS NOT NULL THEN 'position' ELSE 'none' END AS matched_by FROM m
"""


def history_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's history under each condition, as its number and its first episode."""
    past = F.transform("history_episode_ids", lambda h: F.struct(F.element_at(F.split(h, "__"), -1).alias("time"), h.alias("id")))
    rows = table(spark, sf_dir, "listwise_tasks").where("history_episode_ids IS NOT NULL").select("row_id", past.alias("h"))
    each = F.array(*[F.struct(F.lit(c).alias("condition"), retrieval.history_condition(F.col("h"), c).alias("kept")) for c in ("full", "none", "recent", "stale", "truncated", "last_half")])
    return rows.select("row_id", F.explode(each).alias("e")).select("row_id", "e.condition", F.size("e.kept").alias("n"), F.get("e.kept", F.lit(0)).time.alias("first_time"))


ABLATIONS = """
WITH h AS (SELECT row_id, list_transform(history_episode_ids, lambda h: split_part(h, '__', -1)) AS f, list_sort(list_transform(history_episode_ids, lambda h: split_part(h, '__', -1))) AS s FROM listwise_tasks WHERE history_episode_ids IS NOT NULL),
c AS (SELECT row_id, 'full' AS condition, f AS k FROM h UNION ALL SELECT row_id, 'none', f[1:0] FROM h UNION ALL SELECT row_id, 'recent', s[len(s):] FROM h UNION ALL SELECT row_id, 'stale', s[1:1] FROM h
  UNION ALL SELECT row_id, 'truncated', s[1:CAST(ceil(len(s) / 2e0) AS INTEGER)] FROM h UNION ALL SELECT row_id, 'last_half', s[len(s) // 2 + 1:] FROM h)
SELECT row_id, condition, CAST(len(k) AS INTEGER) AS n, k[1] AS first_time FROM c
"""


def conflicting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a group that come with different texts or rewards."""
    return quality.conflicting_keys(table(spark, sf_dir, "review_candidates").select("group_id", "candidate_id", "candidate_text", "reward_total"), ["group_id", "candidate_id"])


CONFLICTS = "SELECT group_id, candidate_id, count(*) AS n FROM (SELECT DISTINCT group_id, candidate_id, candidate_text, reward_total FROM review_candidates) GROUP BY ALL HAVING count(*) > 1"


def sft_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training chats of all tasks with an intent, as digests of their turns."""
    rows = table(spark, sf_dir, "listwise_tasks").select("row_id", F.concat_ws(" / ", "scenario", "app").alias("asked"), "intent", F.array(F.concat(F.lit("/data/img/"), F.col("row_id").cast("string"))).alias("images"))
    out = exports.sft_rows(rows, "row_id", F.col("asked"), F.col("intent"), F.col("images"), "/data", "Suggest.")
    return out.select("row_id", F.size("messages").alias("n_turns"), F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m.role, m.content)), "|")).alias("turns"), F.get("images", F.lit(0)).alias("image"))


SFT = "SELECT row_id, 3 AS n_turns, md5('system:Suggest.|user:<image>' || concat_ws(' / ', scenario, app) || '|assistant:' || intent) AS turns, 'img/' || row_id AS image FROM listwise_tasks WHERE trim(coalesce(intent, ''), ' ') <> ''"


def lettered_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six candidates of every group with their letters for a re-ranking prompt."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND candidate_id IS NOT NULL")
    first = causal.top_k(causal.keep_first(rows.select("group_id", "candidate_id", "candidate_text", "row_id"), ["group_id", "candidate_id"], [F.col("row_id")]), ["group_id"], [F.col("candidate_id")], 6)
    return exports.ranked_choices(first, "group_id", "candidate_id", "candidate_text", 4).select("group_id", "candidate_id", "letter")


LETTERS = """
WITH f AS (SELECT group_id, candidate_id FROM (SELECT DISTINCT group_id, candidate_id, dense_rank() OVER (PARTITION BY group_id ORDER BY candidate_id) AS k FROM review_candidates WHERE group_id IS NOT NULL AND candidate_id IS NOT NULL) WHERE k <= 6)
SELECT group_id, candidate_id, chr(CAST(64 + row_number() OVER (PARTITION BY group_id ORDER BY md5('4:' || group_id || ':' || candidate_id), candidate_id) AS INTEGER)) AS letter FROM f
"""


def next_token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of a trajectory's action types as predictions of the ones after them; clicks are ignored."""
    kind = lambda a: F.length(F.coalesce(a.action_type, F.lit("")))
    rows = table(spark, sf_dir, "trajectory_records").where("size(actions) > 1").select("row_id", F.transform("actions", kind).alias("p"), F.transform("actions", lambda a: F.when(a.action_type == "click", -100).otherwise(kind(a))).alias("y"))
    return rows.select("row_id", F.round(training.token_accuracy(F.col("p"), F.col("y")), 9).alias("accuracy"))


TOKENS = """
WITH l AS (SELECT row_id, list_transform(actions, lambda a: length(coalesce(a.action_type, ''))) AS p, list_transform(actions, lambda a: CASE WHEN a.action_type = 'click' THEN -100 ELSE length(coalesce(a.action_type, '')) END) AS y FROM trajectory_records WHERE len(actions) > 1),
c AS (SELECT row_id, list_filter(list_transform(range(1, len(p)), lambda i: CASE WHEN y[i + 1] = -100 THEN NULL WHEN p[i] = y[i + 1] THEN 1 ELSE 0 END), lambda x: x IS NOT NULL) AS h FROM l)
SELECT row_id, round(CASE WHEN len(h) > 0 THEN list_sum(h) / CAST(len(h) AS DOUBLE) END, 9) AS accuracy FROM c
"""


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads written as a text file and read back by the tolerant reader: lines with and without an error."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, sf_dir, "raw_task_lines").where("payload IS NOT NULL").select(F.translate("payload", "\r\n", "  ").alias("value")).write.text(path)
    found = readers.json_lines(spark, path, T.StructType([T.StructField("task_id", T.StringType())]))
    return found.groupBy("json_error").agg(F.count(F.lit(1)).alias("n"))


LINES = "SELECT CASE WHEN json_valid(p) THEN json_type(p) <> 'OBJECT' ELSE true END AS json_error, count(*) AS n FROM (SELECT translate(payload, chr(13) || chr(10), '  ') AS p FROM raw_task_lines WHERE payload IS NOT NULL) WHERE trim(p, ' ') <> '' GROUP BY 1"


def stored_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as CSV with a byte order mark and read back, numbers coerced."""
    path = f"{shared_dir(spark)}/sheet-{uuid.uuid4().hex}"
    columns = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    sinks.write_csv(table(spark, sf_dir, "supplier").select(*columns), path, columns)
    return readers.typed(readers.csv_rows(spark, path), numbers=["s_acctbal"], integers=["s_suppkey", "s_nationkey"]).select(*columns)


STORED = "SELECT CAST(s_suppkey AS INTEGER) AS s_suppkey, s_name, CAST(s_nationkey AS INTEGER) AS s_nationkey, CAST(s_acctbal AS DOUBLE) AS s_acctbal FROM supplier"

def _initials(c: str):
    return F.transform(c, lambda a: F.substring(F.lower(F.coalesce(a.action_type, F.lit("?"))), 1, 1))


def _sourced_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with their history, the action taken and their source trajectory's actions, as initials."""
    golden = causal.keep_first(table(spark, sf_dir, "trajectory_records").where("trajectory_id IS NOT NULL"), ["trajectory_id"], [F.col("ingested_at"), F.col("row_id")]).select(F.col("trajectory_id").alias("source_trajectory_id"), _initials("actions").alias("golden"))
    rows = table(spark, sf_dir, "gui_step_examples").select("row_id", "source_trajectory_id", "split", _initials("action_history").alias("agent"), F.substring(F.lower(F.coalesce("current_action.action_type", F.lit("?"))), 1, 1).alias("taken"))
    return rows.join(golden, "source_trajectory_id")


_SOURCED = """
g AS (SELECT trajectory_id AS j, list_transform(actions, lambda a: substr(lower(coalesce(a.action_type, '?')), 1, 1)) AS g FROM (SELECT *, row_number() OVER (PARTITION BY trajectory_id ORDER BY ingested_at NULLS FIRST, row_id) AS r FROM trajectory_records WHERE trajectory_id IS NOT NULL) WHERE r = 1),
st AS (SELECT row_id, j, split, list_transform(action_history, lambda a: substr(lower(coalesce(a.action_type, '?')), 1, 1)) AS a, substr(lower(coalesce(current_action.action_type, '?')), 1, 1) AS taken, g FROM gui_step_examples JOIN g ON j = source_trajectory_id)
"""


def proactive_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, how alike the histories of steps are to their sources, by pairs of actions and by edits."""
    rows = _sourced_steps(spark, sf_dir).select("split", F.array_join("golden", "").alias("target"), F.array_join("agent", "").alias("predicted"))
    out = evaluation.proactive_metrics(rows, ["split"], "target", "predicted", lambda a, b: text.dice(text.bigrams(a), text.bigrams(b)))
    return out.select("split", "n_rows", "n_evaluated", *_r("semantic", "edit", "similarity"))


def _pairs(x: str) -> str:
    return GRAMS.replace("(k)", f"({x})").replace("substr(k,", f"substr({x},")


PROACTIVE = f"""
WITH {_SOURCED}, t AS (SELECT split, coalesce(array_to_string(g, ''), '') AS t, coalesce(array_to_string(a, ''), '') AS p FROM st), u AS (SELECT *, t <> '' AND p <> '' AS ok, {_pairs('t')} AS gt, {_pairs('p')} AS gp FROM t),
s AS (SELECT split, CASE WHEN ok THEN 2e0 * len(list_intersect(gt, gp)) / (len(gt) + len(gp)) END AS s1, CASE WHEN ok THEN 1 - levenshtein(t, p) / CAST(greatest(length(t), length(p)) AS DOUBLE) END AS s2 FROM u)
SELECT split, count(*) AS n_rows, count(s1) AS n_evaluated, round(avg(s1), 9) AS semantic, round(avg(s2), 9) AS edit, round(avg((s1 + s2) / 2), 9) AS similarity FROM s GROUP BY split
"""


def prediction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split, how often the action taken is the source's at that place, and how alike whole episodes are."""
    rows = _sourced_steps(spark, sf_dir).select("split", "source_trajectory_id", "row_id", "taken", F.coalesce(F.get("golden", F.coalesce(F.size("agent"), F.lit(0))), F.lit("!")).alias("wanted"))
    return evaluation.prediction_report(rows, "split", "source_trajectory_id", "row_id", "taken", "wanted").select("split", "n_steps", *_r("accuracy", "sequence_similarity"))


PREDICTION = f"""
WITH {_SOURCED}, p AS (SELECT split, j, row_id, taken, coalesce(g[coalesce(len(a), 0) + 1], '!') AS wanted FROM st),
e AS (SELECT split, j, count(*) AS n, avg(CASE WHEN taken = wanted THEN 1e0 ELSE 0e0 END) AS acc, string_agg(taken, '' ORDER BY row_id) AS x, string_agg(wanted, '' ORDER BY row_id) AS y FROM p GROUP BY ALL)
SELECT split, CAST(sum(n) AS BIGINT) AS n_steps, round(sum(acc * n) / sum(n), 9) AS accuracy, round(avg(1 - levenshtein(x, y) / CAST(greatest(length(x), length(y)) AS DOUBLE)), 9) AS sequence_similarity FROM e GROUP BY split
"""


def score_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the trajectories of a split count as a result: all verified, any success."""
    rows = table(spark, sf_dir, "trajectory_records").select("split", (F.col("progress") >= 0.2).alias("success_verified"), (F.col("task_success") >= 0.5).alias("success"))
    return evaluation.score_gates(rows, "split").select("split", "n", "all_verified", "any_success", *_r("verified_success"))


VERDICTS = """
WITH r AS (SELECT split, progress >= 0.2e0 AS v, task_success >= 0.5e0 AS s FROM trajectory_records)
SELECT split, count(*) AS n, bool_and(coalesce(v, false)) AS all_verified, bool_or(s) AS any_success, round(avg(CASE WHEN v AND s IS NOT NULL THEN CAST(s AS INTEGER) END), 9) AS verified_success FROM r GROUP BY split
"""


def repeated_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every step the nearest progress among steps of the same instruction by its user and by others."""
    rows = table(spark, sf_dir, "gui_step_examples").where("instruction IS NOT NULL AND user_id IS NOT NULL AND progress IS NOT NULL").select("row_id", "user_id", text.key_alnum("instruction").alias("intent"), "progress").where("intent <> ''")
    out = retrieval.best_same_and_cross(rows, "intent", "user_id", 1 - F.abs(F.col("a.progress") - F.col("b.progress")), "row_id")
    return out.select("row_id", *_r("same", "cross"))


REPEATED = f"""
WITH r AS (SELECT row_id, user_id AS u, {key('instruction')} AS k, progress AS p FROM gui_step_examples WHERE instruction IS NOT NULL AND user_id IS NOT NULL AND progress IS NOT NULL)
SELECT a.row_id, round(max(1 - abs(a.p - b.p)) FILTER (a.u = b.u), 9) AS same, round(max(1 - abs(a.p - b.p)) FILTER (a.u <> b.u), 9) AS "cross" FROM r a JOIN r b ON a.k = b.k AND a.k <> '' AND a.row_id <> b.row_id GROUP BY a.row_id
"""


def nearest_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per group the same-user and the context candidate nearest in reward, of the three best of each."""
    rows = table(spark, sf_dir, "review_candidates").where(f"group_id IS NOT NULL AND candidate_id IS NOT NULL AND {_SCORED}").groupBy("group_id", "candidate_source", "candidate_id").agg(F.max("reward_total").alias("v"))
    side = lambda s, name: causal.top_k(rows.where(F.col("candidate_source") == s), ["group_id"], [F.col("v").desc(), F.col("candidate_id")], 3, "_n").select("group_id", F.col("candidate_id").alias(name), F.col("v").alias(f"{name}_v"))
    out = retrieval.nearest_pair(side("same_user", "mine"), side("context", "theirs"), ["group_id"], ("mine", "theirs"), F.round(F.abs(F.col("mine_v") - F.col("theirs_v")), 9))
    return out.select("group_id", "distance", "mine", "theirs")


NEAREST = f"""
WITH c AS (SELECT group_id, candidate_source AS s, candidate_id AS i, max(reward_total) AS v FROM review_candidates WHERE group_id IS NOT NULL AND candidate_id IS NOT NULL AND {_SCORED} GROUP BY ALL),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, s ORDER BY v DESC, i) AS n FROM c) WHERE n <= 3),
p AS (SELECT a.group_id, round(abs(a.v - b.v), 9) AS distance, a.i AS mine, b.i AS theirs FROM k a JOIN k b ON a.group_id = b.group_id AND a.s = 'same_user' AND b.s = 'context')
SELECT group_id, distance, mine, theirs FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY distance, mine, theirs) AS r FROM p) WHERE r = 1
"""


def exported_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference rows whose weight lies half a point over the least, as digests, with weight and soft target."""
    rows = table(spark, sf_dir, "preference_pairs").where("papo_weight IS NOT NULL")
    out = exports.pair_rows(rows, "row_id", F.col("task_id"), F.col("chosen.content"), F.col("rejected.content"), F.col("papo_weight") - 0.1, 0.5, 0.4)
    turns = F.concat_ws("|", F.get("messages", F.lit(0)).content, F.col("chosen.role"), F.col("chosen.content"), F.col("rejected.content"))
    return out.select("row_id", F.md5(turns).alias("turns"), *_r("weight", "target_probability"))


PAIR_ROWS = """
WITH p AS (SELECT *, papo_weight - 0.1e0 AS gap FROM preference_pairs WHERE papo_weight IS NOT NULL)
SELECT row_id, md5(concat_ws('|', task_id, 'assistant', chosen.content, rejected.content)) AS turns, round(least(3, greatest(0.5e0, 0.5e0 + 2 * gap)), 9) AS weight, round(greatest(0.55e0, least(0.98e0, 1 / (1 + exp(-gap / 0.4e0)))), 9) AS target_probability FROM p WHERE gap >= 0.5e0
"""


def repaired_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats with weight, soft target and relative image paths filled in."""
    rows = table(spark, sf_dir, "sft_messages").select("row_id", "papo_listwise_weight", F.transform("images", lambda p: F.concat(F.lit("/data/"), p)).alias("images"))
    out = exports.repaired(rows, F.coalesce("papo_listwise_weight", F.lit(0.0)), 0.3, "papo_listwise_weight", "images", "/data")
    return out.select("row_id", F.array_join("images", "|").alias("images"), *_r("papo_listwise_weight", "soft_target"))


REPAIRED = """
SELECT row_id, array_to_string(images, '|') AS images, round(CASE WHEN papo_listwise_weight > 0 THEN papo_listwise_weight ELSE least(3, greatest(0.5e0, 0.5e0 + 2 * coalesce(papo_listwise_weight, 0))) END, 9) AS papo_listwise_weight,
  round(greatest(0.55e0, least(0.98e0, 1 / (1 + exp(-coalesce(papo_listwise_weight, 0) / 0.3e0)))), 9) AS soft_target FROM sft_messages
"""


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random tenth of the chats held out, by hash."""
    return table(spark, sf_dir, "sft_messages").select("row_id", F.when(stats.hash_unit(F.lit(3), F.col("row_id")) < 0.1, "eval").otherwise("train").alias("part"))


HASH_SPLIT = "SELECT row_id, CASE WHEN CAST('0x' || substr(md5('3:' || row_id), 1, 8) AS BIGINT) / 4294967296e0 < 0.1e0 THEN 'eval' ELSE 'train' END AS part FROM sft_messages"


def raw_action_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logged actions written as raw lines and read back: label and confidence without a screen."""
    rows = table(spark, sf_dir, "trajectory_records").select("row_id", F.posexplode("actions").alias("pos", "a")).where("a.action_type IS NOT NULL")
    plain = F.regexp_replace(F.coalesce("a.target", F.lit("")), "['\"]", "")
    raw = F.concat(F.lower("a.action_type"), F.lit("(coordinates=("), F.col("pos").cast("string"), F.lit(", 9), content='"), plain, F.lit("')"))
    parsed = rows.select("row_id", "pos", actions.raw_action(raw).alias("r")).withColumn("node", F.lit(None).cast(screens.NODES.elementType))
    return parsed.select("row_id", "pos", "r.action_type", "r.x", actions.semantic_label(F.col("r"), F.col("node")).alias("label"), actions.confidence(F.col("r"), F.col("node")).alias("confidence"))


LABELS = r"""
WITH e AS (SELECT row_id, unnest(range(len(actions))) AS pos, actions FROM trajectory_records WHERE actions IS NOT NULL), a AS (SELECT row_id, pos, lower(actions[pos + 1].action_type) AS k, regexp_replace(coalesce(actions[pos + 1].target, ''), '[\x27"]', '', 'g') AS c FROM e WHERE actions[pos + 1].action_type IS NOT NULL),
t AS (SELECT *, CASE regexp_extract(k, '^\s*([a-zA-Z_]+)', 1) WHEN '' THEN 'unknown' WHEN 'press' THEN 'press_key' ELSE regexp_extract(k, '^\s*([a-zA-Z_]+)', 1) END AS v FROM a)
SELECT row_id, CAST(pos AS INTEGER) AS pos, v AS action_type, CAST(pos AS INTEGER) AS x, CASE WHEN v = 'scroll' THEN 'scroll:unknown' WHEN v = 'type' THEN 'input:TextField' WHEN v IN ('back', 'press_back') THEN 'navigate:back' WHEN v IN ('finished', 'finish') THEN 'finished' WHEN v = 'wait' THEN 'wait'
    WHEN v IN ('click', 'long_click') THEN 'select:' || CASE WHEN c <> '' THEN substr(c, 1, 48) ELSE 'unknown' END ELSE v END AS label, CASE WHEN c <> '' THEN 0.55e0 WHEN v IN ('scroll', 'wait', 'finished', 'finish') THEN 1e0 ELSE 0.2e0 END AS confidence FROM t
"""

QUERIES = {
    "text_keys": (text_keys, KEYS), "action_geometry": (action_geometry, GEOMETRY), "screen_affordances": (screen_affordances, AFFORDANCES), "reward_scores": (reward_scores, REWARD), "execution_report": (execution_report, EXECUTION), "model_results": (model_results, RESULTS),
    "source_gains": (source_gains, GAINS), "decision_accuracy": (decision_accuracy, ACCURACY), "log_anomaly_counts": (log_anomaly_counts, ANOMALIES), "margin_agreement": (margin_agreement, AGREEMENT), "group_uncertainty": (group_uncertainty, UNCERTAINTY),
    "best_candidates": (best_candidates, BEST), "tag_counts": (tag_counts, TAGS), "common_intents": (common_intents, COMMON), "largest_losses": (largest_losses, LOSSES), "upsampled_chats": (upsampled_chats, UPSAMPLED), "sliced_chats": (sliced_chats, SLICED),
    "merged_actions": (merged_actions, MERGED), "gate_features": (gate_features, FEATURES), "observed_states": (observed_states, OBSERVED), "history_ablations": (history_ablations, ABLATIONS), "conflicting_candidates": (conflicting_candidates, CONFLICTS), "sft_digests": (sft_digests, SFT),
    "lettered_choices": (lettered_choices, LETTERS), "next_token_accuracy": (next_token_accuracy, TOKENS), "stored_lines": (stored_lines, LINES), "stored_sheet": (stored_sheet, STORED),
    "proactive_report": (proactive_report, PROACTIVE), "prediction_accuracy": (prediction_accuracy, PREDICTION), "score_verdicts": (score_verdicts, VERDICTS), "repeated_intents": (repeated_intents, REPEATED), "nearest_candidates": (nearest_candidates, NEAREST),
    "exported_pairs": (exported_pairs, PAIR_ROWS), "repaired_chats": (repaired_chats, REPAIRED), "hash_split": (hash_split, HASH_SPLIT), "raw_action_labels": (raw_action_labels, LABELS),
}
