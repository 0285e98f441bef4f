"""Queries over the event log: episodes, transitions, trees and their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions.sequence import text_levenshtein_similarity
from pathloom.functions.text import jaccard
from pathloom.operators import causal, preference, ranking, stats
from pathloom.storage import cut, table



def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyyMMdd")).withColumn("state", F.concat("event_type", F.lit(":"), F.floor(k / 10).cast("string")))


def _episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user and day: the actions in order, as a string of initials and as a list."""
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    days = _events(spark, sf_dir).groupBy("user_id", "day").agg(steps.alias("s"))
    actions = F.transform("s", lambda x: x.event_type)
    return days.select("user_id", "day", actions.alias("actions"), F.array_join(F.transform("s", lambda x: F.substring(x.event_type, 1, 1)), "").alias("seq"))


EPISODES = """
ev AS (SELECT *, strftime(ts, '%Y%m%d') AS day, event_type || ':' || CAST(CAST(floor(CAST(props::JSON->>'$.k' AS INTEGER) / 10) AS INTEGER) AS VARCHAR) AS state FROM events),
ep AS (SELECT user_id, day, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS seq, list(event_type ORDER BY ts, event_id) AS actions FROM ev GROUP BY user_id, day)
"""


def strict_past_topk_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two earlier days of the same user whose actions are most alike, later ones first on ties."""
    days = _episodes(spark, sf_dir).select("user_id", "day", "seq")
    pairs = causal.strict_past_pairs(days, days, ["user_id"], "day")
    pairs = pairs.withColumn("similarity", F.round(text_levenshtein_similarity(F.col("seq"), F.col("seq_ref")), 6))
    best = causal.top_k(pairs, ["user_id", "day"], [F.col("similarity").desc(), F.col("day_ref").desc()], 2)
    return best.select("user_id", "day", "day_ref", "similarity", "rank")


STRICT_PAST = f"""
WITH {EPISODES},
p AS (SELECT t.user_id, t.day, h.day AS day_ref, round(1 - levenshtein(t.seq, h.seq) / CAST(greatest(length(t.seq), length(h.seq)) AS DOUBLE), 6) AS similarity
  FROM ep t JOIN ep h ON t.user_id = h.user_id AND h.day < t.day)
SELECT *, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY similarity DESC, day_ref DESC) AS rank0 FROM p) AS x(user_id, day, day_ref, similarity, rank) WHERE rank <= 2
""".replace("SELECT *, CAST(rank AS INTEGER) AS rank FROM (", "SELECT user_id, day, day_ref, similarity, CAST(rank AS INTEGER) AS rank FROM (")


def next_state_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = causal.transitions(_events(spark, sf_dir), ["user_id", "day"], [F.col("ts"), F.col("event_id")], "state")
    return out.select("event_id", "state", "next_state", "has_next", "terminal")


NEXT_STATE = f"""
WITH {EPISODES}, n AS (SELECT event_id, state, lead(state) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS next_state FROM ev)
SELECT event_id, state, next_state, next_state IS NOT NULL AS has_next, next_state IS NULL AS terminal FROM n
"""


def prior_action_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every step the actions of its day before it, joined, and how far the day has come."""
    order = [F.col("ts"), F.col("event_id")]
    out = causal.latest_before(_events(spark, sf_dir), ["user_id", "day"], order, 0, F.col("event_type"), "prior")
    progress = F.row_number().over(W.partitionBy("user_id", "day").orderBy(*order)) / F.count(F.lit(1)).over(W.partitionBy("user_id", "day"))
    return out.select("event_id", F.array_join("prior", ">").alias("prior"), F.round(progress, 6).alias("progress"))


PRIOR = f"""
WITH {EPISODES}
SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id, day ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prior,
  round(row_number() OVER (PARTITION BY user_id, day ORDER BY ts, event_id) / CAST(count(*) OVER (PARTITION BY user_id, day) AS DOUBLE), 6) AS progress FROM ev
"""


def chronological_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every event in its user's history, from 0."""
    out = ranking.ranked(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return out.select("event_id", "user_id", (F.col("rank") - 1).alias("chronological_rank"))


RANK = "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS chronological_rank FROM events"


def user_habit_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every user's actions and of pairs of successive actions."""
    pairs = causal.beside(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], {"after": "event_type"})
    one = pairs.groupBy("user_id", F.col("event_type").alias("habit")).agg(F.count(F.lit(1)).alias("n"))
    two = pairs.where("after IS NOT NULL").groupBy("user_id", F.concat_ws("\t", "event_type", "after").alias("habit")).agg(F.count(F.lit(1)).alias("n"))
    return one.unionByName(two)


HABITS = """
WITH p AS (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after FROM events)
SELECT user_id, event_type AS habit, count(*) AS n FROM p GROUP BY ALL
UNION ALL SELECT user_id, event_type || chr(9) || after AS habit, count(*) AS n FROM p WHERE after IS NOT NULL GROUP BY ALL
"""


def jaccard_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of the states of each day with those of the user's day before."""
    days = _events(spark, sf_dir).groupBy("user_id", "day").agg(F.collect_set("state").alias("tokens"))
    before = F.lag("tokens").over(W.partitionBy("user_id").orderBy("day"))
    out = days.select("user_id", "day", F.col("tokens"), before.alias("before")).where("before IS NOT NULL")
    return out.select("user_id", "day", F.round(jaccard(F.col("tokens"), F.col("before")), 6).alias("overlap"))


JACCARD = f"""
WITH {EPISODES}, d AS (SELECT user_id, day, list(DISTINCT state) AS tokens FROM ev GROUP BY ALL),
b AS (SELECT user_id, day, tokens, lag(tokens) OVER (PARTITION BY user_id ORDER BY day) AS before FROM d)
SELECT user_id, day, round(len(list_intersect(tokens, before)) / CAST(len(list_distinct(list_concat(tokens, before))) AS DOUBLE), 6) AS overlap FROM b WHERE before IS NOT NULL
"""


def _transition_table(spark: SparkSession, sf_dir: str, most: int = 4) -> DataFrame:
    """Per state the actions taken next with their support, and the state each most often led to."""
    order = W.partitionBy("user_id", "day").orderBy("ts", "event_id")
    steps = _events(spark, sf_dir).select("state", F.lead("event_type").over(order).alias("action"), F.lead("state").over(order).alias("following")).where("action IS NOT NULL")
    each = steps.groupBy("state", "action", "following").agg(F.count(F.lit(1)).alias("n"))
    moves = each.groupBy("state", "action").agg(F.sum("n").alias("support"), F.min(F.struct((-F.col("n")).alias("n"), F.col("following"))).alias("f"))
    place = F.row_number().over(W.partitionBy("state").orderBy(F.col("support").desc(), "action"))
    return moves.select("state", "action", "support", F.col("f.following").alias("following"), place.alias("place")).where(F.col("place") <= most)


TRANSITIONS = """
st AS (SELECT state, lead(event_type) OVER w AS action, lead(state) OVER w AS following FROM ev WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
ea AS (SELECT state, action, following, count(*) AS n FROM st WHERE action IS NOT NULL GROUP BY ALL),
mv AS (SELECT state, action, CAST(sum(n) AS BIGINT) AS support, first(following ORDER BY n DESC, following) AS following FROM ea GROUP BY state, action),
tt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY support DESC, action) AS place FROM mv) WHERE place <= 4)
"""


def transition_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _transition_table(spark, sf_dir).select("state", "action", "support", "following", F.col("place").cast("int").alias("place"))


CANDIDATES = f"WITH {EPISODES}, {TRANSITIONS} SELECT state, action, support, following, CAST(place AS INTEGER) AS place FROM tt"


def _tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three levels of expansion from every state: one row per leaf.

    The branching is bounded by the candidates kept per state, and each level is one equi join.
    """
    moves = cut(_transition_table(spark, sf_dir), "moves")
    step = lambda i: moves.select(F.col("state").alias(f"s{i}"), F.col("action").alias(f"a{i}"), F.col("support").alias(f"n{i}"), F.col("following").alias(f"s{i + 1}"), F.col("place").alias(f"p{i}"))
    return step(1).join(step(2), "s2").join(step(3), "s3").select("s1", "s2", "s3", "a1", "a2", "a3", "n1", "n2", "n3", "p1", "p2", "p3")


PATHS = """
pa AS (SELECT x.state AS s1, y.state AS s2, z.state AS s3, x.action AS a1, y.action AS a2, z.action AS a3, x.support AS n1, y.support AS n2, z.support AS n3, x.place AS p1, y.place AS p2, z.place AS p3
  FROM tt x JOIN tt y ON x.following = y.state JOIN tt z ON y.following = z.state)
"""


def transition_tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree_paths(spark, sf_dir).select(F.col("s1").alias("root"), F.concat_ws(">", "a1", "a2", "a3").alias("path"), (F.col("n1") + F.col("n2") + F.col("n3")).alias("support"))


TREE = f"WITH {EPISODES}, {TRANSITIONS}, {PATHS} SELECT s1 AS root, a1 || '>' || a2 || '>' || a3 AS path, n1 + n2 + n3 AS support FROM pa"


def _scored_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every traversal of an edge by a leaf, with the leaf's rewards against the greedy path of its root."""
    paths = _tree_paths(spark, sf_dir).withColumn("seq", F.concat(*[F.substring(f"a{i}", 1, 1) for i in (1, 2, 3)]))
    greedy = paths.where("p1 = 1 AND p2 = 1 AND p3 = 1").select("s1", F.col("seq").alias("target"))
    other = paths.where("p1 = 2 AND p2 = 1 AND p3 = 1").select("s1", F.col("seq").alias("cross"))
    leaves = paths.join(greedy, "s1").join(other, "s1", "left")
    same = text_levenshtein_similarity(F.col("seq"), F.col("target"))
    cross = F.coalesce(text_levenshtein_similarity(F.col("seq"), F.col("cross")), F.lit(0.0))
    task = F.when(same >= 0.5, 1.0).otherwise(0.0)
    pref = F.tanh(F.ln((same + 1e-6) / (cross + 1e-6)) / 0.2)
    leaves = leaves.withColumn("r_task", task).withColumn("r_pref", pref).withColumn("r_user", F.col("r_task") * (1 + 0.5 * F.col("r_pref")))
    nodes = [F.struct(F.lit(f"{i}:").alias("depth"), F.concat_ws(">", *[f"a{j}" for j in range(1, i)]).alias("prefix"), F.col(f"a{i}").alias("action"), F.col(f"n{i}").alias("support")) for i in (1, 2, 3)]
    return leaves.select(F.col("s1").alias("root"), F.explode(F.array(*nodes)).alias("e"), "r_task", "r_pref", "r_user").select("root", F.concat("e.depth", "e.prefix").alias("node"), "e.action", "e.support", F.lit(1.0).alias("weight"), "r_task", "r_pref", "r_user")


EDGES = """
sq AS (SELECT *, substr(a1, 1, 1) || substr(a2, 1, 1) || substr(a3, 1, 1) AS seq FROM pa),
gr AS (SELECT s1, seq AS target FROM sq WHERE p1 = 1 AND p2 = 1 AND p3 = 1), ot AS (SELECT s1, seq AS other FROM sq WHERE p1 = 2 AND p2 = 1 AND p3 = 1),
lv0 AS (SELECT sq.*, 1 - levenshtein(seq, target) / CAST(3 AS DOUBLE) AS same, coalesce(1 - levenshtein(seq, other) / CAST(3 AS DOUBLE), 0) AS crs FROM sq JOIN gr USING (s1) LEFT JOIN ot USING (s1)),
lv AS (SELECT *, CASE WHEN same >= 0.5 THEN 1e0 ELSE 0e0 END AS r_task, tanh(ln((same + 1e-6) / (crs + 1e-6)) / 0.2e0) AS r_pref FROM lv0),
ed AS (SELECT s1 AS root, '1:' AS node, a1 AS action, n1 AS support, r_task, r_pref, r_task * (1 + 0.5e0 * r_pref) AS r_user FROM lv
  UNION ALL SELECT s1, '2:' || a1, a2, n2, r_task, r_pref, r_task * (1 + 0.5e0 * r_pref) FROM lv
  UNION ALL SELECT s1, '3:' || a1 || '>' || a2, a3, n3, r_task, r_pref, r_task * (1 + 0.5e0 * r_pref) FROM lv),
va0 AS (SELECT root, node, action, CAST(sum(support) AS DOUBLE) AS support, avg(r_user) AS q_user, avg(r_task) AS q_task, avg(r_pref) AS q_pref, stddev_pop(r_user) AS spread, count(*) AS n_paths FROM ed GROUP BY ALL),
va AS (SELECT *, 1 / sqrt(support + 1) + CASE WHEN n_paths > 1 THEN spread ELSE 0 END AS uncertainty, q_user - 0.1e0 * (1 / sqrt(support + 1) + CASE WHEN n_paths > 1 THEN spread ELSE 0 END) - q_task AS a_delta FROM va0)
"""
_TREE_SQL = f"WITH {EPISODES}, {TRANSITIONS}, {PATHS}, {EDGES}"


def leaf_reward_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = preference.propagated_values(_scored_edges(spark, sf_dir), ["root", "node", "action"], 0.1, 5.0)
    return values.select("root", "node", "action", "support", "n_paths", *[F.round(c, 6).alias(c) for c in ("q_user", "q_task", "q_pref", "uncertainty", "a_delta", "coverage")])


PROPAGATION = _TREE_SQL + "SELECT root, node, action, support, n_paths, round(q_user, 6) AS q_user, round(q_task, 6) AS q_task, round(q_pref, 6) AS q_pref, round(uncertainty, 6) AS uncertainty, round(a_delta, 6) AS a_delta, round(1 - exp(-support / 5), 6) AS coverage FROM va"


def node_advantages(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _scored_edges(spark, sf_dir).groupBy("root", "node", "action").agg(F.sum("support").cast("double").alias("support"), F.avg("r_user").alias("r_user"), F.avg("r_task").alias("r_task"))
    out = preference.node_advantages(edges, ["root", "node"], 0.1)
    return out.select("root", "node", "action", *[F.round(c, 6).alias(c) for c in ("a_user", "a_task", "uncertainty", "a_delta")])


ADVANTAGES = _TREE_SQL + """, ad AS (SELECT root, node, action, q_user - avg(q_user) OVER w AS a_user, q_task - avg(q_task) OVER w AS a_task,
  1 / sqrt(support + 1) + CASE WHEN count(*) OVER w > 1 THEN stddev_pop(q_user) OVER w ELSE 0 END AS uncertainty FROM va WINDOW w AS (PARTITION BY root, node))
SELECT root, node, action, round(a_user, 6) AS a_user, round(a_task, 6) AS a_task, round(uncertainty, 6) AS uncertainty, round(a_user - 0.1e0 * uncertainty - a_task, 6) AS a_delta FROM ad"""


def residual_values_and_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = preference.propagated_values(_scored_edges(spark, sf_dir), ["root", "node", "action"], 0.1, 5.0)
    out = preference.residual_policy(values, ["root", "node"], 0.5)
    return out.select("root", "node", "action", F.round("base_probability", 6).alias("base_probability"), F.round("target_probability", 6).alias("target_probability"))


POLICY = _TREE_SQL + """, po AS (SELECT root, node, action, support / sum(support) OVER (PARTITION BY root, node) AS base, a_delta FROM va),
lg AS (SELECT *, ln(base) + a_delta / 0.5e0 AS l FROM po), ex AS (SELECT *, exp(l - max(l) OVER (PARTITION BY root, node)) AS e FROM lg)
SELECT root, node, action, round(base, 6) AS base_probability, round(e / sum(e) OVER (PARTITION BY root, node), 6) AS target_probability FROM ex"""


def preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = preference.propagated_values(_scored_edges(spark, sf_dir), ["root", "node", "action"], 0.1, 5.0)
    values = cut(values.withColumn("a_delta", F.round("a_delta", 6)), "values")
    out = preference.pairs_within(values, ["root", "node"], "action", "a_delta", 0.05, 0.2, 5.0, 0.1)
    return out.select("root", "node", "positive", "negative", *[F.round(c, 6).alias(c) for c in ("gap", "target_probability", "weight")])


PAIRS = _TREE_SQL + """, rv AS (SELECT root, node, action, round(a_delta, 6) AS a FROM va)
SELECT x.root, x.node, x.action AS positive, y.action AS negative, round(x.a - y.a, 6) AS gap, round(1 / (1 + exp(-(x.a - y.a) / 0.1e0)), 6) AS target_probability, round(least(5e0, (x.a - y.a) / 0.2e0), 6) AS weight
FROM rv x JOIN rv y USING (root, node) WHERE x.a - y.a > 0.05"""


_POISSON = "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.73575888234288467 THEN 1 WHEN u < 0.91969860292860584 THEN 2 WHEN u < 0.98101184312384626 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.99940581518241833 THEN 5 WHEN u < 0.99991675885071207 THEN 6 ELSE 7 END"
BOOTSTRAP = f"""
WITH us AS (SELECT user_id, round(avg(value), 6) AS m FROM events GROUP BY user_id),
dr AS (SELECT d, m, CAST('0x' || substr(md5('42:' || d || ':' || user_id), 1, 8) AS BIGINT) / 4294967296e0 AS u FROM us, range(1000) AS r(d)),
me AS (SELECT d, sum({_POISSON} * m) / sum({_POISSON}) AS m FROM dr GROUP BY d)
SELECT (SELECT count(*) FROM us) AS n_units, (SELECT round(avg(m), 6) FROM us) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low, round(quantile_cont(m, 0.975), 6) AS ci_high FROM me
"""


def bootstrap_ci_user_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the users' mean values with a 95 % interval over users, of the evaluator's 1000 draws."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("m"))
    out = stats.bootstrap_mean(users, "user_id", "m", 1000)
    return out.select("n_units", *[F.round(c, 6).alias(c) for c in ("mean", "ci_low", "ci_high")])


def top_actions_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per action: events, users, share of all events, mean value."""
    events = table(spark, sf_dir, "events")
    per = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("n_users"), F.round(F.avg("value"), 6).alias("mean_value"))
    return per.select("event_type", "n", "n_users", "mean_value", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))


AUDIT = "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(avg(value), 6) AS mean_value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM events GROUP BY event_type"


def user_longitudinal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _events(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("day").alias("active_days"), F.count_distinct("state").alias("n_states"), F.datediff(F.max("ts"), F.min("ts")).alias("span_days"))
    return out


COVERAGE = f"WITH {EPISODES} SELECT user_id, count(DISTINCT day) AS active_days, count(DISTINCT state) AS n_states, CAST(date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS INTEGER) AS span_days FROM ev GROUP BY user_id"


def best_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user the event of least value, the earliest on ties (the checkpoint rule over any log)."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.min(F.struct("value", "event_id")).alias("b")).select("user_id", F.col("b.event_id").alias("event_id"), F.col("b.value").alias("value"))


CHECKPOINT = "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r = 1"


def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per action and six hours (not in the reference: an extra that also runs as a stream)."""
    from pathloom.streaming.windows import tumbling_counts

    return tumbling_counts(table(spark, sf_dir, "events"), "ts", "event_type", "6 hours")


WINDOWED = "SELECT event_type, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events GROUP BY ALL"

QUERIES = {
    "strict_past_topk_reference": (strict_past_topk_reference, STRICT_PAST), "next_state_transitions": (next_state_transitions, NEXT_STATE),
    "prior_action_prefix": (prior_action_prefix, PRIOR), "chronological_rank": (chronological_rank, RANK), "user_habit_profile": (user_habit_profile, HABITS),
    "jaccard_tokens": (jaccard_tokens, JACCARD), "transition_candidates": (transition_candidates, CANDIDATES), "transition_tree_edges": (transition_tree_edges, TREE),
    "leaf_reward_propagation": (leaf_reward_propagation, PROPAGATION), "node_advantages": (node_advantages, ADVANTAGES),
    "residual_values_and_policy": (residual_values_and_policy, POLICY), "preference_pairs": (preference_pairs, PAIRS), "bootstrap_ci_user_1000": (bootstrap_ci_user_1000, BOOTSTRAP),
    "top_actions_audit": (top_actions_audit, AUDIT), "user_longitudinal_coverage": (user_longitudinal_coverage, COVERAGE), "best_checkpoint": (best_checkpoint, CHECKPOINT),
    "windowed_counts": (windowed_counts, WINDOWED),
}
