"""Queries over tasks, candidates, preference rows and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathloom.functions import actions, scores, text
from pathloom.operators import causal, evaluation, exports, nearest, preference, quality, ranking, retrieval, rules, sampling, stats, training
from pathloom.plans import sql
from pathloom.storage import cut, passing, table

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def latest_fraction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest tenth of each user's tasks, at least one, is held out."""
    tasks = table(spark, sf_dir, "listwise_tasks").select("row_id", "user_id", "episode_time")
    return causal.latest_fraction_split(tasks, "user_id", [F.col("episode_time"), F.col("row_id")], 0.1, 1).select("row_id", "part")


SPLIT = """
WITH r AS (SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY episode_time NULLS FIRST, row_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM listwise_tasks)
SELECT row_id, CASE WHEN n >= 2 AND rn > n - least(greatest(1, ceil(n * 0.1e0)), n - 1) THEN 'eval' ELSE 'train' END AS part FROM r
"""


def split_leakage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per pair of splits: users, episodes and tasks that both name."""
    tasks = table(spark, sf_dir, "listwise_tasks")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("user_id", "episode_id", "task_id")])
    seen = tasks.select("target_split", F.explode(kinds).alias("k")).select("target_split", "k.*").where("value IS NOT NULL AND target_split IS NOT NULL").distinct()
    both = seen.groupBy("kind", "value").agg(F.array_sort(F.collect_set("target_split")).alias("s")).where(F.size("s") > 1)
    pairs = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b > a), lambda b: F.concat(a, F.lit("|"), b))))
    return both.select("kind", F.explode(pairs).alias("pair")).groupBy("kind", "pair").agg(F.count(F.lit(1)).alias("n_shared"))


LEAKAGE = """
WITH s AS (SELECT DISTINCT target_split, 'user_id' AS kind, user_id AS value FROM listwise_tasks UNION SELECT DISTINCT target_split, 'episode_id', episode_id FROM listwise_tasks UNION SELECT DISTINCT target_split, 'task_id', task_id FROM listwise_tasks)
SELECT a.kind, a.target_split || '|' || b.target_split AS pair, count(*) AS n_shared FROM s a JOIN s b ON a.kind = b.kind AND a.value = b.value AND a.target_split < b.target_split GROUP BY ALL
"""


def unseen_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out tasks of users without a train task (anti join), nulls among them."""
    tasks = table(spark, sf_dir, "listwise_tasks")
    held = tasks.where("target_split IN ('validation', 'test')").select("row_id", "user_id", "target_split")
    return causal.without_keys(held, tasks.where("target_split = 'train' AND user_id IS NOT NULL"), ["user_id"]).select("row_id", "user_id", "target_split")


UNSEEN = "SELECT row_id, user_id, target_split FROM listwise_tasks t WHERE target_split IN ('validation', 'test') AND NOT EXISTS (SELECT 1 FROM listwise_tasks x WHERE x.target_split = 'train' AND x.user_id = t.user_id)"


def hour_similarity_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each task against the same user's task before: hour similarity and context score."""
    tasks = table(spark, sf_dir, "listwise_tasks").where("user_id IS NOT NULL").select("row_id", "user_id", "episode_time", "scenario")
    out = causal.beside(tasks, ["user_id"], [F.col("episode_time"), F.col("row_id")], {"before": "episode_time", "scenario_before": "scenario"}, -1)
    t, b = F.col("episode_time"), F.col("before")
    return out.select("row_id", F.round(scores.hour_similarity(t, b), 6).alias("hour_similarity"), F.round(scores.context_score(F.col("scenario"), F.col("scenario_before"), t, b), 6).alias("context"))


HOURS = """
WITH p AS (SELECT row_id, scenario, try_cast(substr(episode_time, 10, 2) AS INTEGER) AS h, lag(scenario) OVER w AS sb, try_cast(substr(lag(episode_time) OVER w, 10, 2) AS INTEGER) AS hb
  FROM listwise_tasks WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY episode_time NULLS FIRST, row_id)),
s AS (SELECT *, 1 - least(abs(h - hb), 24 - abs(h - hb)) / 12e0 AS sim FROM p)
SELECT row_id, round(coalesce(sim, 0), 6) AS hour_similarity, round(0.5e0 * coalesce(CAST(scenario = sb AS INTEGER), 0) + 0.5e0 * coalesce(sim, 0.5e0), 6) AS context FROM s
"""


def bigram_dice_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all the user's earlier tasks the one most alike by character pairs of the intent."""
    tasks = table(spark, sf_dir, "listwise_tasks").where("user_id IS NOT NULL AND intent IS NOT NULL")
    place = F.row_number().over(W.partitionBy("user_id").orderBy("episode_time", "row_id"))
    keyed = cut(tasks.select("row_id", "user_id", place.alias("place"), text.key_alnum("intent").alias("key")), "keyed")
    return nearest.best_of_same_user(keyed, "user_id", F.col("place"), "key", late=False).select("row_id", "reference", "similarity")


DICE_WHOLE = f"""
WITH t AS (SELECT row_id, user_id, {sql.key('intent')} AS k, row_number() OVER (PARTITION BY user_id ORDER BY episode_time NULLS FIRST, row_id) AS rn FROM listwise_tasks WHERE user_id IS NOT NULL AND intent IS NOT NULL),
g AS (SELECT row_id, user_id, rn, {sql.GRAMS} AS grams FROM t),
p AS (SELECT a.row_id, b.row_id AS reference, round(CASE WHEN len(a.grams) > 0 AND len(b.grams) > 0 THEN 2e0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams)) ELSE 0 END, 6) AS similarity
  FROM g a JOIN g b ON a.user_id = b.user_id AND b.rn < a.rn)
SELECT row_id, reference, similarity FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY similarity DESC, reference DESC) AS r FROM p) WHERE r = 1
"""


def retrieval_modes_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six retrieval modes over every earlier task of the user, or every task of another user and age group.

    Age groups are those of the tasks' profiles; tasks without one have no cross-user reference.
    """
    tasks = table(spark, sf_dir, "listwise_tasks").where("user_id IS NOT NULL AND intent IS NOT NULL")
    tasks = cut(tasks.select("row_id", "user_id", F.element_at("user_profile", F.lit("age_group")).alias("age"), "episode_time", "intent", text.key_alnum("intent").alias("key")), "tasks")
    order = F.when(F.col("episode_time").isNotNull(), F.dense_rank().over(W.partitionBy("user_id").orderBy("episode_time")))
    keys = tasks.select("row_id", "key")

    def alike(drawn: DataFrame, mode: str) -> DataFrame:
        met = drawn.join(keys, "row_id").join(keys.toDF("reference", "theirs"), "reference")
        return nearest.likeness(met, "row_id", "key", "theirs").select("row_id", F.lit(mode).alias("mode"), "similarity")

    found = [
        lambda: alike(nearest.drawn_same_user(tasks, "user_id", "episode_time"), "random_same_user"),
        lambda: alike(nearest.drawn_other_group(tasks, "user_id", "age"), "random_cross_user"),
        lambda: nearest.best_of_same_user(tasks.withColumn("place", order), "user_id", F.col("place"), "key", "intent").withColumn("mode", F.when(F.col("mode") == "same", "same_user_top1").otherwise("same_user_no_same_intent")),
        lambda: nearest.best_of_other_group(tasks, "user_id", "age", "episode_time", "key").withColumn("mode", F.when(F.col("mode") == "any", "cross_user_top1").otherwise("cross_user_strict_past")),
    ]
    sums = None
    for rows in found:  # one after the other, so that only one's shuffles are on disk
        with passing(spark) as cuts:
            part = cut(rows().groupBy("mode").agg(F.count(F.lit(1)).alias("n"), F.count("similarity").alias("known"), F.sum("similarity").alias("total")), "mode")
            cuts.remove(part._cut_path)
        sums = part if sums is None else sums.unionByName(part)
    return sums.select("mode", "n", F.round(F.col("total") / F.col("known"), 5).alias("mean_similarity"))


_UNIT = "CAST('0x' || substr(md5('42:{}:' || {}), 1, 8) AS BIGINT) / 4294967296e0"
MODES_WHOLE = f"""
WITH t AS (SELECT row_id, user_id, user_profile['age_group'] AS age, episode_time AS tm, intent, {sql.key('intent')} AS k FROM listwise_tasks WHERE user_id IS NOT NULL AND intent IS NOT NULL),
g AS (SELECT *, {sql.GRAMS} AS grams FROM t),
p AS (SELECT a.row_id, b.row_id AS ref, a.user_id = b.user_id AS same, b.age <> a.age AS far, b.tm < a.tm AS past, a.intent <> b.intent AS other, b.tm AS rt, b.user_id AS ru,
    round(CASE WHEN len(a.grams) > 0 AND len(b.grams) > 0 THEN 2e0 * len(list_intersect(a.grams, b.grams)) / (len(a.grams) + len(b.grams)) ELSE 0 END, 6) AS similarity FROM g a, g b),
m AS (SELECT *, 'same_user_top1' AS mode FROM p WHERE same AND past UNION ALL SELECT *, 'same_user_no_same_intent' FROM p WHERE same AND past AND other
  UNION ALL SELECT *, 'cross_user_top1' FROM p WHERE NOT same AND far UNION ALL SELECT *, 'cross_user_strict_past' FROM p WHERE NOT same AND far AND past),
d AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY rt, ref) - 1 AS pos, floor({_UNIT.format('same', 'row_id')} * count(*) OVER (PARTITION BY row_id)) AS want, 'random_same_user' AS mode FROM p WHERE same AND past
  UNION ALL SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY ru, ref) - 1, floor({_UNIT.format('cross', 'row_id')} * count(*) OVER (PARTITION BY row_id)), 'random_cross_user' FROM p WHERE NOT same AND far),
r AS (SELECT row_id, mode, max(similarity) AS similarity FROM m GROUP BY ALL UNION ALL SELECT row_id, mode, similarity FROM d WHERE pos = want)
SELECT mode, count(*) AS n, round(avg(similarity), 5) AS mean_similarity FROM r GROUP BY mode
"""


def oracle_negative_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each group's oracle against its two best negatives that it beats by more than a margin."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND candidate_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total)")
    out = preference.oracle_pairs(rows, "group_id", "candidate_source", "candidate_id", "reward_total", 0.05, 2, 0.1)
    return out.select("group_id", "chosen", "rejected", F.col("place").cast("int").alias("place"), *R6("gap", "weight", "target_probability"))


ORACLE_PAIRS = """
WITH c AS (SELECT * FROM review_candidates WHERE group_id IS NOT NULL AND candidate_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total)),
o AS (SELECT group_id, first(candidate_id ORDER BY reward_total DESC, candidate_id) AS chosen, max(reward_total) AS s FROM c WHERE candidate_source = 'oracle' GROUP BY group_id),
n AS (SELECT group_id, candidate_id AS rejected, max(reward_total) AS r FROM c WHERE candidate_source <> 'oracle' GROUP BY ALL),
p AS (SELECT *, s - r AS gap, row_number() OVER (PARTITION BY group_id ORDER BY r DESC, rejected) AS place FROM n JOIN o USING (group_id) WHERE s - r > 0.05e0 AND rejected <> chosen)
SELECT group_id, chosen, rejected, CAST(place AS INTEGER) AS place, round(gap, 6) AS gap, round(least(5e0, greatest(0.1e0, gap / 0.05e0)), 6) AS weight, round(1 / (1 + exp(-gap / 0.1e0)), 6) AS target_probability FROM p WHERE place <= 2
"""


def weight_assign_v3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New weights of every candidate: the oracle's share fixed, the rest pro rata by probability."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL")
    first = rows.where("candidate_source = 'oracle'").groupBy("group_id").agg(F.min("row_id").alias("oracle_row"))
    rows = rows.join(first, "group_id").where("candidate_source IS NULL OR candidate_source <> 'oracle' OR row_id = oracle_row")
    out = preference.pro_rata_weights(rows, "group_id", F.col("row_id") == F.col("oracle_row"), "current_target_probability", 0.7)
    return out.select("row_id", "group_id", *R6("new_weight"))


WEIGHTS = """
WITH f AS (SELECT group_id, min(row_id) AS oracle_row FROM review_candidates WHERE group_id IS NOT NULL AND candidate_source = 'oracle' GROUP BY group_id),
c AS (SELECT r.row_id, group_id, r.row_id = oracle_row AS o, CASE WHEN r.row_id = oracle_row THEN 0 ELSE greatest(coalesce(current_target_probability, 0), 0) END AS w FROM review_candidates r JOIN f USING (group_id) WHERE candidate_source IS NULL OR candidate_source <> 'oracle' OR r.row_id = oracle_row),
t AS (SELECT *, sum(w) OVER g AS tot, sum(CASE WHEN o THEN 0 ELSE 1 END) OVER g AS n FROM c WINDOW g AS (PARTITION BY group_id))
SELECT row_id, group_id, round(CASE WHEN o AND n = 0 THEN 1 WHEN o THEN 0.7e0 WHEN tot > 0 THEN 0.3e0 * w / tot ELSE 0.3e0 / n END, 6) AS new_weight FROM t
"""


def clamped_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-in-caps probabilities of a group's oracle, same-user and context candidates."""
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total)")
    best = lambda s: F.max(F.when(F.col("candidate_source") == s, F.col("reward_total"))).alias(s)
    wide = rows.groupBy("group_id").agg(best("oracle"), best("same_user"), best("context")).where("oracle IS NOT NULL")
    out = preference.clamped_policy(wide, "oracle", "same_user", "context", temperature=0.15, max_same=0.25, max_context=0.2, min_oracle=0.6, max_oracle=0.9)
    return out.select("group_id", *[F.round(f"{c}_probability", 5).alias(f"{c}_probability") for c in ("oracle", "same_user", "context")])


CLAMPED = """
WITH w AS (SELECT group_id, max(reward_total) FILTER (candidate_source = 'oracle') AS o, max(reward_total) FILTER (candidate_source = 'same_user') AS s, max(reward_total) FILTER (candidate_source = 'context') AS c
  FROM review_candidates WHERE group_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total) GROUP BY group_id),
e AS (SELECT group_id, o, s, c, exp((o - m) / 0.15e0) AS eo, coalesce(exp((s - m) / 0.15e0), 0) AS es, coalesce(exp((c - m) / 0.15e0), 0) AS ec FROM (SELECT *, greatest(o, coalesce(s, -1e308), coalesce(c, -1e308)) AS m FROM w WHERE o IS NOT NULL)),
p AS (SELECT *, least(es / (eo + es + ec), 0.25e0) AS ps, least(ec / (eo + es + ec), 0.2e0) AS pc FROM e),
q AS (SELECT *, CASE WHEN 1 - ps - pc < 0.6e0 THEN CASE WHEN ps + pc > 0 THEN 0.4e0 / (ps + pc) ELSE 0 END ELSE 1 END AS k, CASE WHEN 1 - ps - pc < 0.6e0 THEN 0.6e0 ELSE 1 - (ps + pc) END AS po FROM p),
r AS (SELECT *, ps * k AS s1, pc * k AS c1, CASE WHEN s IS NOT NULL THEN greatest(0, 0.25e0 - ps * k) ELSE 0 END AS rs, CASE WHEN c IS NOT NULL THEN greatest(0, 0.2e0 - pc * k) ELSE 0 END AS rc, greatest(0, po - 0.9e0) AS need FROM q),
t AS (SELECT *, CASE WHEN need > 0 AND rs + rc > 0 THEN least(s1 + need * rs / (rs + rc), greatest(0.25e0, s1)) ELSE s1 END AS s2, CASE WHEN need > 0 AND rs + rc > 0 THEN least(c1 + need * rc / (rs + rc), greatest(0.2e0, c1)) ELSE c1 END AS c2 FROM r),
u AS (SELECT *, CASE WHEN need > 0 THEN 1 - s2 - c2 ELSE po END AS o2 FROM t)
SELECT group_id, round(o2 / h, 5) AS oracle_probability, round(CASE WHEN s IS NOT NULL THEN s2 / h END, 5) AS same_user_probability, round(CASE WHEN c IS NOT NULL THEN c2 / h END, 5) AS context_probability
FROM (SELECT *, o2 + CASE WHEN s IS NOT NULL THEN s2 ELSE 0 END + CASE WHEN c IS NOT NULL THEN c2 ELSE 0 END AS h FROM u)
"""


def frequency_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five uses of each source and text over the pool, the best rewarded."""
    rows = table(spark, sf_dir, "review_candidates").where("candidate_text IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total)")
    keyed = rows.select("row_id", "candidate_source", text.key_alnum("candidate_text").alias("key"), "reward_total")
    return causal.frequency_cap(keyed, ["candidate_source", "key"], [F.col("reward_total").desc(), F.col("row_id").desc()], 5).select("row_id", "candidate_source")


CAP = f"""
WITH k AS (SELECT row_id, candidate_source, row_number() OVER (PARTITION BY candidate_source, {sql.key('candidate_text')} ORDER BY reward_total DESC, row_id DESC) AS r
  FROM review_candidates WHERE candidate_text IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total))
SELECT row_id, candidate_source FROM k WHERE r <= 5
"""


def verbatim_copy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates whose compact text holds, or is held by, the group's oracle text."""
    rows = table(spark, sf_dir, "review_candidates").where("candidate_text IS NOT NULL AND oracle_text IS NOT NULL")
    a, b = F.regexp_replace(F.lower("candidate_text"), "[ \t\n]", ""), F.regexp_replace(F.lower("oracle_text"), "[ \t\n]", "")
    hit = text.copied_from(F.col("a"), F.array("b"))
    return rows.select("row_id", "candidate_source", a.alias("a"), b.alias("b")).where(hit).select("row_id", "candidate_source")


VERBATIM = """
WITH k AS (SELECT row_id, candidate_source, regexp_replace(lower(candidate_text), '[ \\t\\n]', '', 'g') AS a, regexp_replace(lower(oracle_text), '[ \\t\\n]', '', 'g') AS b FROM review_candidates WHERE candidate_text IS NOT NULL AND oracle_text IS NOT NULL)
SELECT row_id, candidate_source FROM k WHERE a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a))
"""


def _review_rules() -> list[quality.Rule]:
    c = F.col
    return [
        ("missing_group", "block", c("group_id").isNull()),
        ("missing_text", "block", c("candidate_text").isNull() | (F.trim("candidate_text") == "")),
        ("missing_reward", "warn", c("reward_total").isNull() | F.isnan("reward_total")),
        ("missing_rank", "warn", c("current_rank").isNull()),
        ("probability_out_of_range", "block", ~c("current_target_probability").between(0, 1)),
        ("oracle_text_differs", "warn", (c("candidate_source") == "oracle") & (c("candidate_text") != c("oracle_text"))),
        ("reviewed_without_reviewer", "warn", c("decision").isNotNull() & c("reviewer").isNull()),
        ("undated_source", "warn", (c("candidate_source") == "same_user") & c("source_time").isNull()),
    ]


def quality_issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(quality.issues(table(spark, sf_dir, "review_candidates"), ["row_id"], _review_rules()))


ISSUES = """
SELECT code, severity, count(*) AS n FROM (
  SELECT 'missing_group' AS code, 'block' AS severity FROM review_candidates WHERE group_id IS NULL
  UNION ALL SELECT 'missing_text', 'block' FROM review_candidates WHERE candidate_text IS NULL OR trim(candidate_text, ' ') = ''
  UNION ALL SELECT 'missing_reward', 'warn' FROM review_candidates WHERE reward_total IS NULL OR isnan(reward_total)
  UNION ALL SELECT 'missing_rank', 'warn' FROM review_candidates WHERE current_rank IS NULL
  UNION ALL SELECT 'probability_out_of_range', 'block' FROM review_candidates WHERE current_target_probability NOT BETWEEN 0 AND 1
  UNION ALL SELECT 'oracle_text_differs', 'warn' FROM review_candidates WHERE candidate_source = 'oracle' AND candidate_text <> oracle_text
  UNION ALL SELECT 'reviewed_without_reviewer', 'warn' FROM review_candidates WHERE decision IS NOT NULL AND reviewer IS NULL
  UNION ALL SELECT 'undated_source', 'warn' FROM review_candidates WHERE candidate_source = 'same_user' AND source_time IS NULL) GROUP BY ALL
"""


def structural_text_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each structural defect occurs among candidate texts, per source."""
    rows = table(spark, sf_dir, "review_candidates").select("candidate_source", F.explode(text.structural_defects(F.coalesce("candidate_text", F.lit("")))).alias("defect"))
    return rows.groupBy("candidate_source", "defect").agg(F.count(F.lit(1)).alias("n"))


DEFECTS = r"""
WITH t AS (SELECT candidate_source, coalesce(candidate_text, '') AS x, lower(regexp_replace(coalesce(candidate_text, ''), '[\t-\r\x{85}\p{Z}]', '', 'g')) AS k FROM review_candidates),
m AS (SELECT *, list_max(list_transform(list_distinct(string_split(k, '')), lambda c: CASE WHEN c = '' THEN 0 ELSE length(k) - length(replace(k, c, '')) END)) AS top FROM t),
d AS (SELECT candidate_source, 'too_short' AS defect FROM m WHERE length(k) < 2 UNION ALL SELECT candidate_source, 'replacement_character' FROM m WHERE contains(x, chr(65533))
  UNION ALL SELECT candidate_source, 'control_character' FROM m WHERE regexp_matches(x, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]') UNION ALL SELECT candidate_source, 'dominant_character' FROM m WHERE length(k) >= 8 AND top >= 0.6e0 * length(k))
SELECT candidate_source, defect, count(*) AS n FROM d GROUP BY ALL
"""


def exact_dup_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task keys delivered more than once, and whether the deliveries say the same."""
    tasks = table(spark, sf_dir, "listwise_tasks").select("task_id", F.struct("user_id", "episode_time", "scenario", "intent", "intent_class", "app", "target_split").alias("body"), "row_id")
    return tasks.groupBy("task_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.to_json("body")).alias("n_versions"), F.min("row_id").alias("keep_id")).where("n_rows > 1").select("task_id", "n_rows", (F.col("n_versions") > 1).alias("conflict"), "keep_id")


DUPLICATES = """
SELECT task_id, count(*) AS n_rows, count(DISTINCT {'u': user_id, 't': episode_time, 's': scenario, 'i': intent, 'c': intent_class, 'a': app, 'p': target_split}) > 1 AS conflict, min(row_id) AS keep_id
FROM listwise_tasks GROUP BY task_id HAVING count(*) > 1
"""


def stratified_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review sample of 200 tasks, one of every user and class in turn."""
    tasks = table(spark, sf_dir, "listwise_tasks").select("row_id", "user_id", "intent_class")
    return sampling.round_robin(tasks, ["user_id", "intent_class"], "row_id", 200, 7).select("row_id", F.col("turn").cast("int").alias("turn"))


ROUND_ROBIN = """
WITH r AS (SELECT row_id, user_id, intent_class, row_number() OVER (PARTITION BY user_id, intent_class ORDER BY md5('7:' || row_id), row_id) AS turn FROM listwise_tasks)
SELECT row_id, CAST(turn AS INTEGER) AS turn FROM r ORDER BY r.turn, coalesce(user_id, ''), coalesce(intent_class, ''), row_id LIMIT 200
"""


def hash_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "listwise_tasks").select("row_id", sampling.hash_shard(F.col("task_id"), 8).alias("shard"))


SHARD = "SELECT row_id, CAST(CAST('0x' || substr(sha256(task_id), 1, 16) AS UBIGINT) % 8 AS INTEGER) AS shard FROM listwise_tasks"


def paired_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model candidates against same-user ones: mean reward per task, paired."""
    rows = table(spark, sf_dir, "review_candidates").where("reward_total IS NOT NULL AND NOT isnan(reward_total)")
    run = lambda s: rows.where(F.col("candidate_source") == s).groupBy("task_id").agg(F.round(F.avg("reward_total"), 9).alias("v"), F.min("split").alias("u"))
    out = stats.paired(run("same_user"), run("model"), "task_id", "v", "u")
    return out.select("n_reference", "n_candidate", "n_paired", "coverage_match", "n_users", *R6("mean_improvement", "win_rate", "macro_improvement", "worst_user", "users_improved"))


PAIRED = """
WITH c AS (SELECT * FROM review_candidates WHERE reward_total IS NOT NULL AND NOT isnan(reward_total)),
a AS (SELECT task_id, round(avg(reward_total), 9) AS a, min(split) AS ua FROM c WHERE candidate_source = 'same_user' GROUP BY task_id),
b AS (SELECT task_id, round(avg(reward_total), 9) AS b, min(split) AS ub FROM c WHERE candidate_source = 'model' GROUP BY task_id),
j AS (SELECT a, b, b - a AS g, coalesce(ub, ua) AS u FROM a FULL JOIN b USING (task_id)),
pu AS (SELECT u, avg(g) AS g FROM j WHERE g IS NOT NULL GROUP BY u)
SELECT count(a) AS n_reference, count(b) AS n_candidate, count(g) AS n_paired, bool_and(a IS NOT NULL AND b IS NOT NULL) AS coverage_match, (SELECT count(*) FROM pu) AS n_users,
  round(avg(g), 6) AS mean_improvement, round(avg(CASE WHEN g IS NULL THEN NULL WHEN g > 0 THEN 1e0 ELSE 0e0 END), 6) AS win_rate, (SELECT round(avg(g), 6) FROM pu) AS macro_improvement,
  (SELECT round(min(g), 6) FROM pu) AS worst_user, (SELECT round(avg(CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END), 6) FROM pu) AS users_improved FROM j
"""


def group_listwise_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: cross entropy of the target shares against a softmax of rewards, and how often the oracle leads.

    Log sums are aggregated per group and joined back: no group is one window.
    """
    rows = table(spark, sf_dir, "review_candidates").where("group_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total) AND current_target_probability IS NOT NULL")
    rows = rows.select("group_id", "split", "candidate_source", F.col("reward_total").alias("r"), F.col("current_target_probability").alias("q"))
    best_oracle = F.max(F.when(F.col("candidate_source") == "oracle", F.col("r")))
    per = rows.groupBy("group_id").agg(F.min("split").alias("split"), F.max("r").alias("top"), F.sum(F.exp("r")).alias("z"), F.sum("q").alias("total"), F.sum(F.col("q") * F.col("r")).alias("qr"), best_oracle.alias("o")).where("total > 0")
    loss = F.ln("z") - F.col("qr") / F.col("total")
    return per.groupBy("split").agg(F.count(F.lit(1)).alias("n_groups"), F.round(F.avg(loss), 5).alias("cross_entropy"), F.round(F.avg((F.col("o") >= F.col("top")).cast("double")), 6).alias("oracle_leads"))


LISTWISE = """
WITH p AS (SELECT group_id, min(split) AS split, max(reward_total) AS top, sum(exp(reward_total)) AS z, sum(current_target_probability) AS total, sum(current_target_probability * reward_total) AS qr, max(reward_total) FILTER (candidate_source = 'oracle') AS o
  FROM review_candidates WHERE group_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total) AND current_target_probability IS NOT NULL GROUP BY group_id)
SELECT split, count(*) AS n_groups, round(avg(ln(z) - qr / total), 5) AS cross_entropy, round(avg(CASE WHEN o IS NULL THEN NULL WHEN o >= top THEN 1e0 ELSE 0e0 END), 6) AS oracle_leads FROM p WHERE total > 0 GROUP BY split
"""


def weighted_pair_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted soft loss of the pairs per source; a pair's margin is what its task's oracle is rewarded beyond the source's best."""
    known = table(spark, sf_dir, "review_candidates").where("reward_total IS NOT NULL AND NOT isnan(reward_total) AND candidate_source IS NOT NULL")
    best = known.groupBy("task_id", "candidate_source").agg(F.max("reward_total").alias("best"))
    oracle = best.where("candidate_source = 'oracle'").select("task_id", F.col("best").alias("oracle"))
    rows = table(spark, sf_dir, "preference_pairs").select("task_id", "candidate_source", "papo_weight", "papo_target_probability")
    pairs = rows.join(oracle, "task_id").join(best, ["task_id", "candidate_source"]).withColumn("margin", F.col("oracle") - F.col("best"))
    return training.pair_loss(pairs, ["candidate_source"], "margin", "papo_target_probability", "papo_weight", 0.1).select("candidate_source", "n", *R6("loss", "accuracy", "mean_margin"))


PAIR_LOSS = """
WITH b AS (SELECT task_id, candidate_source, max(reward_total) AS best FROM review_candidates WHERE reward_total IS NOT NULL AND NOT isnan(reward_total) AND candidate_source IS NOT NULL GROUP BY ALL),
m AS (SELECT p.candidate_source, papo_weight AS w, papo_target_probability AS t, o.best - b.best AS g FROM preference_pairs p JOIN b USING (task_id, candidate_source) JOIN b o ON o.task_id = p.task_id AND o.candidate_source = 'oracle'
  WHERE papo_weight IS NOT NULL AND papo_target_probability IS NOT NULL),
l AS (SELECT *, 1 / (1 + exp(-g / 0.1e0)) AS s FROM m)
SELECT candidate_source, count(*) AS n, round(sum(w * -(t * ln(greatest(s, 1e-12)) + (1 - t) * ln(greatest(1 - s, 1e-12)))) / sum(w), 6) AS loss, round(sum(w * CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END) / sum(w), 6) AS accuracy, round(avg(g), 6) AS mean_margin FROM l GROUP BY candidate_source
"""


def chat_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as prompt and response: turns, whether roles alternate, lengths."""
    out = training.align_chat(table(spark, sf_dir, "sft_messages"), "messages")
    return out.select("row_id", "valid", F.size("prompt").cast("bigint").alias("n_prompt"), F.length("response").cast("bigint").alias("n_response"), F.col("system").isNotNull().alias("has_system"))


CHAT = """
WITH m AS (SELECT row_id, list_filter(messages, lambda x: x.role <> 'system') AS t, list_filter(messages, lambda x: x.role = 'system') AS s FROM sft_messages)
SELECT row_id, len(t) > 0 AND len(t) % 2 = 0 AND len(list_filter(range(len(t)), lambda i: t[i + 1].role <> CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END)) = 0 AS valid,
  CAST(greatest(len(t) - 1, 0) AS BIGINT) AS n_prompt, CAST(length(t[len(t)].content) AS BIGINT) AS n_response, s[1].content IS NOT NULL AS has_system FROM m
"""


def group_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action of every trajectory with its place, from parallel lists of types and targets."""
    lists = table(spark, sf_dir, "trajectory_records").select("row_id", F.col("actions.action_type").alias("action_type"), F.col("actions.target").alias("target"))
    return training.flatten_groups(lists, ["action_type", "target"])


FLATTEN = "SELECT row_id, CAST(i AS INTEGER) AS pos, actions[i + 1].action_type AS action_type, actions[i + 1].target AS target FROM (SELECT row_id, actions, unnest(range(len(actions))) AS i FROM trajectory_records WHERE actions IS NOT NULL)"


def interleave_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preference pairs and chats in turn, until the shorter table ends."""
    out = sampling.interleave({"pairs": table(spark, sf_dir, "preference_pairs"), "chats": table(spark, sf_dir, "sft_messages")}, "row_id")
    return out.select("source", "key", "turn")


MIX = """
WITH u AS (SELECT 'pairs' AS source, row_id AS key, row_number() OVER (ORDER BY row_id) AS turn FROM preference_pairs UNION ALL SELECT 'chats', row_id, row_number() OVER (ORDER BY row_id) FROM sft_messages)
SELECT source, key, turn FROM u WHERE turn <= least((SELECT count(*) FROM preference_pairs), (SELECT count(*) FROM sft_messages))
"""


def strict_action_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions written in the call syntax and parsed back: valid ones and errors per type."""
    rows = table(spark, sf_dir, "trajectory_records").select(F.explode("actions").alias("a"))
    x = F.get(F.col("a.bbox"), F.lit(0)).cast("int")
    call = F.concat(F.lower("a.action_type"), F.lit("(coordinates=("), x.cast("string"), F.lit(", 7), text='"), F.coalesce("a.text", F.lit("")), F.lit("')"))
    parsed = rows.where("a.action_type IS NOT NULL AND a.bbox IS NOT NULL AND a.bbox[0] IS NOT NULL").select(actions.parse_action(call).alias("p"))
    return parsed.groupBy("p.action_type", "p.error").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("p.x", F.lit(0)).cast("bigint")).alias("sum_x"))


_VERBS = r"(?i)\b(click|long_click|type|scroll|press_back|press_home|press_recent|wait|finished)\b"
PARSED = rf"""
WITH a AS (SELECT a.action_type AS t, a.bbox AS b, coalesce(a.text, '') AS x FROM (SELECT unnest(actions) AS a FROM trajectory_records)),
c AS (SELECT trim(lower(t) || '(coordinates=(' || CAST(trunc(b[1]) AS INTEGER) || ', 7), text=' || chr(39) || x || chr(39) || ')', ' ') AS call FROM a WHERE t IS NOT NULL AND b[1] IS NOT NULL),
v AS (SELECT call, regexp_extract_all(call, '{_VERBS}') AS v FROM c),
k AS (SELECT call, CASE WHEN len(v) = 1 THEN lower(v[1]) ELSE 'invalid' END AS k, regexp_matches(call, '(?i)\b(up|down|left|right)\b') AS d, regexp_matches(call, '(?s)text\s*=\s*\x27.*?\x27') AS q, regexp_matches(call, 'coordinates\s*=\s*\([-\d]+\s*,\s*[-\d]+\)') AS p FROM v),
e AS (SELECT call, k, CASE WHEN k = 'invalid' THEN 'not_one_call' WHEN k IN ('press_back', 'press_home', 'press_recent', 'wait', 'finished') THEN '' WHEN k = 'type' AND NOT q THEN 'nothing_to_type' WHEN k = 'type' THEN '' WHEN NOT p THEN 'no_place' WHEN k = 'scroll' AND NOT d THEN 'no_direction' ELSE '' END AS e FROM k)
SELECT k AS action_type, e AS error, count(*) AS n, CAST(sum(CASE WHEN k IN ('click', 'long_click', 'scroll') THEN CAST(regexp_extract(call, 'coordinates\s*=\s*\(([-\d]+)', 1) AS BIGINT) ELSE 0 END) AS BIGINT) AS sum_x FROM e GROUP BY ALL
"""


def retrieval_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split: tasks, share with history, with profile, and mean history length by depth bucket."""
    n = F.coalesce(F.size("history_episode_ids"), F.lit(0))
    bucket = F.when(n == 0, "0").when(n <= 2, "1-2").otherwise("3+")
    rows = table(spark, sf_dir, "listwise_tasks").select("target_split", n.alias("n"), bucket.alias("depth"), F.col("user_profile").isNotNull().alias("p"))
    return rows.groupBy("target_split", "depth").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("n"), 6).alias("mean_history"), F.round(F.avg(F.col("p").cast("double")), 6).alias("with_profile"))


READINESS = """
WITH t AS (SELECT target_split, coalesce(len(history_episode_ids), 0) AS n, user_profile IS NOT NULL AS p FROM listwise_tasks)
SELECT target_split, CASE WHEN n = 0 THEN '0' WHEN n <= 2 THEN '1-2' ELSE '3+' END AS depth, count(*) AS n_tasks, round(avg(n), 6) AS mean_history, round(avg(CAST(p AS INTEGER)), 6) AS with_profile FROM t GROUP BY ALL
"""


def exact_intent_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instructions that several users share, with how many users and how many different paths of action types."""
    steps = table(spark, sf_dir, "gui_step_examples").where("user_id IS NOT NULL").select(
        text.key_alnum("instruction").alias("intent"), "user_id", F.array_join(F.transform("action_history", lambda a: F.coalesce(a.action_type, F.lit("?"))), ">").alias("path"))
    out = steps.where("intent <> ''").groupBy("intent").agg(F.count_distinct("user_id").alias("n_users"), F.count_distinct(F.coalesce("path", F.lit(""))).alias("n_paths"), F.count(F.lit(1)).alias("n"))
    return out.where("n_users >= 2")


INTENTS = f"""
WITH s AS (SELECT {sql.key('instruction')} AS intent, user_id, coalesce(array_to_string(list_transform(action_history, lambda a: coalesce(a.action_type, '?')), '>'), '') AS path FROM gui_step_examples WHERE user_id IS NOT NULL AND instruction IS NOT NULL)
SELECT intent, count(DISTINCT user_id) AS n_users, count(DISTINCT path) AS n_paths, count(*) AS n FROM s WHERE intent <> '' GROUP BY intent HAVING count(DISTINCT user_id) >= 2
"""


def trajectory_rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task reward of every trajectory from success, progress, invalid actions and risk."""
    reward = scores.task_reward(F.col("task_success"), F.col("progress"), F.col("invalid_count"), F.col("risk_score"))
    return table(spark, sf_dir, "trajectory_records").select("row_id", F.round(reward, 6).alias("reward"), F.coalesce(F.size("actions"), F.lit(0)).cast("bigint").alias("n_actions"))


REWARDS = "SELECT row_id, round(coalesce(task_success, 0) + 0.5e0 * coalesce(progress, 0) - 0.1e0 * coalesce(invalid_count, 0) - 0.2e0 * coalesce(risk_score, 0), 6) AS reward, coalesce(len(actions), 0) AS n_actions FROM trajectory_records"


def continuation_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action of every trajectory with a digest of the actions that follow it."""
    lists = table(spark, sf_dir, "trajectory_records").select("row_id", F.transform("actions", lambda a: F.coalesce(a.action_type, F.lit(""))).alias("types"))
    out = retrieval.continuations(lists, "row_id", "types", F.lower)
    return out.select("row_id", "pos", "action", F.size("suffix").alias("n_rest"), F.md5(F.array_join("suffix", ">")).alias("rest"))


CONTINUATIONS = """
WITH r AS (SELECT row_id, list_transform(actions, lambda a: coalesce(a.action_type, '')) AS t, unnest(range(len(actions))) AS pos FROM trajectory_records WHERE actions IS NOT NULL)
SELECT row_id, CAST(pos AS INTEGER) AS pos, lower(t[pos + 1]) AS action, CAST(len(t) - pos - 1 AS INTEGER) AS n_rest, md5(array_to_string(t[pos + 2 :], '>')) AS rest FROM r
"""


def rotated_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chat with the next sample's id in its batch of 16, the last with the first's."""
    rows = ranking.numbered(table(spark, sf_dir, "sft_messages").select("row_id", "sample_id"), [F.col("row_id")], "rn").withColumn("batch", F.floor((F.col("rn") - 1) / 16))
    over = W.partitionBy("batch").orderBy("rn")
    following = F.coalesce(F.lead("sample_id").over(over), F.first("sample_id").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    return rows.select("row_id", following.alias("mismatched"))


ROTATED = """
WITH r AS (SELECT row_id, sample_id, row_number() OVER (ORDER BY row_id) AS rn FROM sft_messages), b AS (SELECT *, (rn - 1) // 16 AS batch FROM r)
SELECT row_id, coalesce(lead(sample_id) OVER (PARTITION BY batch ORDER BY rn), first(sample_id) OVER (PARTITION BY batch ORDER BY rn)) AS mismatched FROM b
"""


def candidate_matching_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean matching ratio of candidates to their oracle text per source; equal pairs are scored once."""
    rows = table(spark, sf_dir, "review_candidates").where("candidate_text IS NOT NULL AND oracle_text IS NOT NULL")
    pairs = rows.groupBy("candidate_source", "candidate_text", "oracle_text").agg(F.count(F.lit(1)).alias("n"))
    scored = pairs.select("candidate_source", "n", text.matching_ratio("candidate_text", "oracle_text").alias("s"))
    return scored.groupBy("candidate_source").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.col("s")) / F.sum("n"), 6).alias("mean_ratio"))


def knapsack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats packed greedily into sequences of 512 characters of response, batch by batch."""
    rows = table(spark, sf_dir, "sft_messages").select("row_id", F.coalesce(F.length(F.element_at("messages", -1).content), F.lit(0)).alias("size"))
    return training.greedy_packs(rows, "row_id", "size", 512)


def retrieval_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per relation and eligibility that the causal pools of held-out tasks hold."""
    tasks = table(spark, sf_dir, "listwise_tasks").where("intent IS NOT NULL AND episode_time IS NOT NULL").select(
        F.col("row_id").cast("string").alias("task_id"), "user_id", F.col("episode_time").alias("time"), "scenario", "intent", "intent_class", "app", "target_split")
    pools = retrieval.retrieval_pools(tasks.where("target_split IN ('validation', 'test')"), tasks.where("target_split = 'train'"))
    return pools.groupBy("relation", "eligibility").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("similarity"), 6).alias("mean_similarity"))


POOLS = f"""
WITH b AS (SELECT CAST(row_id AS VARCHAR) AS id, user_id AS u, episode_time AS t, scenario AS s, intent_class AS c, app AS a, target_split IN ('validation', 'test') AS held, {sql.key('intent')} AS k FROM listwise_tasks WHERE intent IS NOT NULL AND episode_time IS NOT NULL AND target_split IS NOT NULL),
g AS (SELECT *, {sql.GRAMS} AS grams, try_cast(substr(t, 10, 2) AS INTEGER) AS h FROM b),
x AS (SELECT t.id, r.id AS ref, t.u, r.u AS ru, r.k, r.t AS rt, CASE WHEN len(t.grams) > 0 AND len(r.grams) > 0 THEN 2e0 * len(list_intersect(t.grams, r.grams)) / (len(t.grams) + len(r.grams)) ELSE 0e0 END AS sim,
    CASE WHEN t.s <> '' AND t.s = r.s THEN 1e0 ELSE 0e0 END AS scene, coalesce(1 - least(abs(t.h - r.h), 24 - abs(t.h - r.h)) / 12e0, 0e0) AS hour, coalesce(t.c <> '' AND t.c = r.c, false) AS same_c, coalesce(t.a <> '' AND t.a = r.a, false) AS same_a
  FROM g t JOIN g r ON t.held AND NOT r.held AND r.k <> '' AND r.t <> '' AND r.t < t.t AND t.k <> r.k),
o AS (SELECT *, (same_c OR (same_a AND sim >= 0.35e0)) AND sim >= 0.2e0 AS alike FROM x WHERE u = ru AND id <> ref),
m AS (SELECT id, ref, k, rt, sim, CASE WHEN alike THEN 1 ELSE 2 END AS rel, CASE WHEN alike THEN 0.65e0 * sim + 0.2e0 * scene + 0.15e0 * hour ELSE 0.15e0 * sim + 0.55e0 * scene + 0.3e0 * hour END AS score,
    CASE WHEN NOT alike THEN 'contrast_only_zero_mass' WHEN sim >= 0.35e0 THEN 'listwise' ELSE 'review_required_zero_mass' END AS eligibility
  FROM o WHERE alike OR (NOT same_c AND NOT same_a AND (scene > 0 OR hour >= 0.75e0) AND sim < 0.75e0)
  UNION ALL SELECT id, ref, k, rt, sim, 3, 0.75e0 * sim + 0.15e0 * scene + 0.1e0 * hour, CASE WHEN sim >= 0.55e0 THEN 'analysis_only_pseudo_negative_risk' ELSE 'dpo_rejected_review_required' END FROM x WHERE (same_c OR same_a) AND (u IS NULL OR ru IS NULL OR u <> ru)),
f AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY rel, eligibility = 'listwise' DESC, score DESC, rt DESC, ref DESC) AS first FROM m),
w AS (SELECT *, row_number() OVER (PARTITION BY id, rel ORDER BY eligibility = 'listwise' DESC, score DESC, rt DESC, ref DESC) AS place FROM f WHERE first = 1),
l AS (SELECT *, row_number() OVER (PARTITION BY rel, k ORDER BY score DESC, id DESC) AS used FROM w WHERE place <= 2)
SELECT CASE rel WHEN 1 THEN 'same_user_similar_intent' WHEN 2 THEN 'same_user_similar_context_different_intent' ELSE 'cross_user_similar_intent' END AS relation, eligibility, count(*) AS n, round(avg(sim), 6) AS mean_similarity
FROM l WHERE used <= greatest(10, (SELECT CAST(ceil(count(*) / 200e0) AS BIGINT) FROM b WHERE held)) GROUP BY ALL
"""


def generation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap scores of rejected answers against chosen ones, per source."""
    pairs = table(spark, sf_dir, "preference_pairs").select("candidate_source", evaluation.generation_scores(F.col("rejected.content"), F.col("chosen.content")).alias("s"))
    return pairs.groupBy("candidate_source").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(f"s.{n}"), 6).alias(n) for n in ("bleu4", "rouge1", "rouge2", "rougel")])


def grouped_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate groups as training rows: size, index and share of the oracle."""
    rows = table(spark, sf_dir, "review_candidates").where("candidate_id IS NOT NULL")
    best = causal.keep_first(rows.where("group_id IS NOT NULL AND candidate_source IN ('oracle', 'same_user', 'context')"), ["group_id", "candidate_source"], [F.col("current_target_probability").desc_nulls_last(), F.col("row_id")])
    out = exports.grouped(best, "group_id", "candidate_id", "candidate_text", "candidate_source", "current_target_probability")
    return out.select("group_id", F.size("candidates").alias("n"), "oracle_index", F.round(F.get("target_distribution", F.col("oracle_index")), 6).alias("oracle_share"))


GROUPED = """
WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id, candidate_source ORDER BY current_target_probability DESC NULLS LAST, row_id) AS r FROM review_candidates WHERE candidate_id IS NOT NULL AND group_id IS NOT NULL AND candidate_source IN ('oracle', 'same_user', 'context')) WHERE r = 1),
g AS (SELECT group_id, count(*) AS n, sum(coalesce(current_target_probability, 0)) AS t, count(*) FILTER (candidate_source = 'oracle') AS o, list({'p': -coalesce(current_target_probability, 0), 'c': candidate_id, 's': candidate_source} ORDER BY -coalesce(current_target_probability, 0), candidate_id, candidate_text) AS l FROM b GROUP BY group_id),
x AS (SELECT *, list_position(list_transform(l, lambda z: z.s), 'oracle') AS i FROM g WHERE n >= 2 AND o = 1 AND t > 0)
SELECT group_id, CAST(n AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS oracle_index, round(-l[i].p / t, 6) AS oracle_share FROM x
"""


def task_issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(quality.issues(table(spark, sf_dir, "listwise_tasks"), ["row_id"], rules.source_tasks()))


def _counts(table_name: str, parts: list[tuple[str, str, str]]) -> str:
    """SQL that counts the rows of a table for each (code, severity, condition)."""
    rows = " UNION ALL ".join(f"SELECT '{code}' AS code, '{severity}' AS severity FROM {table_name} WHERE {condition}" for code, severity, condition in parts)
    return f"SELECT code, severity, count(*) AS n FROM ({rows}) GROUP BY ALL"


_H = "coalesce(history_episode_ids, CAST([] AS VARCHAR[]))"
TASK_ISSUES = _counts("listwise_tasks", [
    *[(code, severity, f"coalesce(trim({c}, ' '), '') = ''") for code, severity, c in (("missing_task_id", "block", "task_id"), ("missing_intent", "block", "intent"), ("missing_user", "block", "user_id"), ("missing_scenario", "warn", "scenario"), ("missing_class", "warn", "intent_class"), ("missing_app", "warn", "app"))],
    ("bad_time", "block", "NOT regexp_matches(coalesce(episode_time, ''), '^[0-9]{8}_[0-9]{6}$')"), ("unknown_split", "block", "coalesce(target_split, '') NOT IN ('train', 'validation', 'test')"),
    ("history_not_past", "block", f"len(list_filter({_H}, lambda h: split_part(h, '__', 2) >= episode_time)) > 0"), ("history_of_another", "block", f"len(list_filter({_H}, lambda h: split_part(h, '__', 1) <> user_id)) > 0"),
    ("history_holds_target", "block", f"list_contains({_H}, episode_id)"), ("history_repeats", "warn", f"len(list_distinct({_H})) < len({_H})"),
    ("episode_differs_from_key", "warn", "episode_id <> concat_ws('__', user_id, episode_time)"), ("missing_profile", "warn", "user_profile IS NULL"), ("no_history", "warn", f"len({_H}) = 0"),
])


def pair_issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(quality.issues(table(spark, sf_dir, "preference_pairs"), ["row_id"], rules.preference_rows()))


PAIR_ISSUES = _counts("preference_pairs", [
    ("missing_prompt", "block", "coalesce(len(messages), 0) = 0"), ("wrong_roles", "block", "messages[len(messages)].role <> 'user'"), ("missing_chosen", "block", "coalesce(trim(chosen.content, ' '), '') = ''"),
    ("missing_rejected", "block", "coalesce(trim(rejected.content, ' '), '') = ''"), ("same_answers", "block", "chosen.content = rejected.content"), ("answer_not_by_assistant", "block", "chosen.role <> 'assistant' OR rejected.role <> 'assistant'"),
    ("missing_weight", "warn", "papo_weight IS NULL"), ("weight_out_of_range", "warn", "papo_weight NOT BETWEEN 0.1e0 AND 5"), ("target_out_of_range", "block", "papo_target_probability NOT BETWEEN 0.5e0 AND 1"), ("missing_source", "warn", "coalesce(trim(candidate_source, ' '), '') = ''"),
])


def chat_issue_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rollup(quality.issues(table(spark, sf_dir, "sft_messages"), ["row_id"], rules.chat_rows()))


_R = "list_transform(coalesce(messages, []), lambda m: m.role)"
CHAT_ISSUES = _counts("sft_messages", [
    ("no_messages", "block", "coalesce(len(messages), 0) = 0"), ("last_not_assistant", "block", "messages[len(messages)].role <> 'assistant'"), ("system_not_first", "block", f"coalesce(list_position({_R}, 'system'), 0) > 1"),
    ("several_systems", "block", f"len(list_filter({_R}, lambda r: r = 'system')) > 1"), ("missing_answer", "block", "coalesce(trim(messages[len(messages)].content, ' '), '') = ''"), ("missing_weight", "warn", "papo_listwise_weight IS NULL"),
    ("weight_out_of_range", "warn", "papo_listwise_weight NOT BETWEEN 0 AND 1"), ("missing_source", "warn", "coalesce(trim(candidate_source, ' '), '') = ''"), ("has_images", "info", "coalesce(len(images), 0) > 0"),
])


QUERIES = {
    "task_issue_rollup": (task_issue_rollup, TASK_ISSUES), "pair_issue_rollup": (pair_issue_rollup, PAIR_ISSUES), "chat_issue_rollup": (chat_issue_rollup, CHAT_ISSUES),
    "retrieval_pools": (retrieval_pools, POOLS), "generation_report": (generation_report, None), "grouped_tasks": (grouped_tasks, GROUPED),
    "latest_fraction_split": (latest_fraction_split, SPLIT), "split_leakage_audit": (split_leakage_audit, LEAKAGE), "unseen_users": (unseen_users, UNSEEN),
    "hour_similarity_context": (hour_similarity_context, HOURS), "bigram_dice_whole": (bigram_dice_whole, DICE_WHOLE), "retrieval_modes_whole": (retrieval_modes_whole, MODES_WHOLE),
    "oracle_negative_pairs": (oracle_negative_pairs, ORACLE_PAIRS), "weight_assign_v3": (weight_assign_v3, WEIGHTS), "clamped_policy": (clamped_policy, CLAMPED),
    "frequency_cap": (frequency_cap, CAP), "verbatim_copy_gate": (verbatim_copy_gate, VERBATIM), "quality_issue_rollup": (quality_issue_rollup, ISSUES),
    "structural_text_defects": (structural_text_defects, DEFECTS), "exact_dup_canonicalise": (exact_dup_canonicalise, DUPLICATES), "stratified_round_robin": (stratified_round_robin, ROUND_ROBIN),
    "hash_shard": (hash_shard, SHARD), "paired_comparison": (paired_comparison, PAIRED), "group_listwise_metrics": (group_listwise_metrics, LISTWISE),
    "weighted_pair_loss": (weighted_pair_loss, PAIR_LOSS), "chat_align": (chat_align, CHAT), "group_flatten": (group_flatten, FLATTEN), "interleave_mix": (interleave_mix, MIX),
    "strict_action_parse": (strict_action_parse, PARSED), "retrieval_readiness": (retrieval_readiness, READINESS), "exact_intent_groups": (exact_intent_groups, INTENTS),
    "trajectory_rewards": (trajectory_rewards, REWARDS), "continuation_suffixes": (continuation_suffixes, CONTINUATIONS), "rotated_mismatch": (rotated_mismatch, ROTATED),
    "candidate_matching_ratio": (candidate_matching_ratio, None), "knapsack_packing": (knapsack_packing, None),
}
