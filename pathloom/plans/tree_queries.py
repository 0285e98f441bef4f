"""Transition trees over the logged screen steps, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.operators import tree
from pathloom.operators.causal import keep_first
from pathloom.operators.ranking import ranked
from pathloom.plans import sql
from pathloom.storage import cut, passing, table


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps by their first delivery, in the shape that trees are grown from.

    The state is the screen's id, the intent the instruction's key, the tokens the words of the
    screen; a step is placed in its episode by the number of actions before it.
    """
    raw = table(spark, sf_dir, "gui_step_examples").where("example_id IS NOT NULL")
    key = text.key_alnum("instruction")
    intent = F.when(key != "", F.hex(F.xxhash64(key))).otherwise("").alias("intent_key")  # it is only compared, and shuffled
    raw = keep_first(raw.select("row_id", "example_id", F.lower(F.trim("user_id")).alias("user_id"), F.col("source_trajectory_id").alias("episode_id"), F.coalesce(F.size("action_history"), F.lit(0)).alias("n"), "ingested_at", "state_id", intent, "ui_tree", "current_action.action_type", "current_action.target"), ["example_id"], [F.col("ingested_at"), F.col("row_id")])
    words = F.array_distinct(F.regexp_extract_all(F.lower("ui_tree"), F.lit("[a-z]+"), F.lit(0)))
    steps = raw.select(
        F.col("example_id").alias("step_id"), "user_id", "episode_id", F.col("n").alias("step_index"), F.date_format("ingested_at", "yyyyMMdd_HHmmss").alias("time"), F.lit("").alias("app"), F.coalesce("state_id", F.lit("")).alias("state_key"),
        "intent_key", words.alias("tokens"), F.concat_ws(":", F.lower("action_type"), "target").alias("action"), F.col("ui_tree").isNotNull().alias("eligible"), "ingested_at", "row_id",
    )
    return ranked(steps.withColumn("user_id", F.coalesce("user_id", F.lit(""))), ["user_id"], [F.col("ingested_at"), F.col("row_id")]).drop("ingested_at", "row_id")


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    with passing(spark) as cuts:
        steps = cut(_steps(spark, sf_dir), "logged")
        cuts.remove(steps._cut_path)
    return tree.expand(steps.select("step_id"), steps)


def counterfactual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the three-level tree of every step: what was done there, and what was done on earlier alike screens."""
    return _tree(spark, sf_dir)[0]


def counterfactual_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of actions from every step to the end of its tree."""
    return _tree(spark, sf_dir)[1].select("root_id", "leaf", F.array_join("actions", ">").alias("path"))


def _level(i: int) -> str:
    return f"""
p{i} AS (SELECT f.root, f.path, c.sid, c.act, c.rk, c.u = r.u AS same, 2e0 + CASE WHEN c.sk = q.sk THEN 3e0 ELSE 0e0 END + CASE WHEN c.ik <> '' AND c.ik = q.ik THEN 1e0 ELSE 0e0 END
    + CASE WHEN len(c.toks) > 0 AND len(q.toks) > 0 THEN len(list_intersect(q.toks, c.toks)) / CAST(len(list_distinct(list_concat(q.toks, c.toks))) AS DOUBLE) ELSE 0e0 END + CASE WHEN c.u = r.u THEN 0.25e0 ELSE 0e0 END AS score
  FROM f{i} f JOIN st q ON q.sid = f.proxy JOIN st r ON r.sid = f.root JOIN st c ON ((c.sk <> '' AND c.sk = q.sk) OR (c.ik <> '' AND c.ik = q.ik)) AND c.sid <> q.sid AND c.able AND ((c.u = r.u AND c.rk < r.rk) OR (c.u <> r.u AND c.tm < r.tm))),
k{i} AS (SELECT *, row_number() OVER (PARTITION BY root, path, same ORDER BY score DESC, rk DESC, sid) AS n FROM p{i}),
a{i} AS (SELECT root, path, sid, act, CASE WHEN same THEN 2 ELSE 3 END AS s, n FROM k{i} WHERE n <= 2 UNION ALL SELECT root, path, proxy, act, 1, 0 FROM f{i} JOIN st ON sid = proxy),
g{i} AS (SELECT root, path, act, count(*) AS support, list_sort(list(DISTINCT s)) AS src, first(sid ORDER BY s, n, sid) AS example FROM a{i} WHERE act <> '' GROUP BY ALL),
e{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root, path ORDER BY src[1] > 1, support DESC, act) AS place FROM g{i}) WHERE place <= 4),
m{i} AS (SELECT e.*, f.done || [e.act] AS done, x.nxt, e.path || e.place || '.' AS to_path FROM e{i} e JOIN f{i} f USING (root, path) JOIN st x ON x.sid = e.example),
f{i + 1} AS (SELECT root, to_path AS path, nxt AS proxy, done FROM m{i} WHERE nxt IS NOT NULL)"""


_STEPS = f"""
WITH fi AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ingested_at NULLS FIRST, row_id) AS first FROM gui_step_examples WHERE example_id IS NOT NULL) WHERE first = 1),
s0 AS (SELECT example_id AS sid, coalesce(lower(trim(user_id, ' ')), '') AS u, source_trajectory_id AS ep, coalesce(len(action_history), 0) AS idx, strftime(ingested_at, '%Y%m%d_%H%M%S') AS tm, coalesce(state_id, '') AS sk, {sql.key("coalesce(instruction, '')")} AS ik,
  list_distinct(regexp_extract_all(lower(ui_tree), '[a-z]+')) AS toks, concat_ws(':', lower(current_action.action_type), current_action.target) AS act, ui_tree IS NOT NULL AS seen, ingested_at, row_id FROM fi),
st AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY ingested_at NULLS FIRST, row_id) AS rk, CASE WHEN ep IS NOT NULL THEN lead(sid) OVER (PARTITION BY ep ORDER BY idx, sid) END AS nxt, seen AND nxt IS NOT NULL AS able FROM s0),
f0 AS (SELECT sid AS root, sid || ':' AS path, sid AS proxy, CAST([] AS VARCHAR[]) AS done FROM st),{_level(0)},{_level(1)},{_level(2)}
"""
EDGES = _STEPS + " UNION ALL ".join(
    f"SELECT root AS root_id, path AS node, {i} AS depth, act AS action, support, array_to_string(list_transform(src, lambda s: CASE s WHEN 1 THEN 'observed_path' WHEN 2 THEN 'same_user' ELSE 'cross_user' END), '+') AS source, example FROM e{i}" for i in range(3))
LEAVES = _STEPS + " UNION ALL ".join(f"SELECT root AS root_id, to_path AS leaf, array_to_string(done, '>') AS path FROM m{i}" + (" WHERE nxt IS NULL" if i < 2 else "") for i in range(3))

QUERIES = {"counterfactual_edges": (counterfactual_edges, EDGES), "counterfactual_leaves": (counterfactual_leaves, LEAVES)}
