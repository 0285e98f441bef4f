"""Queries pN_... over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm import answers, charform, dedup, encode, overlap, packing, runs, splits, subjects, topn, variants
from pathloom.plans.sql import key
from pathloom.storage import table

Query = Callable[[SparkSession, str], DataFrame]
_ACTIONS = (("trajectory", "trajectory_records", "actions"), ("step", "gui_step_examples", "action_history"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal runs of two or more neighbouring actions that repeat one another."""
    parts = [
        runs.repeated_runs(table(spark, sf_dir, name), column).select(F.lit(kind).alias("record_kind"), "row_id", "start_pos", "run_length")
        for kind, name, column in _ACTIONS
    ]
    return parts[0].unionByName(parts[1])


def _run_part(kind: str, name: str, column: str) -> str:
    text = lambda x: _plain_key(f"coalesce({x}, '')")
    return f"""SELECT '{kind}' AS record_kind, row_id, i - 1 AS pos, {text("a.action_type")} AS k1, {text("a.target")} AS k2, {text("a.text")} AS k3, a.bbox AS b FROM (SELECT row_id, unnest({column}) AS a, generate_subscripts({column}, 1) AS i FROM {name})"""


def _plain_key(x: str) -> str:
    """Letters and digits of a text in lower case, compatibility form and usual letters for look-alikes."""
    pairs = [(c, r) for c in map(chr, (*range(0x250, 0x600), *range(0x1C80, 0x1C90), *range(0x13A0, 0x13F6))) if c.isalpha() and len(r := charform.convert_text(c)) == 1 and r != c.lower()]
    return key(f"translate({x}, '{''.join(a for a, _ in pairs)}', '{''.join(b for _, b in pairs)}')")


def p1_sql() -> str:
    """Runs by comparing each action with the one before it."""
    moved = " OR ".join(f"coalesce(abs(b[{e}] - lag(b[{e}]) OVER w) > 12, false)" for e in range(1, 5))
    parts = " UNION ALL ".join(_run_part(kind, name, column) for kind, name, column in _ACTIONS)
    return f"""
WITH e AS ({parts}),
s AS (SELECT *, coalesce(k1 = lag(k1) OVER w AND k2 = lag(k2) OVER w AND k3 = lag(k3) OVER w AND NOT ({moved}), false) AS same FROM e WINDOW w AS (PARTITION BY record_kind, row_id ORDER BY pos)),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY record_kind, row_id ORDER BY pos) AS run FROM s)
SELECT record_kind, row_id, CAST(min(pos) AS INTEGER) AS start_pos, CAST(count(*) AS INTEGER) AS run_length FROM g GROUP BY record_kind, row_id, run HAVING count(*) > 1
"""


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trajectory and step with its runs collapsed: actions before and after, repeats and their time."""
    parts = []
    for kind, name, column in _ACTIONS:
        df = runs.collapse(table(spark, sf_dir, name).select("row_id", F.size(column).alias("n_before"), column), column)
        parts.append(df.select(
            F.lit(kind).alias("record_kind"), "row_id", "n_before", F.size(column).alias("n_after"),
            F.aggregate(column, F.lit(0), lambda a, x: F.greatest(a, x["count"])).alias("longest_run"),
            F.aggregate(F.filter(column, lambda x: x["count"] > 1), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x.duration_ms, F.lit(0))).alias("repeat_ms"),
        ))
    return parts[0].unionByName(parts[1])


def _tied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of both tables with their split and the keys that tie them."""
    parts = [
        table(spark, sf_dir, name).select(
            F.lit(kind).alias("record_kind"), "row_id", "split", splits.person_key("user_id").alias("user"), F.col("task_id").alias("task"), F.col(trajectory).alias("trajectory")
        )
        for kind, name, trajectory in (("trajectory", "trajectory_records", "trajectory_id"), ("step", "gui_step_examples", "source_trajectory_id"))
    ]
    return parts[0].unionByName(parts[1])


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.components(_tied(spark, sf_dir), ["record_kind", "row_id", "split"], ["user", "task", "trajectory"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation and test rows tied to a train row."""
    return splits.crossing(_components(spark, sf_dir)).select("record_kind", "row_id")


#: The least label spreads over shared keys round by round; far more rounds than any path of the test tables needs.
P2_SQL = r"""
WITH RECURSIVE r AS (
  SELECT 'trajectory' AS record_kind, row_id, split, user_id AS u, task_id AS t, trajectory_id AS j FROM trajectory_records UNION ALL SELECT 'step', row_id, split, user_id, task_id, source_trajectory_id FROM gui_step_examples),
p AS (SELECT record_kind, row_id, split, record_kind || row_id AS own, lower(regexp_replace(u, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g')) AS u, t, j FROM r),
k AS (SELECT record_kind, row_id, split, own, coalesce(CASE WHEN u IN ('', 'unknown') THEN NULL ELSE 'u:' || u END, own) AS u, coalesce('t:' || t, own) AS t, coalesce('j:' || j, own) AS j FROM p),
l AS (SELECT 0 AS n, own, u, t, j, own AS label FROM k
  UNION ALL SELECT n + 1, own, u, t, j, least(min(label) OVER (PARTITION BY u), min(label) OVER (PARTITION BY t), min(label) OVER (PARTITION BY j)) FROM l WHERE n < 64),
c AS (SELECT record_kind, row_id, split, label FROM k JOIN l USING (own) WHERE n = 64)
SELECT record_kind, row_id FROM c WHERE split IN ('validation', 'test') AND label IN (SELECT label FROM c WHERE split = 'train')
"""


def p2_assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split for every row that keeps tied rows together, in the shares 80, 10 and 10."""
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    return splits.assign(_components(spark, sf_dir), shares).select("record_kind", "row_id", "component", "new_split")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three candidates of each group of the reviewer's sheet."""
    return topn.top_n(table(spark, sf_dir, "review_candidates"), 3, "group_id", "candidate_id", "reward_total", "current_rank").select("group_id", "candidate_id", "place")


P3_SQL = """
WITH firsts AS (
  SELECT group_id, candidate_id, reward_total, current_rank,
         row_number() OVER (PARTITION BY group_id, candidate_id ORDER BY reward_total DESC, current_rank ASC NULLS LAST) AS copy
  FROM review_candidates WHERE group_id IS NOT NULL AND reward_total IS NOT NULL AND NOT isnan(reward_total)),
ranked AS (
  SELECT group_id, candidate_id,
         row_number() OVER (PARTITION BY group_id ORDER BY reward_total DESC, current_rank ASC NULLS LAST, candidate_id ASC NULLS LAST) AS place
  FROM firsts WHERE copy = 1)
SELECT group_id, candidate_id, CAST(place AS INTEGER) AS place FROM ranked WHERE place <= 3
"""


_SPLIT_TEXTS = (("listwise_tasks", "task_id", "intent", "target_split"), ("review_candidates", "group_id", "oracle_text", "split"), ("gui_step_examples", "example_id", "instruction", "split"))


def _split_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = None
    for k, (name, key, text, split) in enumerate(_SPLIT_TEXTS):
        part = table(spark, sf_dir, name).select(F.lit(k).alias("grp"), F.col(key).alias("id"), F.col(text).alias("text"), F.col(split).alias("split"))
        records = part if records is None else records.unionByName(part)
    return records


def _split_name():
    return F.get(F.array(*[F.lit(x[0]) for x in _SPLIT_TEXTS]), F.col("grp")).alias("table_name")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a train and a held-out record with equal or nearly equal texts, each once."""
    found = overlap.overlaps(_split_texts(spark, sf_dir))
    return found.select(_split_name(), F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs, and held-out records that overlap, per table and split."""
    found = overlap.overlap_counts(_split_texts(spark, sf_dir))
    return found.select(_split_name(), "held_split", "n_pairs", "n_records")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rows whose texts differ as strings and look the same."""
    parts = [
        variants.variant_pairs(table(spark, sf_dir, name), text).select(F.lit(name).alias("table_name"), "id_a", "id_b")
        for name, text in (("listwise_tasks", "intent"), ("review_candidates", "candidate_text"))
    ]
    return parts[0].unionByName(parts[1])


_LOOKS = (("listwise_tasks", "intent"), ("review_candidates", "candidate_text"))


def p6_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All intents and candidate texts in consistent character form, with whether that changed them."""
    out = None
    for name, text in _LOOKS:
        part = variants.consistent(table(spark, sf_dir, name).select("row_id", F.col(text).alias("text"), F.col(text).alias("form")), "form")
        part = part.select(F.lit(name).alias("table_name"), "row_id", "form", (~F.col("form").eqNullSafe(F.col("text"))).alias("changed"))
        out = part if out is None else out.unionByName(part)
    return out


_REPEATED = (("listwise_tasks", "intent", "row_id"), ("review_candidates", "candidate_text", "row_id"), ("raw_task_lines", "payload", "line_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat an earlier one of their table in another layout."""
    out = None
    for name, text, key in _REPEATED:
        how = dedup.record_copies if text == "payload" else dedup.copies
        part = how(table(spark, sf_dir, name), text, key).select(F.lit(name).alias("table_name"), "keep_id", "copy_id")
        out = part if out is None else out.unionByName(part)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both preference sides and of the chats that are no usable answer."""
    pairs = table(spark, sf_dir, "preference_pairs")
    asked = answers.last_content("messages", "user")
    sides = F.array(*[F.struct(F.lit(side).alias("field_name"), F.col(f"{side}.content").alias("answer")) for side in ("chosen", "rejected")])
    both = pairs.select("row_id", asked.alias("asked"), F.explode(sides).alias("s")).select("s.field_name", "row_id", "s.answer", "asked")
    chats = table(spark, sf_dir, "sft_messages").select(F.lit("messages").alias("field_name"), "row_id", answers.last_content("messages", "assistant").alias("answer"), asked.alias("asked"))
    return answers.defects(both.unionByName(chats), ["field_name", "row_id"], "answer", "asked")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return table(spark, sf_dir, "documents").select("doc_id", encode.token_ids("text").alias("ids"))


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and position of every document, or of each part of one beyond the capacity."""
    sized = table(spark, sf_dir, "documents").select("doc_id", encode.token_count("text").alias("n"))
    return packing.containers(sized, "doc_id", "n").select(F.col("item").alias("doc_id"), "part", "size", "container", "start")


def _subject_model(spark: SparkSession, sf_dir: str) -> subjects.Model:
    return subjects.fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), "doc_id", "text")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that at least a quarter of a document's placed sentences treat."""
    return subjects.document_subjects(table(spark, sf_dir, "documents"), _subject_model(spark, sf_dir), "doc_id", "text")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, placed sentences and share of sentences of every subject in the corpus."""
    counts = subjects.subject_counts(table(spark, sf_dir, "documents"), _subject_model(spark, sf_dir), "doc_id", "text")
    per = counts.groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
    return table(spark, sf_dir, "subject_areas").select("subject").join(per, "subject", "left").na.fill(0)


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_collapsed": p1_collapsed, "p2_found": p2_found, "p2_assigned": p2_assigned, "p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p5_report": p5_report, "p6_found": p6_found, "p6_consistent": p6_consistent, "p7_found": p7_found, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found, "p10_composition": p10_composition}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": p1_sql(), "p2_found": P2_SQL, "p3_found": P3_SQL}
