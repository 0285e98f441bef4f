"""Rule sets of the quality gates: (code, severity, condition) over a table's own columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pathloom.operators.quality import Rule

# Names of splits, and the shape of episode times.
SPLITS = ("train", "validation", "test")
TIME_SHAPE = r"^[0-9]{8}_[0-9]{6}$"


def _blank(c: str | Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def source_tasks() -> list[Rule]:
    """Tasks before anything is built from them: keys, times, and history that is the user's strict past."""
    history = F.coalesce("history_episode_ids", F.array().cast("array<string>"))
    user, time = lambda h: F.split(h, "__")[0], lambda h: F.get(F.split(h, "__"), F.lit(1))
    return [
        ("missing_task_id", "block", _blank("task_id")), ("missing_intent", "block", _blank("intent")), ("missing_user", "block", _blank("user_id")),
        ("bad_time", "block", ~F.coalesce(F.col("episode_time"), F.lit("")).rlike(TIME_SHAPE)), ("unknown_split", "block", ~F.coalesce(F.col("target_split"), F.lit("")).isin(*SPLITS)),
        ("history_not_past", "block", F.exists(history, lambda h: F.coalesce(time(h) >= F.col("episode_time"), F.lit(False)))),
        ("history_of_another", "block", F.exists(history, lambda h: F.coalesce(user(h) != F.col("user_id"), F.lit(False)))),
        ("history_holds_target", "block", F.coalesce(F.array_contains(history, F.col("episode_id")), F.lit(False))),
        ("history_repeats", "warn", F.size(F.array_distinct(history)) < F.size(history)),
        ("episode_differs_from_key", "warn", F.col("episode_id") != F.concat_ws("__", "user_id", "episode_time")),
        ("missing_scenario", "warn", _blank("scenario")), ("missing_class", "warn", _blank("intent_class")), ("missing_app", "warn", _blank("app")), ("missing_profile", "warn", F.col("user_profile").isNull()), ("no_history", "warn", F.size(history) == 0),
    ]


def preference_rows() -> list[Rule]:
    """Pairs as exported: both answers, different ones, roles in order, weight and target in range."""
    roles = F.transform("messages", lambda m: m.role)
    return [
        ("missing_prompt", "block", F.coalesce(F.size("messages"), F.lit(0)) <= 0), ("wrong_roles", "block", F.element_at(roles, -1) != "user"),
        ("missing_chosen", "block", _blank(F.col("chosen.content"))), ("missing_rejected", "block", _blank(F.col("rejected.content"))), ("same_answers", "block", F.col("chosen.content") == F.col("rejected.content")),
        ("answer_not_by_assistant", "block", (F.col("chosen.role") != "assistant") | (F.col("rejected.role") != "assistant")),
        ("missing_weight", "warn", F.col("papo_weight").isNull()), ("weight_out_of_range", "warn", ~F.col("papo_weight").between(0.1, 5.0)),
        ("target_out_of_range", "block", ~F.col("papo_target_probability").between(0.5, 1.0)), ("missing_source", "warn", _blank("candidate_source")),
    ]


def chat_rows() -> list[Rule]:
    """Chats as exported: the assistant last, one system turn at most and first, image marks for images."""
    roles = F.coalesce(F.transform("messages", lambda m: m.role), F.array().cast("array<string>"))
    return [
        ("no_messages", "block", F.size(roles) == 0), ("last_not_assistant", "block", F.get(roles, F.size(roles) - 1) != "assistant"),
        ("system_not_first", "block", F.array_position(roles, "system") > 1), ("several_systems", "block", F.size(F.filter(roles, lambda r: r == "system")) > 1),
        ("missing_answer", "block", _blank(F.element_at("messages", -1).content)), ("missing_weight", "warn", F.col("papo_listwise_weight").isNull()),
        ("weight_out_of_range", "warn", ~F.col("papo_listwise_weight").between(0.0, 1.0)), ("missing_source", "warn", _blank("candidate_source")), ("has_images", "info", F.coalesce(F.size("images"), F.lit(0)) > 0),
    ]
