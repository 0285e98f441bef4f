"""Steps out of logged actions and observations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matched_observations(actions: DataFrame, observations: DataFrame, episode: str, index: str, stamp: str, value: str) -> DataFrame:
    """Actions with the observation of their own time stamp, else with the one at their place; ``matched_by`` says which.

    ``observations`` has episode, stamp and value; places count its stamps in order, actions' from 0.
    """
    ordered = observations.withColumn("_place", F.row_number().over(W.partitionBy(episode).orderBy(stamp)) - 1)
    exact = observations.select(episode, stamp, F.col(value).alias("_exact"))
    placed = ordered.select(F.col(episode).alias("_e"), "_place", F.col(value).alias("_placed"))
    out = actions.join(exact, [episode, stamp], "left").join(placed, (F.col(episode) == F.col("_e")) & (F.col(index) == F.col("_place")), "left")
    how = F.when(F.col("_exact").isNotNull(), "timestamp").when(F.col("_placed").isNotNull(), "position").otherwise("none")
    return out.withColumn(value, F.coalesce("_exact", "_placed")).withColumn("matched_by", how).drop("_exact", "_placed", "_e", "_place")


def flat_actions(lines: DataFrame, episode: str, order: str, payload: str) -> DataFrame:
    """Per episode all values of its action lines, in order, as one list of strings."""
    values = F.map_values(F.from_json(payload, "map<string,string>"))
    rows = lines.select(episode, F.struct(F.col(order).alias("o"), F.coalesce(values, F.array(F.col(payload))).alias("v")).alias("r"))
    return rows.groupBy(episode).agg(F.array_sort(F.collect_list("r")).alias("_r")).select(episode, F.flatten(F.transform("_r", lambda r: r.v)).alias("actions"))


def gate_features(pairs: DataFrame, state: str, margin: str, null_margin: str, uncertainty: str) -> DataFrame:
    """Per state: number of pairs, mean and greatest margins, mean uncertainty, capacity left."""
    m, n, u = F.abs(margin), F.abs(null_margin), F.col(uncertainty)
    return pairs.groupBy(state).agg(F.count(F.lit(1)).alias("n_pairs"), F.avg(m).alias("mean_margin"), F.max(m).alias("max_margin"), F.avg(n).alias("mean_null_margin"), F.avg(u).alias("mean_uncertainty"), F.avg(F.greatest(F.lit(0.0), n - u)).alias("mean_slack"))


def candidate_actions(history: Column, future: Column, offered: Column, observed: Column, most: int) -> Column:
    """Actions to weigh in a state: the observed one, then logged later and earlier ones, then what the screen offers; each once."""
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(observed), future, F.reverse(history), offered), lambda a: a.isNotNull())), 1, most)


def flattened_metrics(metrics: dict, prefix: str = "") -> list[tuple[str, float]]:
    """Numbers of a nested report as (path, value)."""
    out: list[tuple[str, float]] = []
    for name, v in metrics.items():
        path = f"{prefix}/{name}" if prefix else str(name)
        if isinstance(v, dict):
            out += flattened_metrics(v, path)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            out.append((path, float(v)))
    return out
