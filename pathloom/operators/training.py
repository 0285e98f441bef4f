"""Training rows: chat alignment, group flattening, packing, label masks."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.functions.scores import sigmoid


def align_chat(df: DataFrame, messages: str) -> DataFrame:
    """``system``, ``prompt`` (turns before the last), ``response`` and ``valid``: user and assistant alternate and the assistant is last."""
    turns = F.filter(messages, lambda m: F.coalesce(m.role, F.lit("")) != "system")
    good = F.transform(turns, lambda m, i: m.role == F.when(i % 2 == 0, "user").otherwise("assistant"))
    n = F.size(turns)
    out = df.withColumn("system", F.get(F.filter(messages, lambda m: m.role == "system"), F.lit(0)).content)
    out = out.withColumn("prompt", F.slice(turns, 1, F.greatest(n - 1, F.lit(0)))).withColumn("response", F.get(turns, n - 1).content)
    return out.withColumn("valid", F.coalesce((n > 0) & (n % 2 == 0) & F.forall(good, lambda x: F.coalesce(x, F.lit(False))), F.lit(False)))


def align_instruction(instruction: Column, query: Column, output: Column, system: Column | None = None) -> Column:
    """One instruction row as ``struct<system, prompt, response>``; instruction and query share a turn."""
    said = F.concat_ws("\n", F.nullif(F.coalesce(instruction, F.lit("")), F.lit("")), F.nullif(F.coalesce(query, F.lit("")), F.lit("")))
    turn = F.struct(F.lit("user").alias("role"), said.alias("content"))
    return F.struct((system if system is not None else F.lit(None).cast("string")).alias("system"), F.array(turn).alias("prompt"), output.alias("response"))


def flatten_groups(df: DataFrame, arrays: list[str]) -> DataFrame:
    """One row per position of parallel arrays, with ``pos``."""
    rest = [c for c in df.columns if c not in arrays]
    zipped = df.select(*rest, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "_z"))
    return zipped.select(*rest, "pos", *[F.col(f"_z.{a}").alias(a) for a in arrays])


def largest_first(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions per pack, each filled with the largest item that still fits; what exceeds the capacity is left out."""
    held: dict[int, list[int]] = {}
    for at in sorted(range(len(sizes)), key=lambda i: (sizes[i], i)):
        if sizes[at] <= capacity:
            held.setdefault(sizes[at], []).append(at)
    left, packs = sorted(held), []
    while left:
        pack, room = [], capacity
        while fit := bisect.bisect(left, room):
            size = left[fit - 1]
            pack.append(held[size].pop())
            room -= size
            if not held[size]:
                del left[fit - 1]
        packs.append(pack)
    return packs


def greedy_packs(df: DataFrame, key: str, size: str, capacity: int, batch: int = 1000) -> DataFrame:
    """``key``, ``batch``, ``pack`` by greedy packing within batches of about ``batch`` rows dealt by hash."""
    batches = max(1, -(-df.count() // batch))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([size, key])
        packs = largest_first(rows[size].tolist(), capacity)
        keys = rows[key].tolist()
        return pd.DataFrame([(keys[i], int(rows["batch"].iloc[0]), p) for p, own in enumerate(packs) for i in own], columns=[key, "batch", "pack"])

    dealt = df.select(key, size, F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch"))
    return dealt.groupBy("batch").applyInPandas(pack, f"{key} {dict(df.dtypes)[key]}, batch int, pack int")


def label_mask(source: Column, target: Column, ignore: int = -100) -> Column:
    """``struct<input_ids, labels>``: source ids are ignored in the labels."""
    return F.struct(F.concat(source, target).alias("input_ids"), F.concat(F.transform(source, lambda _: F.lit(ignore)), target).alias("labels"))


def blocks(ids: Column, size: int) -> Column:
    """An id list cut into whole blocks; the rest that fills none is dropped, as pretraining rows are."""
    n = F.floor(F.size(ids) / size).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(ids, i * size + 1, F.lit(size)))).otherwise(F.slice(F.array(ids), 1, 0))


def token_accuracy(predicted: Column, labels: Column, ignore: int = -100) -> Column:
    """Share of counted positions where the prediction before meets the label."""
    pairs = F.filter(F.zip_with(F.slice(predicted, 1, F.greatest(F.size(predicted) - 1, F.lit(0))), F.slice(labels, 2, F.size(labels)), lambda p, y: F.struct(p.alias("p"), y.alias("y"))), lambda x: x.y != ignore)
    return F.when(F.size(pairs) > 0, F.size(F.filter(pairs, lambda x: x.p == x.y)) / F.size(pairs))


def token_batches(df: DataFrame, key: str, size: str, budget: int, padded: bool = True, batch: int = 10_000) -> DataFrame:
    """``key``, ``batch``, ``step``: rows in order filled into steps of a token budget.

    A padded step costs its longest row times its rows, a padding-free one the sum of its rows; a
    row beyond the budget is a step of its own. Rows are dealt to batches by hash, as what a step
    holds depends on all before it.
    """
    batches = max(1, -(-df.count() // batch))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        out, step, longest, n, total = [], 0, 0, 0, 0
        for k, s in zip(*(rows.sort_values(key)[c].tolist() for c in (key, size))):
            cost = max(longest, s) * (n + 1) if padded else total + s
            if n and cost > budget:
                step, longest, n, total = step + 1, 0, 0, 0
            longest, n, total = max(longest, s), n + 1, total + s
            out.append((k, int(rows["batch"].iloc[0]), step))
        return pd.DataFrame(out, columns=[key, "batch", "step"])

    dealt = df.select(key, F.coalesce(size, F.lit(0)).alias(size), F.pmod(F.xxhash64(key), F.lit(batches)).cast("int").alias("batch"))
    return dealt.groupBy("batch").applyInPandas(fill, f"{key} {dict(df.dtypes)[key]}, batch int, step int")


def pair_loss(df: DataFrame, keys: list[str], margin: str, target: str, weight: str, beta: float = 1.0) -> DataFrame:
    """Per key: pairs, weighted soft cross entropy of ``target`` against a sigmoid of the margin, weighted accuracy, mean margin.

    Rows without margin, target or weight take no part; probabilities are held off 0 by 1e-12.
    """
    rows = df.where(F.col(margin).isNotNull() & F.col(target).isNotNull() & F.col(weight).isNotNull())
    p, t, w = sigmoid(F.col(margin) / beta), F.col(target), F.col(weight)
    log = lambda x: F.ln(F.greatest(x, F.lit(1e-12)))
    loss = F.sum(w * -(t * log(p) + (1 - t) * log(1 - p))) / F.sum(w)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), loss.alias("loss"), (F.sum(w * (F.col(margin) > 0).cast("double")) / F.sum(w)).alias("accuracy"), F.avg(margin).alias("mean_margin"))
