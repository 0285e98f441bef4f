"""Texts that look the same but are different strings, brought to one form and paired.

Texts are converted by :mod:`pathloom.llm.charform`. Rows with equal strings are gathered first
(one row per key and string, with map-side combine), and only forms with two or more strings go
on. Strings of one form are paired with each other, and only then is each pair of strings
expanded to the rows that hold them: every row of every step stands for at least one row of the
result, so a class of n equal rows and one variant costs n and not n * n. A string that more than
``HOT`` rows hold is split over several salts on its way through both expansions.

Defined cases: null texts and texts without a letter or digit are never cases; repeated rows are
rows of their own; equal strings are no pair.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pathloom.llm.charform import convert, digests, invariants, same_form
from pathloom.storage import cut, discard

#: Rows of one string that go through one task; a table of the strings beyond has at most rows / HOT rows.
HOT = 1 << 18


@F.arrow_udf(T.BinaryType())
def form_key(texts: pa.Array) -> pa.Array:
    """Digest of the text in consistent character form; null without a letter or digit."""
    return digests(convert(texts, "form"), none=invariants(texts)[0] == 0)


def variant_pairs(df: DataFrame, text: str, key: str = "row_id") -> DataFrame:
    """``id_a < id_b`` of rows whose texts differ as strings and agree in character form."""
    keyed = df.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), form_key(text).alias("_key"), F.md5(text).alias("_own"))
    keyed = cut(keyed.where(F.col("_key").isNotNull()), "variants")
    spread = keyed.groupBy("_key").agg(F.min("_own").alias("lo"), F.max("_own").alias("hi")).where("lo <> hi").select("_key")
    rows = cut(keyed.join(spread, "_key", "left_semi"), "spread")
    discard(keyed)
    strings = cut(rows.groupBy("_key", "_own").agg(F.count(F.lit(1)).alias("n")), "strings")
    hot = F.broadcast(strings.where(F.col("n") > HOT).select("_own", F.ceil(F.col("n") / HOT).cast("int").alias("parts")))
    salted = rows.join(hot, "_own", "left").select("_id", "_own", F.pmod(F.xxhash64("_id"), F.coalesce("parts", F.lit(1))).cast("int").alias("salt"))
    salts = F.explode(F.sequence(F.lit(0), (F.ceil(F.col("n") / HOT) - 1).cast("int"))).alias("salt")
    a, b = strings.select("_key", F.col("_own").alias("a"), "n"), strings.select("_key", F.col("_own").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "_key").where("a < b").select("a", "b", "nb", salts)
    left = pairs.join(salted.toDF("x", "a", "salt"), ["a", "salt"]).select("x", "b", F.col("nb").alias("n")).select("x", "b", salts)
    both = left.join(salted.toDF("y", "b", "salt"), ["b", "salt"])
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def consistent(df: DataFrame, *texts: str) -> DataFrame:
    """``df`` with the given text columns in consistent character form."""
    return df.withColumns({t: same_form(t) for t in texts})
