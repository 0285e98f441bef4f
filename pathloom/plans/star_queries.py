"""Queries of statistics, sampling and vectors over the star schema, documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.functions import scores, text, vectors
from pathloom.operators import components, sampling, stats
from pathloom.storage import table

TENTHS = [0.5, 0.9, 0.95]


def numeric_summary_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.linear_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", TENTHS)
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean", "least", "most", "q50", "q90", "q95")])


LINEAR = """
SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(min(l_quantity), 6) AS least, round(max(l_quantity), 6) AS most,
  round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.9), 6) AS q90, round(quantile_cont(l_quantity, 0.95), 6) AS q95 FROM lineitem GROUP BY l_returnflag
"""


def numeric_summary_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.lower_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", TENTHS)


LOWER = """
WITH s AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_quantity)) AS v FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY ALL)
SELECT l_returnflag, l_linestatus, CAST(len(v) AS BIGINT) AS n, v[CAST(floor((len(v) - 1) * 0.5e0) AS INTEGER) + 1] AS q50, v[CAST(floor((len(v) - 1) * 0.9e0) AS INTEGER) + 1] AS q90, v[CAST(floor((len(v) - 1) * 0.95e0) AS INTEGER) + 1] AS q95 FROM s
"""


def nullspace_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier, discounts as preference margins freed of their part along the quantities."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_quantity") / 50).alias("t"), F.col("l_discount").alias("p"), (1 + F.col("l_tax")).alias("w"))
    out = stats.null_space(rows, ["l_suppkey"], "t", "p", "w")
    return out.groupBy("l_suppkey").agg(F.round(F.max("rho"), 6).alias("rho"), F.round(F.avg(F.abs("null_margin")), 6).alias("mean_margin"), (F.round(F.abs(F.sum(F.col("w") * F.col("null_margin") * F.col("t"))), 4) == 0).alias("orthogonal"))


NULLSPACE = """
WITH r AS (SELECT l_suppkey, l_quantity / 50 AS t, l_discount AS p, 1 + l_tax AS w FROM lineitem), k AS (SELECT l_suppkey, sum(w * p * t) / (sum(w * t * t) + 1e-8) AS rho FROM r GROUP BY l_suppkey),
m AS (SELECT r.*, rho, CASE WHEN abs(p - rho * t) < 1e-7 THEN 0 ELSE p - rho * t END AS n FROM r JOIN k USING (l_suppkey))
SELECT l_suppkey, round(max(rho), 6) AS rho, round(avg(abs(n)), 6) AS mean_margin, round(abs(sum(w * n * t)), 4) = 0 AS orthogonal FROM m GROUP BY l_suppkey
"""


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line status: correlation and least-squares line of price on quantity, errors of a flat guess."""
    x, y = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.round(F.coalesce(F.nanvl(F.corr(x, y), F.lit(0.0)), F.lit(0.0)), 5).alias("r"), F.round(F.regr_slope(y, x), 3).alias("slope"), F.round(F.avg(F.abs(y - 1500 * x)), 3).alias("mae"), F.count(F.lit(1)).alias("n"),
    )


REGRESSION = "SELECT l_linestatus, round(coalesce(corr(l_quantity, l_extendedprice), 0), 5) AS r, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(avg(abs(l_extendedprice - 1500 * l_quantity)), 3) AS mae, count(*) AS n FROM lineitem GROUP BY l_linestatus"


def largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.largest_remainder(table(spark, sf_dir, "orders"), "o_orderpriority", 997)


REMAINDER = """
WITH c AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY ALL), s AS (SELECT *, n * 997e0 / sum(n) OVER () AS share FROM c),
b AS (SELECT *, floor(share) AS base, row_number() OVER (ORDER BY share - floor(share) DESC, o_orderpriority) AS r FROM s)
SELECT o_orderpriority, n, CAST(base + CASE WHEN r <= 997 - (SELECT sum(floor(share)) FROM s) THEN 1 ELSE 0 END AS BIGINT) AS take FROM b
"""


def length_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.length_cdf(table(spark, sf_dir, "documents"), "n_chars", 500)
    return out.select("bin", "n", "running", F.round("percent", 6).alias("percent"))


CDF = """
WITH b AS (SELECT CAST(floor(n_chars / 500) * 500 AS BIGINT) AS bin, count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY ALL)
SELECT bin, n, CAST(sum(n) OVER (ORDER BY bin) AS BIGINT) AS running, round(100e0 * sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS percent FROM b
"""


def hashed_text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed feature-hash embedding of every document's words, as its non-zero cells."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.inline(vectors.hashed_embedding(vectors.words(F.col("text")))))
    return docs.select("doc_id", "idx", F.round("weight", 6).alias("weight"))


EMBEDDING = r"""
WITH l AS (SELECT doc_id, lower(text) AS x FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, unnest(CASE WHEN regexp_matches(x, '[a-z0-9_]') THEN regexp_extract_all(x, '[a-z0-9_]+') ELSE list_filter(regexp_split_to_array(x, '[\t-\r\x1c-\x1f\x{85}\p{Z}]+'), lambda y: y <> '') END) AS token FROM l),
h AS (SELECT doc_id, md5(token) AS m FROM t),
c AS (SELECT doc_id, CAST(CAST('0x' || substr(m, 7, 2) || substr(m, 5, 2) || substr(m, 3, 2) || substr(m, 1, 2) AS BIGINT) % 256 AS INTEGER) AS idx, sum(CASE WHEN CAST('0x' || substr(m, 9, 2) AS INTEGER) % 2 = 0 THEN 1e0 ELSE -1e0 END) AS v FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS l FROM c WHERE v <> 0 GROUP BY doc_id)
SELECT doc_id, idx, round(v / l, 6) AS weight FROM c JOIN n USING (doc_id) WHERE v <> 0
"""


def embedding_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors most alike to every vector whose id is divisible by 100, against all rows."""
    rows = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL").select("vec_id", "embedding")
    return vectors.most_alike(rows.where("vec_id % 100 = 0"), rows, "vec_id", "embedding", 5)


COSINE = """
WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(CAST(e AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS similarity FROM q, embeddings WHERE embedding IS NOT NULL AND vec_id <> query_id)
SELECT query_id, vec_id, similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 5
"""


def comparison_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the graph of compared runs (nations tied by region)."""
    nation = table(spark, sf_dir, "nation")
    x, y = nation.select(F.col("n_nationkey").alias("a"), "n_regionkey"), nation.select(F.col("n_nationkey").alias("b"), "n_regionkey")
    return components.components(x.join(y, "n_regionkey").select("a", "b"))


COMPONENTS = "SELECT x.n_nationkey AS run, min(y.n_nationkey) AS component FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey GROUP BY ALL"


def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source and target lengths of every order's lines that fit a cutoff of 100 units."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("int").alias("source"), (F.count(F.lit(1)) * 12).cast("int").alias("target"))
    s = scores.budget_split(F.col("source"), F.col("target"), 100)
    return per.select("l_orderkey", s.source.alias("source"), s.target.alias("target"))


BUDGET = """
WITH p AS (SELECT l_orderkey, CAST(sum(l_quantity) AS INTEGER) AS s, CAST(count(*) * 12 AS INTEGER) AS t FROM lineitem GROUP BY l_orderkey),
n AS (SELECT *, least(CASE WHEN t * 2 < 100 THEN 100 WHEN s * 2 < 100 THEN 100 - s ELSE CAST(floor(100 * (t / CAST(s + t AS DOUBLE))) AS INTEGER) END, t) AS nt FROM p)
SELECT l_orderkey, CAST(least(greatest(100 - nt, 0), s) AS INTEGER) AS source, CAST(nt AS INTEGER) AS target FROM n
"""


PROMPTS = r"""
SELECT doc_id, CASE WHEN ok THEN length(regexp_replace(regexp_extract(text, '(?is)^\s*\[system\](.*?)\[user\](.*)$', 1), '^\s+|\s+$', '', 'g')) END AS n_system,
  length(regexp_replace(CASE WHEN ok THEN regexp_extract(text, '(?is)^\s*\[system\](.*?)\[user\](.*)$', 2) ELSE regexp_replace(text, '(?i)^\s*\[(?:system|user)\]\s*', '') END, '^\s+|\s+$', '', 'g')) AS n_user
FROM (SELECT *, regexp_matches(text, '(?is)^\s*\[system\](.*?)\[user\](.*)$') AS ok FROM documents WHERE text IS NOT NULL)
"""


def prompt_parts_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with a text as lengths of their system and user parts; untagged text is the user's."""
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.prompt_parts(F.col("text")).alias("p"))
    return rows.select("doc_id", F.length("p.system").alias("n_system"), F.length("p.user").alias("n_user"))



QUERIES = {
    "numeric_summary_linear": (numeric_summary_linear, LINEAR), "numeric_summary_lower": (numeric_summary_lower, LOWER), "nullspace_projection": (nullspace_projection, NULLSPACE),
    "regression_report": (regression_report, REGRESSION), "largest_remainder": (largest_remainder, REMAINDER), "length_cdf": (length_cdf, CDF), "hashed_text_embedding": (hashed_text_embedding, EMBEDDING),
    "embedding_cosine_topk": (embedding_cosine_topk, COSINE), "comparison_components": (comparison_components, COMPONENTS), "budget_split": (budget_split, BUDGET), "prompt_parts_whole": (prompt_parts_whole, PROMPTS),
}
