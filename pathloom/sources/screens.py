"""Episode folders and accessibility trees."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEXTS, _FLAGS = ("text", "content_desc", "hint", "view_id", "class_name", "bounds"), ("clickable", "enabled", "visible", "scrollable", "editable")
NODES = T.ArrayType(T.StructType([
    T.StructField("index", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in _TEXTS], *[T.StructField(n, T.BooleanType()) for n in _FLAGS],
    T.StructField("center_x", T.IntegerType()), T.StructField("center_y", T.IntegerType()), T.StructField("merged_text", T.StringType()),
]))
_ARROW = pa.list_(pa.struct([("index", pa.int32()), *[(n, pa.string()) for n in _TEXTS], *[(n, pa.bool_()) for n in _FLAGS], ("center_x", pa.int32()), ("center_y", pa.int32()), ("merged_text", pa.string())]))


def _node(index: int, a: dict[str, str]) -> dict:
    plain = lambda n: " ".join(a.get(n, "").split())
    edges = [int(x) for x in re.findall(r"-?\d+", a.get("bounds", ""))][:4]
    text, said, hint = plain("text"), plain("content_desc"), plain("hint")
    middle = (int((edges[0] + edges[2]) / 2), int((edges[1] + edges[3]) / 2)) if len(edges) == 4 else (None, None)
    flag = lambda n: a.get(n, "").lower() == "true"
    return {
        "index": index, "text": text, "content_desc": said, "hint": hint, "view_id": a.get("view_id") or a.get("resource-id", ""), "class_name": a.get("class", ""), "bounds": a.get("bounds", ""),
        "clickable": flag("clickable"), "enabled": flag("enabled"), "visible": a.get("visible", "true").lower() != "false", "scrollable": flag("scrollable"), "editable": flag("editable"),
        "center_x": middle[0], "center_y": middle[1], "merged_text": text or said or hint,
    }


@F.arrow_udf(NODES)
def nodes(trees: pa.Array) -> pa.Array:
    """Nodes of accessibility trees in document order; a broken tree has none. Attributes stay aligned."""
    out = []
    for tree in trees.to_pylist():
        try:
            root = None if tree is None else ET.fromstring(tree)
            out.append(None if root is None else [_node(i, e.attrib) for i, e in enumerate(root.iter("node"))])
        except ET.ParseError:
            out.append([])
    return pa.array(out, _ARROW)


def listing(spark: SparkSession, root: str) -> DataFrame:
    """``path, user_id, time, name`` of every file below ``root/user/time``; contents aren't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    rest = F.split(F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(root.strip('/'))}/", ""), "/")
    return found.select("path", rest[0].alias("user_id"), F.get(rest, F.size(rest) - 2).alias("parent"), F.get(rest, F.lit(1)).alias("time"), F.element_at(rest, -1).alias("name"))


def stamp(name: Column) -> Column:
    """The last number in a file's name without ending."""
    numbers = F.regexp_extract_all(F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), "^tree_", ""), F.lit(r"\d+"), F.lit(0))
    return F.coalesce(F.get(numbers, F.size(numbers) - 1), F.regexp_replace(name, r"\.[^.]*$", ""))


def observations(files: DataFrame) -> DataFrame:
    """Screenshot and tree of every moment of an episode."""
    image, tree = F.lower("name").rlike(r"\.(png|jpe?g|webp)$"), F.lower("name").endswith(".xml")
    some = files.where(image | tree)
    return some.groupBy("user_id", "time", stamp(F.col("name")).alias("stamp")).agg(F.max(F.when(image, F.col("path"))).alias("screenshot"), F.max(F.when(tree, F.col("path"))).alias("tree"))


def episodes(files: DataFrame, complete: bool = False, allowed: DataFrame | None = None, most_per_user: int = 0) -> DataFrame:
    """Episodes with an action log; complete ones also have a survey, an image and a tree."""
    image, tree = F.lower("name").rlike(r"\.(png|jpe?g|webp)$"), F.lower("name").endswith(".xml")
    first = F.min(F.when(F.col("parent").startswith("Screenshots"), F.col("parent"))).alias("shots")
    has = lambda c, n: F.bool_or(c).alias(n)
    own = files.groupBy("user_id", "time").agg(has(F.col("name") == "action.jsonl", "has_actions"), has(F.col("name").startswith("survey"), "has_survey"), first)
    shots = files.groupBy("user_id", "time", "parent").agg(has(image, "has_image"), has(tree, "has_tree"))
    out = own.join(shots, (own.user_id == shots.user_id) & (own.time == shots.time) & (own.shots == shots.parent), "left").select(own.user_id, own.time, "has_actions", (F.col("has_survey") & F.coalesce(F.col("has_image") & F.col("has_tree"), F.lit(False))).alias("is_complete"))
    out = out.where("has_actions")
    if complete:
        out = out.where("is_complete")
    if allowed is not None:
        out = out.join(allowed.select("user_id", "time").distinct(), ["user_id", "time"], "left_semi")
    if most_per_user:
        from pathloom.operators.causal import top_k

        out = top_k(out, ["user_id"], [F.col("time")], most_per_user, "_n").drop("_n")
    return out


def episode_index(files: DataFrame, root: str) -> DataFrame:
    """``part, time, folder``: for every folder above an episode, and its time, the first such episode folder by path."""
    inner = F.filter(F.split(F.regexp_replace("path", rf"^(?:file:)?/*{re.escape(root.strip('/'))}/", ""), "/"), lambda p: p != "")
    found = files.where("name = 'action.jsonl'").select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.slice(inner, 1, F.greatest(F.size(inner) - 1, F.lit(0))).alias("parts")).where("size(parts) > 0")
    each = found.select("folder", F.explode(F.array_distinct("parts")).alias("part"), F.element_at("parts", -1).alias("time"))
    return each.groupBy("part", "time").agg(F.min("folder").alias("folder"))


def assets(files: DataFrame) -> DataFrame:
    """Per episode its screenshots and its trees, each in the order of their stamps and then of their paths."""
    image, tree = F.lower("name").rlike(r"\.(png|jpe?g|webp)$"), F.lower("name").endswith(".xml")
    place = F.struct(F.lpad(stamp(F.col("name")), 24, "0").alias("s"), "path")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, place))), lambda x: x.path)
    return files.groupBy("user_id", "time").agg(ordered(image).alias("screenshots"), ordered(tree).alias("trees"))
