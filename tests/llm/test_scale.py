"""Cases in which an operator once lost rows, took quadratic time or depended on a size."""

import pyarrow as pa
from pyspark.sql import functions as F

from pathloom.llm import answers, charform, dedup, language, overlap, packing, splits, topn, variants


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bounds_of_small_buffers_and_few_bounds(spark, monkeypatch):
    df = spark.range(6000).selectExpr("concat('g', least(id % 40, 20)) AS g", "cast(id % 900 as string) AS c", "cast(id * 7919 % 1000 as double) AS s", "cast(id % 3 as int) AS r")
    whole = rows(topn.top_n(df, 3, "g", "c", "s", "r"), "g", "place", "c")
    monkeypatch.setattr(topn, "BUFFER", 100)
    assert rows(topn.top_n(df, 3, "g", "c", "s", "r"), "g", "place", "c") == whole
    monkeypatch.setattr(topn, "BROADCAST_BYTES", 600)
    assert rows(topn.top_n(df, 3, "g", "c", "s", "r"), "g", "place", "c") == whole and len(whole) == 63


def test_a_large_class_of_equal_rows_costs_its_result(spark, monkeypatch):
    df = spark.range(60_000).select(F.col("id").alias("row_id"), F.when(F.col("id") == 17, "Ｏpen it").otherwise("Open it").alias("intent"))
    for hot in (variants.HOT, 1000):
        monkeypatch.setattr(variants, "HOT", hot)
        found = variants.variant_pairs(df, "intent")
        assert found.count() == 59_999 and found.where("id_a < id_b AND (id_a = 17 OR id_b = 17)").distinct().count() == 59_999
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()


def test_every_split_has_components_of_all_sizes(spark):
    labelled = spark.range(3000).select(F.explode(F.sequence(F.lit(0), F.pmod(F.xxhash64("id"), F.lit(40)).cast("int"))).alias("k"), F.col("id").cast("string").alias("component"))
    hot = spark.range(2000).select(F.col("id").cast("int").alias("k"), F.lit("hot").alias("component"))
    out = splits.assign(labelled.unionByName(hot), {"train": 0.8, "validation": 0.1, "test": 0.1}, bucket=100)
    total = out.count()
    sized = out.groupBy("component", "new_split").count()
    assert sized.count() == 3001
    found = {r.new_split: r for r in sized.groupBy("new_split").agg(F.sum("count").alias("n"), F.avg(F.when(F.col("component") != "hot", F.col("count"))).alias("size")).collect()}
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        assert abs(found[name].n / total - share) < 0.005 and abs(found[name].size - 20.5) < 2.5


def test_packing_keeps_what_the_last_level_leaves(spark, monkeypatch):
    monkeypatch.setattr(packing, "_LEVELS", 1)
    df = spark.range(500).selectExpr("id AS doc_id", "cast(60 + id % 5 as int) AS n")
    assert rows(packing.containers(df, "doc_id", "n", capacity=100, window=50), "item", "size") == [(i, 60 + i % 5) for i in range(500)]


def test_counts_equal_the_pairs(spark):
    data = [(0, "a", "the same words here", "train"), (0, "b", "The same words here", "test"), (0, "b", "the same wordz here", "test"), (0, "b", "the same words here", "validation"), (0, "c", "the same words here", "test"), (0, "c", "the same words here", "train"), (1, "x", "quite another sentence", "train"), (1, "y", "quite another sentence!", "validation"), (1, "z", "nothing alike", "test")]
    data += [(0, f"t{i}", "the same words here", "train") for i in range(5)] + [(0, f"h{i}", "the same wordz here", "test") for i in range(4)]
    df = spark.createDataFrame(data, "grp int, id string, text string, split string")
    pairs = overlap.overlaps(df).distinct().groupBy("grp", "held_split").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("held_id").alias("n_records"))
    names = ["grp", "held_split", "n_pairs", "n_records"]
    assert rows(overlap.overlap_counts(df), *names) == rows(pairs, *names)
    assert overlap.overlap_counts(df.limit(0)).count() == 0


def test_hot_codes_are_split(spark, monkeypatch):
    df = spark.createDataFrame([(0, f"{s}{i}", f"open the window number {i % 30} and look outside", s) for s in ("train", "test") for i in range(60)], "grp int, id string, text string, split string")
    whole = rows(overlap.overlaps(df), "train_id", "held_id")
    monkeypatch.setattr(overlap, "HOT", 4)
    monkeypatch.setattr(overlap, "HOT_TIMES", 1)
    assert rows(overlap.overlaps(df), "train_id", "held_id") == whole


def test_numbers_of_records(spark):
    long = "9" * 5000
    texts = ['{"a": NaN}', '{"a": NaN}', f'{{"a": {long}}}', f'{{ "a" : {long}.0 }}', f'{{"a": {long}1}}', '{"b": 1.50}', '{"b": 15e-1}', '{"b": 1.5e400}', '{"b": 15E399}', '{"b": -0}', '{"b": 0.0}', '{"b": "1.5"}', '{"caf\\u00e9": "X"}', '{"café": "x!"}']
    df = spark.createDataFrame(list(enumerate(texts)), "line_id bigint, payload string")
    assert rows(dedup.record_copies(df, "payload", "line_id"), "keep_id", "copy_id") == [(2, 3), (5, 6), (7, 8), (9, 10), (12, 13)]


def test_copies_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"Text {i % 7}" + "!" * (i % 3)) for i in range(50)], "row_id bigint, intent string")
    whole = rows(dedup.copies(df, "intent", "row_id"), "keep_id", "copy_id")
    monkeypatch.setattr(dedup, "BROADCAST_BYTES", -1)
    assert rows(dedup.copies(df, "intent", "row_id"), "keep_id", "copy_id") == whole and len(whole) == 43


def test_words_keep_their_script():
    form = lambda *texts: charform.convert(pa.array(texts), "form").to_pylist()
    assert form("Открой роса, её дом", "Mосква", "cаt", "роса", "Ωμέγα ρο", "Zоrrа pау по") == ["Открой роса, её дом", "Москва", "cat", "poca", "Ωμέγα ρο", "Zorra pay по"]
    assert form("Oткpoй poca, eё дoм", "Moсквa")[0] == form("Открой роса, её дом")[0]
    a, b, c = charform.digests(pa.array(["ab", "ab", "ba"])).to_pylist()
    assert a == b != c and len(a) == 16 and charform.digests(pa.array([None, ""], pa.string())).to_pylist()[0] is None


def test_languages_and_what_a_prompt_asks_for():
    ask = "What now? Answer in English."
    cases = [
        ("Ouvrez l'application et cherchez la soupe.", ask, "other_language"), ("Öffne die App und suche nach der Suppe.", ask, "other_language"), ("앱을 열고 수프를 찾아 주세요.", ask, "other_language"),
        ("アプリを開いてスープを探してください。", "现在做什么？请用一句中文回答。", "other_language"), ("El restaurante chino está cerca", "¿Dónde está el restaurante chino?", None), ("El intruso está en la casa", "¿Quién es el intruso?", None),
        ("My apologies, this request is outside what I am permitted to do", ask, "refusal"), ("Je suis désolé, je ne peux pas vous aider.", "Que faire ?", "refusal"), ("Es tut mir leid, dabei kann ich nicht helfen.", "Was nun?", "refusal"),
        ("打开应用。", "Answer in English.\nProfile: x", "other_language"), ("Open the app and look for soup.", "Answer in English.\nProfile: x", None), ("Yes.", ask, None), ("Открой дверь и найди ключ.", ask, "other_language"),
    ]
    got = answers._features(pa.array([c[0] for c in cases]), pa.array([c[1] for c in cases]))
    assert [g["defect"] for g in got.to_pylist()] == [c[2] for c in cases]
    assert language.languages(["", "12 !", "Zorra", "Ella quiere ver la casa"]) == [None, None, None, "es"]
