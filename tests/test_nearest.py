import random

from pyspark.sql import functions as F

from pathloom.functions import text
from pathloom.operators import nearest


def dice(a, b):
    grams = lambda k: {k[i : i + 2] for i in range(max(1, len(k) - 1))} if k else set()
    x, y = grams(a), grams(b)
    return round(2 * len(x & y) / (len(x) + len(y)), 6) if x and y else 0.0


def tasks(n=90):
    rng = random.Random(3)
    words = ["open", "mail", "7", "a", "play", "song", "map", ""]
    return [(i, rng.choice(["busy", "busy", "u1", "u2", None]), rng.choice(["x", "y", "z", None]), f"t{rng.randrange(40):02}", " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5)))) for i in range(n)]


def frame(spark, rows):
    df = spark.createDataFrame(rows, "row_id bigint, user_id string, age string, time string, intent string")
    return df.withColumn("key", text.key_alnum(F.col("intent")))


def test_same_user_reaches_all_earlier_rows_of_a_split_user(spark):
    rows = tasks()
    df = frame(spark, rows).withColumn("place", F.substring("time", 2, 2).cast("int"))
    key = {r[0]: r[4].replace(" ", "") for r in rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] and a[1] == b[1] and b[3] < a[3]:
                for mode in ["same", "other"] if a[4] != b[4] else ["same"]:
                    want[a[0], mode] = max(want.get((a[0], mode), (-1,)), (dice(key[a[0]], key[b[0]]), b[3], b[0]))
    for block in (7, 8192):
        got = {(r.row_id, r.mode): (r.similarity, r.reference) for r in nearest.best_of_same_user(df, "user_id", F.col("place"), "key", "intent", block).collect()}
        assert got == {k: (v[0], v[2]) for k, v in want.items()}


def test_other_group_needs_no_common_class(spark):
    rows = tasks()
    df = frame(spark, rows)
    key = {r[0]: r[4].replace(" ", "") for r in rows}
    want = {}
    for a in rows:
        for b in rows:
            if a[1] and b[1] and a[1] != b[1] and a[2] and b[2] and a[2] != b[2]:
                for mode in ["any", "past"] if b[3] < a[3] else ["any"]:
                    want[a[0], mode] = max(want.get((a[0], mode), -1), dice(key[a[0]], key[b[0]]))
    for block in (20, 8192):
        assert {(r.row_id, r.mode): r.similarity for r in nearest.best_of_other_group(df, "user_id", "age", "time", "key", block).collect()} == want
    by = {r[0]: r for r in rows}
    own, cross = nearest.drawn_same_user(df, "user_id", "time").collect(), nearest.drawn_other_group(df, "user_id", "age").collect()
    assert {r.row_id for r in cross} == {i for i, mode in want if mode == "any"}
    assert all(by[r.reference][1] != by[r.row_id][1] and by[r.reference][2] != by[r.row_id][2] for r in cross)
    assert {r.row_id for r in own} == {a[0] for a in rows if any(a[1] and a[1] == b[1] and b[3] < a[3] for b in rows)}
    assert all(by[r.reference][1] == by[r.row_id][1] and by[r.reference][3] < by[r.row_id][3] for r in own)


def test_a_better_reference_beyond_ten_tasks_is_found(spark):
    rows = [(0, "u", None, "t00", "play the song")] + [(i, "u", None, f"t{i:02}", f"map {i}{i}") for i in range(1, 15)] + [(15, "u", None, "t15", "play the song")]
    df = frame(spark, rows).withColumn("place", F.col("row_id"))
    for block in (4, 8192):
        got = {r.row_id: (r.reference, r.similarity) for r in nearest.best_of_same_user(df, "user_id", F.col("place"), "key", block=block, late=False).collect()}
        assert got[15] == (0, 1.0) and got[1] == (0, 0.0) and len(got) == 15
