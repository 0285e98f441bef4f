import random

from pathloom.functions import text
from pathloom.operators import pools, retrieval


def grams(k):
    return {k[i : i + 2] for i in range(max(1, len(k) - 1))} if k else set()


def tasks(n=120):
    rng = random.Random(5)
    words = ["open", "mail", "7", "play", "song", "map", "给我", ""]
    pick = lambda *x: rng.choice(x)
    return [(f"t{i}", pick("busy", "busy", "u1", "u2", None), f"203101{rng.randrange(1, 9):02}_{pick('07', '12', '23', 'xx')}0000", pick("home", "", None), " ".join(rng.choice(words) for _ in range(rng.randrange(0, 5))), pick("mail", "food", "", None), pick("A", "B", "Home", "", None)) for i in range(n)]


def expected(rows, key, cap, generic=("Home",)):
    """Every pair of targets and references, one after the other."""
    few = []
    for a in rows:
        best = {}
        for b in rows:
            x, y = grams(key[a[0]]), grams(key[b[0]])
            if not y or b[2] >= a[2] or key[a[0]] == key[b[0]]:
                continue
            sim = 2 * len(x & y) / (len(x) + len(y)) if x else 0.0
            scene = float(bool(a[3]) and a[3] == b[3])
            ha, hb = (int(r[2][9:11]) if r[2][9:11].isdigit() else None for r in (a, b))
            hour = 0.0 if ha is None or hb is None else 1 - min(abs(ha - hb), 24 - abs(ha - hb)) / 12
            same_class, same_app = bool(a[5]) and a[5] == b[5], bool(a[6]) and a[6] not in generic and a[6] == b[6]
            found = []
            if a[1] and a[1] == b[1]:
                if (same_class or same_app and sim >= 0.35) and sim >= 0.2:
                    found.append((1, sim >= 0.35, 0.65 * sim + 0.20 * scene + 0.15 * hour))
                elif not same_class and not same_app and (scene or hour >= 0.75) and sim < 0.75:
                    found.append((2, False, 0.15 * sim + 0.55 * scene + 0.30 * hour))
            elif same_class or same_app:
                found.append((3, False, 0.75 * sim + 0.15 * scene + 0.10 * hour))
            for relation, listwise, score in found:
                at = (-relation, listwise, score, b[2], b[0])
                best[key[b[0]]] = max(best.get(key[b[0]], at), at)
        for relation in (1, 2, 3):
            few += [(a[0], k, *v) for k, v in sorted(((k, v) for k, v in best.items() if v[0] == -relation), key=lambda kv: kv[1], reverse=True)[:2]]
    uses, out = {}, set()
    for task, k, relation, _, score, _, ref in sorted(few, key=lambda f: (f[4], f[0]), reverse=True):
        uses[relation, k] = uses.get((relation, k), 0) + 1
        if uses[relation, k] <= cap:
            out.add((task, -relation, k, ref, round(score, 9)))
    return out


def test_pools_need_no_row_per_pair(spark, monkeypatch):
    rows = tasks()
    df = spark.createDataFrame(rows, "task_id string, user_id string, time string, scenario string, intent string, intent_class string, app string")
    key = {r.task_id: r.key for r in df.select("task_id", text.key_alnum("intent").alias("key")).collect()}
    want = expected(rows, key, 6)
    assert {w[1] for w in want} == {1, 2, 3}
    for targets, references, columns in ((32768, 65536, 4096), (50, 30, 8)):
        monkeypatch.setattr(pools, "TARGETS", targets), monkeypatch.setattr(pools, "REFERENCES", references), monkeypatch.setattr(pools, "COLUMNS", columns)
        out = retrieval.retrieval_pools(df, df, generic_apps=("Home",), cap=6)
        got = {(r.task_id, 1 + retrieval.RELATIONS.index(r.relation), r.key, r.source_task_id, round(r.score, 9)) for r in out.collect()}
        assert got == want
    joins = [n for n in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in n and "user_id" in n]
    assert not joins and "CoGroup" in out._jdf.queryExecution().optimizedPlan().toString()
