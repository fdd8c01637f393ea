"""Blocked scans, pointer chains and map folds against plain Python, with one key that holds most rows."""

import random

from pyspark.sql import functions as F

from vidweave.operators import intervals as I
from vidweave.operators.scans import Scan, chain, ordered_fold, prefix_scan
from vidweave.streaming import windows as W


def rows_of_keys(n, seed):
    """(key, t, id, v): key 'hot' holds most rows, one key is null, v is null at times."""
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", None]
    return [(rng.choice(keys), rng.randrange(0, 5000), i, rng.choice([None, rng.randrange(100)])) for i in range(n)]


def test_prefix_scan_carries_over_ranges(spark):
    rows = rows_of_keys(600, 1)
    df = spark.createDataFrame(rows, "key string, t long, id long, v long").repartition(3)
    v = F.col("v")
    scans = [Scan("s", "sum", v), Scan("m", "max", v, inclusive=True), Scan("l", "last", v), Scan("n", "last", v, inclusive=True, reverse=True), Scan("z", "sum", v, reverse=True)]
    got = {r["id"]: r for r in prefix_scan(df, "key", F.col("t"), 100, ["t", "id"], scans).collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        for k, r in enumerate(own):
            some = lambda xs: [x[3] for x in xs if x[3] is not None]
            before, upto, after, onward = some(own[:k]), some(own[: k + 1]), some(own[k + 1 :]), some(own[k:])
            x = got[r[2]]
            assert x["s"] == (sum(before) if before else None) and x["z"] == (sum(after) if after else None)
            assert x["m"] == max(upto, default=None) and x["l"] == (before[-1] if before else None) and x["n"] == (onward[0] if onward else None)
    # the hot key is dealt over tasks: windows are by key and range
    assert len({r[1] // 100 for r in rows if r[0] == "hot"}) > 40
    plan = prefix_scan(df, "key", F.col("t"), 100, ["t", "id"], scans[:1])._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan.split("Window [sum(v")[1].split("]")[1]


def test_chain_follows_pointers(spark):
    rows = [("k", i, i + 3 if i + 3 < 200 else None) for i in range(200)] + [(None, 0, 5), (None, 5, 6), (None, 6, None), ("one", 0, None), ("none", 1, 2)]
    got = chain(spark.createDataFrame(rows, "key string, at long, to long"), "key").collect()
    want = [("k", i) for i in range(0, 200, 3)] + [(None, 0), (None, 5), (None, 6), ("one", 0)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_fold_is_in_order_over_ranges(spark):
    rows = rows_of_keys(900, 2)
    df = spark.createDataFrame(rows, "key string, t long, id long, v long").repartition(4)
    joined = lambda items: F.array_join(F.transform(items, lambda x: x["id"].cast("string")), ",")
    got = {r["key"]: r["folded"] for r in ordered_fold(df, "key", ["t", "id"], joined, ["id"], lambda f, g: F.concat(f, F.lit(","), g), run=16).collect()}
    for key in {r[0] for r in rows}:
        assert got[key] == ",".join(str(r[2]) for r in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3]))


def test_lockout_on_a_hot_key(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.randrange(0, 3000), i, rng.random() < 0.15) for i in range(500)]
    rows += [("same", 7, 1000 + i, i == 3) for i in range(9)]  # all at one time
    df = spark.createDataFrame(rows, "key string, ts_s long, attempt_id long, success boolean")
    for window, captcha, most in ((60, 2, 3), (600, 3, 5), (5, 1, 1)):
        got = {tuple(r) for r in W.login_lockout(df, window, captcha, most, width_s=50).collect()}
        want = set()
        for key in {r[0] for r in rows}:
            own = sorted((r[1:] for r in rows if r[0] == key), key=lambda r: r[:2])
            want |= set(W.lockout_rows(key, own, window_s=window, captcha=captcha, most=most))
        assert got == want
    assert W.login_lockout(df.limit(0)).count() == 0


def test_cache_ttl_on_a_hot_key(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "b", None]), rng.randrange(0, 4000), i) for i in range(400)]
    got = {r["ask_id"]: r["hit"] for r in W.cache_hits_ttl(spark.createDataFrame(rows, "key string, ts_s long, ask_id long"), 30, width_s=100).collect()}
    for key in {r[0] for r in rows}:
        anchor = None
        for _, ts, ask in sorted((r for r in rows if r[0] == key), key=lambda r: r[1:]):
            hit = anchor is not None and ts <= anchor + 30
            anchor = anchor if hit else ts
            assert got[ask] == hit


def test_state_folds_on_a_hot_key(spark):
    rng = random.Random(5)
    names = [*W.EVENT_MOVES, "failed", "unknown"]
    rows = [(rng.choice(["hot"] * 5 + ["a", None]), i, rng.choice(names), rng.randrange(0, 6), rng.choice(["RUNNING", "DONE", "FAILED"])) for i in range(2500)]
    df = spark.createDataFrame(rows, "key string, id long, change string, version long, status string").repartition(4)
    events = {r["key"]: tuple(r)[1:] for r in W.event_state_fold(df, "key", ["id"]).collect()}
    jobs = {r["key"]: tuple(r)[1:] for r in W.job_state_fold(df, "key", ["id"]).collect()}
    for key in {r[0] for r in rows}:
        state, applied, version, status = ("PENDING", 0), 0, 0, "PENDING"
        for r in (r for r in rows if r[0] == key):
            after = W.event_move(r[2], state, 3)
            state, applied = (after, applied + 1) if after else (state, applied)
            version, status = (version + 1, r[4]) if r[3] == version else (version, status)
        assert events[key] == (*state, applied)
        assert jobs[key] == (status, version, status in ("DONE", "FAILED"))


def test_intervals_of_one_key_cross_ranges(spark):
    rng = random.Random(6)
    rows = [("hot", s, s + rng.randrange(1, 400)) for s in (rng.randrange(0, 20_000) for _ in range(300))]
    df = spark.createDataFrame(rows, "key string, start_ms long, end_ms long")
    want = []
    for _, s, e in sorted(rows):
        if want and s <= want[-1][1] + 80:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    for width in (50, 1000, 10**6):
        assert sorted([r["start_ms"], r["end_ms"]] for r in I.merge_intervals(df, "key", 80, width).collect()) == want
