import random
from datetime import datetime, timedelta

from trellium.operators.memory import MemoryRules, source_memory_fold
from trellium.sources.store import Store
from trellium.streaming.memory import EVENTS, TABLE, follow_events


def loop(events, rules=MemoryRules()):
    out = {}
    for key, ts, i, status, jobs, high, q in sorted((e for e in events if e[0] is not None), key=lambda e: (e[1], e[2])):
        s = out.setdefault(key, {"score": rules.initial, "visits": 0, "jobs": 0, "high": 0, "errors": 0, "blocked": 0, "streak": 0, "q": 0})
        d = 0
        if status == "ok":
            d += 600 * jobs + 800 * high + 4 * max(0, min(100, q))
            s["streak"] = 0 if jobs else s["streak"] + 1
            if not jobs:
                d -= 150 + (150 if s["streak"] >= 4 else 0)
            if q <= 30:
                d -= 250
        else:
            d -= 300 if status == "blocked_by_robots" else 500
            s["streak"] += 1
            s["blocked" if status == "blocked_by_robots" else "errors"] += 1
        s["jobs"], s["high"] = s["jobs"] + jobs, s["high"] + high
        s["score"] = max(0, min(10000, s["score"] + d))
        s["visits"], s["q"] = s["visits"] + 1, max(0, min(100, q))
    return sorted((k, v["score"] / 100, v["visits"], v["jobs"], v["high"], v["errors"], v["blocked"], v["streak"], v["q"]) for k, v in out.items())


def events(seed, n, start=datetime(2025, 3, 1)):
    r = random.Random(seed)
    out = []
    for i in range(n):
        status = r.choice(["ok", "ok", "ok", "blocked_by_robots", "error:x"])
        jobs = r.choice([0, 0, 0, 1, 2])
        out.append((r.choice(["a", "b", "c", None]) if r.random() > 0.3 else "a", start + timedelta(hours=r.randrange(300)), i, status, jobs, min(jobs, r.randrange(2)), r.randrange(-20, 130)))
    return out


def test_chunked_fold_is_the_loop(spark):
    rows = events(1, 600)
    df = spark.createDataFrame(rows, EVENTS)
    for most in (1, 7, 60, 10_000):  # down to seconds, hours, days, and uncut
        assert sorted(map(tuple, source_memory_fold(df, chunk_rows=most).collect())) == loop(rows)
    assert source_memory_fold(df.limit(0)).count() == 0


def test_stream_equals_batch_and_runs_again(spark, tmp_path):
    parts = [events(n, 80, datetime(2025, 3, 1) + timedelta(days=30 * n)) for n in range(3)]
    rows, store = [], Store(spark, f"file://{tmp_path}/store")
    for n, p in enumerate(parts):
        p = [(k, t, 1000 * n + i, *rest) for k, t, i, *rest in p]
        rows += p
        spark.createDataFrame(p, EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow_events(spark, f"{tmp_path}/in", store, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, store.read(TABLE).collect())) == loop(rows)
    follow_events(spark, f"{tmp_path}/in", store, f"{tmp_path}/check").awaitTermination()
    assert sorted(map(tuple, store.read(TABLE).collect())) == loop(rows)
