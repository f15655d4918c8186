import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

import trellium.llm.topn as topn
from trellium.llm.topn import top_n_per_group

SCHEMA = "source_key string, job_id bigint, fit_score int, last_seen_at timestamp_ntz, g string, c0 string, rank string"


def run(df, n=5):
    code = [F.col("fit_score"), F.unix_micros(F.col("last_seen_at").cast("timestamp")), -F.col("job_id")]
    return sorted((r.source_key, r.job_id) for r in top_n_per_group(df, "source_key", code, n, ["job_id"]).collect())


def brute(rows, n=5):
    groups = {}
    for r in rows:
        if r[0] is not None and r[2] is not None:
            groups.setdefault(r[0], []).append((-r[2], -(r[3] - datetime(1970, 1, 1)).total_seconds() if r[3] else float("inf"), r[1]))
    return sorted((k, x[2]) for k, v in groups.items() for x in sorted(v)[:n])


def test_against_sorting_with_a_hot_group_ties_and_nulls(spark, monkeypatch):
    r = random.Random(3)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else r.choice([None, "", *"abcdefghij"])
        seen = None if r.random() < 0.2 else datetime(2025, 1, 1) + timedelta(seconds=r.choice([0, 1, r.randrange(10**7)]))
        rows.append((key, i, r.choice([None, 90, 90, r.randrange(-5, 100)]), seen, "x", "y", "z"))
    rows += [("flat", 10_000 + i, 50, None, "x", "y", "z") for i in range(400)]  # one score, no times
    df = spark.createDataFrame(rows, SCHEMA)
    assert run(df) == brute(rows)
    assert run(df, 1) == brute(rows, 1)
    monkeypatch.setattr(topn, "BROADCAST_GROUPS", 3)  # too many groups: only the hot one's state is broadcast
    assert run(df) == brute(rows)


def test_equal_rows_empty_and_small(spark):
    same = [("k", 7, 10, None, "x", "y", "z")] * 9
    assert run(spark.createDataFrame(same, SCHEMA)) == [("k", 7)] * 5
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([("k", 1, None, None, "", "", ""), ("j", 2, -3, None, "", "", "")], SCHEMA)) == [("j", 2)]


def test_large_groups_never_meet_in_a_shuffle(spark):
    rows = spark.range(100).select((F.col("id") % 7).cast("string").alias("g"), F.col("id").alias("c0"))
    state = rows.groupBy("g").agg(F.max("c0").alias("hi"))
    hot = spark.createDataFrame([("3",)], "g string")
    joined = topn._with_state(rows, state, hot)
    assert joined.count() == 100
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("LeftSemi") == 1 and plan.count("broadcast") >= 3
