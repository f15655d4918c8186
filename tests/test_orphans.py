import random
from datetime import datetime, timedelta

import pandas as pd

from trellium.operators.orphans import orphan_references, orphan_report, surviving_bits

REFS, PARENTS = "ref_table string, ref_id bigint, key string, at timestamp_ntz, period string", "key string, at timestamp_ntz, n int"


def brute(refs, parents):
    first, exists = {}, set()
    for k, t, _ in parents:
        if k is not None:
            exists.add(k)
            if t is not None and (k not in first or t < first[k]):
                first[k] = t
    out = []
    for table, i, k, t, _ in refs:
        if k is None:
            continue
        if k not in exists:
            out.append((table, i, "missing"))
        elif t is not None and k in first and first[k] > t:
            out.append((table, i, "late"))
    return sorted(out)


def data(seed, n):
    r = random.Random(seed)
    day = lambda: datetime(2025, 1, 1) + timedelta(hours=r.randrange(5000))
    refs = [("ab"[r.random() < 0.5], i, "hot" if r.random() < 0.4 else r.choice([None, "", *map(str, range(60))]), r.choice([None, day(), day(), day()]), "x") for i in range(n)]
    parents = [(r.choice([None, "hot", *map(str, range(40))]), r.choice([None, day(), day()]), 1) for _ in range(120)]
    return refs + refs[:5], parents


def test_against_brute_force(spark):
    for seed, hot in ((1, 100_000), (2, 50)):
        refs, parents = data(seed, 800)
        got = orphan_references([spark.createDataFrame(refs, REFS)], spark.createDataFrame(parents, PARENTS), hot_rows=hot)
        assert sorted((x.ref_table, x.ref_id, x.ref_state) for x in got.collect()) == brute(refs, parents)


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], REFS), spark.createDataFrame([("a", 1, "k", None, "x")], REFS)
    no_parents = spark.createDataFrame([], PARENTS)
    assert orphan_references([none], no_parents).count() == 0
    found = orphan_references([some, none], no_parents)
    assert [tuple(r) for r in orphan_report(found).collect()] == [("a", None, "missing", 1)]


def test_long_keys_and_keys_that_differ_by_their_last_sign():
    keys = ["x" * 100_000, "k", "k\0", *map(str, range(20_000))]
    pdf = pd.DataFrame({"key": keys, "period": 1, "n": 1, "parent": [i == 1 for i in range(len(keys))], "first_visit": pd.NaT})
    got = surviving_bits(pdf)
    assert set(got["key"]) == set(keys) - {"k"} and set(got["ref_state"]) == {"missing"}


def test_a_hot_key_leaves_the_shuffle(spark):
    """Half of all references share one key and month; it is no orphan, and yet no task joins it by shuffle."""
    now = datetime(2025, 3, 1)
    refs = spark.createDataFrame([("a", i, "hot" if i % 2 else str(i), now, "") for i in range(2000)], REFS)
    found = orphan_references([refs], spark.createDataFrame([("hot", datetime(2025, 1, 1), 1)], PARENTS), hot_rows=100)
    assert found.count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 2 and plan.count("LeftSemi") == 1
