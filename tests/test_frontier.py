import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trellium.operators.frontier import AdmissionRules, admit, decisions, page_statuses, pop_and_mark, revisitable

ENTRY = "url string, depth int, priority double, discovered_from string, reason string, source_key string, status string, queued_at timestamp_ntz, updated_at timestamp_ntz"
DAY = datetime(2025, 5, 1)


def sequential(queue, batch, pages, memory, rules):
    """One candidate after the other, as a crawler meets them."""
    queue = {r[0]: list(r) for r in queue}
    out = {}
    for item, url, depth, priority, parent, reason, key, at in batch:
        if url is None:
            continue
        status = pages.get(url)
        again = status is not None and (status == "blocked_by_robots" and rules.retry_blocked and not rules.obey_robots or status.startswith("error:") and rules.retry_errors)
        visits, score = memory.get(key, (0, rules.initial_score))
        if not again and status is not None:
            out[item] = "visited"
        elif not again and visits >= rules.visits_per_source:
            out[item] = "source_full"
        elif not again and score <= rules.least_score:
            out[item] = "source_weak"
        else:
            out[item] = "admitted"
            old = queue.get(url)
            if old is None or old[6] != "queued":
                queue[url] = [url, depth, priority, parent, reason, key, "queued", at, at]
            else:
                old[1], old[2], old[4], old[8] = min(old[1], depth), max(old[2], priority), reason, at
    return out, sorted(map(tuple, queue.values()), key=str)


def test_admission_against_one_by_one(spark):
    r = random.Random(4)
    states = ["queued", "done", "active", "error"]
    queue = [(f"u{i}", r.randrange(5), float(r.randrange(50)), "p", "old", f"s{i % 4}", r.choice(states), DAY, DAY) for i in range(30)]
    pages = {f"u{i}": r.choice(["ok", "error:x", "blocked_by_robots"]) for i in range(0, 60, 3)}
    memory = {"s0": (3, 60.0), "s1": (25, 60.0), "s2": (1, 8.0)}
    batch = [(n, "u5" if n % 3 == 0 else r.choice([None, f"u{r.randrange(60)}"]), r.randrange(6), float(r.randrange(90)), f"p{n}", f"r{n}", r.choice([None, "s0", "s0", "s1", "s2", "s9"]), DAY + timedelta(hours=n + 1)) for n in range(200)]
    candidates = spark.createDataFrame([(*b, "x", "y") for b in batch], "item bigint, url string, depth int, priority double, discovered_from string, reason string, source_key string, queued_at timestamp_ntz, visits string, page_status string")
    candidates = candidates.drop("visits", "page_status")
    known = spark.createDataFrame([(i, u, f"{u}#end" if i % 2 else u, s, DAY) for i, (u, s) in enumerate(pages.items())], "page_id int, url string, final_url string, status string, visited_at timestamp_ntz")
    sources = spark.createDataFrame([(k, *v) for k, v in memory.items()], "source_key string, visits bigint, score double")
    for rules in (AdmissionRules(), AdmissionRules(obey_robots=True), AdmissionRules(retry_errors=False)):
        want, after = sequential(queue, batch, pages, memory, rules)
        decided = decisions(candidates, page_statuses(known, ["visited_at", "page_id"]), sources, rules)
        assert {x.item: x.decision for x in decided.collect()} == want
        got = admit(spark.createDataFrame(queue, ENTRY), decided.filter("decision = 'admitted'"), ["item"])
        assert sorted(map(tuple, got.collect()), key=str) == after


def test_active_entries_of_a_crash_come_back(spark):
    queue = spark.createDataFrame([("u1", 0, 5.0, "p", "r", "s", "queued", DAY, DAY), ("u2", 0, 9.0, "p", "r", "s", "queued", DAY, DAY), ("u3", 0, None, "p", "r", "s", "queued", DAY, DAY)], ENTRY)
    popped = pop_and_mark(queue, 1, F.lit(datetime(2025, 6, 1)).cast("timestamp_ntz"))
    assert sorted((x.url, x.status) for x in popped.collect()) == [("u1", "queued"), ("u2", "active"), ("u3", "queued")]
    again = spark.createDataFrame([(1, "u2", 3, 1.0, "q", "again", "s", DAY)], "item int, url string, depth int, priority double, discovered_from string, reason string, source_key string, queued_at timestamp_ntz")
    x = [x for x in admit(popped, again, ["item"]).collect() if x.url == "u2"]
    assert [(x.status, x.depth, x.priority, x.reason) for x in x] == [("queued", 3, 1.0, "again")]
    assert admit(popped.limit(0), again.limit(0), ["item"]).count() == 0


def test_revisits(spark):
    df = spark.createDataFrame([("ok",), ("error:x",), ("errors",), ("blocked_by_robots",), (None,)], "s string")
    flags = lambda rules: [x.r for x in df.select(revisitable(F.col("s"), rules).alias("r")).collect()]
    assert flags(AdmissionRules()) == [False, True, False, True, False]
    assert flags(AdmissionRules(obey_robots=True, retry_errors=False)) == [False] * 5
