import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import trellium.llm.packing as P
from trellium.llm.packing import best_fit_decreasing, lower_bound, pack, pack_report


def least(sizes, capacity):
    """Fewest containers by trying all assignments."""
    sizes = sorted((s for s in sizes if s), reverse=True)
    best = len(sizes)

    def go(i, rest):
        nonlocal best
        if len(rest) >= best:
            return
        if i == len(sizes):
            best = len(rest)
            return
        for j in sorted(set(rest), reverse=True):
            if j >= sizes[i]:
                at = rest.index(j)
                go(i + 1, [*rest[:at], j - sizes[i], *rest[at + 1 :]])
        go(i + 1, [*rest, capacity - sizes[i]])

    go(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=8), st.just(12))
def test_bound_and_packing_hold_the_optimum_between_them(sizes, capacity):
    a = np.array(sizes, dtype=np.int64)
    bins = best_fit_decreasing(a, capacity)
    load = np.bincount(bins, weights=a) if len(a) else np.zeros(0)
    assert (load <= capacity).all()
    if any(sizes):
        assert lower_bound(a, capacity) <= least(sizes, capacity) <= len(set(bins[a > 0].tolist()))


def test_pack_keeps_every_token_once(spark, monkeypatch):
    monkeypatch.setattr(P, "ITEMS_PER_PARTITION", 60)
    r = np.random.default_rng(1)
    rows = [(i, int(s), "x", 1) for i, s in enumerate(r.integers(150, 330, 300))] + [(900, 0, "x", 1), (901, None, "x", 1), (902, 512, "x", 1), (903, 5000, "x", 1), (904, 1024, "x", 1), (905, 100, "x", 1), (905, 100, "x", 1)]
    items = spark.createDataFrame(rows, "id bigint, size bigint, part string, bin int")
    windows = spark.createDataFrame([(1, 512), (2, 2048), (3, 0), (4, None)], "window_id int, capacity int")
    packed = pack(items, windows)
    got = packed.toPandas()
    for w, capacity in ((1, 512), (2, 2048)):
        g = got[got.window_id == w]
        assert g["size"].sum() == sum(s or 0 for _, s, _, _ in rows)
        assert g.groupby("container")["size"].sum().max() <= capacity
        assert (g.groupby("id").size()[[i for i in range(300)]] == 1).all() or capacity == 512
        whole = g[g.id < 300].groupby("id").size()
        assert whole.max() == 1  # items under the capacity are never split
        big = g[g.id == 903].sort_values("start")
        assert big["start"].tolist() == [capacity * k for k in range(len(big))] and big["size"].sum() == 5000
    report = {x.window_id: x for x in pack_report(packed, windows).collect()}
    assert set(report) == {1, 2} and all(x.lower_bound <= x.n_containers for x in report.values()) and report[2].n_containers - report[2].lower_bound <= 1
    assert pack(items.limit(0), windows).count() == 0


def test_items_above_half_meet_the_bound(spark):
    items = spark.createDataFrame([(i, 300) for i in range(50)], "id bigint, size bigint")
    x = pack_report(pack(items, spark.createDataFrame([(1, 512)], "window_id int, capacity int")), spark.createDataFrame([(1, 512)], "window_id int, capacity int")).head()
    assert (x.n_containers, x.lower_bound) == (50, 50)
