import numpy as np

from trellium.llm.mixing import mix, plan_quotas, splitting_tree

DOCS, TARGETS = "id bigint, source string, size bigint, pass int, quota string", "source string, share double, repeats int"


def test_tree_uses_up_every_quota(spark):
    quotas = [0, 1, 50, 1000]
    tree = lambda levels: sorted((r.shard, tuple(r.counts), tuple(r["first"])) for r in splitting_tree(spark, quotas, 7, 3, levels).collect())
    rows = tree(10)
    dealt, first = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    assert [r[0] for r in rows] == list(range(7)) and dealt.sum(axis=0).tolist() == quotas and (dealt >= 0).all()
    assert (first == np.cumsum(dealt, axis=0) - dealt).all()
    assert tree(1) == tree(2) == rows  # however many rounds it takes
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= 3


def test_quotas():
    quotas, aimed = plan_quotas({"a": 1000, "b": 100, "c": 0}, [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 9)], None)
    assert aimed == {"a": 2 / 3, "b": 1 / 3} and quotas == {"a": 400, "b": 200}
    assert plan_quotas({}, [("a", 1.0, 1)], None) == ({}, {})
    assert plan_quotas({"a": 10}, [("a", 1.0, 2)], 1000)[0] == {"a": 20}


def test_mixture(spark):
    r = np.random.default_rng(1)
    rows = [(i, "big" if i % 3 else "hot", int(s), 0, "x") for i, s in enumerate(r.integers(1, 60, 1500))] + [(9000 + i, "small", int(s), 0, "x") for i, s in enumerate(r.integers(1, 60, 20))]
    rows += [(9900, "big", 0, 0, "x"), (9901, "big", None, 0, "x"), (9902, None, 5, 0, "x"), (9903, "other", 5, 0, "x"), (9904, "small", 20_000, 0, "x")]
    targets = [("big", 0.5, 1), ("hot", 0.3, 1), ("small", 0.2, 3), ("gone", 0.0, 3), (None, 0.5, 1)]
    docs, goal = spark.createDataFrame(rows[:-1], DOCS), spark.createDataFrame(targets, TARGETS)
    mixture, shares = mix(docs, goal, block_tokens=100, shard_tokens=1500)
    m, s = mixture.toPandas(), {x.source: x for x in shares.collect()}
    caps = {"big": 1, "hot": 1, "small": 3}
    assert (m.groupby(["source", "id"]).size().groupby("source").max() <= m.source.drop_duplicates().map(caps).set_axis(m.source.drop_duplicates())).all()
    assert m.duplicated(["id", "pass"]).sum() == 0 and set(m.source) == set(caps)
    assert all(abs(s[k].actual_share - t) < 0.01 for k, t, _ in targets[:3]) and s["gone"].tokens == 0
    assert m.groupby("shard").position.apply(lambda p: sorted(p) == list(range(1, len(p) + 1))).all() and m.shard.nunique() > 1
    again = mix(docs.repartition(3), goal, block_tokens=100, shard_tokens=1500)[0].toPandas()
    key = ["shard", "position", "id", "pass"]
    # a total beyond what the scarce source can serve: it ends at its repeats, the others keep their part of the total
    more = {x.source: x for x in mix(docs, goal, total=0.9, block_tokens=100, shard_tokens=1500)[1].collect()}
    assert more["small"].passes == 3 and more["small"].actual_share < 0.15 and more["big"].tokens > s["big"].tokens
    assert sorted(map(tuple, again[key].values.tolist())) == sorted(map(tuple, m[key].values.tolist()))


def test_empty(spark):
    docs, goal = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", 1.0, 1)], TARGETS)
    mixture, shares = mix(docs, goal)
    assert mixture.count() == 0 and [tuple(x)[:4] for x in shares.collect()] == [("a", 1.0, 0.0, 0.0)]
    assert mix(docs, goal.limit(0))[0].count() == 0
