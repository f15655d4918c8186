import random

import pytest

from trellium.llm import variants
from trellium.llm.variants import follow_parents, link_employers


def loop(parent, weight):
    out = {}
    for x in parent:
        seen = []
        while x not in seen:
            seen.append(x)
            x = parent[x]
        cycle = seen[seen.index(x) :]
        out[seen[0]] = min(cycle, key=lambda v: (-weight[v], v))
    return out


def test_names_whose_parents_form_a_cycle_stay_linked(spark):
    names = ["Morevo Logistik GmbH"] * 5 + ["Morevol Logistik GmbH"] * 3 + ["Morevola Logistik GmbH", "Mrevola Logistik GmbH", "Andere Logistik KG"]
    got = {r.name: r.entity for r in link_employers(spark.createDataFrame([(n,) for n in names], "company string"), "company").collect()}
    one = {v for k, v in got.items() if "Andere" not in k}
    assert len(one) == 1 and got["Andere Logistik KG"] not in one


@pytest.mark.parametrize("seed", [1, 2])
def test_parents_with_cycles_against_a_walk(spark, seed):
    r = random.Random(seed)
    parent = {f"r{n}": f"r{r.randrange(60)}" for n in range(60)} | {f"c{n}": f"c{(n + 1) % 37}" for n in range(37)} | {f"t{n}": f"t{max(0, n - 1)}" for n in range(100)}
    weight = {x: r.randrange(5) for x in parent}
    df = spark.createDataFrame([(x, p, weight[x]) for x, p in parent.items()], "x string, parent string, n bigint")
    assert {row.x: row.root for row in follow_parents(df, "test").collect()} == loop(parent, weight)


def test_too_few_rounds_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(variants, "ROUNDS", 2)
    with pytest.raises(RuntimeError):
        follow_parents(spark.createDataFrame([(f"{n}", f"{max(0, n - 1)}") for n in range(100)], "x string, parent string"), "test")
