import random

import pytest

from trellium.llm import variants
from trellium.llm.companies import learn_companies, read_company
from trellium.llm.names import osa_within
from trellium.llm.roles import Lexicon, is_within
from trellium.llm.variants import link_employers, near_names, pairs_within


@pytest.mark.parametrize("k,hot", [(1, 2000), (2, 2000), (3, 2000), (1, 5), (2, 20)])
def test_segment_join_against_all_pairs(spark, monkeypatch, k, hot):
    """Every pair within k edits is found, of names of one letter up to twenty, also where keys are hot."""
    monkeypatch.setattr(variants, "HOT_KEY", hot)
    r = random.Random(5)
    base = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 21))) for _ in range(120)]
    for w in base[:90]:
        for _ in range(k + 1):
            i = r.randrange(len(w))
            w = r.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "y" + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w]) or "z"
            base.append(w)
    df = spark.createDataFrame([(w, 1) for w in [*base, None, ""]], "core string, key int")
    got = [(x.a, x.b, x.distance) for x in near_names(df, "core", k).collect()]
    words = sorted({*base, ""})
    want = {(a, b, osa_within(a, b, k)) for i, a in enumerate(words) for b in words[i + 1 :] if osa_within(a, b, k) is not None}
    assert set(got) == want and len(got) == len(want)


LEXICON = Lexicon({"mobelwerke": "mobelwerke", "werkzeugbau": "werkzeugbau", "wzg": "werkzeugbau", "gieserei": "gieserei", "elektronik": "elektronik", "elektrotechnik": "elektrotechnik"}, frozenset(["fa", "gruppe", "personalabteilung", "und", "bau"]))


def test_reading_names():
    read = lambda name: read_company(name, LEXICON)
    assert read("Dütapenen Möbelwerke SE") == ("dutapenen", "dutapenen", "mobelwerke", "se", "dutapenen")
    assert read("MÖBELW. DUETAPENEN gmbh & co. kg")[:4] == ("dutapenen", "duetapenen", "mobelwerke", "cokg")
    assert read("Lobenefal Wzg.-Bau, Personalabteilung")[0::2] == ("lobenefal", "werkzeugbau", "lobenefal")
    assert read("Lobenefal Werkz. Bau")[0::2] == ("lobenefal", "werkzeugbau", "lobenefal")
    assert read("Kivavifing Gieserei ®")[2] == read("Kivavifing Gisserei")[2] == "gieserei"
    assert read("Elektro. Kivavifing")[2] == ""  # short for two trades
    assert read("Querbalken Consulting")[0] == read("Consulting Querbalken AG")[0] == "consultingqurbalken"
    assert read("Zeit. Ostwind") == ("ostwindzeit", "zeitostwind", "", "", "ostwind zeit.")
    assert [read(x)[0] for x in (None, "", " - ", "—")] == [""] * 4 and read("Möbelwerke GmbH")[0] == "mobelwerke"


def test_forms_found_by_index_as_by_comparison():
    r = random.Random(2)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(5, 9))) for _ in range(80)]
    lexicon = Lexicon({w: w for w in words[:40]})
    for w in words:
        assert lexicon.close(w) == {t for t in words[:40] if osa_within(w, t, 1) is not None}
        head, tail = w[:2], w[-3:]
        assert lexicon.of_two(head, tail) == {t for t in words[:40] if t.endswith(tail) and len(t) >= 5 and t[0] == head[0] and is_within(head, t[:-3])}


def firms(seed, n, trades, light):
    """(name, firm): spellings of firms with trades of invented words, which no list could know."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        core = "".join(r.choice("bdfgklmnprtvwz") + r.choice("aeiou") for _ in range(4)).capitalize()
        trade, legal = r.choice(trades), r.choice(["GmbH", "AG", "KG"])
        forms = [f"{core} {trade} {legal}", f"{trade} {core}", f"{core} {trade[:5]}. {legal}", f"{core.upper()} {trade.upper()}", f"{core} {legal}", f"Fa. {core}", f"{core} {trade} {legal} {r.choice(light)}", f"{core}-{trade}", f"{core[:3]}{core[4]}{core[3]}{core[5:]} {trade} {legal}"]
        out += [(f, i) for f in forms for _ in range(1 + (f == forms[0]))]
    return out


def test_trades_are_learned_from_the_names(spark):
    trades, light = ["Blorbwerk", "Vexcraft", "Quundrei", "Sprolltech", "Dranfabrik", "Zwimmhaus"], ["Nordland", "Holdfast"]
    rows = firms(3, 120, trades, light)
    df = spark.createDataFrame([(n, "x", 1) for n, _ in rows] + [(None, "x", 1), ("", "x", 1)], "company string, name string, core int")
    lexicon = learn_companies(df, "company")
    assert set(lexicon.trades.values()) == {t.lower() for t in trades} and {"fa", "nordland", "holdfast"} <= lexicon.light
    assert lexicon.trades["blorb"] == "blorbwerk"
    entity = {r.name: r.entity for r in link_employers(df, "company").collect()}
    firm = dict(rows)
    pairs = {(a, b) for a in entity for b in entity if a < b and firm[a] == firm[b]}
    linked = {(a, b) for a, b in pairs if entity[a] == entity[b]}
    assert len(linked) > 0.97 * len(pairs)
    assert all(firm[a] == firm[b] for a in entity for b in entity if a < b and entity[a] == entity[b])


def test_linking(spark):
    names = ["Dütapenen Möbelwerke SE"] * 5 + [
        "Dütapenen SE", "Fa. Duetapenen", "dütapenn  möbelwerke", "Möbelwerke Dütapenen", "Dütape Möbelwerke SE", "Grukoruler Glastechnik GmbH", "Grukoruler Pharma AG", "Grukoruler GmbH", "Fa. Grukoruler", None, "", "-", "Andere Logistik KG", "Ostwind Zeitarbeit GmbH", "Zeitarb. Ostwind", "Ostwind",
    ]
    cores = [(c * 4 + v * 3 + "ol", t) for v, t in zip("aeiu", ("Möbelwerke", "Glastechnik", "Pharma", "Logistik")) for c in "bcdfghklmn"]
    others = [f"{c} {t} GmbH" for c, t in cores] + [f"Fa. {c}" for c, _ in cores]
    df = spark.createDataFrame([(n, "x", 1) for n in names + others], "company string, name string, core int")
    got = link_employers(df, "company")
    pairs = {(r.a, r.b) for r in pairs_within(got, "entity", "name", "a", "b").collect()}
    one = sorted({n for n in names if n and "ape" in n.lower()})
    assert {(a, b) for i, a in enumerate(one) for b in one[i + 1 :]} <= pairs
    assert ("Grukoruler Glastechnik GmbH", "Grukoruler GmbH") in pairs
    assert {("Ostwind", "Ostwind Zeitarbeit GmbH"), ("Ostwind Zeitarbeit GmbH", "Zeitarb. Ostwind")} <= pairs
    assert not any("Pharma" in a + b and "Grukoruler" in a + b for a, b in pairs) and not any("Fa. Grukoruler" in p or "Andere" in p[0] + p[1] for p in pairs)
    assert link_employers(df.limit(0), "company").count() == 0


def test_a_name_that_a_longer_one_and_a_heavier_one_claim(spark):
    rows = ["Falkenst Maschinenbau GmbH"] * 9 + ["Falkensti Maschinenbau GmbH"] * 5 + ["Falkenstio Maschinenbau"] * 2
    got = link_employers(spark.createDataFrame([(n,) for n in rows], "company string"), "company").collect()
    assert len(got) == 3 and len({r.entity for r in got}) == 1
