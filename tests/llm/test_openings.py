import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import trellium.llm.openings as O
import trellium.llm.trie as trie
from trellium.llm.openings import linked_texts, opening_groups, same_openings, title_links, title_words
from trellium.llm.trie import letter_bits, letter_code, letter_codes, near_codes, trie_pairs
from trellium.llm.variants import components

ENTRIES = [(1, "Kreuzfelden", "Crossfields"), (2, "Mühldorfen", None)]
SCHEMA = "url string, title string, company string, location string, text string, block int, code string"
EVEN = [(c, k) for k in range(1, 4) for c in range(26)][:64]


@pytest.mark.parametrize("front", [1 << 20, 50])
def test_trie_against_all_pairs(monkeypatch, front):
    monkeypatch.setattr(trie, "FRONT", front)
    r = np.random.default_rng(2)
    near = r.integers(0, 2**63, 40, dtype=np.uint64)
    codes = np.sort(np.concatenate([near, near ^ np.uint64(1 << 63), near ^ np.uint64(5), r.integers(0, 2**63, 400, dtype=np.uint64), near[:3]]))
    whole = (np.array([0]), np.array([len(codes)]))
    for budget in (0, 3, 20):
        i, j = trie_pairs(codes, *whole, budget)
        want = {(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if int(codes[a] ^ codes[b]).bit_count() <= budget}
        assert set(zip(i.tolist(), j.tolist())) == want and len(i) == len(want)
    i, j = trie_pairs(codes, np.array([0, 100]), np.array([100, len(codes)]), 3)
    assert all((a < 100) == (b < 100) for a, b in zip(i, j))


def test_trie_prunes_titles(sf):
    """Of all pairs of the titles' codes one in fifty is compared, and none within two edits is lost."""
    titles = duckdb.sql(f"select distinct title from '{sf.replace('0.001', '0.1')}/jobs.parquet' where title is not null").fetchall()
    texts = sorted({" ".join(title_words(t)) for (t,) in titles} - {""})
    counts = trie.letter_counts(texts)
    even = sorted(((abs((counts[:, c] >= k).mean() - 0.5), c, k) for c in range(26) for k in range(1, 9)))[:64]
    codes = letter_codes(texts, [(c, k) for _, c, k in even])
    order = np.argsort(codes, kind="stable")
    counted = {}
    i, j = trie_pairs(codes[order], np.array([0]), np.array([len(codes)]), trie.BUDGET, counted)
    assert counted["compared"] < 0.1 * len(texts) ** 2 / 2 and counted["pruned"] > 100_000
    found = {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
    lengths = np.array([len(t) for t in texts])
    for a in range(0, len(texts), 97):
        for b in np.flatnonzero(np.abs(lengths - lengths[a]) <= 2).tolist():
            if a != b and O.osa_within(texts[a], texts[b], 2) is not None:
                assert (min(a, b), max(a, b)) in found


def test_an_edit_changes_two_bits_at_most():
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäж "
    for _ in range(300):
        t = "".join(r.choice(letters) for _ in range(r.randrange(1, 40)))
        i = r.randrange(len(t))
        edited = [t[:i] + t[i + 1 :], t[:i] + r.choice(letters) + t[i:], t[:i] + r.choice(letters) + t[i + 1 :], "".join(sorted(t))]
        own, *others = letter_codes([t, *edited], EVEN).tolist()
        assert [(own ^ o).bit_count() <= 2 for o in others] == [True] * 4 and others[3] == own


def test_hot_blocks_give_the_same_links(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(7)) for _ in range(12)]
    texts = set()
    for _ in range(150):
        t = sorted(r.sample(words, 3))
        texts.add(" ".join(t))
        texts.add(" ".join(sorted([t[0][:-1] + "z", *t[1:]])))
    df = spark.createDataFrame([("b", t) for t in sorted(texts)] + [("c", "alone"), ("d", "two"), ("d", "tow")], "block string, text string")
    df = df.withColumn("code", letter_code(F.col("text"), letter_bits(df, "text")))
    whole = sorted(tuple(x) for x in linked_texts(df).collect())
    assert len(whole) == len(set(whole)) > len(texts) and ("d", "tow", "two") in whole
    near = sorted(tuple(x) for x in near_codes(df).collect())
    for size in (1, 10, 60):  # cut by four, three and one of the code's parts
        monkeypatch.setattr(trie, "HOT_BLOCK", size)
        assert sorted(tuple(x) for x in linked_texts(df).collect()) == whole
        assert sorted(tuple(x) for x in near_codes(df).collect()) == near


def test_title_links_against_all_pairs(spark):
    r = random.Random(8)
    base = ["Einkäufer Zoll (m/w/d)", "Planner – Lacke", "Lead Planner Lacke", "Müller", "x", "", None]
    rows = base + [t[: (i := r.randrange(len(t)))] + r.choice("abc") + t[i + 1 :] for t in base[:4] for _ in range(30)]
    df = spark.createDataFrame([(t, "k", 1) for t in rows * 2], "title string, text string, code int")
    texts = sorted({x.t for x in df.select(O.folded_title(F.col("title")).alias("t")).collect()} - {"", None})
    want = {(a, b, duckdb.execute("select levenshtein(?, ?)", [a, b]).fetchone()[0]) for i, a in enumerate(texts) for b in texts[i + 1 :]}
    assert {tuple(x) for x in title_links(df).collect()} == {w for w in want if w[2] <= 2}
    assert title_links(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_a_walk(spark, seed):
    r = random.Random(seed)
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(90)] + [(f"r{r.randrange(80):02}", f"r{r.randrange(80):02}") for _ in range(50)] + [("alone", "alone")] + [("hub", f"h{i}") for i in range(200)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {x.x: x.root for x in components(spark.createDataFrame(edges, "a string, b string"), "test").collect()}
    assert got == {x: find(x) for x in list(root)}


def test_titles():
    assert title_words("Senior Einkäufer (Kabelbäume) (m/w/d)") == title_words("NEU: (f/m/x) Kabelbäume: Sr. Einkäufer(in) - ab sofort")
    assert title_words("Lead Shift Lead – Zoll") != title_words("Shift Lead – Zoll")
    assert title_words(None) == title_words(" ") == []


def test_openings(spark):
    rows = [
        ("u1", "Senior Einkäufer (Kabelbäume) (m/w/d)", "Dütapenen Möbelwerke SE", "Kreuzfelden"), ("u2", "Kabelbäume: Sr. Einkäfuer", "möbelwerke duetapenen", "12345 Crossfields / D"), ("u3", "Junior Einkäufer (Kabelbäume)", "Dütapenen Möbelwerke SE", "Kreuzfelden"),
        ("u4", "Senior Einkäufer (Kabelbäume)", "Dütapenen Möbelwerke SE", "Mühldorfen"), ("u5", "Senior Einkäufer (Zoll)", "Dütapenen Möbelwerke SE", "Kreuzfelden"), ("u6", "Senior Einkäufer (Kabelbäume)", None, "Kreuzfelden"), ("u7", "Senior Einkäufer (Kabelbäume)", "-", "Kreuzfelden"),
        ("u8", "Senior Einkäufer (Kabelbäume)", "Dütapenen Möbelwerke SE", " "), ("u9", None, "Dütapenen Möbelwerke SE", "Kreuzfelden"), ("r1", "Controller Zoll", "Dütapenen Möbelwerke SE", "100% Remote"), ("r2", "Controller, Zoll", "Dütapenen Möbelwerke SE", "Homeoffice"), ("s1", "Controller Zoll", "Dütapenen Möbelwerke SE", "mehrere Standorte"),
        ("t1", "Planner Lacke", "Dütapenen Möbelwerke SE", "Port Ovelle"), ("t2", "Planner (Lacke) gesucht", "Dütapenen Möbelwerke SE", "DE-1 port ovele (hybrid)"), ("t3", "Planner Lacke", "Dütapenen Möbelwerke SE", "Ostrevice"), ("u1", "Senior Einkäufer Kabelbäume", "Dütapenen Möbelwerke SE", "Kreuzfelden"),
    ]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows * 2] + [("w", "Lang " * 20_000, "Dütapenen Möbelwerke SE", "Kreuzfelden", "", 0, "")], SCHEMA)
    assert sorted(map(tuple, same_openings(df, ENTRIES).collect())) == [("r1", "r2"), ("t1", "t2"), ("u1", "u2")]
    assert same_openings(df.limit(0), ENTRIES).count() == 0
    assert same_openings(df.withColumn("title", F.lit(None).cast("string")), ENTRIES).count() == 0
    groups = opening_groups(df, ENTRIES).collect()
    class_of = {}
    for g in groups:
        class_of.setdefault(g.opening, set()).add(g.url)
        assert g.representative <= g.url
    assert sorted(sorted(c) for c in class_of.values() if len(c) > 1) == [["r1", "r2"], ["t1", "t2"], ["u1", "u2"]]
    assert {g.url: g.n_links for g in groups}["u2"] == 1 and opening_groups(df.limit(0), ENTRIES).count() == 0
