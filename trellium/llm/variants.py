"""Linking variant spellings of names by a pigeonhole segment join.

A name within k edits of another shares the inner part of one of its k+1
segments, moved by a few positions at most. The parts form an inverted index;
each name looks up its substrings at the positions that k edits can reach, and
banded edit distance verifies what was found. Names too short for segments are
looked up by their forms with letters left out. Joins run on distinct names only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.llm.companies import learn_companies, read_company
from trellium.llm.names import osa_within
from trellium.llm.trie import letter_bits, letter_code, near_codes
from trellium.operators.keyed import computed
from trellium.session import cut

MIN_LENGTH = 5  # letters from which a name may be a misspelling of another
MIN_STEM = 5  # least letters of a name that was cut short
CUT_LETTERS = (2, 3, 4)  # letters of the syllable that people leave off
ROUNDS = 16
TREES_SETTLE = 4  # rounds after which cycles are looked for
HOT_KEY = 2_000  # names that share a key from which they are joined by the trie instead of pair by pair
MAX_HOT_KEYS = 10_000  # the threshold rises with the table, so that no more keys can be beyond it


def _cores(length: int, k: int) -> list[tuple[int, int]]:
    """(start, size) of the inner parts of the k+1 segments of a name, without the letters beside a limit between segments.

    An edit, a swap of neighbours across a limit included, reaches one of them at most.
    """
    size, rest, at, out = length // (k + 1), length % (k + 1), 0, []
    for i in range(k + 1):
        n = size + (i >= k + 1 - rest)
        start, end = at + (i > 0), at + n - (i < k)
        out.append((start, end - start))
        at += n
    return out


def _least(k: int) -> int:
    """Letters from which a name is cut into segments; shorter ones have segments too short to tell names apart."""
    return 4 * (k + 1)


def _deletions(name: str, k: int) -> set[str]:
    """The name with up to k letters left out: names within k edits share such a form."""
    forms = newest = {name}
    for _ in range(k):
        newest = {f[:i] + f[i + 1 :] for f in newest for i in range(len(f))}
        forms = forms | newest
    return forms


def _short_keys(name: str, k: int) -> list[str]:
    return [f"d.{f}" for f in _deletions(name, k)] if len(name) < _least(k) + k else []


def index_keys(name: str, k: int) -> list[str]:
    cores = [f"{len(name)}.{i}.{name[a : a + n]}" for i, (a, n) in enumerate(_cores(len(name), k))] if len(name) >= _least(k) else []
    return cores + _short_keys(name, k)


def probe_keys(name: str, k: int) -> list[str]:
    """Keys of all names within k edits: substrings where insertions and deletions can have moved a segment to."""
    out = set(_short_keys(name, k))
    for length in range(max(_least(k), len(name) - k), len(name) + k + 1):
        delta = len(name) - length
        shifts = [s for s in range(-k, k + 1) if abs(s) + abs(delta - s) <= k]
        for i, (a, n) in enumerate(_cores(length, k)):
            for s in shifts:
                if a + s >= 0 and a + s + n <= len(name):
                    out.add(f"{length}.{i}.{name[a + s : a + s + n]}")
    return sorted(out)


def _keys(fn, k: int):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: fn(v, k))

    return run


def near_names(names: DataFrame, col: str, k: int = 1) -> DataFrame:
    """Pairs ``a < b`` of distinct values of ``col`` within ``k`` edits, with their ``distance``.

    Exact for every k and length; swaps of neighbours are one edit; NULL has no
    partners. Names that share a key with thousands of others are joined by the
    trie of letter codes within that key, so no key costs all its pairs.
    """
    distinct = cut(names.select(F.col(col).alias("a")).filter("a is not null").distinct(), "near-names")
    index = distinct.select("a", F.explode(_keys(index_keys, k)("a")).alias("key"), F.lit(1).alias("held"))
    probes = distinct.select("a", F.explode(_keys(probe_keys, k)("a")).alias("key"), F.lit(0).alias("held"))
    keyed = cut(index.unionByName(probes), "near-keys")
    sizes = keyed.groupBy("key").agg(F.sum("held").alias("n_held"), F.count("*").alias("n")).filter("n_held > 0 and n > n_held")
    hot = cut(sizes.filter(F.col("n") > max(HOT_KEY, keyed.count() // MAX_HOT_KEYS)).select("key"), "near-hot")
    cold = keyed
    if any_hot := hot.limit(1).count():
        cold = keyed.join(F.broadcast(hot), "key", "left_anti")
    left, right = cold.filter("held = 0").select("key", "a"), cold.filter("held = 1").select("key", F.col("a").alias("b"))
    candidates = left.join(right, "key").filter("a < b").select("a", "b")
    if any_hot:
        within = keyed.join(F.broadcast(hot), "key").select(F.col("key").alias("block"), F.col("a").alias("text")).distinct()
        coded = cut(within.withColumn("code", letter_code(F.col("text"), letter_bits(distinct, "a"))), "near-codes")
        candidates = candidates.unionByName(near_codes(coded, 2 * k).select(F.col("text_a").alias("a"), F.col("text_b").alias("b")))

    @F.pandas_udf("int")
    def distance(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series([osa_within(p, q, k) for p, q in zip(x, y)], dtype="Int32")

    return computed(candidates.distinct(), "distance", distance("a", "b")).filter("distance is not null")


def near_keys(names: DataFrame, key: str, plain: str) -> DataFrame:
    """Pairs ``a < b`` of keys of which some form of five letters or more, ``key`` itself or ``plain``, is within one edit of the other's."""
    forms = names.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.array(key, plain))).alias("form")).distinct()
    near = near_names(forms.filter(F.length("form") >= MIN_LENGTH), "form").select("a", "b").unionByName(forms.select(F.col("form").alias("a"), F.col("form").alias("b")))
    left, right = (forms.select(F.col("key").alias(c), F.col("form").alias(f)) for c, f in (("x", "a"), ("y", "b")))
    near = near.join(left, "a").join(right, "b").filter("x <> y")
    return near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def fold_rare(names: DataFrame, key: str, plain: str, weight: Column) -> DataFrame:
    """``x, root``: each key with the most frequent one, by ``weight``, that it is a misspelling of, itself if none."""
    counts = names.groupBy(F.col(key).alias("x")).agg(weight.alias("n"))
    near = near_keys(names, key, plain)
    ways = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    other = counts.select(F.col("x").alias("b"), F.col("n").alias("y_n"))
    heavier = (F.col("y_n") > F.col("n")) | ((F.col("y_n") == F.col("n")) & (F.col("b") < F.col("a")))
    best = ways.join(counts.withColumnRenamed("x", "a"), "a").join(other, "b").filter(heavier).groupBy(F.col("a").alias("x")).agg(F.max_by("b", F.struct("y_n", "b")).alias("parent"))
    parents = counts.join(best, "x", "left").select("x", F.coalesce("parent", "x").alias("parent"))
    return follow_parents(parents, "rare-names")


def follow_parents(parents: DataFrame, name: str) -> DataFrame:
    """``x, parent`` (every x once) to ``x, root`` by pointer doubling.

    The root of a cycle, and of all that hangs on it, is its heaviest node by the
    column ``n``, of equal ones the smallest; without ``n`` the smallest.
    """
    weight = -F.col("n") if "n" in parents.columns else F.lit(0)
    current = cut(parents.select("x", "parent", F.col("parent").alias("root"), F.struct(weight.cast("bigint").alias("n"), "x").alias("best")), name)
    for done in range(ROUNDS):
        # best: of the nodes from x up to, and without, root
        ahead = current.select(F.col("x").alias("via"), F.col("root").alias("next"), F.col("best").alias("further"))
        step = current.join(ahead, F.col("root") == F.col("via"), "left")
        moved = F.coalesce("next", "root") != F.col("root")
        step = cut(step.select("x", "parent", F.coalesce("next", "root").alias("root"), F.least("best", "further").alias("best"), moved.alias("moved")), name)
        current = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            return current.select("x", "root")
        if done >= TREES_SETTLE:
            # what still moves goes round: where all share their parent's choice, it is the best of the whole cycle
            choice = cut(current.join(current.select(F.col("x").alias("at"), F.col("best.x").alias("choice")), F.col("root") == F.col("at"), "left").select("x", "parent", F.coalesce("choice", "root").alias("root")), name)
            if not choice.join(choice.select(F.col("x").alias("up"), F.col("root").alias("up_root")), F.col("parent") == F.col("up")).filter("root <> up_root").limit(1).count():
                return choice.select("x", "root")
    raise RuntimeError(f"{name}: parents do not settle in {ROUNDS} rounds")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``x, root`` of every node of ``a, b`` (a node without partners comes as ``a = b``): root is the smallest node joined to it.

    Every node follows its smallest neighbour, the trees are drawn together to
    their roots, and what is left between roots is the next round's graph, of
    half the nodes at most. It ends when no edge is left, however long a chain is.
    """
    between = edges.filter("a <> b").distinct()
    between = cut(between.unionByName(between.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), name)
    reached = cut(edges.select(F.col("a").alias("x")).unionByName(edges.select(F.col("b").alias("x"))).distinct().withColumn("root", F.col("x")), name)
    while between.limit(1).count():
        roots = follow_parents(between.groupBy(F.col("a").alias("x")).agg(F.least(F.col("x"), F.min("b")).alias("parent")), name)
        reached = reached.join(roots.select(F.col("x").alias("via"), F.col("root").alias("next")), F.col("root") == F.col("via"), "left")
        reached = cut(reached.select("x", F.coalesce("next", "root").alias("root")), name)
        ends = between
        for end in ("a", "b"):
            ends = ends.join(roots.select(F.col("x").alias(end), F.col("root").alias(f"{end}_root")), end)
        between = cut(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).filter("a <> b").distinct(), name)
    return reached


def _node(core: Column, trade: Column, legal: Column) -> Column:
    """Names of one core and trade are one node; those without a trade only if their legal form agrees too."""
    return F.concat_ws("|", core, trade, F.when(trade == "", legal))


READ = "core string, plain string, trade string, legal string, parts string"
READ_COLUMNS = ["core", "plain", "trade", "legal", "parts"]


def link_employers(names: DataFrame, col: str) -> DataFrame:
    """Distinct values of ``col`` with the employer each of them means.

    Returns ``name, core, trade, entity``. NULL, blank and dash values name no
    employer and are left out. A variant follows, in this order: a more frequent
    core within one edit in the same trade; the full core whose last syllable it
    lacks, in the same trade; and, where it names no trade, the only trade of
    its core, or the only one with its legal form, else the only core that has
    one word more. Equal cores in different
    trades stay apart. Ties go to the smaller name in binary order. Empty input
    gives an empty result.
    """
    spelled = cut(names.select(F.col(col).alias("name")).filter("name is not null").groupBy("name").agg(F.count("*").alias("n")), "employer-spellings")
    lexicon = learn_companies(spelled, "name")

    @F.pandas_udf(READ)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([read_company(v, lexicon) for v in s], columns=READ_COLUMNS)

    parsed = spelled.withColumn("r", read("name")).select("name", "n", "r.*").filter("core <> ''")
    parsed = cut(parsed.withColumn("x", employer_node()), "employer-names")
    return parsed.join(employer_roots(parsed), "x").select("name", "core", "trade", F.col("root").alias("entity"))


def employer_node() -> Column:
    return _node(F.col("core"), F.col("trade"), F.col("legal"))


def employer_roots(parsed: DataFrame) -> DataFrame:
    """``x, root`` for every node ``x`` of read names (``core, plain, trade, legal, parts``, ``n`` rows each)."""
    parsed = parsed.groupBy(*READ_COLUMNS).agg(F.sum("n").alias("n")).withColumn("x", employer_node())
    nodes = cut(parsed.groupBy("x", "core", "trade").agg(F.sum("n").alias("n"), F.collect_set(F.nullif("legal", F.lit(""))).alias("legals"), F.max("parts").alias("parts")), "employer-nodes")
    near = cut(near_keys(parsed, "core", "plain"), "employer-near")

    other = nodes.select(*[F.col(c).alias(f"y_{c}") for c in nodes.columns])
    both_ways = near.select(F.col("a").alias("core"), F.col("b").alias("y_core")).unionByName(near.select(F.col("b").alias("core"), F.col("a").alias("y_core")))
    heavier = (F.col("y_n") > F.col("n")) | ((F.col("y_n") == F.col("n")) & (F.col("y_x") < F.col("x")))
    typo = nodes.join(both_ways, "core").join(other, "y_core").filter((F.col("trade") == F.col("y_trade")) & heavier)
    stems = other.select("*", F.explode(F.array(*[F.expr(f"substring(y_core, 1, length(y_core) - {c})") for c in CUT_LETTERS])).alias("core")).filter(F.length("core") >= MIN_STEM)
    short = nodes.join(stems, "core").filter("trade = y_trade")
    bare = nodes.filter("trade = ''")
    same_core = bare.join(other, bare["core"] == other["y_core"]).filter("y_trade <> ''")
    same_bare = bare.join(other, bare["core"] == other["y_core"]).filter("y_trade = ''").filter(heavier)
    near_core = bare.join(both_ways, "core").join(other, "y_core").filter("y_trade <> ''")
    stem_core = bare.join(stems, "core").filter("y_trade <> ''")
    # a core that lacks one word of another, or has it cut off with a dot; such a word may be a trade too rare to be learned
    words = F.split("y_parts", " ")
    rest = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), F.array_join(F.filter(ws, lambda _, j: i != j), "").alias("core")))
    right = other.filter((F.col("y_trade") == "") & F.contains("y_parts", F.lit(" ")) & ~F.contains("y_parts", F.lit("."))).join(typo.select(F.col("x").alias("y_x")).distinct(), "y_x", "left_anti")
    fuller = right.withColumn("r", F.explode(rest(words))).select("*", "r.core", "r.word").drop("r").withColumn("y_trade", F.col("y_core"))
    part_core = bare.join(fuller, "core")
    dotted = bare.filter(F.contains("parts", F.lit("."))).withColumn("r", F.explode(rest(F.split("parts", " ")))).filter(F.endswith("r.word", F.lit(".")))
    dotted = dotted.select("x", "trade", "legals", F.replace("r.core", F.lit("."), F.lit("")).alias("core"), F.rtrim("r.word", F.lit(".")).alias("stem"))
    cut_core = dotted.join(fuller, "core").filter((F.length("stem") >= 3) & F.startswith("word", F.col("stem")))

    def edges(df: DataFrame, kind: int) -> DataFrame:
        legal_ok = F.arrays_overlap("legals", "y_legals")
        return df.select("x", "trade", F.lit(kind).alias("kind"), "y_x", "y_trade", "y_n", "y_core", F.coalesce(legal_ok, F.lit(False)).alias("legal_ok"))

    all_edges = edges(typo, 0)
    for kind, df in enumerate((short, same_core, near_core, stem_core, same_bare, part_core, cut_core), 1):
        all_edges = all_edges.unionByName(edges(df, kind))
    all_edges = cut(all_edges, "employer-edges")

    # With a trade: a typo first, then a cut name. Without one: the nearest kind
    # of name with a trade decides, if it leaves one choice; names without a
    # trade only where no other is near.
    by_kind = all_edges.groupBy("x", "kind").agg(
        F.max_by("y_x", F.struct(F.col("legal_ok"), F.col("y_n"), F.col("y_x"))).alias("any_best"),
        F.count_distinct("y_trade").alias("n_trades"),
        F.max_by("y_x", F.when(F.col("legal_ok"), F.struct("y_n", "y_x"))).alias("legal_best"),
        F.count_distinct(F.when(F.col("legal_ok"), F.col("y_trade"))).alias("n_legal_trades"),
        F.first("trade").alias("trade"),
    )
    chosen = F.when(F.col("n_trades") == 1, F.col("any_best")).when(F.col("n_legal_trades") == 1, F.col("legal_best"))
    order = F.when((F.col("trade") == "") & (F.col("kind") >= 5), F.when(F.col("kind") == 5, 9).otherwise(8)).when((F.col("trade") == "") & (F.col("kind") < 2), F.col("kind") + 10).otherwise(F.col("kind"))
    picks = by_kind.groupBy("x").agg(F.min_by(F.struct(chosen.alias("parent")), order).alias("pick")).select("x", "pick.parent")
    parents = nodes.select("x", "n").join(picks, "x", "left").select("x", F.coalesce("parent", "x").alias("parent"), "n")
    return follow_parents(parents, "employer-roots")


def pairs_within(members: DataFrame, key: str, value: str, a: str, b: str) -> DataFrame:
    """Every pair of different values that share a key, smaller first in binary order."""
    left = members.select(key, F.col(value).alias(a))
    right = members.select(key, F.col(value).alias(b))
    return left.join(right, key).filter(F.col(a) < F.col(b)).select(a, b)
