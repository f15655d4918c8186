"""Learning from the names themselves which of their words tell employers apart.

In a set of names most words belong to one employer, and a few stand beside
many. Such shared words are either trades, of which an employer has one, or
words of no weight, which stand beside trades and beside each other. Nothing but
counts tells them apart: the rarest word of a name is its core; words with many
cores are shared; a shared word that is short for another has mostly the cores of
that other; and trades are what remains when the words that meet others of the
remaining ones, in a name or through a core, are taken away one by one.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.llm.names import one_deletions, osa_within
from trellium.session import cut

MIN_CORES = 8  # cores from which a word is shared
PER_CORES = 5_000  # and of all cores at least one in so many, which bounds the number of shared words
MOST_SHARED = 50_000
SAME_CORES = 0.4  # share of a short form's cores that its long form has too
IN_NAME, IN_CORE = 0.25, 0.4  # shares of names, of cores, with another trade from which a word is none
_SLIGHT = 0.01  # pairs of words that meet more rarely do not count


@dataclass
class Lexicon:
    """``trades``: shared words and the trade that each means; ``light``: words of no weight."""

    trades: dict[str, str] = field(default_factory=dict)
    light: frozenset[str] = frozenset()

    def __post_init__(self):
        self.near: dict[str, list[str]] = defaultdict(list)
        self.beginnings: dict[str, set[str]] = defaultdict(set)
        self.endings: dict[str, set[str]] = defaultdict(set)
        for form in self.trades:
            if len(form) >= 5:
                for d in one_deletions(form):
                    self.near[d].append(form)
            for n in range(3, len(form)):
                self.beginnings[form[:n]].add(form)
        for trade in set(self.trades.values()):
            for n in range(3, len(trade) - 1):
                self.endings[trade[-n:]].add(trade)
        self.near_light: dict[str, list[str]] = defaultdict(list)
        for w in self.light:
            if len(w) >= 6:
                for d in one_deletions(w):
                    self.near_light[d].append(w)

    def close(self, word: str) -> set[str]:
        """Trades with a form within one edit of a word."""
        return {self.trades[f] for d in one_deletions(word) for f in self.near.get(d, ()) if osa_within(word, f, 1) is not None}

    def of_two(self, head: str, tail: str) -> set[str]:
        """Trades written in two parts, the first shortened."""
        return {t for t in self.endings.get(tail, ()) if len(t) >= len(tail) + len(head) and t[0] == head[0] and is_within(head, t[: -len(tail)])}

    def is_light(self, word: str) -> bool:
        return word in self.light or len(word) >= 5 and any(osa_within(word, w, 1) is not None for d in one_deletions(word) for w in self.near_light.get(d, ()))


def is_within(short: str, whole: str) -> bool:
    """Whether the letters of one word occur in another in their order."""
    rest = iter(whole)
    return all(c in rest for c in short)


def may_mean(short: str, whole: str) -> bool:
    """Whether a word looks like a short or mistyped form of another."""
    if len(whole) < 4:
        return False
    shortened = len(short) > 1 and len(whole) > len(short) and whole[0] == short[0] and is_within(short, whole)
    return shortened or len(short) >= 5 and osa_within(short, whole, 1) is not None


def long_forms(frequency: dict[str, int], overlap: dict[tuple[str, str], int], cores: dict[str, int]) -> dict[str, str]:
    """Every shared word with the more frequent one that it is a form of, itself if of none; chains are followed."""
    to = {}
    for a in frequency:
        better = [(n / cores[a], frequency[t], t) for (x, t), n in overlap.items() if x == a and (frequency[t], t) > (frequency[a], a) and n >= SAME_CORES * cores[a]]
        to[a] = max(better)[2] if better else a
    for a in to:
        while to[to[a]] != to[a]:
            to[a] = to[to[a]]
    return to


def covering(meetings: dict[tuple[str, str], int], counts: dict[str, int], limit: float, taken: set[str]) -> set[str]:
    """Words to take away so that none of the others meets the remaining ones in ``limit`` of its cases or more.

    The word with the largest share goes first, to a tenth; of equal ones that which meets the most others.
    """
    share = defaultdict(int)
    beside = defaultdict(dict)
    for (u, v), n in meetings.items():
        if u not in taken and v not in taken:
            share[u] += n
            beside[u][v] = n
    out = set()
    while share:
        # a case with several others counts for each of them
        worst = max(share, key=lambda w: (min(1.0, round(share[w] / counts[w], 1)), len(beside[w]), share[w] / counts[w], w))
        if share[worst] < limit * counts[worst]:
            break
        out.add(worst)
        del share[worst]
        for other in list(beside[worst]):
            if other in share:
                share[other] -= beside[other].pop(worst, 0)
    return out


def learn_lexicon(names: DataFrame, words: str) -> Lexicon:
    """The lexicon of distinct names, given as arrays of words without legal forms.

    All names count, each set of words once. Two tables of bounded size reach
    the driver: the shared words, at most five thousand times the words of a
    name, and the pairs of them that meet in a hundredth of the cases of one.
    Fewer names than give a word eight cores teach nothing, and then every word
    is part of the core.
    """
    sets = cut(names.select(F.array_sort(F.array_distinct(words)).alias("set")).filter("size(set) > 0").distinct().withColumn("n", F.monotonically_increasing_id()), "role-names")
    tokens = sets.select("n", F.explode("set").alias("t"))
    frequency = cut(tokens.groupBy("t").agg(F.count("*").alias("df")), "role-frequency")
    n_sets = sets.count()
    # words frequent enough to burden a task meet their count by a broadcast: no more than 10,000 times the words of a name
    hot = F.broadcast(frequency.filter(F.col("df") > max(1_000, n_sets // 10_000)))
    counted = tokens.join(hot, "t").unionByName(tokens.join(hot.select("t"), "t", "left_anti").join(frequency, "t"))
    core = counted.groupBy("n").agg(F.min(F.struct("df", "t")).alias("c"), F.count("*").alias("size"))
    cored = cut(core.select("n", F.col("c.t").alias("core"), "size"), "role-cores")
    beside = sets.filter("size(set) > 1").join(cored.select("n", "core"), "n").select("core", F.explode("set").alias("t")).filter("t <> core").distinct()
    spread = cut(beside.groupBy("t").agg(F.count("*").alias("cores")), "role-spread")
    least = max(MIN_CORES, cored.select("core").distinct().count() // PER_CORES)
    shared = spread.filter(F.col("cores") >= least).join(frequency, "t")
    rows = shared.limit(MOST_SHARED + 1).collect()
    if len(rows) > MOST_SHARED:
        raise ValueError(f"more than {MOST_SHARED} shared words")
    if not rows:
        return Lexicon()
    df, n_cores = {r.t: r.df for r in rows}, {r.t: r.cores for r in rows}

    spark = names.sparkSession
    by_letter = defaultdict(list)
    for t in df:
        by_letter[t[:1]].append(t)
        by_letter[t[1:2]].append(t)  # a typo may have changed or moved the first letter
    like = sorted({(a, t) for a in df for t in {*by_letter[a[:1]], *by_letter[a[1:2]]} if a != t and (df[t], t) > (df[a], a) and may_mean(a, t)})
    known = F.broadcast(spark.createDataFrame([(t,) for t in df], "t string"))
    held = cut(beside.join(known, "t").groupBy("core").agg(F.collect_set("t").alias("held")), "role-held")  # no more than the shared words a core
    overlap = {}
    if like:
        pairs = F.broadcast(spark.createDataFrame(like, "a string, t string"))
        both = held.select("core", "held", F.explode("held").alias("a")).join(pairs, "a").filter(F.array_contains("held", F.col("t")))
        overlap = {(r.a, r.t): r.n for r in both.groupBy("a", "t").agg(F.count("*").alias("n")).collect()}
    means = long_forms(df, overlap, n_cores)

    meant = F.broadcast(spark.createDataFrame(list(means.items()), "t string, meant string"))

    def meetings(cases: DataFrame) -> tuple[dict, dict]:
        """Pairs of meanings that meet in a case, and the number of cases of each meaning; cases: ``case, t``."""
        grouped = cut(cases.join(meant, "t").groupBy("case").agg(F.collect_set("meant").alias("m")), "role-meetings")
        counts = {r.u: r.n for r in grouped.select(F.explode("m").alias("u")).groupBy("u").agg(F.count("*").alias("n")).collect()}
        met = grouped.filter("size(m) > 1").select("m", F.explode("m").alias("u")).select("u", F.explode("m").alias("v")).filter("u <> v").groupBy("u", "v").agg(F.count("*").alias("n"))
        of = F.broadcast(spark.createDataFrame(list(counts.items()), "u string, n_u bigint"))
        met = met.join(of, "u").join(of.withColumnsRenamed({"u": "v", "n_u": "n_v"}), "v").filter(F.col("n") >= F.least("n_u", "n_v") * _SLIGHT)
        return {(r.u, r.v): r.n for r in met.collect()}, counts

    light = covering(*meetings(tokens.withColumnRenamed("n", "case")), IN_NAME, set())
    light |= covering(*meetings(held.select(F.col("core").alias("case"), F.explode("held").alias("t"))), IN_CORE, light)
    return Lexicon({t: m for t, m in means.items() if m not in light}, frozenset(t for t, m in means.items() if m in light))
