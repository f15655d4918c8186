"""Self-join of texts by binary codes in a trie.

A text's code has 64 bits, each saying whether it holds some letter a given
number of times. An edit moves two letter counts by one at most, so texts within
k edits differ in 2k bits at most, whatever the order of their words: the join
of all codes within ``budget`` bits loses no pair of ``budget / 2`` edits. Which
64 of the (letter, number) pairs make up the code is learned from all texts:
those that split them most evenly come first.

Codes are the leaves of a binary trie. Pairs of nodes are walked down together,
level by level, the differing bits add up, and a pair of nodes is dropped as
soon as they exceed the budget. A block of texts too many for one task is cut by
the pigeonhole principle: of ``budget + s`` parts of the code a pair within the
budget agrees in ``s`` at least.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 64
EDITS = 2
BUDGET = 2 * EDITS
LEAF = 2  # nodes of no more codes are compared one by one
LETTERS, MOST_OF_A_LETTER = 26, 12
HOT_BLOCK = 20_000  # distinct texts from which a block is cut into parts
MAX_HOT_BLOCKS = 10_000  # the threshold rises with the table, so that no more blocks can be beyond it
MOST_AGREEING = 4
CODES_PER_TASK = 20_000
FRONT = 1 << 20  # node pairs, or pairs of codes, held at once


def letter_counts(texts: list[str]) -> np.ndarray:
    """How often each of 26 classes of letters occurs; a to z are classes of their own, other signs share them, spaces have none."""
    out = np.zeros((len(texts), LETTERS), dtype=np.int32)
    for n, t in enumerate(texts):
        raw = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        out[n] = np.bincount((raw[raw != 32] + 7) % LETTERS, minlength=LETTERS)
    return out


def letter_bits(texts: DataFrame, col: str) -> list[tuple[int, int]]:
    """The 64 (letter, number) pairs that split the texts most evenly, the most even first."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((LETTERS, MOST_OF_A_LETTER), dtype=np.int64)
        seen = 0
        for pdf in batches:
            counts = letter_counts(pdf[col].tolist())
            seen += len(counts)
            for k in range(MOST_OF_A_LETTER):
                total[:, k] += (counts > k).sum(axis=0)
        yield pd.DataFrame([(c, k + 1, int(total[c, k]), seen) for c in range(LETTERS) for k in range(MOST_OF_A_LETTER)], columns=["letter", "least", "having", "seen"])

    got = texts.select(col).mapInPandas(count, "letter int, least int, having bigint, seen bigint")
    rows = got.groupBy("letter", "least").agg(F.sum("having").alias("having"), F.sum("seen").alias("seen")).collect()  # 312 rows
    ranked = sorted(rows, key=lambda r: (abs(2 * r.having - r.seen), r.letter, r.least))
    return [(r.letter, r.least) for r in ranked[:BITS]]


def letter_codes(texts: list[str], bits: list[tuple[int, int]]) -> np.ndarray:
    counts = letter_counts(texts)
    out = np.zeros(len(texts), dtype=np.uint64)
    for i, (letter, least) in enumerate(bits):
        out |= (counts[:, letter] >= least).astype(np.uint64) << np.uint64(BITS - 1 - i)
    return out


def letter_code(text: Column, bits: list[tuple[int, int]]) -> Column:
    @F.pandas_udf("bigint")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(letter_codes(s.tolist(), bits).astype(np.int64))

    return run(text)


def _leaves(codes: np.ndarray, a0, a1, b0, b1, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs within the budget of codes a0..a1 and b0..b1 of each node pair, a slice of pairs at a time."""
    upto = np.cumsum((a1 - a0) * (b1 - b0))
    at = 0
    while at < len(upto):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + FRONT, side="right")))
        wide = b1[at:to] - b0[at:to]
        size = (a1[at:to] - a0[at:to]) * wide
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        wide = np.repeat(wide, size)
        i, j = np.repeat(a0[at:to], size) + nth // wide, np.repeat(b0[at:to], size) + nth % wide
        keep = (i < j) & (np.bitwise_count(codes[i] ^ codes[j]) <= budget)
        yield i[keep], j[keep]
        at = to


def trie_pairs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, budget: int, counted: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j within ``budget`` bits inside each of the ranges start..end, whose uint64 codes are sorted.

    A node is a range of codes that agree down to its level. All node pairs of a
    level are split at once; at most ``FRONT`` of them are held per step, the
    others wait. ``counted`` takes the node pairs met and pruned, and the pairs
    of codes compared.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    ones: dict[int, np.ndarray] = {}
    met = pruned = compared = 0
    a0, a1 = np.asarray(starts, dtype=np.int64), np.asarray(ends, dtype=np.int64)
    waiting = [(0, (a0, a1, a0, a1, np.zeros(len(a0), dtype=np.int16)))]
    while waiting:
        depth, front = waiting.pop()
        if len(front[0]) > FRONT:
            half = len(front[0]) // 2
            waiting += [(depth, tuple(x[half:] for x in front)), (depth, tuple(x[:half] for x in front))]
            continue
        a0, a1, b0, b1, errors = front
        met += len(a0)
        leaf = (a1 - a0 <= LEAF) & (b1 - b0 <= LEAF) if depth < BITS else np.ones(len(a0), dtype=bool)
        compared += int(((a1 - a0) * (b1 - b0))[leaf].sum())
        found += _leaves(codes, a0[leaf], a1[leaf], b0[leaf], b1[leaf], budget)
        a0, a1, b0, b1, errors = (x[~leaf] for x in (a0, a1, b0, b1, errors))
        if not len(a0):
            continue
        if depth not in ones:
            bit = (codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        am, bm = a1 - (ones[depth][a1] - ones[depth][a0]), b1 - (ones[depth][b1] - ones[depth][b0])
        two = a0 != b0  # a node paired with itself crosses once
        a0, a1 = np.concatenate([a0, am, a0, am[two]]), np.concatenate([am, a1, am, a1[two]])
        b0, b1 = np.concatenate([b0, bm, bm, b0[two]]), np.concatenate([bm, b1, b1, bm[two]])
        errors = np.concatenate([errors, errors, errors + 1, errors[two] + 1])
        there = (a0 < a1) & (b0 < b1)
        near = there & (errors <= budget)
        pruned += int(there.sum() - near.sum())
        waiting.append((depth + 1, tuple(x[near] for x in (a0, a1, b0, b1, errors))))
    if counted is not None:
        counted.update(met=met, pruned=pruned, compared=compared)
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else (none, none)


def _parts(agreeing: int, budget: int) -> list[int]:
    """Bit masks of the code's ``budget + agreeing`` parts; neighbouring bits go to different parts."""
    n = budget + agreeing
    return [sum(1 << (BITS - 1 - i) for i in range(p, BITS, n)) for p in range(n)]


def near_codes(records: DataFrame, budget: int = BUDGET, accept: Callable[[str, str], bool] | None = None) -> DataFrame:
    """Pairs of texts of one block within ``budget`` bits that ``accept``, from distinct ``block, text, code``.

    Returns ``block, text_a, text_b`` with text_a before text_b. A block with
    more than ``HOT_BLOCK`` texts, or than a ten thousandth of all, is cut into
    the groups that agree in 1 to 4 of the code's parts, more the larger it is;
    a pair counts in the first group that it is in. The result is the same
    however blocks are cut.
    """
    sizes = records.groupBy("block").agg(F.count("*").alias("size"))
    total = records.count()
    least = max(HOT_BLOCK, -(-total // MAX_HOT_BLOCKS))
    hot = F.broadcast(sizes.filter(F.col("size") > least).select("block", "size"))  # no more than MAX_HOT_BLOCKS by the threshold
    several = sizes.filter((F.col("size") > 1) & (F.col("size") <= least)).select("block")  # a text alone in its block has no partner
    cold = records.join(hot, "block", "left_anti").join(several, "block").withColumns({"agreeing": F.lit(0), "pick": F.lit(0), "part": F.lit(0).cast("bigint")})
    masks = {s: [sum(c) for c in itertools.combinations(_parts(s, budget), s)] for s in range(1, MOST_AGREEING + 1)}
    # every part that must agree cuts a block to about an eighth
    agreeing = F.greatest(F.lit(1), F.least(F.lit(MOST_AGREEING), F.ceil(F.log2(F.col("size") / least) / 3).cast("int")))
    split = records.join(hot, "block").withColumn("agreeing", agreeing)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    choices = F.lit(None)
    for s, ms in masks.items():
        choices = F.when(F.col("agreeing") == s, F.array(*[F.lit(signed(m)).cast("bigint") for m in ms])).otherwise(choices)
    split = split.select("block", "text", "code", "agreeing", F.posexplode(choices).alias("pick", "mask")).withColumn("part", F.col("code").bitwiseAND(F.col("mask")))
    tasks = max(1, -(-total // CODES_PER_TASK)) * 2
    columns = ["block", "text", "code", "agreeing", "pick", "part"]
    work = cold.select(columns).unionByName(split.select(columns)).withColumn("task", F.pmod(F.xxhash64("block", "pick", "part"), F.lit(tasks)))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf["group"] = pdf.groupby(["block", "pick", "part"], sort=False).ngroup()
        codes = pdf["code"].to_numpy(dtype=np.int64).view(np.uint64)
        order = np.lexsort((codes, pdf["group"].to_numpy()))
        pdf, codes = pdf.iloc[order], codes[order]
        group = pdf["group"].to_numpy()
        new = np.flatnonzero(group[1:] != group[:-1]) + 1
        i, j = trie_pairs(codes, np.concatenate([[0], new]), np.concatenate([new, [len(group)]]), budget)
        agree, pick, texts, blocks = (pdf[c].to_numpy() for c in ("agreeing", "pick", "text", "block"))
        first = np.ones(len(i), dtype=bool)
        for s, ms in masks.items():
            mine = np.flatnonzero(agree[i] == s)
            differing, own = codes[i[mine]] ^ codes[j[mine]], pick[i[mine]]
            for at, m in enumerate(ms):
                first[mine] &= (own <= at) | ((differing & np.uint64(m)) != 0)
        out = []
        for x, y, b in zip(texts[i[first]], texts[j[first]], blocks[i[first]]):
            if x != y and (accept is None or accept(x, y)):
                out.append((b, min(x, y), max(x, y)))
        return pd.DataFrame(out, columns=["block", "text_a", "text_b"], dtype=object)

    return work.groupBy("task").applyInPandas(join, "block string, text_a string, text_b string")
