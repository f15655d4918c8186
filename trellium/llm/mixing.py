"""Mixing sources to target shares.

Every source is put into a random order by a hash, passed over as often as its
quota needs, and cut into blocks of equal token number. A splitting tree deals
the blocks to output shards: at each node the block counts of all sources are
split by a multivariate hypergeometric draw, so each source's quota is used up
exactly. The tree is a table that grows downwards. Within a shard the documents are shuffled again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.session import cut

MAX_SOURCES = 10_000
DOCS_PER_BUCKET = 5_000
CLOSING_DOCS = 3
MOST_BLOCKS = 900_000_000  # the generator draws exactly from fewer than 10^9; blocks grow so that there are no more
LEVELS = 10  # levels of the tree that a task grows from one node


def grown(a: int, b: int, counts: np.ndarray, first: np.ndarray, seed: int, levels: int = LEVELS) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes ``levels`` below a node of the splitting tree, or its leaves where those are nearer.

    A node is (first shard, end shard, blocks of each source, first block of
    each source). Its draw depends on the seed and its shards alone.
    """
    out, nodes = [], [(a, b, counts, first, levels)]
    while nodes:
        a, b, counts, first, left = nodes.pop()
        if b - a == 1 or not left:
            out.append((a, b, counts, first))
            continue
        mid = (a + b) // 2
        take = int(counts.sum()) * (mid - a) // (b - a)
        rng = np.random.default_rng([seed, a, b])
        one = rng.multivariate_hypergeometric(counts, take, method="marginals")
        nodes += [(mid, b, counts - one, first + one, left - 1), (a, mid, one, first, left - 1)]
    return out


def splitting_tree(spark: SparkSession, quotas: list[int], shards: int, seed: int, levels: int = LEVELS) -> DataFrame:
    """``shard, counts, first``: blocks of every source that each shard gets, and the number of the first of them.

    A table from the root down: every round grows each node by ``levels``, so
    the tree of any number of shards is never held in one place.
    """
    nodes = spark.createDataFrame([(0, shards, [int(q) for q in quotas], [0] * len(quotas))], "a bigint, b bigint, counts array<bigint>, first array<bigint>")

    def grow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, counts, first in pdf.itertuples(index=False):
                rows = grown(int(a), int(b), np.asarray(counts, dtype=np.int64), np.asarray(first, dtype=np.int64), seed, levels)
                yield pd.DataFrame(rows, columns=["a", "b", "counts", "first"])

    depth = 0
    while (1 << depth) < shards:
        nodes = cut(nodes.mapInPandas(grow, nodes.schema), "mix-tree")
        depth += levels
        if (1 << depth) < shards:
            nodes = nodes.repartition(F.col("a"))
    return nodes.select(F.col("a").alias("shard"), "counts", "first")


def plan_quotas(have: dict[str, int], targets: list[tuple[str, float, int]], total: int | None) -> tuple[dict[str, int], dict[str, float]]:
    """Token quota and aimed share of every source.

    A source without tokens cannot serve; its share goes to the others in
    proportion. Without ``total`` the mixture is the largest in which every other
    source keeps its share within its repeats; with it, sources end at their cap.
    """
    able = {s: (share, reps) for s, share, reps in targets if share > 0 and reps > 0 and have.get(s, 0) > 0}
    whole = sum(share for share, _ in able.values())
    aimed = {s: share / whole for s, (share, _) in able.items()}
    if not able:
        return {}, {}
    largest = min(have[s] * able[s][1] / aimed[s] for s in able)
    size = largest if total is None else total
    return {s: int(min(have[s] * able[s][1], math.floor(aimed[s] * size))) for s in able}, aimed


def mix(docs: DataFrame, targets: DataFrame, total: int | float | None = None, block_tokens: int = 2_000, shard_tokens: int = 500_000, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) of ``docs`` (``id``, ``source``, ``size``) by ``targets`` (``source``, ``share``, ``repeats``).

    ``total`` is the size aimed at in tokens, a fraction of what all target
    sources hold if it is a float, or as much as the shares allow without it.

    The mixture has ``shard, position, id, source, pass, size``: no document
    occurs more often than its source's repeats, passes count from 0, and the
    last pass of a source ends before the document that would exceed the quota;
    up to three of its unused documents then come as near to it as they can.
    shares has ``source, target_share, aimed_share, actual_share, tokens,
    n_docs, passes`` for every target. NULL sources, sources that are no target,
    and documents of size 0 or NULL do not take part; a target listed twice
    counts with its larger share; empty frames give empty mixtures. The order
    follows from ``seed`` and the ids alone.
    """
    spark = docs.sparkSession
    rows = targets.filter("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max_by("repeats", "share").alias("repeats")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"at most {MAX_SOURCES} sources")
    wanted = sorted((r[0], float(r[1] or 0.0), int(r[2] or 0)) for r in rows)
    listed = spark.createDataFrame([(s,) for s, _, _ in wanted], "source string")
    base = docs.select("id", "source", F.col("size").cast("bigint").alias("size")).join(F.broadcast(listed), "source")
    # sizes may come from a Python function: written once before anything filters on them
    base = cut(base.withColumn("h", F.xxhash64("id", F.lit(seed))), "mix-docs").filter("size > 0")
    sizes = {r[0]: (int(r[1]), int(r[2])) for r in base.groupBy("source").agg(F.sum("size"), F.count("*")).collect()}
    if isinstance(total, float):
        total = int(total * sum(t for t, _ in sizes.values()))
    quotas, aimed = plan_quotas({s: t for s, (t, _) in sizes.items()}, wanted, total)
    order = [s for s in sorted(quotas) if quotas[s] > 0]
    whole = sum(quotas.values())
    block_tokens = max(block_tokens, -(-whole // MOST_BLOCKS))
    blocks = [-(-quotas[s] // block_tokens) for s in order]
    shards = max(1, -(-whole // max(shard_tokens, block_tokens)))
    # ranges of blocks meet their documents by cells about as wide as a shard's average range
    width = {s: max(1, n // shards) for s, n in zip(order, blocks)}
    ranges = splitting_tree(spark, blocks, shards, seed).select("shard", F.posexplode(F.arrays_zip("counts", "first")).alias("i", "r")).filter("r.counts > 0")
    named = spark.createDataFrame([(i, s, width[s]) for i, s in enumerate(order)], "i int, source string, width bigint")
    ranges = ranges.join(F.broadcast(named), "i").select("source", "shard", F.col("r.first").alias("from_block"), (F.col("r.first") + F.col("r.counts")).alias("to_block"), "width")
    cell = lambda c: F.floor(c / F.col("width")).cast("bigint")
    ranges = ranges.select("source", "shard", "from_block", "to_block", F.explode(F.sequence(cell(F.col("from_block")), cell(F.col("to_block") - 1))).alias("cell"))

    plan = [(s, quotas[s], sizes[s][0], -(-quotas[s] // sizes[s][0]), max(1, -(-sizes[s][1] // DOCS_PER_BUCKET))) for s in order]
    known = spark.createDataFrame(plan, "source string, quota bigint, have bigint, passes bigint, buckets bigint")
    drawn = base.join(F.broadcast(known), "source").withColumn("pass", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("passes") - 1)))
    # a pass permutes anew; a bucket is a slice of the permutation small enough for one task
    drawn = drawn.withColumn("at", F.xxhash64("h", "pass")).withColumn("bucket", F.pmod(F.shiftrightunsigned("at", 16), F.col("buckets")))
    per_bucket = drawn.groupBy("source", "pass", "bucket").agg(F.sum("size").alias("bucket_size"))
    w = Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("source", "pass", "bucket", F.coalesce(F.sum("bucket_size").over(w), F.lit(0)).alias("bucket_start"))
    inner = Window.partitionBy("source", "pass", "bucket").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = drawn.withColumn("inside", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(starts, ["source", "pass", "bucket"])
    placed = placed.withColumn("offset", F.col("pass") * F.col("have") + F.col("bucket_start") + F.col("inside"))
    placed = cut(placed.select("id", "source", "pass", "size", "at", "offset", "quota", "passes"), "mix-placed")
    fits = F.col("offset") + F.col("size") <= F.col("quota")
    used = placed.filter(fits).select("id", "source", "pass", "size", "at", "offset")
    # the document at the quota's end may be long: unused ones of the last pass close the rest
    spare = placed.filter(~fits & (F.col("pass") == F.col("passes") - 1))
    rest = {r[0]: quotas[r[0]] - int(r[1]) for r in used.groupBy("source").agg(F.sum("size")).collect()}
    taken: list[tuple[str, int, int, int]] = []
    for _ in range(CLOSING_DOCS):
        lacking = [(s, n) for s, n in ((s, rest.get(s, quotas[s])) for s in order) if n > 0]
        if not lacking:
            break
        gone = spark.createDataFrame([(s, i) for s, i, _, _ in taken], "source string, id bigint")
        left = spare.join(F.broadcast(spark.createDataFrame(lacking, "source string, lack bigint")), "source").join(F.broadcast(gone), ["source", "id"], "left_anti")
        miss = F.abs(F.col("size") - F.col("lack"))
        best = left.filter(F.col("size") < 2 * F.col("lack")).groupBy("source").agg(F.min_by(F.struct("id", "size", "at"), F.struct(miss, F.col("at"), F.col("id"))).alias("b"))
        new = [(r["source"], r["b"]["id"], r["b"]["size"], r["b"]["at"]) for r in best.collect()]
        for s, _, size, _ in new:
            rest[s] = rest.get(s, quotas[s]) - size
        taken += new
        if not new:
            break
    closing = spark.createDataFrame([(i, s, -(-quotas[s] // sizes[s][0]) - 1, n, at, max(0, quotas[s] - 1)) for s, i, n, at in taken], "id bigint, source string, pass bigint, size bigint, at bigint, offset bigint")
    used = used.unionByName(closing)

    last = spark.createDataFrame([(s, n - 1, width[s]) for s, n in zip(order, blocks)], "source string, last_block bigint, width bigint")
    used = used.join(F.broadcast(last), "source").withColumn("block", F.least(F.floor(F.col("offset") / block_tokens).cast("bigint"), "last_block")).withColumn("cell", cell(F.col("block")))
    used = used.join(ranges, ["source", "cell"]).filter("block >= from_block and block < to_block")
    used = cut(used.select("shard", "id", "source", "pass", "size", F.xxhash64("at", F.lit(seed + 1)).alias("r")), "mix-used")
    mixture = used.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy("r", "id", "pass")).cast("bigint")).select("shard", "position", "id", "source", "pass", "size")
    reached = used.groupBy("source").agg(F.sum("size").alias("tokens"), F.count("*").alias("n_docs"), (F.max("pass") + 1).alias("passes"))
    all_tokens = used.agg(F.sum("size").alias("all_tokens"))
    goal = spark.createDataFrame([(s, share, aimed.get(s, 0.0)) for s, share, _ in wanted], "source string, target_share double, aimed_share double")
    shares = goal.join(reached, "source", "left").crossJoin(F.broadcast(all_tokens))
    zero = F.lit(0).cast("bigint")
    shares = shares.select(
        "source", "target_share", "aimed_share", F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0)).alias("actual_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("n_docs", zero).alias("n_docs"), F.coalesce("passes", zero).alias("passes")
    )
    return mixture, shares
