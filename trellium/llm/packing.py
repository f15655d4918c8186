"""Filling containers of fixed capacity, certified by lower bounds.

Items are packed by best-fit decreasing within partitions. For each partition
dual feasible functions give a number of containers that no packing can beat.
Partitions that meet it are done, proven best for their items; those with a gap
exchange their items among each other and are packed anew, as long as that
saves containers.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.session import cut

ITEMS_PER_PARTITION = 20_000
ROUNDS = 4
STAIRCASES = 40
MAX_WINDOWS = 1000


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; sizes are whole numbers of 0 to ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    open_by_rest: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0  # bit r: a container with r tokens left is open
    out = np.zeros(len(sizes), dtype=np.int64)
    n = 0
    for i, s in zip(order.tolist(), sizes[order].tolist()):
        fitting = mask >> s
        if fitting:
            rest = (fitting & -fitting).bit_length() - 1 + s
            b = open_by_rest[rest].pop()
            if not open_by_rest[rest]:
                mask &= ~(1 << rest)
        else:
            b, rest = n, capacity
            n += 1
        out[i] = b
        rest -= s
        open_by_rest[rest].append(b)
        mask |= 1 << rest
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Containers that any packing needs: the best of three families of dual feasible functions.

    The identity (all tokens over the capacity); the threshold functions that
    count items above C - k whole, drop those under k and keep the rest, for all
    k up to C/2; and the staircases floor((k+1)x)/k.
    """
    s = sizes[sizes > 0].astype(np.int64)
    if not len(s):
        return int(len(sizes) > 0)
    best = -(-int(s.sum()) // capacity)
    counts = np.bincount(s, minlength=capacity + 1).astype(np.int64)
    values = np.arange(capacity + 1, dtype=np.int64)
    n_to, sum_to = np.cumsum(counts), np.cumsum(counts * values)
    k = np.arange(0, capacity // 2 + 1, dtype=np.int64)
    big = n_to[-1] - n_to[capacity - k]  # above C - k
    below = np.where(k > 0, sum_to[k - 1], 0)
    middle = sum_to[capacity - k] - below
    best = max(best, int((big + -(-middle // capacity)).max()))
    for j in range(1, STAIRCASES + 1):
        exact = ((j + 1) * values) % capacity == 0
        # weights in units of 1 / (j * capacity)
        weight = np.where(exact, j * values, ((j + 1) * values // capacity) * capacity)
        best = max(best, -(-int((counts * weight).sum()) // (j * capacity)))
    return best


def pack(items: DataFrame, windows: DataFrame) -> DataFrame:
    """Containers of every window's capacity for ``items`` (``id``, ``size``).

    windows: ``window_id``, ``capacity``, at most 1,000 rows. Returns
    ``window_id, container, id, piece, start, size, part, bound``: an item above
    the capacity is cut into full pieces and a rest, any other stays whole; NULL
    sizes count as 0, and items of size 0 lie in some container. Repeated ids
    are items of their own. ``part`` is the partition that packed the row and
    ``bound`` its lower bound (NULL for full pieces, which fill their container).
    Windows without a capacity of 1 or more are left out; an empty frame gives
    an empty one.
    """
    spec = [(int(r[0]), int(r[1])) for r in windows.select("window_id", "capacity").filter("capacity >= 1").limit(MAX_WINDOWS + 1).collect()]
    if len(spec) > MAX_WINDOWS:
        raise ValueError(f"at most {MAX_WINDOWS} windows")
    spark = items.sparkSession
    base = cut(items.select("id", F.coalesce(F.col("size").cast("bigint"), F.lit(0)).alias("size")), "pack-items")
    n_items = base.count()
    sized = base.crossJoin(F.broadcast(spark.createDataFrame(spec, "window_id bigint, capacity bigint")))
    full = sized.filter("size > capacity or (size = capacity)").select(
        "window_id", "id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr("size div capacity - 1"))).alias("piece"), "capacity"
    )
    full = full.select(
        "window_id", F.concat_ws("-", F.lit("f"), "id", "piece").alias("container"), "id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"), F.lit(None).cast("string").alias("part"), F.lit(None).cast("bigint").alias("bound")
    )
    rest = sized.filter("size = 0 or size % capacity > 0").select("window_id", "capacity", "id", F.expr("size div capacity").alias("piece"), F.expr("(size div capacity) * capacity").alias("start"), F.expr("size % capacity").alias("size"))
    parts = max(1, -(-n_items // ITEMS_PER_PARTITION))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id"], ascending=[False, True], kind="stable")
        capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["size"].to_numpy(dtype=np.int64)
        bins = best_fit_decreasing(sizes, capacity)
        return pdf.assign(bin=bins, bins=int(bins.max()) + 1, bound=lower_bound(sizes, capacity))[names]

    names = ["window_id", "capacity", "id", "piece", "start", "size", "part", "bin", "bins", "bound"]
    schema = "window_id bigint, capacity bigint, id bigint, piece bigint, start bigint, size bigint, part string, bin bigint, bins bigint, bound bigint"

    def packed(df: DataFrame, label: str, n: int) -> DataFrame:
        part = F.concat_ws(".", F.lit(label), F.pmod(F.xxhash64("id", F.lit(label)), F.lit(n)).cast("string"))
        return cut(df.withColumn("part", part).groupBy("window_id", "part").applyInPandas(run, schema), "pack-state")

    def totals(df: DataFrame) -> dict[int, tuple[int, int, int, int]]:
        """Per window: containers, bounds, partitions, rows."""
        per_part = df.groupBy("window_id", "part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count("*").alias("n"))
        return {r[0]: tuple(r[1:]) for r in per_part.groupBy("window_id").agg(F.sum("bins"), F.sum("bound"), F.count("*"), F.sum("n")).collect()}

    state = packed(rest, "r0", parts)
    settled = state.filter("bins <= bound")
    open_ = state.filter("bins > bound")
    before = totals(open_)
    for r in range(1, ROUNDS + 1):
        # one partition alone has nobody to exchange with
        alive = [w for w, (_, _, n_parts, _) in before.items() if n_parts > 1]
        if not alive:
            break
        going = open_.filter(F.col("window_id").isin(alive))
        fewest = max(2, *(-(-before[w][3] // ITEMS_PER_PARTITION) for w in alive))
        again = packed(going.select("window_id", "capacity", "id", "piece", "start", "size"), f"r{r}", fewest)
        after = totals(again)
        better = [w for w in alive if after[w][0] < before[w][0]]
        settled = settled.unionByName(open_.filter(~F.col("window_id").isin(better)))
        again = again.filter(F.col("window_id").isin(better))
        settled, open_ = settled.unionByName(again.filter("bins <= bound")), again.filter("bins > bound")
        before = totals(open_) if better else {}
    settled = settled.unionByName(open_)
    done = settled.select("window_id", F.concat_ws("-", "part", "bin").alias("container"), "id", "piece", "start", "size", "part", "bound")
    return done.unionByName(full)


def pack_report(packed: DataFrame, windows: DataFrame) -> DataFrame:
    """Per window: containers, proven least number for the same partitions, tokens, filled share."""
    per_part = packed.groupBy("window_id", "part").agg(F.count_distinct("container").alias("n"), F.coalesce(F.max("bound"), F.count_distinct("container")).alias("bound"), F.sum("size").alias("tokens"))
    total = per_part.groupBy("window_id").agg(F.sum("n").alias("n_containers"), F.sum("bound").alias("lower_bound"), F.sum("tokens").alias("tokens"))
    cap = windows.select(F.col("window_id").cast("bigint"), F.col("capacity").cast("bigint"))
    return total.join(F.broadcast(cap), "window_id").withColumn("filled", F.col("tokens") / (F.col("n_containers") * F.col("capacity")))
