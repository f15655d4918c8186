"""Top N rows of every group by simultaneous bisection of rank codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trellium.session import cut

SPLITS = 256  # cutoffs tried per group and round
#: Groups whose state may be broadcast; a state row has under 200 bytes.
BROADCAST_GROUPS = 20_000
_MIN = -(1 << 62)


def _with_state(rows: DataFrame, state: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows of a group with its state. With ``hot``, the names of the large groups, only their state is
    broadcast and the rows of all others meet theirs by a shuffle, which then holds small groups only."""
    if hot is None:
        return rows.join(F.broadcast(state), "g")
    large = rows.join(F.broadcast(state.join(F.broadcast(hot), "g", "left_semi")), "g")
    small = rows.join(F.broadcast(hot), "g", "left_anti").join(state, "g")
    return large.unionByName(small)


def top_n_per_group(df: DataFrame, group: str, code: list[Column], n: int, keep: list[str]) -> DataFrame:
    """The ``n`` rows with the largest code of every non-null ``group``.

    ``code`` is the order-preserving code of a row: bigint columns within
    +-2^62, compared from the left, larger first; the last one should identify
    the row. NULL in the first component leaves the row out, NULL in a later
    one sorts last. Rows with wholly equal codes are ties: the result still
    has ``n`` rows for the group, and which of the equal ones is not defined.
    Groups of fewer rows come out whole; an empty frame gives an empty one.
    Returns ``group`` and the columns ``keep``; other columns are not read.

    All groups are bisected at once. A round counts, per group, the rows above
    255 equidistant midpoints of the group's interval (with partial sums
    before the shuffle, so a group of any size costs 256 numbers per task) and
    narrows the interval to the one part that holds the N-th row. Where there
    are too many groups to broadcast their state, those with more than a
    20,000th of all rows, which are no more than 20,000, still have theirs
    broadcast, so no task ever gathers one; a group ends
    when the rows above its cutoff are exactly N. Only rows inside an interval
    still open are read again. An interval of one value goes on to the next
    component of the code.
    """
    depth = len(code)
    names = [f"c{i}" for i in range(depth)]
    keep = [c for c in keep if c != group]
    picked = [F.col(group).alias("g"), *[F.coalesce(c.cast("bigint"), F.lit(_MIN)).alias(k) if i else c.cast("bigint").alias(k) for i, (k, c) in enumerate(zip(names, code))]]
    rows = df.select(*picked, *[F.col(c).alias(f"k_{i}") for i, c in enumerate(keep)]).filter("g is not null and c0 is not null")
    codes = rows.select("g", *names)

    def prefix(level: Column) -> list[Column]:
        return [F.when(level > i, F.col(f"p{i}")) for i in range(depth)]

    sizes = codes.groupBy("g").agg(F.count("*").alias("cnt"), F.min("c0").alias("lo"), F.max("c0").alias("hi"))
    start = sizes.select(
        "g", "cnt", F.lit(0).alias("level"), "lo", "hi", F.lit(n).cast("bigint").alias("need"), (F.col("cnt") <= n).alias("done"), *[F.lit(_MIN).cast("bigint").alias(f"p{i}") for i in range(depth)]
    )
    sized = cut(start, "topn-state")
    state, hot = sized.drop("cnt"), None
    n_groups, n_rows = sized.agg(F.count("*"), F.sum("cnt")).head()
    if n_groups > BROADCAST_GROUPS:
        hot = cut(sized.filter(F.col("cnt") > n_rows / BROADCAST_GROUPS).select("g"), "topn-hot")
    settled = state.filter("done")
    open_state, active = state.filter("not done"), codes
    n_open = open_state.count()
    while n_open:
        value = F.element_at(F.array(*names), F.col("level") + 1)
        following = F.element_at(F.array(*names[1:], F.lit(0).cast("bigint")), F.col("level") + 1)
        same = F.lit(True)
        for i in range(depth):
            same = same & ((F.col("level") <= i) | (F.col(f"c{i}") == F.col(f"p{i}")))
        width = F.expr(f"(hi - lo) div {SPLITS} + 1")
        inside = _with_state(active, open_state, hot).filter(same).withColumn("v", value).filter("v between lo and hi")
        inside = inside.withColumn("part", F.floor((F.col("v") - F.col("lo")) / width)).withColumn("following", following)
        fixed = ["level", "need", *[f"p{i}" for i in range(depth)]]
        counts = inside.groupBy("g", "part").agg(
            F.count("*").alias("cnt"),
            F.min("v").alias("v_lo"),
            F.max("v").alias("v_hi"),
            F.min("following").alias("f_lo"),
            F.max("following").alias("f_hi"),
            *[F.first(c).alias(c) for c in fixed],
        )
        above = F.sum("cnt").over(Window.partitionBy("g").orderBy(F.desc("part")))
        pivot = counts.withColumn("above", above).filter("above >= need and above - cnt < need")
        exact = F.col("above") == F.col("need")
        single = F.col("v_lo") == F.col("v_hi")
        last = F.col("level") == depth - 1
        done = exact | (single & last)
        deeper = single & ~done
        nxt = pivot.select(
            "g",
            F.when(deeper, F.col("level") + 1).otherwise(F.col("level")).alias("level"),
            F.when(deeper, F.col("f_lo")).otherwise(F.col("v_lo")).alias("lo"),
            F.when(deeper, F.col("f_hi")).otherwise(F.col("v_hi")).alias("hi"),
            F.when(done, F.col("need")).otherwise(F.col("need") - (F.col("above") - F.col("cnt"))).alias("need"),
            done.alias("done"),
            *[F.when((F.col("level") == i) & (done | deeper), F.col("v_lo")).otherwise(F.col(f"p{i}")).alias(f"p{i}") for i in range(depth)],
        )
        nxt = cut(nxt, "topn-state")
        settled = settled.unionByName(nxt.filter("done"))
        open_state = nxt.filter("not done")
        active = cut(_with_state(active, open_state.select("g", "level", *[f"p{i}" for i in range(depth)], "lo", "hi"), hot).filter(same).withColumn("v", value).filter("v between lo and hi").select("g", *names), "topn-rows")
        n_open = open_state.count()

    at_or_above = F.struct(*names) >= F.struct(*[f"p{i}" for i in range(depth)])
    chosen = _with_state(rows, settled.select("g", *[f"p{i}" for i in range(depth)]), hot).filter(at_or_above)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(*[F.desc(c) for c in names]))  # wholly equal codes only
    return chosen.withColumn("rank", rank).filter(F.col("rank") <= n).select(F.col("g").alias(group), *[F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)])
