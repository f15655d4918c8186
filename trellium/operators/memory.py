"""Ordered, clamped folds per key, computed in pieces.

A step of the fold is x -> clamp(x + d). Such functions are closed under
composition: a run of steps is again x -> min(hi, max(lo, x + d)). So the fold is
cut into chunks of time with a bounded number of events, each chunk becomes one function, and a key's functions
are composed in order; no task holds all events of a key. Scores are kept as
whole hundredths, which makes the result independent of the cuts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class MemoryRules:
    """Constants of the source score, in hundredths."""

    initial: int = 5000
    lowest: int = 0
    highest: int = 10000
    per_job: int = 600
    per_high_fit: int = 800
    quality_weight: int = 4  # per point of quality, 0 to 100
    no_job: int = -150
    error: int = -500
    blocked: int = -300
    bad_quality: int = -250
    bad_quality_at: int = 30
    streak_from: int = 4


UNITS = ["month", "day", "hour", "minute", "second"]
CHUNK_ROWS, MAX_LARGE = 200_000, 10_000


def with_chunks(events: DataFrame, key: str, at: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``events`` with ``_chunk``, the start of a span of time of its key that holds no more than ``chunk_rows`` rows.

    Spans are months; those with more rows are cut into days, then hours,
    minutes and seconds. The limit rises to a ten thousandth of all rows, so
    that the spans to be cut are few and their list is broadcast.
    """
    e = events.withColumn("_chunk", F.date_trunc(UNITS[0], at))
    for unit in UNITS[1:]:
        sizes = e.groupBy(key, "_chunk").agg(F.count("*").alias("_rows"))
        large = sizes.filter(F.col("_rows") > chunk_rows)
        n = large.count()
        if not n:
            break
        if n > MAX_LARGE:
            large = sizes.filter(F.col("_rows") > max(chunk_rows, sizes.agg(F.sum("_rows")).head()[0] // MAX_LARGE))
        e = e.join(F.broadcast(large.withColumnRenamed("_rows", "_large")), [key, "_chunk"], "left").withColumn("_chunk", F.when(F.col("_large").isNotNull(), F.date_trunc(unit, at)).otherwise(F.col("_chunk"))).drop("_large")
    return e


def with_streak(events: DataFrame, key: str, order: list[str], reset: Column, start: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``events`` with ``streak``: rows since the key's last reset, 0 on a reset; ``order`` begins with the time.

    ``start`` (key, ``start_streak``) is what each key had before; 0 without it.

    Within a chunk of bounded rows the streak is a window; across chunks a
    window over one row for each carries it on.
    """
    e = with_chunks(events, key, order[0], chunk_rows).withColumn("_reset", reset.cast("int"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    e = e.withColumn("_island", F.sum("_reset").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.row_number().over(Window.partitionBy(key, "_chunk", "_island").orderBy(*order)) - F.when(F.col("_island") > 0, 1).otherwise(0)
    e = e.withColumn("_since", since)
    per_chunk = e.groupBy(key, "_chunk").agg(F.count("*").alias("_n"), F.sum("_reset").alias("_resets"), F.max_by("_since", F.struct(*order)).alias("_trailing"))
    over = Window.partitionBy(key).orderBy("_chunk")
    per_chunk = per_chunk.join(start, key, "left") if start is not None else per_chunk.withColumn("start_streak", F.lit(None))
    before = F.coalesce(F.col("start_streak").cast("bigint"), F.lit(0))
    per_chunk = per_chunk.withColumn("_group", F.sum(F.when(F.col("_resets") > 0, 1).otherwise(0)).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    at_end = F.sum(F.when(F.col("_resets") > 0, F.col("_trailing")).otherwise(F.col("_n"))).over(Window.partitionBy(key, "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0))
    per_chunk = per_chunk.withColumn("_end", at_end + F.when(F.col("_group") == 0, before).otherwise(0))
    carry = per_chunk.select(key, "_chunk", F.coalesce(F.lag("_end").over(over), before).alias("_carry"))
    joined = e.join(carry, [key, "_chunk"])
    streak = (F.col("_since") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).cast("bigint")
    return joined.withColumn("streak", streak).drop("_reset", "_island", "_since", "_carry")


def _clamped(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, lo), hi)


def _compose(acc: Column, step: Column) -> Column:
    """First ``acc``, then ``step``; both (d, lo, hi)."""
    return F.struct(
        (acc["d"] + step["d"]).alias("d"),
        _clamped(acc["lo"] + step["d"], step["lo"], step["hi"]).alias("lo"),
        _clamped(acc["hi"] + step["d"], step["lo"], step["hi"]).alias("hi"),
    )


def _composed(steps: Column) -> Column:
    """One function from an ordered, non-empty array of (.., d, lo, hi)."""
    fn = lambda s: F.struct(s["d"].alias("d"), s["lo"].alias("lo"), s["hi"].alias("hi"))
    return F.aggregate(F.slice(steps, 2, F.size(steps)), fn(F.element_at(steps, 1)), lambda acc, s: _compose(acc, fn(s)))


def source_memory_fold(events: DataFrame, rules: MemoryRules = MemoryRules(), start: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per source from ``source_key, ts, id, status, jobs, high_fit, quality``.

    ``start`` is an earlier result to go on from; sources that have no new
    events keep their row.

    Rewards and penalties are added step by step in the order of (ts, id), the
    score is clamped after every step. Jobs and high fits count whatever the
    status. Rows without a source key are left out, NULL counts are 0. Folds are
    cut into chunks of no more than ``chunk_rows`` events; the result is the
    same however they are cut.
    """
    e = events.filter("source_key is not null").select("source_key", "ts", "id", "status", *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in ("jobs", "high_fit", "quality")])
    ok, blocked = F.col("status") == "ok", F.col("status") == "blocked_by_robots"
    e = with_streak(e, "source_key", ["ts", "id"], ok & (F.col("jobs") > 0), start.select("source_key", F.col("no_job_streak").alias("start_streak")) if start is not None else None, chunk_rows)
    quality = _clamped(F.col("quality"), F.lit(0), F.lit(100))
    idle = F.when(F.col("jobs") > 0, 0).otherwise(rules.no_job + F.when(F.col("streak") >= rules.streak_from, rules.no_job).otherwise(0))
    reward = rules.per_job * F.col("jobs") + rules.per_high_fit * F.col("high_fit") + rules.quality_weight * quality + idle + F.when(F.col("quality") <= rules.bad_quality_at, rules.bad_quality).otherwise(0)
    d = F.when(ok, reward).when(blocked, rules.blocked).otherwise(rules.error).cast("bigint")
    bounds = [F.lit(rules.lowest).cast("bigint").alias("lo"), F.lit(rules.highest).cast("bigint").alias("hi")]
    last = F.struct("ts", "id")
    per_chunk = e.groupBy("source_key", "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("ts", "id", d.alias("d"), *bounds))).alias("steps"),
        F.count("*").alias("visits"),
        F.sum("jobs").alias("jobs_found"),
        F.sum("high_fit").alias("high_fit_jobs"),
        F.count_if(~ok & ~blocked).alias("errors"),
        F.count_if(blocked).alias("blocked"),
        F.max_by(F.struct("streak", quality.alias("quality")), last).alias("last"),
    )
    per_chunk = per_chunk.withColumn("f", _composed(F.col("steps"))).drop("steps")
    sums = [F.sum(c).alias(c) for c in ("visits", "jobs_found", "high_fit_jobs", "errors", "blocked")]
    whole = per_chunk.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("_chunk", "f.d", "f.lo", "f.hi"))).alias("steps"), *sums, F.max_by("last", "_chunk").alias("last"))
    f = _composed(F.col("steps"))
    first = F.lit(rules.initial).cast("bigint")
    if start is not None:
        whole = whole.join(start.select("source_key", F.round(F.col("score") * 100).cast("bigint").alias("_from")), "source_key", "left")
        first = F.coalesce("_from", first)
    score = _clamped(first + f["d"], f["lo"], f["hi"]) / 100.0
    done = whole.select("source_key", score.alias("score"), "visits", "jobs_found", "high_fit_jobs", "errors", "blocked", F.col("last.streak").alias("no_job_streak"), F.col("last.quality").alias("last_quality"))
    if start is None:
        return done
    counters = ["visits", "jobs_found", "high_fit_jobs", "errors", "blocked"]
    old = start.select("source_key", F.struct("score", *counters, "no_job_streak", "last_quality").alias("old"))
    new = done.select("source_key", F.struct("score", *counters, "no_job_streak", "last_quality").alias("new"))
    both = old.join(new, "source_key", "full")
    latest = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    sums = [(F.coalesce(F.col(f"old.{c}"), F.lit(0)) + F.coalesce(F.col(f"new.{c}"), F.lit(0))).alias(c) for c in counters]
    return both.select("source_key", latest("score"), *sums, latest("no_job_streak"), latest("last_quality"))


def decayed(score: Column, initial: float = 50.0, decay: float = 0.98) -> Column:
    """A score drawn towards its initial value; NULL starts there."""
    return F.lit(initial) + (F.coalesce(score, F.lit(initial)) - F.lit(initial)) * F.lit(decay)
