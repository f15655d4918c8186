"""Keyed table operations: upserts, inserts, lookups, capped and ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_write(rows: DataFrame, key: str, order: Column, keep_first: dict[str, Column] | None = None) -> DataFrame:
    """One row per non-null key: the one with the greatest ``order``.

    ``keep_first`` maps a column to an aggregate that replaces the row's value.
    Partial aggregation, so a key of any size costs one row per task.
    """
    others = [c for c in rows.columns if c != key]
    best = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*others), order).alias("_row"), *[a.alias(f"_{c}") for c, a in (keep_first or {}).items()])
    kept = keep_first or {}
    return best.select(key, *[F.col(f"_{c}").alias(c) if c in kept else F.col(f"_row.{c}").alias(c) for c in others])


def upsert(base: DataFrame, updates: DataFrame, key: str, keep_old: list[str] = []) -> DataFrame:
    """``updates`` over ``base`` by a unique key; the columns ``keep_old`` stay as they were."""
    cols = [c for c in base.columns if c != key]
    new = updates.select(key, F.struct(*cols).alias("_new"))
    old = base.select(key, F.struct(*cols).alias("_old"))
    both = old.join(new, key, "full")
    pick = lambda c: F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_new.{c}")) if c in keep_old else F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}"))
    return both.select(key, *[pick(c).alias(c) for c in cols])


def insert_new(base: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """``base`` and those candidates (unique keys) that it has no row for."""
    return base.unionByName(candidates.join(base.select(key), key, "left_anti"), allowMissingColumns=True)


def explode_keys(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """A row for each distinct non-null one of several key columns."""
    return rows.withColumn(name, F.explode(F.filter(F.array_distinct(F.array(*keys)), lambda k: k.isNotNull())))


def capped(rows: DataFrame, key: str, room: Column, order: list[Column], most: int) -> DataFrame:
    """Rows while their key has room left; ``most`` bounds the room, so that tasks drop what is beyond it early."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_rank", rank).filter(F.col("_rank") <= most).filter(F.col("_rank") <= room).drop("_rank")


def ranked(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column computed once per row.

    A plain projection may be merged with the filters and projections above it,
    which then compute the value again each time; a generator is not merged.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
