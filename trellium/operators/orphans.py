"""References to records that do not exist, or exist only later.

Keys are dictionary-encoded as integers within a key range (a hash slice of the
key space), the references and the parents of a range become one compressed
bitmap per period, ``references AND NOT parents`` leaves the orphans, and the
surviving bits are decoded back into keys.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellium.operators.bitmaps import Bitmap
from trellium.session import cut

MISSING, LATE = "missing", "late"
_CHECK = "check"  # first visit in the month of the reference: the exact times decide
KEYS_PER_RANGE = 1 << 16


def month_index(t):
    """Months since year 0, as the period of a time."""
    return F.year(t) * 12 + F.month(t) - 1


def surviving_bits(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: encode, build bitmaps, AND NOT, decode."""
    code_of: dict[str, int] = {}
    codes = np.fromiter((code_of.setdefault(k, len(code_of)) for k in pdf["key"]), dtype=np.int64, count=len(pdf))
    dictionary = np.array(list(code_of), dtype=object)
    parent = pdf["parent"].to_numpy(dtype=bool)
    period = pdf["period"].fillna(-1).to_numpy(dtype=np.int64)
    existing = Bitmap.of(codes[parent])
    first_in = {int(p): Bitmap.of(codes[parent & (period == p)]) for p in np.unique(period[parent])}
    first_visit = np.full(len(dictionary), np.datetime64("NaT"), dtype="datetime64[us]")
    first_visit[codes[parent]] = pdf["first_visit"].to_numpy(dtype="datetime64[us]")[parent]
    out = []
    for p in np.unique(period[~parent]):
        mine = ~parent & (period == p)
        refs = Bitmap.of(codes[mine])
        not_later = Bitmap()
        for q, b in first_in.items():
            if q <= p:
                not_later = not_later | b
        states = [(MISSING, refs.and_not(existing))]
        if p >= 0:  # without a time nothing can be late
            states += [(LATE, (refs & existing).and_not(not_later)), (_CHECK, refs & first_in.get(int(p), Bitmap()))]
        count = np.zeros(len(dictionary), dtype=np.int64)
        count[codes[mine]] = pdf["n"].to_numpy(dtype=np.int64)[mine]
        for state, bits in states:
            at = bits.values()
            if len(at):
                out.append(pd.DataFrame({"key": dictionary[at], "period": np.int32(p), "ref_state": state, "first_visit": first_visit[at], "n": count[at]}))
    columns = {"key": object, "period": np.int32, "ref_state": object, "first_visit": "datetime64[us]", "n": np.int64}
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({k: pd.Series(dtype=v) for k, v in columns.items()})


def orphan_references(references: Iterable[DataFrame], parents: DataFrame, hot_rows: int = 100_000) -> DataFrame:
    """Rows of ``references`` whose key is in no parent row, or only in later ones.

    references: frames with ``ref_table`` string, ``ref_id`` bigint, ``key``
    string and ``at`` timestamp; rows with a NULL key are no references and
    are left out, and so are rows with NULL ``at`` whose key exists (their
    period is unknown; without any parent they are ``missing``). Repeated rows
    each come out. parents: ``key`` string and ``at`` timestamp, several rows
    per key allowed; the earliest counts, NULL times only prove existence.
    Empty frames give an empty result, or all references as ``missing``.
    Other columns are ignored, whatever their names.

    Returns ``ref_table, ref_id, ref_state, period``; period counts months.

    A key that holds any share of all references takes one row per month in
    the bitmaps. On the way back to the records, keys of at least ``hot_rows``
    references in a month (and at least a thousandth of all rows, so a thousand
    keys at most) are taken out of the shuffle and meet their state by a
    broadcast, orphans or not, so no task gathers them.
    """
    refs = None
    for r in references:
        r = r.select(F.col("ref_table").cast("string"), F.col("ref_id").cast("bigint"), F.col("key").cast("string"), F.col("at").cast("timestamp_ntz"))
        refs = r if refs is None else refs.unionByName(r)
    refs = cut(refs.filter("key is not null").withColumn("period", F.coalesce(month_index("at"), F.lit(-1))), "orphan-references")
    parent = parents.select(F.col("key").cast("string"), F.col("at").cast("timestamp_ntz")).filter("key is not null")

    on = ["key", "period"]
    asked = refs.groupBy(on).agg(F.count("*").alias("n"))
    there = parent.groupBy("key").agg(F.min("at").alias("first_visit"))
    both = asked.select("key", "period", "n", F.lit(False).alias("parent"), F.lit(None).cast("timestamp_ntz").alias("first_visit")).unionByName(
        there.select("key", F.coalesce(month_index("first_visit"), F.lit(-1)).alias("period"), F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("parent"), "first_visit")
    )
    both = cut(both, "orphan-counts")
    n_keys, n_refs = both.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).head()
    ranges = max(1, -(-n_keys // KEYS_PER_RANGE)) * 4
    survivors = (
        both.withColumn("key_range", F.pmod(F.xxhash64("key"), F.lit(ranges)))
        .groupBy("key_range")
        .applyInPandas(surviving_bits, "key string, period int, ref_state string, first_visit timestamp_ntz, n bigint")
    )
    survivors = cut(survivors, "orphan-keys").drop("n")

    hot = F.broadcast(both.filter(F.col("n") >= max(hot_rows, n_refs // 1000)).select(on))
    found = refs.join(hot, on, "left_anti").join(survivors.join(hot, on, "left_anti"), on)
    found = found.unionByName(refs.join(F.broadcast(survivors.join(hot, on, "left_semi")), on))
    exact = F.when(F.col("ref_state") != _CHECK, F.col("ref_state")).when(F.col("first_visit") > F.col("at"), F.lit(LATE))
    return found.withColumn("ref_state", exact).filter("ref_state is not null").select("ref_table", "ref_id", "ref_state", "period")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    month = F.format_string("%04d-%02d", F.floor(F.col("period") / 12).cast("int"), (F.col("period") % 12 + 1).cast("int"))
    return found.groupBy("ref_table", F.when(F.col("period") >= 0, month).alias("month"), "ref_state").agg(F.count("*").alias("n_refs"))
