"""The queue of addresses as keyed state: admission of candidates, popping, marking, clearing.

A batch of candidates is admitted against pages, source memory and queue as they
stand before it, in the order of the candidates. Every step is a join or a
partial aggregate, so an address or source of any share of the rows is one row
per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellium.operators.keyed import last_write, ranked

FIELDS = ["depth", "priority", "discovered_from", "reason", "source_key", "status", "queued_at", "updated_at"]
QUEUED, ACTIVE, BLOCKED = "queued", "active", "blocked_by_robots"


@dataclass(frozen=True)
class AdmissionRules:
    visits_per_source: int = 25
    least_score: float = 8.0  # sources at or below it are not visited
    initial_score: float = 50.0
    obey_robots: bool = False
    retry_blocked: bool = True
    retry_errors: bool = True


def page_statuses(pages: DataFrame, order: list[str]) -> DataFrame:
    """``url, page_status`` of every address that a page has or ended at; its own page goes before one that ended there, then the later."""
    seen = [pages.select(F.col(c).alias("url"), "status", F.struct(F.lit(rank).alias("own"), *order).alias("at")) for c, rank in (("url", 1), ("final_url", 0))]
    both = seen[0].unionByName(seen[1]).filter("url is not null")
    return both.groupBy("url").agg(F.max_by(F.coalesce("status", F.lit("")), "at").alias("page_status"))


def revisitable(status: Column, rules: AdmissionRules) -> Column:
    """Whether a page of that status may be fetched once more; False for NULL, which is no page."""
    blocked = (status == BLOCKED) & F.lit(rules.retry_blocked and not rules.obey_robots)
    return F.coalesce(blocked | (status.startswith("error:") & F.lit(rules.retry_errors)), F.lit(False))


def decisions(candidates: DataFrame, pages: DataFrame, memory: DataFrame, rules: AdmissionRules = AdmissionRules()) -> DataFrame:
    """``candidates`` with ``decision``: 'visited', 'source_full', 'source_weak' or 'admitted'.

    candidates: ``url`` and ``source_key`` beside other columns; pages: ``url,
    page_status`` (unique); memory: ``source_key, visits, score`` (unique). A
    source without memory has no visits and the initial score, and so has the
    NULL source. A page that may be visited again is admitted whatever its
    source. NULL addresses are left out.
    """
    known = memory.select("source_key", F.col("visits").alias("_visits"), F.col("score").alias("_score"))
    rows = candidates.filter("url is not null").join(pages.select("url", "page_status"), "url", "left").join(known, "source_key", "left")
    again = revisitable(F.col("page_status"), rules)
    decision = (
        F.when(again, "admitted")
        .when(F.col("page_status").isNotNull(), "visited")
        .when(F.coalesce("_visits", F.lit(0)) >= rules.visits_per_source, "source_full")
        .when(F.coalesce("_score", F.lit(rules.initial_score)) <= rules.least_score, "source_weak")
        .otherwise("admitted")
    )
    return rows.withColumn("decision", decision).drop("_visits", "_score", "page_status")


def admit(queue: DataFrame, admitted: DataFrame, order: list[str]) -> DataFrame:
    """The queue after a batch of admitted candidates.

    queue: ``url`` (unique) and the fields of an entry; admitted: ``url`` and
    the same fields but status, ``queued_at`` being the time of the candidate,
    and the columns ``order`` that tell their turn. An entry still queued keeps
    parent, source and time of queueing, takes the highest priority, the least
    depth, the last reason and the last time; an entry in any other state is
    queued anew with the fields of the first candidate, which the later ones
    then meet as queued. Entries without candidates stay as they are.
    """
    turn = F.struct(*order)
    first = F.struct(*[c for c in FIELDS if c not in ("status", "updated_at")])
    came = admitted.groupBy("url").agg(F.min_by(first, turn).alias("_first"), F.max("priority").alias("_priority"), F.min("depth").alias("_depth"), F.max_by("reason", turn).alias("_reason"), F.max("queued_at").alias("_at"))
    both = queue.select("url", F.struct(*FIELDS).alias("_old")).join(came, "url", "full")
    waits = F.coalesce(F.col("_old.status") == QUEUED, F.lit(False))
    kept = lambda c: F.when(waits, F.col(f"_old.{c}")).otherwise(F.col(f"_first.{c}"))
    new = {
        "depth": F.when(waits, F.least("_old.depth", "_depth")).otherwise(F.col("_depth")),
        "priority": F.when(waits, F.greatest("_old.priority", "_priority")).otherwise(F.col("_priority")),
        "discovered_from": kept("discovered_from"), "reason": F.col("_reason"), "source_key": kept("source_key"), "status": F.lit(QUEUED), "queued_at": kept("queued_at"), "updated_at": F.col("_at"),
    }
    return both.select("url", *[F.when(F.col("_first").isNull(), F.col(f"_old.{c}")).otherwise(new[c]).alias(c) for c in FIELDS])


def popped(queue: DataFrame, n: int, key: str = "url") -> DataFrame:
    """The next ``n`` queued entries: highest priority (NULL last), then longest waiting, then smallest key."""
    return ranked(queue.filter(F.col("status") == QUEUED), [F.desc_nulls_last("priority"), F.asc("queued_at"), F.asc(key)], n)


def marked(queue: DataFrame, transitions: DataFrame, key: str = "url") -> DataFrame:
    """The queue with the states of ``transitions`` (``key`` unique, ``status``, ``at``); entries without one stay as they are."""
    to = transitions.select(key, F.col("status").alias("_status"), F.col("at").alias("_at"))
    changed = queue.join(to, key, "left").withColumns({"status": F.coalesce("_status", "status"), "updated_at": F.when(F.col("_status").isNotNull(), F.col("_at")).otherwise(F.col("updated_at"))})
    return changed.select(*queue.columns)


def pop_and_mark(queue: DataFrame, n: int, at: Column, key: str = "url") -> DataFrame:
    """The queue after its next ``n`` entries have become active."""
    return marked(queue, popped(queue, n, key).select(key, F.lit(ACTIVE).alias("status"), at.alias("at")), key)


def waiting(queue: DataFrame) -> DataFrame:
    """The queue without its history."""
    return queue.filter(F.col("status") == QUEUED)


def entries(log: DataFrame, order: list[str]) -> DataFrame:
    """The state of every address from a log of entries: the last one."""
    return last_write(log.filter("url is not null").select("url", *FIELDS, *[c for c in order if c not in FIELDS]), "url", F.struct(*order)).select("url", *FIELDS)
