"""Source memory kept up to date from a stream of page events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from trellium.operators.memory import MemoryRules, source_memory_fold
from trellium.sources.store import Store

EVENTS = "source_key string, ts timestamp, id bigint, status string, jobs bigint, high_fit bigint, quality bigint"
MEMORY = "source_key string, score double, visits bigint, jobs_found bigint, high_fit_jobs bigint, errors bigint, blocked bigint, no_job_streak bigint, last_quality bigint"
TABLE = "source_memory"


def follow_events(spark: SparkSession, landing: str, store: Store, checkpoint: str, rules: MemoryRules = MemoryRules(), files_per_batch: int = 100) -> StreamingQuery:
    """Fold every landed file of events into the stored memory; ends when none is left.

    Within a micro-batch events go by (ts, id); later batches follow earlier
    ones, whatever their times. A batch is one generation of the table named
    after it, so a batch that is run again changes nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        last = store.generation(TABLE)
        if last is not None and last >= number:
            return
        before = store.read(TABLE, MEMORY)
        store.swap(TABLE, source_memory_fold(batch, rules, start=before), number)

    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    return events.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
