"""Documents in containers of each window's capacity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.packing import pack, pack_report
from trellium.llm.tokens import token_count
from trellium.plans.tables import table
from trellium.session import spread


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "context_windows").select("window_id", F.col("capacity_tokens").alias("capacity"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    items = spread(table(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), token_count(F.col("text")).alias("size"))
    return pack(items, _windows(spark, d))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).select("window_id", "container", F.col("id").alias("doc_id"), "piece", F.col("start").alias("token_start"), F.col("size").alias("n_tokens"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return pack_report(_packed(spark, d), _windows(spark, d))


def p8_documents(spark: SparkSession, d: str) -> DataFrame:
    """Each document of each window, whether its pieces follow each other without gap or overlap, and whether it is split without need."""
    caps = F.broadcast(_windows(spark, d))
    pieces = F.array_sort(F.collect_list(F.struct("start", F.col("size").alias("n"))))
    docs = _packed(spark, d).groupBy("window_id", "id").agg(pieces.alias("p"), F.sum("size").alias("size")).join(caps, "window_id")  # a document's own pieces
    follow = F.aggregate("p", F.lit(0).cast("bigint"), lambda at, x: F.when(at == x["start"], at + x["n"]).otherwise(F.lit(-1).cast("bigint")))
    return docs.select("window_id", F.col("id").alias("doc_id"), (follow == F.col("size")).alias("complete"), ((F.size("p") > 1) & (F.col("size") <= F.col("capacity"))).alias("split_in_vain"))


def p8_overfull(spark: SparkSession, d: str) -> DataFrame:
    """Containers of each window beyond its capacity: none."""
    loads = _packed(spark, d).groupBy("window_id", "container").agg(F.sum("size").alias("load")).join(F.broadcast(_windows(spark, d)), "window_id")
    return loads.groupBy("window_id").agg(F.count_if(F.col("load") > F.col("capacity")).alias("n_overfull"))


def queries():
    return {"p8_containers": p8_containers, "p8_report": p8_report, "p8_documents": p8_documents, "p8_overfull": p8_overfull}


def sql():
    return {
        "p8_documents": "SELECT window_id, doc_id, true AS complete, false AS split_in_vain FROM documents, context_windows",
        "p8_overfull": "SELECT window_id, CAST(0 AS BIGINT) AS n_overfull FROM context_windows",
    }
