"""Mixture of sources to target shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellium.llm.mixing import mix
from trellium.llm.tokens import token_count
from trellium.plans.tables import table
from trellium.session import spread


#: Share of all tokens of the target sources that the second mixture aims at: more than its scarce sources can serve.
TOTAL = 0.8


def _mixed(spark: SparkSession, d: str, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets").select("source", F.col("target_share").alias("share"), F.col("max_repeats").alias("repeats"))
    docs = spread(table(spark, d, "documents").select("doc_id", "source", "text")).join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    return mix(docs.select(F.col("doc_id").alias("id"), "source", token_count(F.col("text")).alias("size")), targets, total)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0].withColumnsRenamed({"id": "doc_id", "size": "n_tokens"})


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p9_total(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of four fifths of all tokens: sources at their most repeats fall short of their share."""
    return _mixed(spark, d, TOTAL)[0].withColumnsRenamed({"id": "doc_id", "size": "n_tokens"})


def p9_total_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d, TOTAL)[1]


def p9_within(spark: SparkSession, d: str) -> DataFrame:
    """Each source of the mixture: whether no document is used beyond its repeats or twice in a pass, and all are its own."""
    caps = F.broadcast(table(spark, d, "mix_targets").select("source", "max_repeats"))
    own = table(spark, d, "documents").select("doc_id", F.col("source").alias("own"))
    uses = _mixed(spark, d)[0].groupBy("source", "id").agg(F.count("*").alias("uses"), F.count_distinct("pass").alias("passes")).join(caps, "source").join(own, F.col("id") == F.col("doc_id"))
    return uses.groupBy("source").agg(F.bool_and((F.col("uses") <= F.col("max_repeats")) & (F.col("uses") == F.col("passes")) & (F.col("own") == F.col("source"))).alias("within"))


def queries():
    return {"p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_total": p9_total, "p9_total_shares": p9_total_shares, "p9_within": p9_within}


def sql():
    return {"p9_within": "SELECT DISTINCT source, true AS within FROM documents JOIN mix_targets USING (source) WHERE text <> '' AND target_share > 0 AND max_repeats > 0"}
