"""Stored tables as generations, exports, seeds and robots rules."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trellium.functions.urls import clean_url, strip


class Store:
    """Tables under one folder, each a row of generations.

    A swap writes the next generation in full and then moves the pointer, so a
    reader or a lost job sees the old one or the new one, never a mixture.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def generation(self, name: str) -> int | None:
        fs, p = self._fs(f"{self.root}/{name}")
        if not fs.exists(p):
            return None
        done = [int(f.getPath().getName()[8:]) for f in fs.listStatus(p) if f.getPath().getName().startswith("current-")]
        return max(done, default=None)

    def read(self, name: str, schema: T.StructType | str | None = None) -> DataFrame:
        g = self.generation(name)
        if g is None:
            if schema is None:
                raise FileNotFoundError(name)
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{name}/g{g}")

    def swap(self, name: str, df: DataFrame, generation: int | None = None) -> int:
        """Write ``df`` as the given or next generation; one that is there already is left alone."""
        last = self.generation(name)
        g = generation if generation is not None else (-1 if last is None else last) + 1
        if last is not None and g <= last:
            return last
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/g{g}")
        fs, p = self._fs(f"{self.root}/{name}/current-{g}")
        fs.create(p, True).close()
        return g


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order; missing strings are '', other missing ones NULL."""
    have = set(df.columns)
    blank = lambda f: F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(None)
    return df.select(*[(F.coalesce(F.col(f.name), F.lit("")) if isinstance(f.dataType, T.StringType) else F.col(f.name) if f.name in have else blank(f)).cast(f.dataType).alias(f.name) if f.name in have else blank(f).cast(f.dataType).alias(f.name) for f in schema])


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned start addresses of a text file, comments and repeats left out, in the order of the file."""
    lines = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
    seeds = lines.filter((strip("value") != "") & ~strip("value").startswith("#")).select("n", clean_url("value").alias("url"))
    return seeds.filter("url is not null").groupBy("url").agg(F.min("n").alias("n")).orderBy("n").select("url")


def export_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def export_jsonl(df: DataFrame, path: str, one_file: bool = False) -> None:
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_events(df: DataFrame, path: str, kind: str, at: Column) -> None:
    """Rows as JSON payloads of one kind, appended to an event log."""
    df.select(F.lit(kind).alias("event_type"), F.to_json(F.struct(*df.columns)).alias("payload_json"), at.alias("at")).write.mode("append").parquet(path)


def robots_allow(url: Column, rules: Column, agent: str = "*", strict: bool = False) -> Column:
    """Whether a robots file lets an address be fetched; without rules (NULL) not ``strict``."""

    @F.pandas_udf("boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from urllib.robotparser import RobotFileParser

        parsed: dict[str, RobotFileParser] = {}
        for urls, texts in batches:
            out = []
            for u, t in zip(urls, texts):
                if t is None or u is None:
                    out.append(not strict)
                    continue
                if t not in parsed:
                    if len(parsed) > 10_000:
                        parsed.clear()
                    parsed[t] = RobotFileParser()
                    parsed[t].parse(t.splitlines())
                out.append(parsed[t].can_fetch(agent, u))
            yield pd.Series(out, dtype=bool)

    return run(url, rules)


def local_path(path: str) -> str:
    return path if "://" in path else "file://" + os.path.abspath(path)
