"""Rendezvous: all ranks of a group meet and get each other's payloads in order of rank."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class RendezvousError(ValueError):
    """A group is not well formed."""


def invalid(joins: DataFrame) -> DataFrame:
    """(group, reason) for joins (group, rank, world_size, payload): joins that can never complete."""
    checks = joins.groupBy("group").agg(
        F.min("world_size").alias("low"), F.max("world_size").alias("high"), F.min("rank").alias("first"), F.max("rank").alias("last")
    )
    twice = joins.groupBy("group", "rank").agg(F.count_distinct("payload").alias("n")).where("n > 1").groupBy("group").agg(F.min("rank").alias("twice"))
    both = checks.join(twice, "group", "left")
    reason = (
        F.when(F.col("low") <= 0, "worldSize not positive")
        .when(F.col("low") != F.col("high"), "worldSize mismatch")
        .when((F.col("first") < 0) | (F.col("last") >= F.col("low")), "rank out of range")
        .when(F.col("twice").isNotNull(), F.concat(F.lit("duplicate rank "), F.col("twice").cast("string"), F.lit(" in group "), F.col("group").cast("string")))
    )
    return both.select("group", reason.alias("reason")).where("reason is not null")


def gathered(joins: DataFrame) -> DataFrame:
    """(group, peers): payloads in order of rank of each complete group; joining twice with one payload is one join."""
    once = joins.select("group", "rank", "world_size", "payload").distinct()
    peers = F.transform(F.array_sort(F.collect_list(F.struct("rank", "payload"))), lambda x: x["payload"])
    out = once.groupBy("group").agg(peers.alias("peers"), F.max("world_size").alias("world_size"))
    return out.where(F.size("peers") == F.col("world_size")).select("group", "peers")


def all_gather(spark: SparkSession, payloads: list[str]) -> list[list[str]]:
    """Run one task per rank as a barrier stage; each returns all payloads in order of rank.

    The cluster must have a free slot for every rank.
    """
    n = len(payloads)
    if n < 1:
        raise RendezvousError("world size not positive")
    if spark.sparkContext.defaultParallelism < n:
        raise RendezvousError(f"{n} ranks need {n} slots at a time; there are {spark.sparkContext.defaultParallelism}")

    def rank(items: Iterator[str]) -> Iterator[list[str]]:
        yield BarrierTaskContext.get().allGather(next(iter(items)))

    return spark.sparkContext.parallelize(payloads, n).barrier().mapPartitions(rank).collect()
