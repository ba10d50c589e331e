"""Metrics of the engine's state, each a DataFrame over a relation of submissions, nodes or events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DURATION_BOUNDS = (1, 10, 60, 600, 3600)
WAIT_BOUNDS = (0.1, 1, 10, 60, 600)
OTHER = "_other"


def count_by_task(submissions: DataFrame) -> DataFrame:
    """(task, version, n)."""
    return submissions.groupBy("task", "version").agg(F.count("*").alias("n"))


def outcomes(answers: DataFrame, key: str = "key") -> DataFrame:
    """(outcome, n) over the answers of a submission: how many different keys completed, failed, or were hits."""
    what = F.when(F.col("error").isNotNull(), "failed").when(F.col("from_cache"), "cache_hit").otherwise("completed")
    return answers.select(key, what.alias("outcome")).distinct().groupBy("outcome").agg(F.count("*").alias("n"))


def totals(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Sums of columns (0 over no rows), over all or by group."""
    return rows.groupBy(*(by or [])).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in columns))


def node_totals(nodes: DataFrame) -> DataFrame:
    """(state, n, cpu, memory, scratch, gpu) of running, pending and in-flight nodes."""
    sums = [F.sum(c).cast("long").alias(c) for c in ("cpu", "memory", "scratch")]
    return nodes.groupBy("state").agg(F.count("*").alias("n"), *sums, F.sum(F.size("gpu")).cast("long").alias("gpu"))


def available(running: DataFrame, allocated: DataFrame, columns: list[str]) -> DataFrame:
    """One row: what running nodes have minus what is allocated, in total."""
    plus = running.select(*(F.col(c).cast("long") for c in columns))
    minus = allocated.select(*((-F.col(c)).cast("long").alias(c) for c in columns))
    return totals(plus.union(minus), columns)


def count_by_label(nodes: DataFrame) -> DataFrame:
    """(label, n): a node counts once for each of its labels."""
    return nodes.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def capped(counts: DataFrame, key: str, first_seen: str, cap: int, value: str = "n") -> DataFrame:
    """(key, value): the first ``cap`` keys by first occurrence keep their series, all others add up in ``_other``.

    The cap is of the metric: series are limited, no value is lost. Only one row per key is ranked.
    """
    keep = counts.orderBy(first_seen, key).limit(cap).select(key)
    named = counts.join(keep.withColumn("_kept", F.lit(True)), key, "left")
    label = F.when(F.col("_kept"), F.col(key)).otherwise(F.lit(OTHER))
    return named.groupBy(label.alias(key)).agg(F.sum(value).cast("long").alias(value))


def admitted(before: DataFrame, seen: DataFrame, key: str, first_seen: str, cap: int) -> DataFrame:
    """(key): the keys with series of their own after more were seen (key, first_seen): those admitted before, and new ones in
    order of first occurrence while there is room. A key that was admitted stays, so series of all queries agree."""
    held = before.select(key).distinct()
    room = max(0, cap - held.limit(cap).count())
    new = seen.join(held, key, "left_anti").groupBy(key).agg(F.min(first_seen).alias("_first")).orderBy("_first", key).limit(room)
    return held.union(new.select(key))


def relabelled(counts: DataFrame, names: DataFrame, key: str, value: str = "n") -> DataFrame:
    """(key, value): counts of admitted keys, all others added up in ``_other``."""
    named = counts.join(names.select(key).withColumn("_kept", F.lit(True)), key, "left")
    label = F.when(F.col("_kept"), F.col(key)).otherwise(F.lit(OTHER))
    return named.groupBy(label.alias(key)).agg(F.sum(value).cast("long").alias(value))


def series_caps(max_series: str | Column) -> tuple[Column, Column]:
    """``caps`` of a column."""
    n = F.col(max_series) if isinstance(max_series, str) else max_series
    return F.greatest(F.lit(1), F.floor((n - 6) / 21) - 1), F.greatest(F.lit(1), F.floor(n / 50))


def caps(max_series: int) -> tuple[int, int]:
    """(task series, labels) that fit a budget of series."""
    return max(1, (max_series - 6) // 21 - 1), max(1, max_series // 50)


def bucket(seconds: str | Column, bounds: tuple[float, ...]) -> Column:
    """The upper bound (inclusive) of a value's bucket as text; ``inf`` beyond the last."""
    value = F.col(seconds) if isinstance(seconds, str) else seconds
    out = F.lit("inf")
    for b in reversed(bounds):
        out = F.when(value <= b, f"{b:g}").otherwise(out)
    return out


def histogram(rows: DataFrame, seconds: str, bounds: tuple[float, ...], by: list[str] | None = None) -> DataFrame:
    """(group, le, n, total)."""
    return rows.groupBy(*(by or []), bucket(seconds, bounds).alias("le")).agg(F.count("*").alias("n"), F.sum(seconds).alias("total"))


def queue_waits(events: DataFrame, key: str = "key", order: str = "seq", at: str = "moment") -> DataFrame:
    """(key, seq, wait): from the latest enqueueing to each scheduling of a key; a scheduling without one is dropped."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    since = F.last(F.when(F.col("kind") == "Enqueued", F.col(at)), ignorenulls=True).over(w)
    return events.withColumn("_since", since).where("kind = 'TaskScheduled' and _since is not null").select(key, order, (F.col(at) - F.col("_since")).alias("wait"))
