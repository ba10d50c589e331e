"""Recursive plans: closures over edges, and recursion whose subproblems are each solved once."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.operators import memo
from larkspur.sources.shared import materialize, new_path


def closure(edges: DataFrame, child: str = "child", parent: str = "parent", most: int = 1 << 20) -> DataFrame:
    """(child, parent, depth): every ancestor of every node, at its least depth.

    Paths double in each round: a shortest path of more than L and up to 2 L steps is one of exactly L steps and one of at
    most L. A round writes the pairs it finds and no others again. Cycles end by themselves, since only new pairs go on. A
    path of more than ``most`` steps is an error, not a shorter answer. Where no node has two parents or is its own ancestor,
    ``forest`` finds the same pairs with less.
    """
    first = edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"), F.lit(1).alias("depth")).where("child is not null and parent is not null")
    ends = materialize(first.groupBy("child").agg(F.min("parent").alias("parent"), F.max("parent").alias("_last")), "closure")
    if ends.where(~F.col("parent").eqNullSafe(F.col("_last"))).isEmpty():
        found = forest(ends.select("child", "parent"), most)
        if found is not None:
            return found
    known = [materialize(first.distinct(), "closure")]
    length = 1
    while True:
        every = functools.reduce(DataFrame.union, known)
        far = known[-1].where(F.col("depth") == length).alias("a").join(every.alias("b"), F.col("a.parent") == F.col("b.child"))
        longer = far.select(F.col("a.child").alias("child"), F.col("b.parent").alias("parent"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        new = longer.groupBy("child", "parent").agg(F.min("depth").alias("depth")).join(every.select("child", "parent"), ["child", "parent"], "left_anti")
        new = materialize(new, "closure")
        if new.isEmpty():
            return every
        if length >= most:
            raise ValueError(f"a path of more than {most} steps")
        known.append(new)
        length *= 2


def forest(step: DataFrame, most: int) -> DataFrame | None:
    """``closure`` of a table (child, parent) in which each child is once; None where a node is its own ancestor.

    A pair then has one path, so nothing found has to be compared with what is known. A round of length L keeps the L-th ancestor of every node
    and all ancestors, up to L steps, of those nodes that are an L-th ancestor: the pairs of more than L and up to 2 L steps are the join
    of the two. They are only joined when the result is read; what is written is a row for each node and round, and the kept ancestors,
    of ever fewer nodes where paths meet.
    """
    length, jump = 1, step
    near = step.withColumn("depth", F.lit(1))
    pairs = [near]
    while True:
        ends = jump.select(F.col("parent").alias("child")).distinct()
        kept = near.join(materialize(ends, "forest-ends"), "child", "left_semi")
        if length > 1:  # near has up to half of length
            half = kept.where(F.col("depth") == length // 2).select("child", F.col("parent").alias("_via"))
            upper = near.select(F.col("child").alias("_via"), "parent", (F.col("depth") + length // 2).alias("depth"))
            kept = kept.union(half.join(upper, "_via").select("child", "parent", "depth"))
        near = materialize(kept, "forest-near")
        if near.isEmpty():
            return functools.reduce(DataFrame.union, pairs)
        if not near.where("child = parent").isEmpty():
            return None
        if length >= most:
            raise ValueError(f"a path of more than {most} steps")
        above = near.select(F.col("child").alias("_via"), F.col("parent").alias("_above"), "depth")
        far = jump.select("child", F.col("parent").alias("_via")).join(above, "_via")
        pairs.append(far.select("child", F.col("_above").alias("parent"), (F.col("depth") + length).alias("depth")))
        jump = materialize(far.where(F.col("depth") == length).select("child", F.col("_above").alias("parent")), "forest-jump")
        length *= 2


def solve(roots: DataFrame, needs: Callable[[DataFrame], DataFrame], key: str = "n") -> DataFrame:
    """(key, level): all subproblems that roots need, each once, found level by level.

    ``needs`` maps (key) rows to the (key) rows they need. The highest level comes first in an evaluation from
    the leaves up.
    """
    seen = materialize(roots.select(key).distinct().withColumn("level", F.lit(0)), "solve")
    front, level = seen.select(key), 0
    while True:
        level += 1
        new = needs(front).select(key).distinct().join(seen.select(key), key, "left_anti").withColumn("level", F.lit(level))
        new = materialize(new, "solve-front")
        if new.isEmpty():
            return seen
        seen = materialize(seen.union(new), "solve")
        front = new.select(key)


def evaluate(t: memo.Task, roots: DataFrame, needs: Callable[[DataFrame], DataFrame], store: memo.Store, key: str = "n") -> DataFrame:
    """(key, value) of the roots and of all they need, each run once, from the leaves up.

    ``needs`` maps (key) rows to (key, need) rows. The body of ``t`` gets the key and ``inputs``, the array of (need, value) of what it
    needs, in order of need; it has the key as its only key column, so results of earlier runs are hits. A round submits all keys whose
    needs are known; there are as many rounds as the longest chain of needs has steps. Keys that need each other are an error,
    and so is a failing row.
    """
    spark = roots.sparkSession
    edges = lambda rows: needs(rows.select(key)).select(key, F.col("need")).distinct()
    every = materialize(solve(roots, lambda f: edges(f).select(F.col("need").alias(key)), key).select(key), "needs")
    every = materialize(every.withColumn(memo.KEY, t.key(every.schema)), "needs")
    open_edges = materialize(edges(every), "needs")
    kind = T.StructType([every.schema[key], T.StructField("value", t.out)])
    none = F.array().cast(T.ArrayType(T.StructType([T.StructField("need", every.schema[key].dataType), T.StructField("value", t.out)])))
    folder, total, n, turn = new_path(spark, "evaluated"), every.count(), 0, 0
    known = memo.decoded(store.table(t), t.out).dropDuplicates(["key"])
    every.join(known, every[memo.KEY] == known["key"]).select(every[key], "value").write.parquet(f"{folder}/turn=0")
    while True:
        done = spark.read.schema(T.StructType([*kind.fields, T.StructField("turn", T.IntegerType())])).parquet(folder)
        here = done.where(F.col("turn") == turn).count()
        n += here
        if n == total:
            return done.select(key, "value")
        if turn and not here:
            raise ValueError("some keys need each other")
        turn += 1
        waiting = open_edges.join(done.select(F.col(key).alias("need")), "need", "left_anti").select(key)
        ready = every.join(waiting.union(done.select(key)), key, "left_anti")
        found = open_edges.join(done.select(F.col(key).alias("need"), "value"), "need")
        inputs = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("need", "value"))).alias("inputs"))
        rows = ready.join(inputs, key, "left").withColumn("inputs", F.coalesce("inputs", none))
        good, bad = memo.executed(t, rows, store)
        failed = bad.join(every.withColumnRenamed(memo.KEY, "key"), "key").select(key, "error").first()
        if failed:
            raise RuntimeError(f"{t.name} failed for {failed[key]}: {failed.error}")
        results = good.select(F.col("key").alias(memo.KEY), F.from_json("result", t.out).alias("value"))
        every.join(results, memo.KEY).select(key, "value").write.parquet(f"{folder}/turn={turn}")
