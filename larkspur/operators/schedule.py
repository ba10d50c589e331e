"""Scheduling queries over relations of submissions, nodes and allocations."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.resources import Request, Supply, can_fulfill


def fits(submissions: DataFrame, nodes: DataFrame, selector: Column | None = None) -> DataFrame:
    """(shape columns, n_tasks, node): which node can take which request.

    Requests are grouped by shape first, so the inequality join pairs distinct shapes with nodes, not submissions with nodes.
    """
    shape = ["min_cpu", "memory", "scratch", "gpu", "image"]
    shapes = submissions.groupBy(*shape).agg(F.count("*").alias("n_tasks"))
    right = nodes.select("node", *(F.col(c).alias(f"node_{c}") for c in ("cpu", "memory", "scratch", "gpu", "image", "labels")))
    request = Request(F.col("min_cpu"), F.col("min_cpu"), F.col("memory"), F.col("scratch"), F.col("gpu"), F.col("image"))
    ok = can_fulfill(Supply.of("node_"), request)
    return shapes.join(right, ok if selector is None else ok & selector).select(*shape, "n_tasks", "node")


def free_capacity(nodes: DataFrame, launchers: DataFrame, scheduled: DataFrame) -> DataFrame:
    """(node, free_cpu, free_memory): idle nodes keep all; submissions of launchers without a node deduct nothing."""
    used = scheduled.join(launchers.where("node is not null"), "launcher").groupBy("node").agg(F.sum("cpu").alias("used_cpu"), F.sum("memory").alias("used_memory"))
    left = lambda c: (F.col(c) - F.coalesce(F.col(f"used_{c}"), F.lit(0))).alias(f"free_{c}")
    return nodes.join(used, "node", "left").select("node", left("cpu"), left("memory"))


def free_supply(nodes: DataFrame, launchers: DataFrame, allocated: DataFrame) -> DataFrame:
    """(node, cpu, memory, scratch, gpu): what nodes have left of every resource.

    allocated: (launcher, cpu, memory, scratch, gpu array). Grants of launchers without a node deduct nothing; a gpu is held or not,
    however many grants name it.
    """
    held = allocated.join(launchers.where("node is not null"), "launcher")
    sums = [F.sum(c).alias(f"used_{c}") for c in ("cpu", "memory", "scratch")]
    used = held.groupBy("node").agg(*sums, F.array_distinct(F.flatten(F.collect_set("gpu"))).alias("used_gpu"))
    left = lambda c: (F.col(c) - F.coalesce(F.col(f"used_{c}"), F.lit(0))).cast("long").alias(c)
    gpu = F.array_except("gpu", F.coalesce("used_gpu", F.array().cast("array<int>"))).alias("gpu")
    return nodes.join(used, "node", "left").select("node", left("cpu"), left("memory"), left("scratch"), gpu)


def not_blocked(queued: DataFrame, scheduled: DataFrame, key: str = "key", lineage: str = "lineage") -> DataFrame:
    """Queued submissions that are no ancestor of a queued or scheduled one."""
    ancestors = queued.select(F.explode(lineage).alias(key)).union(scheduled.select(F.explode(lineage).alias(key))).distinct()
    return queued.join(ancestors, key, "left_anti")


def ask_for_work(queued: DataFrame, supply: Supply, code_version: str | None = None) -> DataFrame:
    """The one task a launcher gets: of those that fit, highest priority, then deepest lineage, then least key."""
    request = Request.of()
    ok = can_fulfill(supply, request)
    if code_version is not None:
        ok &= F.col("code_version") == code_version
    return queued.where(ok).orderBy(F.desc("priority"), F.desc("depth"), "key").limit(1)


def first_match(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(order))).where("_r = 1").drop("_r")


def unmet_demand(wanted: DataFrame, granted: DataFrame, shape: list[str]) -> DataFrame:
    """(shape, n): how many requests of each shape are not granted yet; shapes with none left are dropped."""
    w = wanted.groupBy(*shape).agg(F.count("*").alias("w"))
    g = granted.groupBy(*shape).agg(F.count("*").alias("g"))
    left = F.col("w") - F.coalesce(F.col("g"), F.lit(0))
    return w.join(g, shape, "left").select(*shape, left.alias("n")).where("n > 0")


def allowed_nodes(max_nodes: int, max_cumulative: int, max_pending: int, active: int, pending: int, cumulative: int) -> int:
    """How many nodes may be requested now."""
    if pending >= max_pending:
        return 0
    return max(0, min(max_nodes - active, max_cumulative - cumulative))


def may_request(max_nodes: str | Column, max_cumulative: str | Column, max_pending: str | Column, active: str | Column, pending: str | Column, cumulative: str | Column) -> Column:
    """``allowed_nodes`` of columns."""
    caps = [F.col(c) if isinstance(c, str) else c for c in (max_nodes, max_cumulative, max_pending, active, pending, cumulative)]
    room = F.greatest(F.lit(0), F.least(caps[0] - caps[3], caps[1] - caps[5]))
    return F.when(caps[4] >= caps[2], F.lit(0)).otherwise(room)


def still_needed(plan: DataFrame, in_flight: DataFrame, shape: list[str]) -> DataFrame:
    """(shape, n): a plan (shape, n) less the requests (shape) that are under way; shapes with none left are dropped."""
    flying = in_flight.groupBy(*shape).agg(F.count("*").alias("_flying"))
    left = F.col("n") - F.coalesce(F.col("_flying"), F.lit(0))
    return plan.join(flying, shape, "left").select(*shape, left.alias("n")).where("n > 0")


def first_success(attempts: DataFrame, ask: str = "ask") -> DataFrame:
    """(ask, member, error) for attempts (ask, member, position, accepts, error): members are asked in order of position.

    The first that accepts an ask and has no error makes the node. Where each of those fails, the error names them all in order; where
    none accepts, it says so. Attempts after the first success do not count.
    """
    wanted = F.when(F.col("accepts"), F.struct("position", "member", "error"))
    made = F.min(F.when(F.col("accepts") & F.col("error").isNull(), F.struct("position", "member")))
    tried = F.transform(F.array_sort(F.collect_list(wanted)), lambda x: F.concat(x["member"], F.lit(": "), x["error"]))
    by = attempts.groupBy(ask).agg(made.alias("made"), tried.alias("tried"))
    why = F.when(F.size("tried") == 0, "no member accepts the request").otherwise(F.array_join("tried", "; "))
    return by.select(ask, F.col("made.member").alias("member"), F.when(F.col("made").isNull(), why).alias("error"))


def cold_start(queued: DataFrame, plan: DataFrame, workers: DataFrame) -> DataFrame:
    """(shape, n): the plan, or one node for the head of the queue where there is no plan, no worker, but work."""
    shape = [c for c in plan.columns if c != "n"]
    if not plan.isEmpty() or not workers.isEmpty():
        return plan
    head = queued.orderBy(F.desc("priority"), "key").limit(1)
    return head.select(*shape, F.lit(1).cast("long").alias("n"))


class Free:
    """What the nodes (gpu, cpu, memory, scratch, node) of a pool have left, and the best fit of one request after the other.

    A request goes to the least node, in that order of columns, that has its gpu, min_cpu, memory and scratch; it takes its max_cpu, and no node
    falls below 0 cpu. A node that gives is less than before, so while requests need the same it stays the best until it no longer fits
    them: the nodes that fit are looked up and put in order once for each need, by what is left, not once for each request.
    """

    def __init__(self, nodes: Iterable[tuple]) -> None:
        self.left: dict[tuple, list] = {}  # what is left -> a heap of the nodes that have it
        for *state, node in sorted(n for n in nodes if not any(x is None or x != x for x in n[:4])):
            self.left.setdefault(tuple(state), []).append(node)
        self.need: tuple | None = None
        self.order: list[tuple] = []  # states that fit, the best one last
        self.node, self.state = None, None  # the node that gives now

    def place(self, gpu: int, min_cpu: int, max_cpu: int | None, memory: int, scratch: int) -> int | None:
        """The node that takes the request; None where nothing fits, as for a request that does not say what it needs."""
        need = (gpu, min_cpu, memory, scratch)
        if any(x is None or x != x for x in need):
            return None
        if need != self.need:
            self.keep()
            self.need = need
            self.order = sorted((s for s in self.left if s[0] >= gpu and s[1] >= min_cpu and s[2] >= memory and s[3] >= scratch), reverse=True)
        s = self.state
        if s is None or s[0] < gpu or s[1] < min_cpu or s[2] < memory or s[3] < scratch:
            self.keep()
            if not self.order:
                return None
            s = self.order[-1]
            self.node = heapq.heappop(self.left[s])
            if not self.left[s]:
                del self.left[self.order.pop()]
        cpu = 0 if max_cpu is None or max_cpu != max_cpu else max(0, s[1] - max_cpu)
        self.state = (s[0] - gpu, cpu, s[2] - memory, s[3] - scratch)
        if self.state > s:  # a request that gives something back: others may be better now
            self.need = None
        return self.node

    def keep(self) -> None:
        """Put the node that gives back among the others."""
        if self.state is not None:
            heapq.heappush(self.left.setdefault(self.state, []), self.node)
        self.node, self.state = None, None


def pack_requests(requests: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """Best fit, largest first: each request goes to the smallest node that still fits it.

    A request needs its min_cpu to fit and takes its max_cpu (no node falls below 0). Ties go to the smaller id. Returns
    (task, node); node is null where nothing fits.
    """
    free = Free(nodes[["gpu", "cpu", "memory", "scratch", "node"]].itertuples(index=False, name=None))
    order = requests.sort_values(["gpu", "min_cpu", "memory", "scratch", "task"], ascending=[False, False, False, False, True])
    placed = [(r.task, free.place(r.gpu, r.min_cpu, r.max_cpu, r.memory, r.scratch)) for r in order.itertuples()]
    return pd.DataFrame(placed, columns=["task", "node"])


def pack(requests: DataFrame, nodes: DataFrame, pool: str) -> DataFrame:
    """(pool, task, node): ``pack_requests`` in every pool on its own. A pool is what one placement decision sees.

    A pool's nodes and then its requests, largest first, come as a sorted stream; the nodes and a batch are all that a worker holds.
    """
    columns = ["_turn", "task", "gpu", "min_cpu", "max_cpu", "memory", "scratch"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, free = None, [], Free([])
        for batch in batches:
            pools, tasks, placed = [], [], []
            for key, turn, task, gpu, min_cpu, max_cpu, memory, scratch in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, turn) != now:
                    if turn:
                        free, rows = Free(rows if now == (key, 0) else []), []
                    now = (key, turn)
                if turn:
                    pools.append(key)
                    tasks.append(task)
                    placed.append(free.place(gpu, min_cpu, max_cpu, memory, scratch))
                else:
                    rows.append((gpu, min_cpu, memory, scratch, task))
            yield pa.RecordBatch.from_arrays([pa.array(pools, batch.column(0).type), pa.array(tasks, pa.int64()), pa.array(placed, pa.int64())], [pool, "task", "node"])

    kind = dict(requests.dtypes)[pool]
    have = nodes.select(F.col(pool).cast(kind).alias(pool), F.lit(0), "node", "gpu", "cpu", F.lit(None).cast("long"), "memory", "scratch")
    rows = have.union(requests.select(pool, F.lit(1), *columns[1:])).toDF(pool, *columns)
    order = [pool, "_turn", *(F.desc(c) for c in ("gpu", "min_cpu", "memory", "scratch")), F.asc_nulls_last("task")]
    return rows.repartition(pool).sortWithinPartitions(*order).mapInArrow(run, f"{pool} {kind}, task long, node long")


SHAPE = ("gpu", "min_cpu", "max_cpu", "memory", "scratch")


def place_shapes(shapes: pd.DataFrame, nodes: pd.DataFrame) -> list[int]:
    """How many requests of each row of ``shapes`` (SHAPE and n) find a place, by the rule of ``pack_requests``."""
    free = Free(nodes[["gpu", "cpu", "memory", "scratch", "node"]].itertuples(index=False, name=None))
    placed = dict.fromkeys(shapes.index, 0)
    order = shapes.sort_values(["gpu", "min_cpu", "memory", "scratch", "max_cpu"], ascending=[False, False, False, False, True])
    for r in order.itertuples():
        while placed[r.Index] < r.n and free.place(r.gpu, r.min_cpu, r.max_cpu, r.memory, r.scratch) is not None:
            placed[r.Index] += 1
            if not (r.gpu or r.max_cpu or r.memory or r.scratch):  # takes nothing: all of them fit
                placed[r.Index] = r.n
    return list(placed.values())


def scale_out_plan(requests: DataFrame, nodes: DataFrame, pool: str) -> DataFrame:
    """(pool, SHAPE, n): how many nodes of each shape a pool lacks. Requests are counted by shape first, so a pool's
    placement sees its shapes and nodes, however many requests there are."""
    counts = requests.groupBy(pool, *SHAPE).agg(F.count("*").alias("n"))

    def run(key: tuple, r: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        r["n"] -= place_shapes(r, n)
        return r[r["n"] > 0]

    return counts.groupBy(pool).cogroup(nodes.groupBy(pool)).applyInPandas(run, counts.schema)


def round_robin(requests: DataFrame, hosts: list[tuple[str, int, int]], pool: str = "pool") -> DataFrame:
    """(pool, task, host): the first of a pool's hosts that fits each request, which then goes to the end of the list.

    requests: (pool, task, cpu, memory), walked in order of task in every pool on its own; each pool starts with all
    ``hosts`` (name, cpu, memory). Rows come as a sorted stream, and the host list is the only state.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, []
        for batch in batches:
            out = []
            for r in batch.itertuples():
                if r.pool != now:
                    now, free = r.pool, [list(h) for h in hosts]
                i = next((i for i, h in enumerate(free) if h[1] >= r.cpu and h[2] >= r.memory), None)
                if i is not None:
                    h = free.pop(i)
                    h[1] -= r.cpu
                    h[2] -= r.memory
                    free.append(h)
                out.append((r.pool, r.task, None if i is None else free[-1][0]))
            yield pd.DataFrame(out, columns=["pool", "task", "host"])

    cols = requests.select(F.col(pool).cast("long").alias("pool"), "task", "cpu", "memory")
    return cols.repartition("pool").sortWithinPartitions("pool", "task").mapInPandas(run, "pool long, task long, host string")


def route_queue(asks: DataFrame, queues: DataFrame, instances: DataFrame) -> DataFrame:
    """(ask, queue): where each ask (ask, cpu, memory, gpu) goes, if anywhere.

    queues: (queue, spot, most, used) in vcpus; instances: (queue, vcpus, memory, gpus), the types a queue can start. A queue
    fits if one of its types does, or if none is known. An ask without gpus goes to on-demand queues while those
    together have room for it and to spot queues otherwise; if no queue of that kind fits, to the other kind. Then the
    queue with the smallest largest type wins (unknown counts as largest), then the least name.
    """
    need = asks.select("cpu", "memory", "gpu").distinct()
    largest = instances.groupBy("queue").agg(F.max("vcpus").alias("size"))
    all_queues = queues.select("queue", "spot").join(largest, "queue", "left").withColumn("size", F.coalesce("size", F.lit((1 << 31) - 1)))
    fit = (F.col("vcpus") >= F.col("cpu")) & (F.col("i.memory") >= F.col("n.memory")) & (F.col("gpus") >= F.col("gpu"))
    known = need.alias("n").join(instances.alias("i"), fit).select("cpu", "n.memory", "gpu", "queue").distinct()
    unknown = queues.select("queue").join(instances.select("queue"), "queue", "left_anti")
    anything = need.select("*", F.explode(F.array(*(F.lit(r[0]) for r in unknown.collect())).cast("array<string>")).alias("queue"))
    room = queues.where("not spot").agg(F.coalesce(F.sum("most"), F.lit(0)).alias("most"), F.coalesce(F.sum("used"), F.lit(0)).alias("used"), F.count("*").alias("n")).first()
    has_room = F.lit(room.n > 0) & (F.lit(room.used) + F.col("cpu") <= room.most)
    rank = F.struct(F.when((F.col("gpu") > 0) | (F.col("spot") != has_room), 0).otherwise(1).alias("a"), F.col("size").alias("b"), F.col("queue").alias("c"))
    shape = known.union(anything).join(all_queues, "queue").groupBy("cpu", "memory", "gpu").agg(F.min_by("queue", rank).alias("queue"))
    return asks.join(shape, ["cpu", "memory", "gpu"]).select("ask", "queue")


def screen_targets(asks: DataFrame, targets: DataFrame) -> DataFrame:
    """(ask, target): the first target in listed order that fits an ask and has room; external ones come first."""
    ok = (F.col("max_cpu") >= F.col("cpu")) & (F.col("max_memory") >= F.col("memory")) & (F.col("room") > 0)
    rank = F.struct((~F.col("external")).cast("int").alias("a"), F.col("position").alias("b"))
    return asks.join(targets, ok).groupBy("ask").agg(F.min_by("target", rank).alias("target"))


def largest_instance(instances: DataFrame, queue: str = "queue") -> DataFrame:
    """(queue, cpu, memory, gpu): the largest of each component over a queue's instance types."""
    return instances.groupBy(queue).agg(F.max("cpu").alias("cpu"), F.max("memory").alias("memory"), F.max("gpu").alias("gpu"))
