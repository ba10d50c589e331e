import collections
import random
import time

import pandas as pd

from larkspur.operators import metrics, schedule


def pack(requests, nodes):
    r = pd.DataFrame(requests, columns=["task", "min_cpu", "max_cpu", "memory", "scratch", "gpu"])
    n = pd.DataFrame(nodes, columns=["node", "cpu", "memory", "scratch", "gpu"])
    return {t: None if x != x else x for t, x in schedule.pack_requests(r, n).itertuples(index=False)}


def test_big_request_does_not_block_small_one():
    big, small = (1, 1, 1, 64000, 0, 8), (2, 1, 1, 8000, 0, 0)
    for order in ([big, small], [small, big]):
        assert pack(order, [(1, 16, 64000, 0, 8)]) == {1: 1, 2: None}


def test_each_request_gets_the_node_that_fits():
    assert pack([(1, 8, 8, 1000, 0, 0), (2, 1, 1, 64000, 0, 0)], [(1, 16, 64000, 0, 0), (2, 8, 1000, 0, 0)]) == {2: 1, 1: 2}


def test_simple_cases():
    assert pack([(1, 2, 2, 1000, 0, 0)], [(1, 4, 2000, 0, 0)]) == {1: 1}
    assert pack([(1, 8, 8, 4000, 0, 0)], [(1, 2, 1000, 0, 0)]) == {1: None}
    assert pack([(1, 1, 1, 500, 0, 0)], [(1, 2, 1000, 0, 0)]) == {1: 1}


def one_by_one(requests, nodes):
    """The placement by its rule: each request looks at all nodes."""
    free, placed = [[n[4], *n[1:4], n[0]] for n in nodes], {}
    for task, low, high, memory, scratch, gpu in sorted(requests, key=lambda r: (-r[5], -r[1], -r[3], -r[4], r[0])):
        best = min((f for f in free if f[0] >= gpu and f[1] >= low and f[2] >= memory and f[3] >= scratch), default=None)
        placed[task] = None if best is None else best[4]
        if best is not None:
            best[:4] = best[0] - gpu, max(0, best[1] - high), best[2] - memory, best[3] - scratch
    return placed


def drawn(seed, least=0):
    """Up to 60 requests and 12 nodes; with a least below 0 some requests give something back."""
    draw = random.Random(seed)
    number = lambda most: draw.randint(least, most)
    requests = [(task, number(4), number(6), number(4), number(2), number(2)) for task in draw.sample(range(1000), draw.randint(1, 60))]
    return requests, [(node, draw.randint(0, 12), draw.randint(0, 12), draw.randint(0, 4), draw.randint(0, 3)) for node in range(draw.randint(1, 12))]


def test_packing_follows_its_rule(spark):
    for seed in range(60):
        requests, nodes = drawn(seed, -1 if seed % 3 == 0 else 0)
        assert pack(requests, nodes) == one_by_one(requests, nodes)
    pools = {p: drawn(100 + p) for p in range(6)}
    r = spark.createDataFrame([(p, *x) for p, (a, _) in pools.items() for x in a], "pool long, task long, min_cpu int, max_cpu int, memory int, scratch int, gpu int")
    n = spark.createDataFrame([(p, *x) for p, (_, b) in pools.items() for x in b if p < 5], "pool long, node long, cpu int, memory int, scratch int, gpu int")
    got = {(x.pool, x.task): x.node for x in schedule.pack(r, n, "pool").collect()}
    assert got == {(p, t): x for p, (a, b) in pools.items() for t, x in one_by_one(a, b if p < 5 else []).items()}


def test_requests_that_do_not_say_what_they_need_fit_nothing():
    assert pack([(1, 2, None, 10, 0, 0), (2, None, 1, 10, 0, 0), (3, 1, 1, 10, 0, 0)], [(1, 4, 100, 0, 0), (2, 9, 100, 0, 0)]) == {1: 1, 2: None, 3: 2}


def test_packing_does_not_look_at_all_nodes_for_each_request():
    requests = [(i, 1 + i % 8, 1 + i % 8, 1 + i % 4, 0, 0) for i in range(20000)]
    began = time.time()
    assert len(pack(requests, [(i, 16, 8, 0, 0) for i in range(5000)])) == 20000
    assert time.time() - began < 5


def test_plan_follows_the_rule_of_packing():
    for seed in range(60):
        requests, nodes = drawn(seed)
        requests = [(i, *r[1:]) for i, r in enumerate(sorted(requests, key=lambda r: r[2]))]  # of one need, the least max_cpu comes first
        shapes = collections.Counter((r[5], *r[1:5]) for r in requests)
        left = collections.Counter((r[5], *r[1:5]) for r in requests if one_by_one(requests, nodes)[r[0]] is None)
        counted = pd.DataFrame([(*s, n) for s, n in shapes.items()], columns=[*schedule.SHAPE, "n"])
        placed = schedule.place_shapes(counted, pd.DataFrame(nodes, columns=["node", "cpu", "memory", "scratch", "gpu"]))
        assert placed == [n - left[s] for s, n in shapes.items()]


def test_plan_does_not_look_at_all_nodes_for_each_request():
    shapes = pd.DataFrame([(0, 1 + i, 1 + i, 1, 0, 4000) for i in range(8)], columns=[*schedule.SHAPE, "n"])
    nodes = pd.DataFrame([(i, 16, 8, 0, 0) for i in range(5000)], columns=["node", "cpu", "memory", "scratch", "gpu"])
    began = time.time()
    assert sum(schedule.place_shapes(shapes, nodes)) > 10000
    assert time.time() - began < 5


def test_free_capacity(spark):
    nodes = spark.createDataFrame([("a", 4, 2000), ("b", 4, 2000)], "node string, cpu int, memory int")
    launchers = spark.createDataFrame([("l1", "a"), ("l2", None)], "launcher string, node string")
    scheduled = spark.createDataFrame([("l1", 2, 1000), ("l2", 3, 1500)], "launcher string, cpu int, memory int")
    got = {tuple(r) for r in schedule.free_capacity(nodes, launchers, scheduled).collect()}
    assert got == {("a", 2, 1000), ("b", 4, 2000)}


def test_routing(spark):
    def route(ask, queues, types):
        q = spark.createDataFrame(queues, "queue string, spot boolean, most int, used int")
        t = spark.createDataFrame(types, "queue string, vcpus int, memory int, gpus int")
        a = spark.createDataFrame([("x", *ask)], "ask string, cpu int, memory int, gpu int")
        return [r.queue for r in schedule.route_queue(a, q, t).collect()]

    od, spot = ("od", False, 100, 0), ("spot", True, 100, 0)
    types = [("od", 8, 8000, 0), ("spot", 8, 8000, 0)]
    assert route((4, 1000, 0), [], []) == []
    assert route((16, 1000, 0), [od, spot], types) == []
    assert route((4, 1000, 0), [od, spot], types) == ["od"]
    assert route((4, 1000, 0), [("od", False, 100, 98), spot], types) == ["spot"]
    assert route((4, 1000, 0), [("od", False, 100, 98)], types[:1]) == ["od"]
    two = [("small", False, 100, 0), ("big", False, 100, 0)]
    assert route((2, 1000, 0), two, [("small", 4, 8000, 0), ("big", 64, 8000, 0)]) == ["small"]
    assert route((2, 1000, 1), [od, ("gpu-spot-small", True, 9, 0)], [("od", 64, 8000, 4), ("gpu-spot-small", 8, 8000, 1)]) == ["gpu-spot-small"]
    assert route((2, 1000, 0), [("known", False, 100, 0), ("unknown", False, 100, 0)], [("known", 8, 8000, 0)]) == ["known"]
    assert route((2, 1000, 0), [("unknown", False, 100, 0)], []) == ["unknown"]


def test_caps():
    assert metrics.caps(47)[0] == 1
    assert metrics.caps(50)[1] == 1
    assert schedule.allowed_nodes(5, 10, 5, 2, 1, 4) == 3


def test_histogram(spark):
    df = spark.createDataFrame([(5.0,), (30.0,)], "s double")
    got = {tuple(r) for r in metrics.histogram(df, "s", metrics.DURATION_BOUNDS).collect()}
    assert got == {("10", 1, 5.0), ("60", 1, 30.0)}


def test_cardinality_cap(spark):
    df = spark.createDataFrame([("A", 1, 1), ("B", 2, 1), ("third", 3, 1)], "k string, first int, n int")
    assert {tuple(r) for r in metrics.capped(df, "k", "first", 1).collect()} == {("A", 1), ("_other", 2)}


def test_queue_waits(spark):
    df = spark.createDataFrame([("k", 1, "Enqueued", 10), ("k", 2, "Enqueued", 14), ("k", 3, "TaskScheduled", 20), ("x", 1, "TaskScheduled", 5)], "key string, seq int, kind string, moment int")
    assert [tuple(r) for r in metrics.queue_waits(df).collect()] == [("k", 3, 6)]


def test_round_robin(spark):
    rows = [(1, 1, 1, 10), (1, 2, 1, 10), (1, 3, 1, 10), (1, 4, 9, 10), (2, 1, 1, 10)]
    df = spark.createDataFrame(rows, "pool long, task long, cpu int, memory int")
    got = {(r.pool, r.task): r.host for r in schedule.round_robin(df, [("a", 2, 100), ("b", 4, 100)]).collect()}
    assert got == {(1, 1): "a", (1, 2): "b", (1, 3): "a", (1, 4): None, (2, 1): "a"}


def test_plan_counts_what_packing_leaves(spark):
    import larkspur.plans.queries as q

    sf = "/root/testdata/sf0.001"
    left = q.QUERIES["best_fit_packing"](spark, sf).where("node is null").count()
    plan = q.QUERIES["scale_out_plan"](spark, sf).collect()
    assert sum(r.n for r in plan) == left > 0
