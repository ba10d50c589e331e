import random

import numpy as np
import pyarrow as pa

from larkspur.llm.batches import slices, whole_groups
from larkspur.llm.components import components, heads


def test_groups_stay_whole():
    r = random.Random(2)
    for _ in range(300):
        keys = sorted(r.choices(range(-5, 5), k=r.randint(0, 40)))
        rows = list(enumerate(keys))
        cuts = sorted(r.choices(range(len(rows) + 1), k=r.randint(0, 8)))
        batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        made = (pa.RecordBatch.from_arrays([pa.array([k for _, k in b], pa.int64()), pa.array([i for i, _ in b], pa.int64())], ["k", "i"]) for b in batches)
        got = list(whole_groups(made))
        assert np.concatenate([g[1] for g in got]).tolist() == list(range(len(rows))) if rows else not got
        ends = [(set(g[0].tolist())) for g in got]
        assert all(not a & b for i, a in enumerate(ends) for b in ends[:i])


def test_slices_by_size():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * n for n in (3, 3, 9, 1, 1)])], ["t"])
    assert [s.num_rows for s in slices(batch, "t", 6)] == [2, 1, 2]


def test_heads_carry_the_least_rank(spark):
    """Ranks that do not follow the order of the keys, equal ranks and null ones."""
    ranks = spark.createDataFrame([(1, 50), (2, 7), (3, 90), (4, 3), (5, 3), (6, None), (7, None), (8, None), (9, 1)], "k long, r long")
    edges = spark.createDataFrame([(1, 2), (2, 3), (4, 4), (5, 1), (6, 7), (8, 9), (3, 2)], "a long, b long")
    got = {x.k: x["head"] for x in heads(edges, ranks, "k", "r").collect()}
    assert got == {1: 3, 2: 3, 3: 3, 5: 3, 6: None, 7: None, 8: 1, 9: 1}


def test_components_of_long_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, (i * 7 + 7) % (7 * n) // 7) for i in range(n)], "a long, b long").selectExpr("a", "(a + 1) % 300 AS b").where("a % 100 < 99")
    got = {r.node: r.component for r in components(edges).collect()}
    assert all(got[i] == i // 100 * 100 for i in range(n))
