import math

import numpy as np
import pytest

from larkspur.llm import ann, topk
from larkspur.llm.queries import OP10_SQL, op2_ann, op10_topk
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, rank int, score double, shard long, node int, id long, v string"


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 0.0, 0.0]), (1, [1.0, 0.0, 0.0]), (2, [0.0, 2.0, 0.0]), (3, [0.5, 0.5, 0.0]), (4, None), (5, []), (6, [0.0, 0.0, 0.0]),
        (7, [nan, 1.0, 0.0]), (8, [inf, 0.0, 0.0]), (9, [None, 1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 2.0]), (12, [2.0, 1.0]),
        (None, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (13, [-1.0, 0.0, 1e-30]), (14, [3e38, 0.0, 0.0]), (15, [1e-40, 0.0, 0.0]),
    ]
    return spark.createDataFrame([(i, v, 1, 1.0, 1, 1, 1, "clash") for i, v in vectors], SCHEMA).repartition(3)


def test_topk_equals_sql(spark):
    assert rows(op10_topk(spark, SF).toPandas()) == rows(connect(SF).sql(OP10_SQL).df())


def test_topk_odd_vectors(spark):
    import pyspark.sql.functions as F

    data = odd_vectors(spark).where("vec_id is null or vec_id < 14")
    got = topk.top_inner_products(data, F.col("vec_id") % 2 == 0, k=3, shard=4, block=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert by[0] == [(1, 4096), (10, 4096), (10, 4096)]
    assert by[6][:2] == [(0, 0), (1, 0)]
    assert by[12] == [(11, 64 * 128 + 128 * 64)]
    assert set(by) == {0, 2, 6, 10, 12}
    assert all(v not in (4, 5, 7, 8, 9) for own in by.values() for v, _ in own)
    assert topk.top_inner_products(data.limit(0), F.lit(True)).count() == 0


def test_topk_of_large_components(spark):
    import pyspark.sql.functions as F

    data = spark.createDataFrame([(0, [3e38, 1.0]), (1, [3e38, 0.0]), (2, [1e9, 1e9]), (3, [1e9, 1e9 + 64])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_inner_products(data, F.lit(True), k=2).collect()}
    assert got[0, 1] == (1, (1 << 63) - 1)
    assert got[2, 1][1] == (1 << 63) - 1
    small = spark.createDataFrame([(0, [1e6 + 0.5, 1.0]), (1, [1e6, 3.0]), (2, [1e6, 2.0])], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_inner_products(small, F.lit(True), k=2).collect()}
    assert got[0, 1] == (1, 64_000_032 * 64_000_000 + 64 * 192)
    assert got[1, 2] == (2, 64_000_000**2 + 192 * 128)


def test_topk_blocks_against_all(spark):
    r = np.random.default_rng(2)
    x = np.floor(64 * r.normal(0, 0.3, (500, 8)))
    x[100:200] = x[100]
    ids = r.permutation(500)
    basis = topk.choose_pivots(x[:50], 6)
    got, evaluated = topk.search_block(x[:40], ids[:40], x, ids, topk.pivot_table(x, basis), basis, 20, first=16)
    assert evaluated < 40 * 500
    for i in range(40):
        s = x @ x[i]
        want = sorted((-s[j], ids[j]) for j in range(500) if ids[j] != ids[i])[:20]
        assert [(v, p) for q, v, p in got if q == ids[i]] == [(v, -p) for p, v in want]


def test_topk_bounds_hold():
    """The bound of a pair is never below its inner product and equals it in the span of the pivots."""
    r = np.random.default_rng(5)
    x = np.floor(64 * r.normal(0, 1, (300, 12)) * 10.0 ** r.integers(-1, 6, (300, 1)))
    for pivots in (0, 1, 5, 12):
        basis = topk.choose_pivots(x[:100], pivots)
        assert basis.shape == (12, pivots)
        table = topk.pivot_table(x, basis)
        bound, norm = table @ table.T, np.sqrt((x * x).sum(1))
        assert (bound + 1e-12 * norm * norm[:, None] >= x @ x.T).all()
    assert np.abs(bound - x @ x.T).max() <= 1e-6 * (norm * norm[:, None]).max()


@pytest.mark.parametrize("far", [1e5, 1.5e7, 3e9])
def test_topk_with_a_far_row_in_another_shard(spark, far):
    import pyspark.sql.functions as F

    r = np.random.default_rng(11)
    x = r.normal(0.6, 0.05, (6000, 16))
    x[17] = far * r.normal(1, 0.1, 16)
    data = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for row in topk.top_inner_products(data, F.col("vec_id") % 100 == 0, shard=1500).collect():
        got.setdefault(row.query_id, {})[row["rank"]] = (row.score, row.vec_id)
    y = np.floor(64 * x).astype(np.int64).astype(object)
    for q in range(0, 6000, 100):
        s = y @ y[q]
        want = sorted((-min(v, topk.LIMIT), i) for i, v in enumerate(s.tolist()) if i != q)[:20]
        assert [got[q][k + 1] for k in range(20)] == [(-v, i) for v, i in want]


def test_topk_rows_of_one_id_go_to_all_shards(spark):
    import pyspark.sql.functions as F

    r = np.random.default_rng(12)
    rows_ = [(0 if i % 3 else i, v) for i, v in enumerate(r.normal(0, 0.3, (900, 6)).tolist())]
    data = spark.createDataFrame(rows_, "vec_id long, embedding array<double>").repartition(5)
    got = topk.top_inner_products(data, (F.col("vec_id") % 20 == 0) & (F.col("vec_id") > 0), k=4, shard=100, block=8).collect()
    for q, v in rows_:
        if q and q % 20 == 0:
            s = sorted(((-int(np.floor(64 * np.array(w)) @ np.floor(64 * np.array(v))), i) for i, w in rows_ if i != q))[:4]
            assert sorted((x["rank"], x.vec_id, x.score) for x in got if x.query_id == q) == [(k + 1, i, -p) for k, (p, i) in enumerate(s)]


def recall(spark, got, table):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(table).collect()]
    ids, u = np.array([d[0] for d in data]), ann._unit(np.array([d[1] for d in data], np.float32))
    hits = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        s = u @ u[q]
        want = [v for _, v in sorted((-s[j], ids[j]) for j in range(len(ids)) if j != q)[:5]]
        own = [r for r in got if r.query_id == ids[q]]
        assert [r["rank"] for r in sorted(own, key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        for r in own:
            assert r.score == pytest.approx(float(s[np.flatnonzero(ids == r.vec_id)[0]]), abs=1e-12)
        hits += len({r.vec_id for r in own} & set(want))
        total += 5
    return hits / total


def test_ann_recall(spark):
    assert recall(spark, op2_ann(spark, SF).collect(), f"{SF}/embeddings.parquet") >= 0.9


def test_ann_index_of_several_shards(spark):
    table = "/root/testdata/sf0.1/embeddings.parquet"
    vectors = spark.read.parquet(table)
    index = ann.build_index(vectors, shard=700)
    assert index.count() == vectors.count()
    assert recall(spark, ann.search(index, vectors.where("vec_id % 50 = 0"), block=16).collect(), table) >= 0.9


def test_ann_odd_vectors(spark):
    data = odd_vectors(spark)
    got = ann.search(ann.build_index(data, shard=3), data, k=2).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 9)))
    assert by[0] == [(1, 1.0), (10, 1.0)]
    assert by[14] == [(0, 1.0), (1, 1.0)]
    assert by[15] == [(0, 1.0), (1, 1.0)]
    assert by[11] == [(12, 0.8)]
    assert not {4, 5, 6, 7, 8, 9} & ({v for own in by.values() for v, _ in own} | set(by))
    empty = data.limit(0)
    assert ann.search(ann.build_index(empty), empty).count() == 0
    assert not any(math.isnan(r.score) for r in got)


def test_ann_ties_of_scaled_copies(spark):
    """Multiples of one vector have one cosine: ties go to the least ids, however many there are."""
    r = np.random.default_rng(3)
    base = r.integers(-9, 10, 16).astype(float)
    rows_ = [(i, (base * (1 + (7 * i) % 41)).tolist()) if i <= 40 else (i, r.normal(0, 1, 16).tolist()) for i in range(240)]
    for kind in ("float", "double"):
        data = spark.createDataFrame(rows_, f"vec_id long, embedding array<{kind}>")
        for shard in (4096, 60):
            got = ann.search(ann.build_index(data, shard=shard), data.where("vec_id in (0, 7)")).collect()
            found = {q: [(x.vec_id, x.score) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == q] for q in (0, 7)}
            assert found == {0: [(i, 1.0) for i in (1, 2, 3, 4, 5)], 7: [(i, 1.0) for i in (0, 1, 2, 3, 4)]}


def test_ann_rows_of_one_id(spark):
    one, other = [1.0, 2.0, 3.0], [3.0, 0.0, -1.0]
    rows_ = [(0, one)] * 7 + [(1, one), (2, one), (3, other), (0, other)]
    data = spark.createDataFrame(rows_, "vec_id long, embedding array<float>").repartition(3)
    for shard in (4096, 2):
        index = ann.build_index(data, shard=shard)
        assert index.count() == len(rows_)
        got = ann.search(index, data).collect()
        assert [(x.vec_id, round(x.score, 12)) for x in sorted(got, key=lambda x: x["rank"]) if x.query_id == 0] == [(1, 1.0), (2, 1.0), (3, 0.0)]
        assert [x.vec_id for x in got if x.query_id == 1] == [0] * 5


def test_graph_of_equal_and_single_points():
    for x in (np.ones((1, 4)), np.repeat(np.eye(4), 2, 0)):
        unit = ann._unit(x).astype(np.float32)
        graph, entries = ann.build_graph(unit, 4, 8)
        ids, _ = ann.beam_search(unit, graph, entries, unit[:1], 8)
        assert 0 in ids
