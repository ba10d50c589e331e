"""Approximate nearest neighbours by cosine over a robust-pruned directed graph for each shard.

Rows are dealt by their place in the table, not by id, into shards of about ``shard`` vectors. In a shard the points enter the graph in
batches: a greedy beam search from fixed entry points proposes neighbours, and relaxed pruning keeps the
nearest candidate, drops those that are closer to it than to the point by the factor ``alpha``, and goes on with the
nearest one left, up to ``degree``. Reverse edges are added and pruned alike. Rows of one direction (equal vectors, or one
a multiple of the other) share a node. The index, one row per input row, is a table in the shared folder. A search runs a
beam of width ``beam`` for every query on every shard. The cosines of the nodes found that can be among the k best, ties
included, are taken again on the original vectors in extended precision and rounded to double, so equal cosines are equal
numbers and tie by id. The best of all shards are kept.

Queries meet shards in blocks: a group holds one shard and one block of queries, of which ``TOGETHER`` at a time advance
one expansion after the other as array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.topk import _matrix, usable
from larkspur.sources.shared import materialize

INDEX = "dim int, shard long, node int, id long, v array<{kind}>, entry boolean, neighbours array<int>"
OUT = "query_id long, vec_id long, score double"
ENTRIES = 8
TOGETHER = 1024
#: Cosines in double precision are less than this apart from those in extended precision.
CLOSE = 1e-9


def beam_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (n_queries, beam; -1 where fewer were met) and distances (1 - cosine) of the nearest nodes met by greedy search."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # stands for a missing neighbour (-1)
    seen[:, entries] = True
    ids = np.full((n, max(beam, len(entries))), -1)
    ids[:, : len(entries)] = entries
    d = np.full(ids.shape, np.inf, x.dtype)
    d[:, : len(entries)] = 1 - q @ x[entries].T
    done = ids < 0
    active = np.arange(n)
    while len(active):
        open_d = np.where(done[active], np.inf, d[active])
        best = open_d.argmin(1)
        more = np.isfinite(open_d[np.arange(len(active)), best])
        active, best = active[more], best[more]
        if not len(active):
            break
        done[active, best] = True
        near = graph[ids[active, best]]
        at = rows[: len(active)] * 0 + active[:, None]
        fresh = ~seen[at, near]
        seen[at, near] = True
        dist = 1 - np.matmul(x[near], q[active][:, :, None])[:, :, 0]
        dist[~fresh] = np.inf
        all_d = np.concatenate([d[active], dist], 1)
        keep = np.argpartition(all_d, ids.shape[1] - 1, 1)[:, : ids.shape[1]]
        local = np.arange(len(active))[:, None]
        d[active] = all_d[local, keep]
        all_ids = np.concatenate([ids[active], np.where(fresh, near, -1)], 1)
        ids[active] = all_ids[local, keep]
        done[active] = np.concatenate([done[active], ~fresh], 1)[local, keep]
    return ids, d


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse candidates (-1: none) for each point; candidates may hold -1 and the point itself."""
    valid = (candidates >= 0) & (candidates != points[:, None])
    order = np.sort(np.where(valid, candidates, np.iinfo(np.int64).max), 1)
    valid = order < np.iinfo(np.int64).max
    valid[:, 1:] &= order[:, 1:] != order[:, :-1]
    c = np.where(valid, order, 0)
    xc = x[c]
    d = np.where(valid, 1 - np.matmul(xc, x[points][:, :, None])[:, :, 0], np.inf)
    out = np.full((len(points), degree), -1)
    row = np.arange(len(points))
    for k in range(degree):
        best = d.argmin(1)
        live = np.isfinite(d[row, best])
        if not live.any():
            break
        out[live, k] = c[row, best][live]
        to_best = 1 - np.matmul(xc, xc[row, best][:, :, None])[:, :, 0]
        # 1 - cosine is half the squared distance, hence the squared factor
        d[alpha * alpha * to_best <= d] = np.inf
        d[row, best] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = 48, beam: int = 96, alpha: float = 1.2, batch: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency (n, degree; -1: none) and entry points over unit vectors."""
    n = len(x)
    graph = np.full((n, degree), -1)
    mean = x.mean(0)
    # the middle of the shard and a few points far from each other
    entries = [int((x @ mean).argmax())]
    far = 1 - x @ x[entries[0]]
    while len(entries) < min(ENTRIES, n) and far.max() > 1e-9:
        entries.append(int(far.argmax()))
        far = np.minimum(far, 1 - x @ x[entries[-1]])
    entries = np.array(entries)
    order = np.r_[entries, np.setdiff1d(np.random.default_rng(7).permutation(n), entries, assume_unique=True)]
    at = 0
    while at < n:
        size = min(n - at, max(64, min(batch, at)))
        points = order[at : at + size]
        if at == 0:
            found = np.broadcast_to(points, (size, size)).copy()
        else:
            found = np.concatenate([beam_search(x, graph, entries, x[points], beam)[0], graph[points]], 1)
        graph[points] = robust_prune(x, points, found, degree, alpha)
        source, target = np.repeat(points, degree), graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        for part in range(0, len(heads), 256):
            h, f, m = heads[part : part + 256], first[part : part + 256], counts[part : part + 256]
            wide = np.full((len(h), int(m.max())), -1)
            col = np.concatenate([np.arange(k) for k in m])
            wide[np.repeat(np.arange(len(h)), m), col] = source[f[0] : f[0] + m.sum()]
            merged = np.concatenate([graph[h], wide], 1)
            room = (merged >= 0).sum(1) <= degree
            if room.any():  # no pruning needed: shift the neighbours to the front
                front = np.take_along_axis(merged[room], np.argsort(merged[room] < 0, axis=1, kind="stable"), 1)[:, :degree]
                dup = np.array([len(set(r[r >= 0].tolist())) < (r >= 0).sum() for r in front])
                keep = np.flatnonzero(room)[~dup]
                graph[h[keep]] = front[~dup]
                room[np.flatnonzero(room)[dup]] = False
            if (~room).any():
                graph[h[~room]] = robust_prune(x, h[~room], merged[~room], degree, alpha)
        at += size
    return graph, entries


def _unit(v: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """Unit vectors; each is scaled by its largest component first, so that squares neither overflow nor vanish.

    They are made in extended precision: vectors of one direction give equal unit vectors in double.
    """
    v = v.astype(np.longdouble)
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(kind)


def _kind(df: DataFrame, column: str) -> str:
    """Components keep their precision: double stays double, all else fits float."""
    return "double" if dict(df.dtypes)[column] == "array<double>" else "float"


def build_index(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = 4096, degree: int = 48, beam: int = 96, alpha: float = 1.2) -> DataFrame:
    """The graph index (columns as in ``INDEX``), a table in the shared folder with a row for each usable input row.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, are left out. Repeated
    rows are rows of their own; vectors meet only vectors of their own length; other columns are ignored; an empty table gives
    an empty index.
    """
    zero = ~F.exists(vector_col, lambda v: v != 0)
    kind = _kind(vectors, vector_col)
    rows = vectors.where(usable(vector_col) & ~zero & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{kind}>").alias("v"), F.size(vector_col).alias("dim")
    )
    # a number of its own for every row, so that rows of one id, however many, are dealt over all shards
    rows = materialize(rows.withColumn("no", F.monotonically_increasing_id()), "vectors")
    shards = -(-rows.count() // shard) or 1

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        unit = _unit(_matrix(table.column("v")))
        distinct, first, node = np.unique(unit, axis=0, return_index=True, return_inverse=True)
        node = node.ravel()
        graph, entries = build_graph(distinct.astype(np.float32), degree, beam, alpha)
        is_first = np.zeros(len(unit), bool)
        is_first[first] = True
        links = [graph[k][graph[k] >= 0].tolist() if f else None for k, f in zip(node, is_first, strict=True)]
        return pa.table(
            {
                "dim": table.column("dim"),
                "shard": table.column("shard"),
                "node": pa.array(node, pa.int32()),
                "id": table.column("id"),
                "v": table.column("v"),
                "entry": pa.array(np.isin(node, entries) & is_first),
                "neighbours": pa.array(links, pa.list_(pa.int32())),
            }
        )

    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("no", F.lit(1)), F.lit(shards))).drop("no")
    return materialize(dealt.groupBy("dim", "shard").applyInArrow(build, INDEX.format(kind=kind)), "graph-index")


def search(index: DataFrame, queries: DataFrame, *, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", beam: int = 128, block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, other than those with its own id.

    Largest cosine first, ties to the smaller id; all rows found, if fewer than k. Queries with unusable vectors or a
    null id get no rows; a query id that repeats gives the results of one of its rows (that with the least vector). Rows that
    repeat an id are each found on their own.
    """
    zero = ~F.exists(vector_col, lambda v: v != 0)
    asks = queries.where(usable(vector_col) & ~zero & F.col(id_col).isNotNull())
    asks = asks.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(F.col(vector_col).cast(f"array<{_kind(queries, vector_col)}>")).alias("v"))
    blocks = -(-asks.count() // block) or 1
    shards = (index.agg(F.max("shard")).first()[0] or 0) + 1
    x = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    q = asks.select(
        "id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"),
    )

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float]] = []
        if left.num_rows and right.num_rows:
            left = left.sort_by([("node", "ascending"), ("id", "ascending")])
            node, ids = left.column("node").to_numpy(), left.column("id").to_numpy()
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            ends = np.r_[starts[1:], len(node)]
            links = [v for v in left.column("neighbours").to_pylist() if v is not None]
            graph = np.full((len(starts), max(map(len, links))), -1)
            for row, v in zip(graph, links, strict=True):
                row[: len(v)] = v
            exact = _matrix(left.column("v"))[starts]
            unit = _unit(exact)
            entries = np.unique(node[left.column("entry").to_numpy(zero_copy_only=False)])
            asked, qid = _unit(_matrix(right.column("v")), np.longdouble), right.column("id").to_numpy()
            for at in range(0, len(qid), TOGETHER):
                part = asked[at : at + TOGETHER]
                near, _ = beam_search(unit.astype(np.float32), graph, entries, part.astype(np.float32), beam)
                for u, own, nodes in zip(part, qid[at : at + TOGETHER].tolist(), near, strict=True):
                    nodes = nodes[nodes >= 0]
                    score = unit[nodes] @ u.astype(np.float64)
                    order = np.argsort(-score, kind="stable")
                    nodes, score = nodes[order], score[order]
                    rows_of = [ids[starts[j] : ends[j]] for j in nodes]
                    # where the query's own rows stand among the ids of a node
                    cuts = [(int(np.searchsorted(r, own, "left")), int(np.searchsorted(r, own, "right"))) for r in rows_of]
                    total = np.cumsum([len(r) - (b - a) for r, (a, b) in zip(rows_of, cuts, strict=True)])
                    enough = int(np.searchsorted(total, k))
                    n = len(nodes) if enough >= len(nodes) else int((score >= score[enough] - CLOSE).sum())
                    cosine = (_unit(exact[nodes[:n]], np.longdouble) @ u).astype(np.float64).tolist()
                    best: list[tuple[float, int]] = []
                    for c, r, (a, b) in zip(cosine, rows_of, cuts, strict=False):
                        best += [(-c, int(v)) for v in [*r[: min(a, k)], *r[b : b + k]]]
                    found += [(own, v, min(1.0, max(-1.0, -c))) for c, v in sorted(best)[:k]]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        types = (pa.int64(), pa.int64(), pa.float64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score"), cols, types, strict=True)})

    at = ("dim", "shard", "block")
    found = x.groupBy(*at).cogroup(q.groupBy(*at)).applyInArrow(group, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
