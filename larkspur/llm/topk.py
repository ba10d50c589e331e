"""Exact top-k by inner product with pivot-table elimination.

The distances of a vector to the pivots fix its coordinates in their span and its distance from that span. The pivot
table holds these, computed once for every row: with coordinates a and distance r of x, and b and s of q, the
distance of q and x is at least that of (a, r) and (b, s). This is the maximum of the lower bounds that distances to the pivots
allow (the triangle inequality through any one pivot gives less), and it makes a . b + r s an upper bound of the inner
product. Candidates are evaluated exactly in the order of that bound, and the search of a query stops when the bound of the
next candidate is below the k-th score found. Bounds are widened by what rounding can change, in proportion to the norms of the
two vectors at hand, so results are exact, ties included, whatever other rows there are.

Rows are dealt into shards of about ``shard`` vectors by their place in the table, queries into blocks of ``block``; each pair
of a shard and a block is one group. A group returns at most k rows a query, which a last ranking merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.sources.shared import materialize

LIMIT = (1 << 63) - 1
OUT = "query_id long, vec_id long, score long"


def usable(embedding: str) -> Column:
    """Whether a vector takes part: not null, not empty, no component null or not finite."""
    c = F.col(embedding)
    # null components make the first test null unless coalesced
    finite = F.forall(c, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return F.coalesce((F.size(c) > 0) & finite, F.lit(False))


def choose_pivots(vectors: np.ndarray, pivots: int) -> np.ndarray:
    """Orthonormal directions (columns) of the span of up to ``pivots`` rows, each the one farthest from the span of those before."""
    vectors = vectors.astype(np.float64)
    rest, norms = vectors.copy(), np.sqrt((vectors * vectors).sum(1))
    basis = np.zeros((vectors.shape[1], 0))
    while len(vectors) and basis.shape[1] < min(pivots, vectors.shape[1]):
        far = np.sqrt((rest * rest).sum(1))
        far[far <= 1e-6 * norms] = 0
        best = int(far.argmax())
        if not far[best] > 0:
            break
        u = rest[best] / far[best]
        u -= basis @ (basis.T @ u)
        basis = np.hstack([basis, (u / np.sqrt(u @ u))[:, None]])
        rest -= (rest @ basis[:, -1:]) * basis[:, -1]
    return basis


def pivot_table(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Coordinates of the rows of x along ``basis`` and, last and rounded up, their distance from its span."""
    x = x.astype(np.float64)
    a = x @ basis
    square = (x * x).sum(1)
    # the columns of the basis are orthonormal up to some 1e-15
    rest = np.sqrt(np.maximum(0, square - (a * a).sum(1)) + 1e-13 * square)
    return np.hstack([a, rest[:, None]])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    return a.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def search_block(q: np.ndarray, qid: np.ndarray, x: np.ndarray, xid: np.ndarray, table: np.ndarray, basis: np.ndarray, k: int, first: int = 256) -> tuple[list[tuple[int, int, int]], int]:
    """(query id, vector id, score) of the k best rows for each query, by elimination, and how many rows were evaluated.

    ``table`` is the pivot table of x for ``basis``. A row with the id of the query is none.
    """
    out, evaluated = [], 0
    exact_x, exact_q = x, q
    x, q = x.astype(np.float64), q.astype(np.float64)
    largest = max(np.abs(x).max(initial=0), np.abs(q).max(initial=0))
    total = largest * largest * x.shape[1]
    # single precision adds the products of small integers without rounding and halves what is read;
    # beyond what double precision holds, scores are added as integers of any size
    kind = np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else object
    wide = np.float64 if kind is object else np.float32
    slack = 8 * (table.shape[1] + 8) * float(np.finfo(wide).eps)  # products and sums of the bound
    x_norm, q_norm = np.sqrt((x * x).sum(1)), np.sqrt((q * q).sum(1))
    left, right = table.astype(wide), pivot_table(q, basis).astype(wide)
    if kind is np.float32:
        x, q = x.astype(kind), q.astype(kind)
    rows = np.zeros_like(x)
    for at in range(0, len(q), 128):
        bounds = right[at : at + 128] @ left.T
        for i, bound in enumerate(bounds, at):
            bound = np.floor(bound + (slack * q_norm[i]) * x_norm)  # scores are integers
            bound[xid == qid[i]] = -np.inf
            best_ids, best = np.zeros(0, np.int64), np.zeros(0, kind)
            rest, size = np.flatnonzero(bound > -np.inf), first
            while len(rest):
                if len(rest) > size:
                    top = np.argpartition(-bound[rest], size - 1)
                    now, rest = rest[top[:size]], rest[top[size:]]
                else:
                    now, rest = rest, rest[:0]
                evaluated += len(now)
                if kind is object:
                    score = exact_x[now].astype(kind) @ exact_q[i].astype(kind)
                else:
                    score = np.take(x, now, axis=0, out=rows[: len(now)], mode="clip") @ q[i]
                if len(best) == k:  # those below the k-th score so far cannot stay
                    now, score = now[score >= best[-1]], score[score >= best[-1]]
                best, best_ids = np.concatenate([best, score]), np.concatenate([best_ids, xid[now]])
                order = np.lexsort((best_ids, -best))[:k]
                best, best_ids = best[order], best_ids[order]
                if len(best) == k:
                    rest = rest[bound[rest] >= best[-1]]  # equal bounds may tie with a smaller id
                size *= 2
            out += [(int(qid[i]), int(v), max(-LIMIT - 1, min(LIMIT, int(s)))) for v, s in zip(best_ids, best, strict=True)]
    return out, evaluated


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 64.0,
    pivots: int = 48,
    pivot_sample: int = 2048,
    shard: int = 8192,
    block: int = 8192,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each row where ``is_query`` holds.

    Components become floor(scale * x) first. Every row is a candidate but those with the query's own id. Ties go to the
    smaller id. Vectors that are null, empty or hold null or non-finite components, and rows with a null id, take
    no part; vectors meet only vectors of their own length. Repeated rows count each on their own as candidates; a
    query id that repeats gives the results of one of its rows (that with the least vector). Fewer candidates than k: all.
    Components and scores beyond 64 bits become the nearest long. The pivots come from ``pivot_sample`` rows (the least by hash of the id); they affect
    how many rows are evaluated, not the result. An empty table gives no rows; other columns are ignored.
    """
    whole = F.transform(F.col(vector_col), lambda v: F.floor(F.lit(scale) * v.cast("double")))
    rows = vectors.where(usable(vector_col) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    )
    sample = rows.orderBy(F.xxhash64("id"), "id", "v").limit(pivot_sample).select("v").collect()
    by_dim: dict[int, list[list[float]]] = {}
    for r in sample:
        by_dim.setdefault(len(r.v), []).append([float(c) for c in r.v])
    chosen = {d: choose_pivots(np.array(v), pivots) for d, v in by_dim.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(chosen)

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, lengths = batch.column("v"), batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
            out: list[list[float]] = [[] for _ in range(batch.num_rows)]
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                x = _matrix(v.take(pa.array(at)))
                for i, row in zip(at.tolist(), pivot_table(x, shared.value.get(d, np.zeros((d, 0)))).tolist(), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, "pivot"])

    # a number of its own for every row, so that rows of one id are dealt over all shards
    numbered = rows.withColumn("no", F.monotonically_increasing_id())
    indexed = materialize(numbered.mapInArrow(tabulate, "id long, v array<long>, asks boolean, no long, pivot array<double>"), "pivot-table")
    asks = indexed.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    counts = indexed.agg(F.count("*"), F.approx_count_distinct(F.when(F.col("asks"), F.col("id")))).first()
    shards, blocks = -(-counts[0] // shard) or 1, -(-counts[1] // block) or 1
    x = indexed.select("id", "v", "pivot", F.size("v").alias("dim"), F.pmod(F.xxhash64("no", F.lit(1)), F.lit(shards)).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    q = asks.select("id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))).alias("shard"))

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            d = left.column("dim")[0].as_py()
            basis = shared.value.get(d, np.zeros((d, 0)))
            found, _ = search_block(_matrix(right.column("v")), right.column("id").to_numpy(), _matrix(left.column("v")), left.column("id").to_numpy(), _matrix(left.column("pivot")), basis, k)
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    at = ("dim", "shard", "block")
    found = x.groupBy(*at).cogroup(q.groupBy(*at)).applyInArrow(group, OUT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
