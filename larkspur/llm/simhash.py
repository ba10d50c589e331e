"""Near-duplicate documents by SimHash, found through Golay fuzzy hashing.

A fingerprint has 64 bits; two documents link if theirs differ in at most 4. The fingerprint is cut into segments of
22, 21 and 21 bits. Segments of a linked pair have errors that sum to 4 or less, so either
 - one segment is equal and one of the others has at most two errors: key (segment, Golay index of the other), or
 - all differ, two of them in one bit and the third in at most two: key (an equal half of either of the two, Golay
   index of the third).
Words with at most two errors share a Golay index (see ``golay``), so a linked pair shares a key of 32 bits or more.
A fingerprint has up to 36 + 72 keys. Documents are grouped by fingerprint first, so copies never meet in pairs.

Rows of a key are checked together in a sorted stream: neighbours in small groups pairwise, large groups through
leaders (fingerprints more than 4 bits apart): a fingerprint within 4 bits of a leader joins it, and only clusters of
other components with a leader within 8 bits are compared member by member. Each group gives a spanning
forest of its links, so the edges grow with the fingerprints and not with the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import slices, whole_groups
from larkspur.llm.components import PER_FILE, heads
from larkspur.llm.golay import indices
from larkspur.sources.shared import materialize

BITS, ERRORS = 64, 4
#: (lowest bit, length) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
LARGE = 64
#: Fingerprints whose keys one task makes (about 1.5 kB each).
PER_TASK = 131_072


def fingerprint(text: str | None, width: int = 4) -> int:
    """The fingerprint of a whole text as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 65_280):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + 65_280], stops[at : at + 65_280], strict=True)], "<u8")
        bits = np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, BITS)
        whole = len(bits) // 255 * 255
        total += bits[:whole].reshape(-1, 255, BITS).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        total += bits[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long. Null text has no words, so fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                fps = np.array([fingerprint(t, width) for t in part.column(text_col).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(fps.view(np.int64))], [id_col, "fp"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` long, fp long")


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) for all keys of unsigned fingerprints; pairs within ERRORS bits have a key in common."""
    seg = [(fps >> np.uint64(low)) & np.uint64((1 << n) - 1) for low, n in SEGMENTS]
    fuzzy = [indices(s) for s in seg]
    out, rows, kind = [], [], 0

    def add(exact: np.ndarray, third: np.ndarray) -> None:
        """exact: under 2^22 values."""
        nonlocal kind
        at, j = np.nonzero(third >= 0)
        out.append((np.uint64(kind) << np.uint64(40)) | (exact[at] << np.uint64(12)) | third[at, j].astype(np.uint64))
        rows.append(at)
        kind += 1

    for i in range(3):
        for j in range(3):
            if i != j:
                add(seg[i], fuzzy[j])
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        halves = [(s & np.uint64((1 << (n // 2)) - 1), s >> np.uint64(n // 2)) for s, (_, n) in ((seg[i], SEGMENTS[i]), (seg[j], SEGMENTS[j]))]
        for p in halves[0]:
            for q in halves[1]:
                add((p << np.uint64(11)) | q, fuzzy[k])
    return np.concatenate(out), np.concatenate(rows)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges (rows) that connect what links of at most ERRORS bits among the fingerprints connect."""
    root = list(range(len(fps)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges: list[tuple[int, int]] = []

    def link(i: int, j: int) -> None:
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            edges.append((i, j))

    leaders: list[int] = []
    members: list[list[int]] = []
    heads = np.zeros(16, np.uint64)
    for i, fp in enumerate(fps):
        d = distance(heads[: len(leaders)], fp)
        near = np.flatnonzero(d <= 2 * ERRORS)
        close = [k for k in near if d[k] <= ERRORS]
        for k in close:
            link(leaders[k], i)
        for k in near:
            if d[k] > ERRORS and find(leaders[k]) != find(i):
                hit = np.flatnonzero(distance(fps[members[k]], fp) <= ERRORS)
                # members of one cluster are linked to its leader, so one link connects them all
                if len(hit):
                    link(members[k][hit[0]], i)
        if close:
            members[close[0]].append(i)
        else:
            if len(leaders) == len(heads):
                heads = np.concatenate([heads, np.zeros_like(heads)])
            heads[len(leaders)] = fp
            leaders.append(i)
            members.append([i])
    return edges


def _bucket_edges(key: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within equal keys (sorted, complete groups)."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    a, b = [], []
    for s, n in zip(starts[sizes > LARGE], sizes[sizes > LARGE], strict=True):
        found = forest(fps[s : s + n])
        a += [s + i for i, _ in found]
        b += [s + j for _, j in found]
    size_of = np.repeat(sizes, sizes)
    small = np.flatnonzero(size_of <= LARGE)
    one, two = [np.array(a, np.int64)], [np.array(b, np.int64)]
    for shift in range(1, min(LARGE, int(sizes.max(initial=0)))):
        left = small[small + shift < len(key)]
        left = left[key[left] == key[left + shift]]
        if not len(left):
            break
        hit = left[distance(fps[left], fps[left + shift]) <= ERRORS]
        one.append(hit)
        two.append(hit + shift)
    a, b = fps[np.concatenate(one)], fps[np.concatenate(two)]
    return np.minimum(a, b), np.maximum(a, b)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges over distinct fingerprints ``fp`` with the connected components of all links."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(fps), 2000):
                key, row = keys(fps[at : at + 2000])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fps[at : at + 2000][row].view(np.int64))], ["key", "fp"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_edges(key, fp.view(np.uint64))
            pairs = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy().view(np.int64)) for i in range(2)], ["a", "b"])

        for key, fp in whole_groups(batches):
            yield edges(key, fp)

    # fingerprints are few bytes, so Spark would put millions of them, and their keys, into one task
    n = distinct.count()
    parts = max(-(-n // PER_TASK), min(-(-n // 4096), 2 * distinct.sparkSession.sparkContext.defaultParallelism), 1)
    spreaded = distinct.select("fp").repartition(parts).mapInArrow(spread, "key long, fp long")
    return spreaded.repartition("key").sortWithinPartitions("key").mapInArrow(check, "a long, b long")


def fingerprint_components(fps: DataFrame, id_col: str) -> DataFrame:
    """(fp, component_id): for every fingerprint of ``fps`` (columns ``id_col`` and fp) the least id of its component."""
    files = -(-fps.count() // PER_FILE) or 1  # small tables are few files
    least = materialize(fps.groupBy("fp").agg(F.min(id_col).alias("least")).coalesce(files), "fingerprint-least")
    found = heads(links(least), least, "fp", "least")
    # fingerprints without a link keep their own least id
    every = least.join(found, "fp", "left").select("fp", F.coalesce("head", "least").alias("component_id"))
    # as a table of its own, so that the join to the documents can split a fingerprint that very many share
    return materialize(every.coalesce(files), "fingerprint-components")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """One row per row of ``docs``: its id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most 4 bits, itself included. Null text, empty text and
    text of white space alone have fingerprint zero and link like any other. Repeated rows give repeated results; null
    ids take the component of the other documents of their fingerprint (null if there are none); other columns are
    ignored; an empty table gives no rows.
    """
    fps = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    return fps.join(fingerprint_components(fps, id_col), "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
