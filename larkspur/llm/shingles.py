"""Near-duplicate documents by SimHash, verified by the Jaccard similarity of their word shingles; banded minimum hashes find the rest.

A text is the set of its shingles of ``width`` words (a shorter text is one shingle). Two texts link if the similarity of
their sets is ``least`` or more. Equal sets are one node throughout. Candidates meet in two ways, both verified on the whole sets:
 - Texts of a component of SimHash fingerprints (see ``simhash``: shingles of ``width`` words, Golay fuzzy keys, at most 4
   differing bits) are candidates of each other.
 - Most pairs at 0.8 differ in more bits than Golay keys can reach, so bands of minimum hashes find what fingerprints miss. Sets of a
   similarity s agree in a band of ROWS with probability s^ROWS; with BANDS bands a pair at 0.8 shares none with probability 5e-8.

Rows of a key, a component's or a band's, meet in a sorted stream. Groups of up to LARGE sets give their pairs; the sets of larger groups travel with
their key and are linked through leaders: within the bound of a leader a set joins it, and it meets the members of a
cluster only if the leader is within twice that distance (one less the similarity is a metric). Every link is verified on
the whole sets, which are made again from the texts; a bit map of fixed size spares sets that are no candidates the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import slices, whole_groups
from larkspur.llm.components import PER_FILE, heads
from larkspur.llm.lines import FILTER_BITS, _xxhash64_of_longs
from larkspur.llm.simhash import SEED, fingerprint, fingerprint_components
from larkspur.sources.shared import materialize

BANDS, ROWS = 32, 4
LARGE = 64
SEEN = 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)
BY, PLUS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int) -> np.ndarray:
    """The hashes of the shingles of a text, each once, in order."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)), np.uint64, n))


def node(found: np.ndarray) -> int:
    """The name of a set, a signed long."""
    import xxhash

    return int.from_bytes(xxhash.xxh3_64_digest(found.tobytes()), "little", signed=True)


def bands(found: np.ndarray) -> np.ndarray:
    """The band keys of a set; none of an empty one."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 2048):
        h = found[at : at + 2048, None] * BY + PLUS
        np.minimum(least, (h ^ (h >> np.uint64(31))).min(0), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * MIX
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    same = len(np.intersect1d(a, b, assume_unique=True))
    every = len(a) + len(b) - same
    return same / every if every else 1.0


def group_links(sets: list[tuple[int, np.ndarray]], least: float) -> list[tuple[int, int]]:
    """Links that connect what all links of the group connect, through leaders (see the module)."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    leaders: list[int] = []
    members: list[list[int]] = []
    edges = []
    far = 2 * least - 1 - 1e-9
    for i, (_, own) in enumerate(sets):
        home = None
        for k, leader in enumerate(leaders):
            if find(leader) == find(i) and home is not None:
                continue
            s = similarity(sets[leader][1], own)
            if s >= least:
                home, j = k if home is None else home, leader
            elif s >= far:
                j = next((x for x in members[k] if similarity(sets[x][1], own) >= least), None)
            else:
                continue
            if j is not None and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
                edges.append((sets[j][0], sets[i][0]))
        if home is None:
            leaders.append(i)
            members.append([i])
        else:
            members[home].append(i)
    return edges


def set_links(rows: DataFrame, keyed: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): verified links between the sets of ``rows`` (text) that connect all linked ones that share a key. keyed: (key, node, n), distinct."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: np.ndarray, name: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            of = np.repeat(sizes, sizes)
            small, one, two = np.flatnonzero((of <= LARGE) & (of > 1)), [], []
            for shift in range(1, LARGE):
                left = small[small + shift < len(key)]
                left = left[key[left] == key[left + shift]]
                if not len(left):
                    break
                right = left + shift
                ok = np.minimum(n[left], n[right]) >= least * np.maximum(n[left], n[right]) - 1e-6
                one.append(left[ok])
                two.append(right[ok])
            a, b = (name[np.concatenate(x)] if x else np.zeros(0, np.int64) for x in (one, two))
            pairs = np.unique(np.sort(np.stack([a, b], 1), 1), axis=0)
            large = np.flatnonzero(of > LARGE)
            gap = np.zeros(len(large), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[pairs[:, 0], name[large]]), pa.array(np.r_[pairs[:, 1], gap], mask=np.r_[np.zeros(len(pairs), bool), gap == 0]), pa.array(np.r_[np.zeros(len(pairs), np.int64), key[large]])],
                ["a", "b", "group"],
            )

        for cols in whole_groups(batches):
            yield out(*cols)

    found = materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet, "a long, b long, `group` long").distinct(), "set-pairs")

    wanted = found.select(F.col("a").alias("h")).union(found.where("b is not null").select("b"))
    place = wanted.select(F.pmod(F.xxhash64("h"), F.lit(FILTER_BITS)).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, m in words:
        bits[w] = m
    flag = rows.sparkSession.sparkContext.broadcast(bits)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        kept = flag.value
        for batch in batches:
            for part in slices(batch, "text"):
                names, sets = [], []
                found_sets = [shingles(text, width) for text in part.column("text").to_pylist()]
                ids = np.array([node(own) for own in found_sets], np.int64)
                p = _xxhash64_of_longs(ids) % np.int64(FILTER_BITS)
                keep = np.flatnonzero(kept[p >> 5] >> (p & 31).astype(np.uint32) & 1)
                for i in keep.tolist():
                    name, own = int(ids[i]), found_sets[i]
                    if name in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    sets.append(own.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], ["node", "shingles"])

    sets = materialize(rows.select("text").mapInArrow(fetch, "node long, shingles binary").dropDuplicates(["node"]), "shingle-sets")
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    pairs = found.where("b is not null").select("a", "b").join(left, "a").join(right, "b").select("a", "set_a", "b", "set_b")
    groups = found.where("b is null").select("a", "group").join(left, "a").select("group", "a", "set_a")

    def links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in range(2)], ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (part for batch in batches for part in slices(batch, "set_a")):
            every = zip(*(c.to_pylist() for c in part.columns), strict=True)
            yield links([(a, b) for a, x, b, y in every if similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least])

    def verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for g, a, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and g != now:
                    yield links(group_links(held, least))
                    held = []
                now = g
                held.append((a, np.frombuffer(x, np.uint64)))
        if held:
            yield links(group_links(held, least))

    one = pairs.mapInArrow(verify, "a long, b long")
    two = groups.repartition("group").sortWithinPartitions("group", "a").mapInArrow(verify_groups, "a long, b long")
    return one.union(two)


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8, text_md5: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id and ``component_id``, the smallest id reachable over links, itself included.

    With ``text_md5`` also the digest of its text (of an empty one for null), which tells rows of one id apart.

    Null text, empty text and text of white space alone have the empty set and are equal. Repeated rows give repeated
    results; null ids take the component of the other documents of their set (null if there are none); other columns
    are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                keys = pa.array([bands(s) for s in sets], pa.list_(pa.int64()))
                fps = pa.array(np.array([fingerprint(t, width) for t in part.column("text").to_pylist()], np.uint64).view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("md5"), pa.array([node(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), keys, fps], ["id", "md5", "node", "n", "bands", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    digest = F.md5(F.coalesce("text", F.lit("")))
    every = materialize(rows.select("id", "text", digest.alias("md5")).mapInArrow(run, "id long, md5 string, node long, n long, bands array<long>, fp long"), "sets")
    files = -(-every.count() // PER_FILE) or 1  # small tables are few files
    least_id = materialize(every.groupBy("node").agg(F.min("id").alias("least")).coalesce(files), "set-least")
    # texts of one set may repeat its shingles differently, so a node can have several fingerprints
    marked = every.select("node", "n", "fp").distinct()
    alike = marked.join(fingerprint_components(marked, "node"), "fp").select(F.col("component_id").alias("key"), "node", "n").distinct()
    banded = every.dropDuplicates(["node"]).select(F.explode("bands").alias("key"), "node", "n")
    found = heads(set_links(rows, alike.union(banded), width, least), least_id, "node", "least")
    of = least_id.join(found, "node", "left").select("node", F.coalesce("head", "least").alias("component_id"))
    of = materialize(of.coalesce(files), "set-components")
    return every.select("id", "node", "md5").join(of, "node").select(F.col("id").alias(id_col), "component_id", *([F.col("md5").alias("text_md5")] if text_md5 else []))
