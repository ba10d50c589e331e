"""Near-duplicate lines by a segment-partition edit join, and their removal.

Lines are taken without surrounding white space; blank ones take no part. Two lines of ``least`` characters or more link if they
differ by at most ``edits`` insertions, deletions and substitutions of a character; shorter ones (``short``) only if they are equal.

Candidates. Cut into ``edits + 1`` segments, the shorter line of a linked pair has a segment that occurs unchanged in the
longer one, close to its place. For each length and segment that a line could meet, its substrings at the
places the edits leave open are keys (length, segment, substring hash); the line's own segments are among them. A
key row carries half a line digest and a sketch (parities of hashed character pairs, of which an edit changes at most
four), never the text. Rows of a key meet in a sorted stream, which returns pairs whose sketches allow a link.
A Spark task writes a repeated line once, so hot lines are no hot keys.

Hot segments. Lines of a key that would be too many to compare are dealt again by a second key: with the first segment they share
one of twice as many shorter segments that is no part of it, of which ``edits`` at least are unchanged in a linked pair.

Verification. The texts of candidates are read again (a bit map of fixed size spares the others the shuffle) and
compared by a banded bit-parallel edit distance. Where a key has far more candidates than lines, its lines
travel with their text instead, and the group is verified through leaders: within ``edits`` of a leader a line joins it,
and it meets the members of a cluster only if the leader is within twice that. Each such group gives a
spanning forest, so no group gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.batches import slices, whole_groups
from larkspur.llm.components import heads
from larkspur.sources.shared import materialize, per_worker

SEEN = 200_000
#: Candidates to a line of a group beyond which it is verified through leaders, and its lines beyond which they are dealt again first.
DENSE, LEADERS = 8, 20_000
#: Comparisons of sketches beyond which the lines of a key are dealt again, and at a time.
MUCH, AT_ONCE = 1 << 26, 1 << 22
FILTER_BITS = 1 << 24
BASE = 0x9E3779B97F4A7C15  # odd, for substring hashes modulo 2^64
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
KEYED, FOUND = "key long, half long, mark long", "a long, kind int, b long"
PAIR, GROUP, AGAIN = 0, 1, 2


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``.

    Bit d of level e says that b so far and a prefix of a that is d - edits longer differ by at most e: the band of
    2 * edits + 1 diagonals is one machine word per level, and a character of b advances all of it.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # the length of the common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[:mid] == b[:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:  # and of the common suffix of the rest
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << (i + edits)
    band = (1 << (2 * edits + 1)) - 1
    # a prefix of length i stands at diagonal i; diagonals beyond the ends of a die by themselves or at the final test
    level = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    for j, c in enumerate(b):
        match = where.get(c, 0) >> j & band
        new = [level[0] & match]
        for e in range(1, edits + 1):
            new.append((level[e] & match | level[e - 1] | level[e - 1] >> 1 | new[-1] << 1) & band)
        level = new
        if not level[-1]:
            return False
    return bool(level[-1] >> (len(a) - len(b) + edits) & 1)


def eligible(text: str | None, least: int) -> list[tuple[int, str]]:
    """(number from 0, line) of the lines of a text that take part."""
    found = ((i, line.strip()) for i, line in enumerate((text or "").split("\n")))
    return [(i, line) for i, line in found if len(line) >= least]


def digest(line: str) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64 for i up to n."""
    size = 1 << max(18, n.bit_length())

    def build(base: int) -> np.ndarray:
        out = np.full(size, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return per_worker(("powers", size), lambda: (build(BASE), build(pow(BASE, -1, 1 << 64))))


def segments(length: np.ndarray, m: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(place, length) of the m segments of lines of the given lengths: lengths differ by one at most, longer ones last."""
    short, extra = length // m, length % m
    place, found = np.zeros_like(length), []
    for i in range(m):
        n = short + (i >= m - extra)
        found.append((place, n))
        place = place + n
    return found


class Lines:
    """Lines with what substring hashes need."""

    def __init__(self, lines: list[str]):
        code = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.begin = np.r_[0, np.cumsum(self.size)[:-1]]
        self.power, self.inverse = _powers(len(code) + 1)
        self.prefix = np.zeros(len(code) + 1, np.uint64)
        np.cumsum((code + np.uint64(1)) * self.power[: len(code)], out=self.prefix[1:])
        # pairs of neighbouring characters; the pair across the end of a line is left out
        pair = (code * np.uint64(MIX[0]) + np.roll(code, -1) * np.uint64(MIX[1])) * np.uint64(BASE)
        bit = np.uint64(1) << ((pair >> np.uint64(40)) % np.uint64(63))
        bit[self.begin + self.size - 1] = 0
        self.sketch = np.bitwise_xor.reduceat(bit, self.begin)

    def keys(self, rows: np.ndarray, place: np.ndarray, n: np.ndarray, length: np.ndarray, m: int, i: int) -> np.ndarray:
        """The key of a substring of each of the rows as segment i of m of a line of the given length."""
        s = self.begin[rows] + place
        h = (self.prefix[s + n] - self.prefix[s]) * self.inverse[s]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(MIX[0]) + (length.astype(np.uint64) * np.uint64(m) + np.uint64(i)) * np.uint64(BASE)
        return (h ^ (h >> np.uint64(32))) * np.uint64(MIX[1])


def key_rows(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, is_own, sketch of the line) for all keys of the lines."""
    key, row, own, _, sketch = _first_keys(Lines(lines), edits)
    return key, row, own, sketch[row]


def _first_keys(of: Lines, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, is_own, 16 * delta + segment) of all keys, and the sketches of the lines."""
    keys, rows, own, kind = [], [], [], []
    m = edits + 1
    for delta in range(edits + 1):
        length = of.size - delta
        for i, (place, n) in enumerate(segments(length, m)):
            for shift in range(max(-i, delta - (edits - i)), min(i, delta + (edits - i)) + 1):
                ok = np.flatnonzero((place + shift >= 0) & (place + shift + n <= of.size) & (n > 0))
                keys.append(of.keys(ok, place[ok] + shift, n[ok], length[ok], m, i))
                rows.append(ok)
                own.append(np.full(len(ok), delta == 0 and shift == 0))
                kind.append(np.full(len(ok), 16 * delta + i))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(own), np.concatenate(kind), of.sketch


def second_keys(lines: list[str], first: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line number, is_own, sketch of the line) of the second keys of lines that hold the first keys at hand.

    For each way a line holds its first key: the shorter segments of that length that are no part of the first one.
    """
    of = Lines(lines)
    key, row, _, kind, sketch = _first_keys(of, edits)
    hit = np.flatnonzero(key == first[row])
    ways = np.unique(np.stack([row[hit], kind[hit]], 1), axis=0)
    keys, rows, own = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
    m = edits + 1
    for way in np.unique(ways[:, 1]).tolist():
        delta, i = divmod(way, 16)
        at = ways[ways[:, 1] == way, 0]
        length = of.size[at] - delta
        big, wide = segments(length, m)[i]
        for j, (place, n) in enumerate(segments(length, 2 * m)):
            outside = (place < big) | (place + n > big + wide)
            for shift in range(-((edits - delta) // 2), (edits + delta) // 2 + 1):
                ok = np.flatnonzero(outside & (place + shift >= 0) & (place + shift + n <= of.size[at]) & (n > 0))
                found = of.keys(at[ok], place[ok] + shift, n[ok], length[ok], 2 * m, j) ^ first[at[ok]]
                keys.append((found ^ (found >> np.uint64(31))) * np.uint64(MIX[0]))
                rows.append(at[ok])
                own.append(np.full(len(ok), delta == 0 and shift == 0))
    rows = np.concatenate(rows)
    return np.concatenate(keys), rows, np.concatenate(own), sketch[rows]


def candidate_pairs(key: np.ndarray, half: np.ndarray, mark: np.ndarray, most: int, again: bool = False) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """Pairs of rows with equal keys whose sketches differ in at most ``most`` bits, one of them an own segment.

    Keys are sorted, groups complete; ``mark`` holds the sketch and in its lowest bit is_own. Also returns the rows of
    dense groups and of those to be dealt again (if ``again``), which give no pairs.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    one, two, dense, more = [], [], [], []
    for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist(), strict=True):
        own = s + np.flatnonzero(mark[s : s + n] & np.uint64(1))
        every = np.arange(s, s + n)
        if again and len(own) * n > MUCH:
            more.append(every)
            continue
        found_a, found_b, total = [], [], 0
        step = max(1, AT_ONCE // n)
        blocks = ((own[at : at + step], every[to : to + AT_ONCE]) for at in range(0, len(own), step) for to in range(0, n, AT_ONCE))
        for a, b in blocks:
            ok = np.bitwise_count((mark[a][:, None] ^ mark[b][None]) >> np.uint64(1)) <= most
            ok &= (half[a][:, None] != half[b][None]) & ((a[:, None] < b[None]) | ((mark[b] & np.uint64(1)) == 0)[None])
            i, j = np.nonzero(ok)
            found_a.append(a[i])
            found_b.append(b[j])
            total += len(i)
            if total > DENSE * n:
                break
        if total <= DENSE * n:
            one += found_a
            two += found_b
        else:
            (more if again and n > LEADERS else dense).append(every)
    small = np.flatnonzero(np.repeat((sizes <= 32) & (sizes > 1), sizes))
    for shift in range(1, 32):
        left = small[small + shift < len(key)]
        left = left[key[left] == key[left + shift]]
        if not len(left):
            break
        right = left + shift
        ok = ((mark[left] | mark[right]) & np.uint64(1)) > 0
        ok &= (half[left] != half[right]) & (np.bitwise_count((mark[left] ^ mark[right]) >> np.uint64(1)) <= most)
        one.append(left[ok])
        two.append(right[ok])
    none = np.zeros(0, np.int64)
    return one, two, np.concatenate(dense) if dense else none, np.concatenate(more) if more else none


def group_links(lines: list[tuple[bytes, str]], edits: int) -> list[tuple[bytes, bytes]]:
    """Links that connect what all links of the group connect, through leaders (see the module)."""
    lines = sorted(set(lines))
    sketch = key_rows([t for _, t in lines], 0)
    sketches = np.zeros(len(lines), np.uint64)
    sketches[sketch[1]] = sketch[3]
    root = list(range(len(lines)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    leaders: list[int] = []
    members: list[list[int]] = []
    edges = []
    for i, (_, text) in enumerate(lines):
        home = None
        may = np.flatnonzero(np.bitwise_count(sketches[leaders] ^ sketches[i]) <= 8 * edits) if leaders else []
        for k in may:
            if find(leaders[k]) == find(i) and home is not None:
                continue
            if within(lines[leaders[k]][1], text, edits):
                home = k if home is None else home
                j = leaders[k]
            elif within(lines[leaders[k]][1], text, 2 * edits):
                close = np.array(members[k])
                close = close[np.bitwise_count(sketches[close] ^ sketches[i]) <= 4 * edits]
                j = next((x for x in close.tolist() if within(lines[x][1], text, edits)), None)
            else:
                continue
            if j is not None and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
                edges.append((lines[j][0], lines[i][0]))
        if home is None:
            leaders.append(i)
            members.append([i])
        else:
            members[home].append(i)
    return edges


def _flat(batches: Iterator[pa.RecordBatch], least: int, name: str = "doc_id") -> Iterator[tuple[list, list[int], list[str]]]:
    for batch in batches:
        for part in slices(batch, "text", 1 << 18):
            docs, numbers, lines = [], [], []
            for doc, text in zip(part.column(name).to_pylist(), part.column("text").to_pylist(), strict=True):
                for i, line in eligible(text, least):
                    docs.append(doc)
                    numbers.append(i)
                    lines.append(line)
            yield docs, numbers, lines


def _half(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def line_links(rows: DataFrame, edits: int, least: int) -> DataFrame:
    """(a, b): links between digests of different lines of ``rows`` (doc_id, text) that connect all linked lines."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, _, lines in _flat(batches, least):
            fresh, halves = [], []
            for line in lines:
                d = digest(line)
                if d not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(d)
                    fresh.append(line)
                    halves.append(_half(d))
            if fresh:
                key, row, own, sketch = key_rows(fresh, edits)
                mark = (sketch << np.uint64(1)) | own.astype(np.uint64)
                cols = (key.view(np.int64), np.array(halves, np.int64)[row], mark.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["key", "half", "mark"])

    def meet(again: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for key, half, mark in whole_groups(batches):
                one, two, dense, more = candidate_pairs(key, half, mark.view(np.uint64), 4 * edits, again)
                a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (one, two))
                pairs = np.unique(np.sort(np.stack([half[a], half[b]], 1), 1), axis=0)
                yield _found(pairs[:, 0], PAIR, pairs[:, 1])
                for rows, kind in ((dense, GROUP), (more, AGAIN)):
                    if len(rows):
                        group = np.unique(np.stack([half[rows], key[rows]], 1), axis=0)
                        yield _found(group[:, 0], kind, group[:, 1])

        return run

    def candidates(keyed: DataFrame, again: bool, name: str) -> DataFrame:
        return materialize(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(meet(again), FOUND).distinct(), name)

    found = candidates(rows.mapInArrow(spread, KEYED), True, "line-pairs")

    # a bit map of fixed size over the candidates; a line outside it is no candidate
    wanted = found.select(F.col("a").alias("h")).union(found.where(F.col("kind") == PAIR).select("b"))
    place = wanted.select(F.pmod(F.xxhash64("h"), F.lit(FILTER_BITS)).alias("p"))
    words = place.groupBy(F.shiftright("p", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 31 as int))")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    for w, m in words:
        bits[w] = m
    spark = rows.sparkSession
    flag = spark.sparkContext.broadcast(bits)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        kept = flag.value
        for _, _, lines in _flat(batches, least):
            ids = [digest(line) for line in lines]
            halves = np.array([_half(d) for d in ids], np.int64)
            p = _xxhash64_of_longs(halves) % np.int64(FILTER_BITS)
            keep = np.flatnonzero(kept[p >> 5] >> (p & 31).astype(np.uint32) & 1)
            got = []
            for i in keep.tolist():
                if ids[i] not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(ids[i])
                    got.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(halves[got]), pa.array([ids[i] for i in got], pa.binary()), pa.array([lines[i] for i in got], pa.string())], ["half", "id", "line"])

    texts = materialize(rows.mapInArrow(fetch, "half long, id binary, line string").distinct(), "line-texts")
    left = texts.select(F.col("half").alias("a"), F.col("id").alias("id_a"), F.col("line").alias("line_a"))
    right = texts.select(F.col("half").alias("b"), F.col("id").alias("id_b"), F.col("line").alias("line_b"))

    def spread_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line_a", 1 << 18):
                first, half = (part.column(c).to_numpy() for c in ("b", "a"))
                key, row, own, sketch = second_keys(part.column("line_a").to_pylist(), first.view(np.uint64), edits)
                mark = (sketch << np.uint64(1)) | own.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key.view(np.int64), half[row], mark.view(np.int64))], ["key", "half", "mark"])

    hot = found.where(F.col("kind") == AGAIN)
    if not hot.isEmpty():
        keyed = hot.select("a", "b").join(left, "a").select("a", "b", "line_a").mapInArrow(spread_again, KEYED)
        found = found.where(F.col("kind") != AGAIN).union(candidates(keyed, False, "line-pairs-again")).distinct()
    pairs = found.where(F.col("kind") == PAIR).select("a", "b").join(left, "a").join(right, "b").select("id_a", "line_a", "id_b", "line_b")
    groups = found.where(F.col("kind") == GROUP).select("a", F.col("b").alias("group")).join(left, "a").select("group", "id_a", "line_a")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "line_a"):
                ok = [(p, q) for p, s, q, t in zip(*(c.to_pylist() for c in part.columns), strict=True) if within(s, t, edits)]
                yield _links(ok)

    def verify_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for g, d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and g != now:
                    yield _links(group_links(held, edits))
                    held = []
                now = g
                held.append((d, t))
        if held:
            yield _links(group_links(held, edits))

    one = pairs.mapInArrow(verify, "a binary, b binary")
    two = groups.repartition("group").sortWithinPartitions("group").mapInArrow(verify_groups, "a binary, b binary")
    return one.union(two)


def _found(a: np.ndarray, kind: int, b: np.ndarray) -> pa.RecordBatch:
    """Rows of FOUND: the half digest of a line, and that of another (PAIR) or the key of a group (GROUP, AGAIN)."""
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.full(len(a), kind, np.int32)), pa.array(b)], ["a", "kind", "b"])


def _links(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in range(2)], ["a", "b"])


def _xxhash64_of_longs(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """What Spark's xxhash64 gives for one long column, as the non-negative remainder needs it: modulo 2^63 bits kept."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))

    h = np.uint64(seed) + p5 + np.uint64(8)
    h = h ^ (turn(values.view(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h = h ^ (h >> np.uint64(32))
    return (h & np.uint64((1 << 62) - 1)).astype(np.int64)  # a power of two below divides 2^62


def _row_key(text: str | Column) -> Column:
    """What tells rows of one id, or without an id, apart."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


def _classes(docs: DataFrame, id_col: str, text_col: str, edits: int, least: int, short: bool) -> DataFrame:
    """(doc_id, row, line_no, class, keep): class is a struct (doc_id, line_no, row), the line's own where the line is kept."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_, numbers, lines in _flat(batches, 1 if short else least, "name"):
            doc, row = [d["doc_id"] for d in docs_], [d["row"] for d in docs_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(row, pa.binary()), pa.array(numbers, pa.int32()), pa.array([digest(t) for t in lines], pa.binary())], ["doc_id", "row", "line_no", "id"]
            )

    named = rows.select(F.struct("doc_id", _row_key("text").alias("row")).alias("name"), "text")
    every = materialize(named.mapInArrow(occurrences, "doc_id long, row binary, line_no int, id binary"), "lines")
    own = F.struct("doc_id", "line_no", "row")
    first = every.groupBy("id").agg(F.min(own).alias("first"), F.count("*").alias("n"))
    linked = heads(line_links(rows, edits, least), first, "id", "first")
    named = first.join(linked, "id", "left")
    # lines that are alone, most of all, need no row
    of = materialize(named.where("n > 1 or head is not null").select("id", F.coalesce("head", "first").alias("class")), "line-classes")
    out = every.join(of, "id", "left").withColumn("class", F.coalesce("class", own))
    return out.select("doc_id", "row", "line_no", "class", own.eqNullSafe(F.col("class")).alias("keep"))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24, short: bool = False) -> DataFrame:
    """One row per line that takes part: id, ``line_no`` (from 0), ``class_doc_id``, ``class_line_no`` and ``keep``.

    Lines of ``least`` characters or more take part, and with ``short`` all others that are not blank, as classes of equal lines. The
    class of a line is what links reach from it; it is named by its first occurrence in order of id and number (of
    rows that share both, in order of a digest of the text), and that occurrence alone has ``keep``. Null and empty texts have no lines. A null id
    comes before all others. Rows are told apart by id and text, so different texts without an id, or of one id, are different
    documents; repeated rows get the same result each. Lines of any length are compared whole. Other columns are ignored; an empty table
    gives no rows. ``least`` is greater than ``edits``.
    """
    found = _classes(docs, id_col, text_col, edits, least, short)
    return found.select(F.col("doc_id").alias(id_col), "line_no", F.col("class.doc_id").alias("class_doc_id"), F.col("class.line_no").alias("class_line_no"), "keep")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: int = 2, least: int = 24, short: bool = False) -> DataFrame:
    """``docs`` with every line left out of its texts that ``classes`` does not keep; all rows and columns stay.

    Null texts stay null; a text all of whose lines go becomes empty. Without ``short`` lines of fewer than ``least`` characters all stay:
    they recur by chance, and a text without them is not the text that it was. Columns may have any names.
    """
    found = _classes(docs, id_col, text_col, edits, least, short)
    id_, row, gone = (_free(name, docs.columns) for name in ("id_", "row_", "gone_"))
    lost = found.where("not keep").groupBy(F.col("doc_id").alias(id_), F.col("row").alias(row)).agg(F.collect_set("line_no").alias(gone))
    lines = F.filter(F.split(docs[text_col], "\n"), lambda _, i: ~F.array_contains(lost[gone], i))
    text = F.when(lost[gone].isNull(), docs[text_col]).otherwise(F.array_join(lines, "\n"))
    joined = docs.join(lost, docs[id_col].cast("long").eqNullSafe(lost[id_]) & (_row_key(docs[text_col].cast("string")) == lost[row]), "left")
    return joined.select(*(text.alias(c) if c == text_col else docs[c] for c in docs.columns))


def _free(name: str, taken: list[str]) -> str:
    """The name, or a longer one where a column has it."""
    while name.lower() in (c.lower() for c in taken):
        name += "_"
    return name
