import re
from itertools import combinations

import numpy as np
import xxhash

from larkspur.llm import golay, simhash
from larkspur.llm.components import components
from larkspur.llm.queries import op4_simhash
from tests.llm.data import edge_documents, edge_rows, no_documents


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in combinations(zip(ids, fps, strict=True), 2):
        if (a ^ b).bit_count() <= 4 and find(i) != find(j):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


def test_golay_words_within_two_bits_share_an_index():
    words = np.array([sum(1 << b for b in bits) for w in range(4) for bits in combinations(range(23), w)])
    own = golay.indices(words)
    for flip in [0, *(1 << a for a in range(23)), *(1 << a | 1 << b for a, b in combinations(range(23), 2))]:
        other = golay.indices(words ^ flip)
        assert ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any((1, 2)).all()


def test_keys_of_linked_pairs_meet():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << r.integers(0, 64, len(a)).astype(np.uint64)
    (ka, ra), (kb, rb) = simhash.keys(a), simhash.keys(b)
    met = {x for _, x in set(zip(ka.tolist(), ra.tolist(), strict=True)) & set(zip(kb.tolist(), rb.tolist(), strict=True))}
    assert len(met) == len(a)


def test_forest_connects_what_pairs_connect():
    r = np.random.default_rng(4)
    for _ in range(20):
        fps = r.integers(0, 1 << 62, 6, dtype=np.uint64)[r.integers(0, 6, 150)]
        for _ in range(5):
            fps = fps ^ (np.uint64(r.integers(0, 2)) << r.integers(0, 64, len(fps)).astype(np.uint64))
        fps = np.unique(fps)
        root = list(range(len(fps)))
        edges = simhash.forest(fps)
        assert len(edges) < len(fps)
        assert all((int(fps[i]) ^ int(fps[j])).bit_count() <= 4 for i, j in edges)
        for _ in range(len(fps)):
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        assert dict(enumerate(root)) == slow_components(range(len(fps)), fps.tolist())


def compare(rows, got):
    known = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    want = slow_components(list(known), list(known.values()))
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == known[r.doc_id]
            assert len(r.fingerprint) == 16
            assert r.component_id == want[r.doc_id]
    assert len(got) == len(rows)


def test_table_against_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    compare(rows, op4_simhash(spark, "/root/testdata/sf0.001").collect())


def test_edges(spark):
    got = simhash.near_duplicates(edge_documents(spark)).collect()
    compare(edge_rows(), got)
    assert {r.component_id for r in got if r.doc_id in (4, 5, 6, 12)} == {4}
    assert [r.component_id for r in got if r.doc_id is None] == [1]
    assert simhash.near_duplicates(no_documents(spark)).count() == 0


def test_large_group_of_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(300):
        own = list(words)
        own[i % 400] = f"changed{i}"
        rows.append((i, " ".join(own)))
    compare(rows, simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (None, 3), (7, 7), (101, 100)]
    got = dict(components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
