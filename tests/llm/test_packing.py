import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from larkspur.llm.packing import assign, encoder, pack
from larkspur.llm.queries import op3_packing
from tests.llm.data import edge_documents, edge_rows, no_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_are_those_of_the_tokenizer(tokenizer):
    encode, r = encoder(PATH), random.Random(5)
    parts = ["a", "bc", " ", "  ", "\n", "é", "ß", "1", "'s", "<|endoftext|>", "_", "\t", "中", "🎉", "\x00", "\x85", "ſ", "²", "́", "<|endof"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 15)))
        assert encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def check(rows, want, capacity=1024):
    """rows: pieces; want: (doc_id, ids) of all documents."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    left = sorted(((d, len(i)) for d, i in want), key=str)
    for d, ids in want:
        own = sorted({(r.start, r.length, r.ids_crc32, r.doc_tokens) for r in spans[d]})
        assert all(x[3] == len(ids) for x in own)
        at = 0
        for start, length, crc, _ in own:
            assert start == at
            assert crc == zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())
            at += length
        assert at == len(ids)
    assert sum(r.length for r in rows) == sum(n for _, n in left)
    return len(sequences)


def test_pieces_of_the_table(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op3_packing(spark, "/root/testdata/sf0.001").collect()
    want = [(d.doc_id, [*tokenizer.encode(d.text, add_special_tokens=False).ids, 0]) for d in docs]
    n = check(rows, want)
    assert n * 1024 - sum(len(i) for _, i in want) < 1024


def test_edges(spark, tokenizer):
    rows = pack(edge_documents(spark).where("doc_id is not null and doc_id <> 9"), PATH, window=4).collect()
    check(rows, [(r[0], [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in edge_rows() if r[0] not in (None, 9)])
    assert len([r for r in pack(edge_documents(spark), PATH).collect() if r.doc_id == 9]) >= 2
    assert pack(no_documents(spark), PATH).count() == 0


def test_costs_are_balanced():
    lengths = [r for r in range(1, 200)]
    pieces = assign(lengths, 1024, 1.0, 1 / 1024)
    cost = defaultdict(float)
    for _, _, k, s, _ in pieces:
        cost[s] += k + k * k / 1024
    assert max(cost.values()) < 1.25 * (sum(cost.values()) / len(cost))
    assert assign([], 1024, 1, 1) == []
    assert assign([5, 5], 5, 1, 1) == [(0, 0, 5, 0, 0), (1, 0, 5, 1, 0)]
