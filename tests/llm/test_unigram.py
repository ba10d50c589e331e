import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from larkspur.llm import unigram
from larkspur.llm.queries import op5_unigram
from tests.llm.data import edge_documents, edge_rows, no_documents

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return unigram.Model(PATH)


def proto_of(model):
    proto = pb.ModelProto()
    with open(PATH, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p, s in zip(proto.pieces, model.score, strict=True):
        p.score = float(s) if p.type == unigram.NORMAL else 0.0
    return proto


def encode(model, texts):
    ids, counts, score = model.encode(texts, unigram.Parts())
    ends = np.cumsum(np.r_[0, counts])
    return [(ids[ends[i] : ends[i + 1]], score[i]) for i in range(len(texts))]


def samples(n, longest, seed=1):
    r = random.Random(seed)
    parts = [*"abcdefg é ß 中文 🎉\n\t  0123", " the ", "ing", "▁", "́", "\x00", "퟿", "token"]
    return ["".join(r.choice(parts) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_same_as_the_library(model):
    """The library adds scores in single precision, so only segmentations of equal score may differ."""
    reference = sentencepiece.SentencePieceProcessor(model_proto=proto_of(model).SerializeToString())
    texts = samples(3000, 30)
    same = 0
    for text, (ids, score) in zip(texts, encode(model, texts), strict=True):
        want = reference.encode(text)
        assert score == pytest.approx(model.price[np.array(want, int)].sum(), rel=1e-5, abs=1e-3)
        same += ids.tolist() == want
        assert model.decode(ids, np.array([len(ids)])) == [reference.decode(ids.tolist())]
    assert same > 0.97 * len(texts)


def test_best_of_all_segmentations(model):
    pieces = {p.piece: model.score[i] for i, p in enumerate(proto_of(model).pieces) if p.type == unigram.NORMAL}

    def best(text):
        if not text:
            return 0.0
        found = [pieces[text[:k]] + best(text[k:]) for k in range(1, len(text) + 1) if text[:k] in pieces]
        if text[0] not in pieces:
            found.append(model.unknown_score + best(text[1:]))
        return max(found)

    for text in samples(200, 9, 2):
        (_, score), = encode(model, [text])
        assert score == pytest.approx(best(unigram.MARKER + text.replace(" ", unigram.MARKER)) if text else 0.0)


def test_one_and_many_agree(model):
    parts = list({p for t in samples(300, 25, 3) for p in model.parts(t)})
    kept = unigram.Parts()
    model.solve(parts, kept)
    for p in parts:
        ids, _ = kept.gather(np.array([kept.slot[p]]))
        assert ids.tolist() == model._one(p.encode())


def test_trie():
    items = {b"a": 0, b"ab": 1, b"abc": 2, b"\xff\x00": 3, b"b": 4}
    t = unigram.DoubleArray(items)
    for word in [*items, b"abd", b"c", b"\xff"]:
        node = 0
        for c in word:
            nxt = t.base[node] + c
            node = nxt if t.base[node] and t.check[nxt] == node else None
            if node is None:
                break
        assert (-1 if node is None else t.value[node]) == items.get(word, -1)


def test_decoding_of_any_ids(model):
    reference = sentencepiece.SentencePieceProcessor(model_file=PATH)
    ids = [model.bytes[0xE4], model.bytes[0xB8], 300, 0, 1, 2, 400]
    assert model.decode(np.array(ids), np.array([len(ids)]))[0].endswith(reference.decode([400]))
    assert model.decode(np.zeros(0, int), np.array([0])) == [""]


def test_query(spark):
    got = op5_unigram(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    assert all(r.round_trip for r in got)


def test_edges(spark):
    docs = edge_documents(spark)
    got = unigram.decode(unigram.encode(docs, PATH), PATH).collect()
    key = lambda r: (str(r.doc_id), str(r.ids), str(r.decoded))
    assert sorted(map(key, unigram.encode(docs, PATH, decode_to="decoded").collect())) == sorted(map(key, got))
    want = {}
    for r in edge_rows():
        want.setdefault(r[0], []).append(r[1])
    assert len(got) == len(edge_rows())
    for r in got:
        assert r.decoded in want[r.doc_id]
        assert (r.ids is None) == (r.decoded is None)
    assert all(r.ids == [] for r in got if r.doc_id == 5)
    assert unigram.decode(unigram.encode(no_documents(spark), PATH), PATH).count() == 0
