import random

import numpy as np

import corpus_pipeline as pipeline
from larkspur.llm import shingles, simhash
from tests.llm.data import edge_documents, no_documents
from tests.llm.test_simhash import slow_fingerprint


def sets_of(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def slow_components(rows, least=0.8):
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a | b else 1) >= least:
                root[max(find(i), find(j))] = min(find(i), find(j))
    heads = {}
    for i, (d, _) in enumerate(rows):
        heads[find(i)] = min(d, heads.get(find(i), d))
    return sorted((d, heads[find(i)]) for i, (d, _) in enumerate(rows))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def documents():
    """Texts of up to 4 changed words, most 0.6 to 0.95 similar to the first of their kind."""
    r = random.Random(5)
    bases = [[f"w{r.randrange(3000)}" for _ in range(r.choice((12, 60, 150, 400)))] for _ in range(25)]
    rows = [(i, " ".join(edited(r, r.choice(bases), r.randrange(5)))) for i in range(300)]
    return rows + [(i, " ".join(edited(r, bases[0] + bases[1], r.randrange(3)))) for i in range(300, 500)]


def test_against_all_pairs(spark):
    rows = documents()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in shingles.similar_documents(df).collect()) == slow_components(rows)


def test_stage_finds_what_fingerprints_miss(spark):
    r = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(r, base, 3))) for i in range(2)]
    assert len(sets_of(rows[0][1]) & sets_of(rows[1][1])) / len(sets_of(rows[0][1]) | sets_of(rows[1][1])) < 0.8
    rows = [(0, " ".join(base)), (1, " ".join([*base[:40], "new", *base[41:90], "newer", *base[91:]]))]
    assert len(sets_of(rows[0][1]) & sets_of(rows[1][1])) / len(sets_of(rows[0][1]) | sets_of(rows[1][1])) >= 0.8
    assert (slow_fingerprint(rows[0][1]) ^ slow_fingerprint(rows[1][1])).bit_count() > 4
    df = spark.createDataFrame([(*x, "en", "s", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert [x.doc_id for x in pipeline.near(spark, df, "").collect()] == [0]


def test_fingerprints_find_links_by_themselves(spark, monkeypatch):
    """Without bands near still finds what is within 4 bits, and links of that only what is similar."""
    r = random.Random(4)
    base = [f"w{i}" for i in range(400)]
    close = next(" ".join(x) for x in (edited(r, base, 1) for _ in range(200)) if 0 < (simhash.fingerprint(" ".join(x), 5) ^ simhash.fingerprint(" ".join(base), 5)).bit_count() <= 4)
    loops = [" ".join(["a b c d e"] * 300 + [f"{c}{i}" for i in range(9)]) for c in "xy"]
    assert (simhash.fingerprint(loops[0], 5) ^ simhash.fingerprint(loops[1], 5)).bit_count() <= 4
    assert len(sets_of(loops[0]) & sets_of(loops[1])) / len(sets_of(loops[0]) | sets_of(loops[1])) < 0.8
    monkeypatch.setattr(shingles, "bands", lambda found: np.zeros(0, np.int64))
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([" ".join(base), close, *loops])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(x.doc_id for x in pipeline.near(spark, df, "").collect()) == [0, 2, 3]


def test_group_links_connect_what_pairs_connect():
    rows = [(i, t) for i, (_, t) in enumerate(documents()[300:])]
    sets = [(i, shingles.shingles(t, 5)) for i, t in rows]
    edges = shingles.group_links(sets, 0.8)
    of, root = dict(sets), {i: i for i, _ in sets}
    assert all(shingles.similarity(of[a], of[b]) >= 0.8 for a, b in edges)
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert sorted(root.items()) == slow_components(rows)
    assert len(np.unique(shingles.bands(sets[0][1]))) == shingles.BANDS


def test_edges(spark):
    got = shingles.similar_documents(edge_documents(spark)).collect()
    assert len(got) == edge_documents(spark).count()
    assert {x.component_id for x in got if x.doc_id in (4, 5, 6, 12)} == {4}
    assert {x.component_id for x in got if x.doc_id in (1, 2, None)} == {1}
    assert shingles.similar_documents(no_documents(spark)).count() == 0
