import corpus_pipeline as pipeline
import public_tokenizers
from larkspur.llm.lines import within
from larkspur.sources.shared import materialize
from tests.llm.data import edge_documents, no_documents
from tests.llm.test_lines import slow_classes
from tests.llm.test_packing import check
from tests.llm.test_simhash import slow_components, slow_fingerprint

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), name)
        before, rows = rows, {i: r for i, r in enumerate(docs.collect())} if name == "packing" else {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in rows.values())
        if name == "language":
            assert set(rows) == {i for i, r in before.items() if any(map(str.isalpha, r.text or ""))}
        elif name == "lines":
            assert set(rows) == set(before)
            gone = {x[:2] for x in slow_classes([(i, r.text) for i, r in before.items()]) if not x[4]}
            for i, r in before.items():
                assert rows[i].text == "\n".join(t for k, t in enumerate(r.text.split("\n")) if (i, k) not in gone)
        elif name == "near":
            fps = {i: slow_fingerprint(r.text) for i, r in before.items()}
            of = slow_components(list(fps), list(fps.values()))
            assert set(rows) == {i for i in fps if of[i] == i}
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            check(list(rows.values()), [(i, [*t.encode(r.text, add_special_tokens=False).ids, 0]) for i, r in before.items()])


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0
    assert 4 <= len(pipeline.STAGES) <= 5


def test_edges(spark):
    for docs in (edge_documents(spark), no_documents(spark)):
        some = docs.count() > 0
        for name, stage in pipeline.STAGES:
            docs = materialize(stage(spark, docs, SF), name)
            if name == "language" and some:
                ids = [r.doc_id for r in docs.collect()]
                assert not {4, 5, 6, 11, 12} & set(ids)
                assert {1, 2, 7, 8, 13, 14} <= set(ids)
            if name == "near" and some:
                ids = [r.doc_id for r in docs.collect()]
                assert sorted(x for x in ids if x is not None) == sorted({x for x in ids if x is not None})
                assert None in ids
        assert (docs.count() > 0) is some
    assert within("abc", "abd", 1)


def test_near_keeps_a_defined_row(spark):
    """Rows of one doc_id with different texts; equal texts with other columns; the choice does not depend on partitions."""
    import hashlib

    one, two, other = ("the quick brown fox jumps over the lazy dog and runs away", "an entirely different text about something else at all here", "and here is a third one that nobody has seen before today")
    rows = [(3, one, "en", "a", 1), (7, one, "en", "b", 1), (7, two, "en", "c", 1), (7, two, None, "d", 1), (8, two, "en", "e", 1), (9, other, "en", "f", 1), (9, one, "en", "g", 1), (None, one, "en", "h", 1), (5, None, "en", "i", 0), (6, "", "en", "j", 0)]
    for n in (1, 3):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(n)
        got = sorted((r.doc_id or -1, r.source) for r in pipeline.near(spark, docs, SF).collect())
        assert got == [(-1, "h"), (3, "a"), (5, "i"), (7, "d"), (9, "f")]
    both = [(1, one, "en", "x", 1), (1, two, "en", "y", 1)]
    got = [r.text for r in pipeline.near(spark, spark.createDataFrame(both, "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()]
    assert got == [min((one, two), key=lambda t: hashlib.md5(t.encode()).hexdigest())]
