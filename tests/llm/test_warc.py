import gzip
import hashlib
import os

from larkspur.llm import warc
from larkspur.llm.lines import FILTER_BITS
from larkspur.llm.queries import OP8_SQL, op8_warc
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    assert rows(op8_warc(spark, SF).toPandas()) == rows(connect(SF).sql(OP8_SQL).df())


def pages(spark):
    data = [
        (3, "http://a/\nx", "same"), (1, None, "same"), (2, "u", "other"), (4, "u", None), (5, "u", ""), (None, "u", "same"),
        (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC-Type: x"), (7, "ü", "naïve 🎉\x00"), (1, None, "same"), (8, "u", "long " * 100_000), (None, "u", "alone"), (None, "u", "alone"),
    ]
    return spark.createDataFrame([(*d, "clash", 1) for d in data], "page_id long, url string, html string, archive string, `offset` long").repartition(2)


def test_round_trip(spark):
    for level in (0, 6):
        index = warc.write(pages(spark), archive_bytes=2000, level=level)
        back = warc.read(index, span=100_000, gap=10).collect()
        assert len(back) == 12
        by = {}
        for r in back:
            by.setdefault(r.id, []).append(r)
        assert bytes(by[1][0].payload) == b"same"
        assert {r.record_type for r in by[1]} == {"response"}
        assert (by[3][0].record_type, by[3][0].refers_to, by[3][0].payload_bytes, bytes(by[3][0].payload)) == ("revisit", 1, 4, b"")
        assert by[4][0].record_type == "response"
        assert by[5][0].refers_to == 4
        assert bytes(by[7][0].payload).decode() == "naïve 🎉\x00"
        assert bytes(by[6][0].payload).startswith(b"WARC/1.1")
        assert len(by[8][0].payload) == 500_000
        assert by[3][0].url == "http://a/ x"
        assert by[7][0].url == "ü"
        assert sorted((r.record_type, r.payload_bytes) for r in by[None]) == [("response", 5), ("response", 5), ("revisit", 4)]
        assert all(r.payload_digest == warc.digest_of(b"same") for r in by[3])


def test_index_names_the_bytes_of_each_record(spark):
    for r in warc.write(pages(spark)).collect():
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        head, block = warc.parse(gzip.decompress(data))
        assert head["warc-type"] == r.record_type
        if r.record_type == "response":
            assert len(block) == r.payload_bytes
            assert warc.digest_of(block) == r.payload_digest
    assert warc.digest_of(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"
    assert hashlib.sha1(b"").hexdigest()[:4] == "da39"


def test_selection_and_least_revisit(spark):
    index = warc.write(pages(spark), least_revisit=5)
    assert {r.record_type for r in warc.read(index.where("id = 3")).collect()} == {"response"}
    assert warc.read(index.where("id = 99")).count() == 0
    assert os.path.exists(index.first().archive.removeprefix("file://"))


def test_empty_table(spark):
    index = warc.write(pages(spark).limit(0))
    assert index.count() == 0
    assert warc.read(index).count() == 0


def test_only_payloads_that_repeat_are_shuffled(spark, monkeypatch):
    """Unique payloads are written where they are read; a payload that all bits of the map let through is still written once."""
    taken, sent = warc.materialize, []

    def watch(df, name):
        sent.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return taken(df, name)

    monkeypatch.setattr(warc, "materialize", watch)
    data = [(i, "u", f"page {i}" if i % 10 else "same") for i in range(100)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    for bits in (FILTER_BITS, 32):
        monkeypatch.setattr(warc, "FILTER_BITS", bits, raising=False)
        sent.clear()
        index = warc.write(df)
        assert [(n, "Join" in plan) for n, plan in sent] == [("warc-copies", False), ("warc-index", False), ("warc-index", True)]
        assert index.columns == [x.split()[0] for x in warc.INDEX.split(", ")]
        got = sorted((r.id, r.record_type, r.refers_to, bytes(r.payload).decode()) for r in warc.read(index).collect())
        assert got == [(i, "response", None, t) if i % 10 or not i else (i, "revisit", 0, "") for i, _, t in data]
