import http.server
import re
import threading

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import memo
from larkspur.sources import blobs, files, http as web, shared
from larkspur.sources.shared import new_path

KEY = "00112233445566778899aabbccddeeff" * 2


def test_files_written_by_executors(spark):
    store = blobs.BlobStore(spark, new_path(spark, "blobs"), prefix=("a", "b"))
    rows = spark.createDataFrame([("x/1", b"one"), ("2", b""), ("3", None), ("4", b"z" * 600_000), (None, b"no")], "name string, content binary").repartition(3)
    got = {r.path: (r.byte_size, r.hash) for r in store.sink(rows).collect()}
    assert got == {p: (n, files.head_hash(d)) for p, n, d in [("a/b/x/1", 3, b"one"), ("a/b/2", 0, b""), ("a/b/3", 0, b""), ("a/b/4", 600_000, b"z" * 600_000)]}
    assert store.find("x/1") == blobs.Handle("a/b/x/1", 3, files.head_hash(b"one"))
    assert {(r.path, r.byte_size, r.hash) for r in store.listing().collect()} == {(k, *v) for k, v in got.items()}
    store.sink(rows)
    store.sink(spark.createDataFrame([("2", "more")], "name string, content string"))
    assert (store.get("a/b/2"), store.get("a/b/2.old.0"), store.find("x/1.old.0")) == (b"more", b"", None)
    assert {r.path: bytes(r.content) for r in store.contents(spark.createDataFrame([("a/b/2",), ("a/b/x/1",)], "path string")).collect()} == {"a/b/2": b"more", "a/b/x/1": b"one"}


def test_import_by_executors(spark):
    source = blobs.BlobStore(spark, new_path(spark, "in dir's"))
    for name, data in (("a/b", b"one"), ("c", b"two"), ("d e", b"")):
        source.put(name, data)
    store = blobs.BlobStore(spark, new_path(spark, "blobs"), prefix=("p",))
    assert {h.path: h.byte_size for h in store.import_folder(source.root)} == {"p/a/b": 3, "p/c": 3, "p/d e": 0}
    assert store.get("p/a/b") == b"one"
    safe = blobs.EncryptedStore(spark, new_path(spark, "safe"), KEY, chunk=2)
    assert len(safe.import_folder(source.root)) == 3
    assert (safe.get("a/b"), safe.get("d e")) == (b"one", b"")


def test_local_copies_are_checked(spark):
    store = blobs.BlobStore(spark, new_path(spark, "blobs"), overwrite=True)
    one = store.put("f", b"one")
    path = store.local(one)
    with open(path, "wb") as f:
        f.write(b"two")
    with open(store.local(one), "rb") as f:
        assert f.read() == b"one"
    store.put("f", b"six")
    with open(path, "wb") as f:
        f.write(b"bad")
    with pytest.raises(FileNotFoundError):
        store.local(one)


def test_encrypted_store(spark):
    root = new_path(spark, "safe")
    store = blobs.EncryptedStore(spark, root, KEY, chunk=100, deletion=True)
    data = bytes(range(256)) * 3
    made = store.put("f", data)
    raw = blobs.BlobStore(spark, root)
    assert (made.byte_size, made.hash) == (4 + len(data) + 8 * 28, files.head_hash(raw.get("f")))
    assert data not in raw.get("f")
    assert store.put("f", data) == made
    assert (store.get("f"), store.get("f", 700), store.find("f"), store.accessible(made)) == (data, data[700:], made, True)
    with open(store.local(made), "rb") as f:
        assert f.read() == data
    handles = store.scoped("s").sink(spark.createDataFrame([("g", data), ("h", None)], "name string, content binary"))
    assert {r.path: r.byte_size for r in handles.collect()} == {"s/g": made.byte_size, "s/h": 4}
    assert (store.get("s/g"), store.get("s/h")) == (data, b"")
    assert {r.path: bytes(r.content) for r in store.contents(handles).collect()} == {"s/g": data, "s/h": b""}
    assert store.delete(made)
    with pytest.raises(ValueError, match="32 bytes"):
        blobs.EncryptedStore(spark, root, "00")


def lines_of(rows):
    from larkspur.sources import files as f

    return pd.DataFrame({"n": [f.read(root, x["path"]).count(b"\n") + i for i, x, root in zip(rows["i"], rows["f"], rows["root"], strict=True)]})


def test_files_among_the_inputs(spark):
    """Equal handles are equal inputs, whatever else their rows hold."""
    store = blobs.BlobStore(spark, new_path(spark, "blobs"))
    handles = store.sink(spark.createDataFrame([("a", "1\n2\n"), ("b", "1\n")], "name string, content string"))
    rows = handles.select(F.struct("path", "byte_size", "hash").alias("f"), F.explode(F.array(*(F.lit(k).cast("long") for k in (1, 10, 1)))).alias("i"), F.lit(store.root).alias("root"))
    t = memo.Task("lines", 1, lines_of, ("i", "f", "root"), memo.T._parse_datatype_string("n long"), ("i", "f"))
    kept = memo.Store(spark, new_path(spark, "store"))
    out = memo.submit(t, rows, kept).collect()
    assert {r.error for r in out} == {None}
    got = sorted((r.f.path, r.i, r.value.n) for r in out)
    assert got == [("a", 1, 3), ("a", 1, 3), ("a", 10, 12), ("b", 1, 2), ("b", 1, 2), ("b", 10, 11)]
    assert kept.table().count() == 4


DATA = bytes(range(250)) * 40


class Server(http.server.BaseHTTPRequestHandler):
    asked: list = []
    fails: dict = {}

    def do_HEAD(self):
        self.answer(False)

    def do_GET(self):
        self.answer(True)

    def answer(self, body):
        at = self.headers.get("Range")
        Server.asked.append((self.command, self.path, at))
        if self.path == "/gone":
            return self.send_error(404)
        if body and self.path == "/flaky" and Server.fails.setdefault(at, 0) < 2:
            Server.fails[at] += 1
            return self.send_error(503)
        data, m = DATA, re.match(r"bytes=(\d+)-(\d+)", at or "")
        if m and self.path != "/plain":
            data = DATA[int(m[1]) : int(m[2]) + 1]
        self.send_response(206 if m and self.path != "/plain" else 200)
        if self.path != "/plain":
            self.send_header("Accept-Ranges", "bytes")
            self.send_header("ETag", '"x1"')
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        if body:
            self.wfile.write(data)

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    made = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{made.server_port}"
    made.shutdown()


def test_http_ranges_and_retries(server):
    from larkspur.functions.scalars import java_hash

    assert web.describe(f"{server}/file") == (len(DATA), java_hash('"x1"'), True)
    assert web.describe(f"{server}/plain")[1:] == (-1, False)
    Server.asked.clear()
    assert [len(p) for p in web.pieces(f"{server}/file", part=4000)] == [4000, 4000, 2000]
    assert [r for m, _, r in Server.asked if m == "GET"] == ["bytes=0-3999", "bytes=4000-7999", "bytes=8000-9999"]
    for path in ("file", "plain", "flaky"):
        assert b"".join(web.pieces(f"{server}/{path}", part=4000, wait=0.01)) == DATA
        assert b"".join(web.pieces(f"{server}/{path}", offset=9000, part=4000, wait=0.01)) == DATA[9000:]
    with pytest.raises(OSError, match="404"):
        list(web.pieces(f"{server}/gone", wait=0.01))


def test_http_frames(spark, server):
    urls = spark.createDataFrame([(f"{server}/{p}", p) for p in ("file", "plain", "gone")], "url string, name string")
    got = {r.url.rsplit("/")[-1]: (r.content and bytes(r.content), r.error) for r in web.fetched(urls, part=3000, wait=0.01).collect()}
    assert (got["file"], got["plain"]) == ((DATA, None), (DATA, None))
    assert "404" in got["gone"][1]
    assert sorted(r.path.rsplit("/")[-1] for r in web.registered(urls, wait=0.01).collect()) == ["file", "plain"]
    root = new_path(spark, "down")
    made = web.downloaded(urls.where("name <> 'gone'"), root, part=3000).collect()
    assert {(r.path, r.byte_size, r.hash) for r in made} == {(p, len(DATA), files.head_hash(DATA)) for p in ("file", "plain")}


def test_tables_go_with_the_process(spark, monkeypatch):
    import os

    monkeypatch.setattr(shared, "RUN", "run-of-a-test")
    monkeypatch.setattr(shared, "_used", {})
    df = shared.materialize(spark.range(3), "some")
    folder = df.inputFiles()[0].removeprefix("file://").rsplit("/", 2)[0]
    assert folder.endswith("run-of-a-test")
    shared.cleanup()
    assert not os.path.exists(folder)


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)
