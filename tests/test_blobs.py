import pytest

from larkspur.operators import memo, sets
from larkspur.sources import blobs
from larkspur.sources.shared import new_path


@pytest.fixture
def store(spark):
    return blobs.BlobStore(spark, new_path(spark, "blobs"), prefix=("a",))


def test_import_same_and_other_content(spark, store):
    one = store.put("f", b"one")
    assert store.put("f", b"one") == one
    assert store.find("f.old.0") is None
    two = store.put("f", b"two!")
    assert store.get(two.path) == b"two!"
    assert store.get("a/f.old.0") == b"one"
    assert not store.accessible(one)
    assert store.accessible(one, content=False)
    assert store.accessible(two)


def test_prefixes(store):
    assert store.scoped("b").put("f", b"x").path == "a/b/f"
    assert store.at("c").put("f", b"x").path == "c/f"
    assert store.find("missing") is None


def test_offset_and_delete(spark, store):
    h = store.put("g", b"abcdef")
    assert store.get(h.path, 2) == b"cdef"
    assert store.text(h.path) == "abcdef"
    assert not store.delete(h)
    assert blobs.BlobStore(spark, store.root, deletion=True).delete(h)
    assert store.find("g") is None


def test_listing_verifies_results(spark, store):
    h = store.put("f", b"data")
    store.put("m", b"mutable")
    files = "files array<struct<path string, byte_size long, hash long, mutable boolean>>"
    rows = [("ok", [(h.path, h.byte_size, h.hash, False), ("a/m", 0, 0, True)]), ("bad", [(h.path, 1, h.hash, False)]), ("gone", [("a/x", 1, 1, True)]), ("none", [])]
    got = dict(memo.verify_files(spark.createDataFrame(rows, f"key string, {files}"), store.listing()).collect())
    assert got == {"ok": True, "bad": False, "gone": False, "none": True}


def test_encryption(spark):
    key, data = bytes(range(32)), b"0123456789" * 100
    coded = blobs.encrypt(data, key, spark, chunk=300)
    assert coded[:4] == (300).to_bytes(4, "big")
    assert len(coded) == 4 + len(data) + 4 * (blobs.IV_BYTES + blobs.TAG_BYTES)
    assert blobs.decrypt(coded, key, spark) == data
    assert blobs.decrypt(coded, key, spark, 995) == data[995:]


def test_file_handles_of_plain_schema(spark):
    assert sets.file_handles(spark.range(1)) is None
