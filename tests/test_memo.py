import pandas as pd
import pytest

from larkspur.operators import memo
from larkspur.sources.shared import new_path


def plus_one(rows):
    return pd.DataFrame({"n": rows["i"] + 1})


def fail_on_one(rows):
    if (rows["i"] == 1).any():
        raise ValueError("one")
    return pd.DataFrame({"n": rows["i"]})


def make(body=plus_one, version=1, key=()):
    return memo.Task("t", version, body, ("i",) if not key else ("i", "e"), memo.T._parse_datatype_string("n long"), tuple(key))


@pytest.fixture
def store(spark):
    return memo.Store(spark, new_path(spark, "store"))


def runs(store):
    return store.table().count()


def test_many_submissions_run_once(spark, store):
    rows = spark.range(10_000).selectExpr("id", "0L AS i")
    out = memo.submit(make(), rows, store)
    assert out.where("value.n = 1").count() == 10_000
    assert runs(store) == 1


def test_second_submission_is_a_hit(spark, store):
    rows = spark.createDataFrame([(1,), (2,)], "i long")
    memo.submit(make(), rows, store)
    again = memo.submit(make(), spark.createDataFrame([(2,), (3,)], "i long"), store).collect()
    assert sorted((r.i, r.value.n, r.from_cache) for r in again) == [(2, 3, True), (3, 4, False)]
    assert runs(store) == 3


def test_version_is_part_of_the_key(spark, store):
    rows = spark.createDataFrame([(1,)], "i long")
    memo.submit(make(), rows, store)
    assert not memo.submit(make(version=2), rows, store).first().from_cache


def test_no_cache_does_not_write(spark, store):
    rows = spark.createDataFrame([(1,)], "i long")
    for _ in range(2):
        assert not memo.submit(make(), rows, store, no_cache=True).first().from_cache
    assert runs(store) == 0


def test_key_columns(spark, store):
    rows = spark.createDataFrame([(1, 1), (1, 2), (2, 2)], "i long, e long")
    memo.submit(make(key=("i",)), rows, store)
    assert runs(store) == 2


def test_failure_reaches_its_row_only(spark, store):
    rows = spark.createDataFrame([(1,), (2,)], "i long")
    out = {r.i: r for r in memo.submit(make(fail_on_one), rows, store, attempts=2).collect()}
    assert "ValueError" in out[1].error
    assert out[1].value is None
    assert out[2].value.n == 2
    assert runs(store) == 1


def test_undecodable_result_runs_again(spark, store):
    rows = spark.createDataFrame([(1,)], "i long")
    memo.submit(make(), rows, store)
    broken = spark.read.schema(memo.STORE).parquet(store.path).selectExpr("key", "'not json' AS result", "started", "ended", "lineage", "task", "version").collect()
    other = memo.Store(spark, new_path(spark, "store"))
    other.append(spark.createDataFrame(broken, "key string, result string, started timestamp, ended timestamp, lineage array<string>, task string, version int"))
    out = memo.submit(make(), rows, other).first()
    assert (out.value.n, out.from_cache) == (2, False)


def test_closures_are_refused():
    captured = 3
    with pytest.raises(memo.SubmissionError):
        memo.task("c", 1, ["i"], "n long")(lambda rows: rows + captured)


def test_empty_input(spark, store):
    assert memo.submit(make(), spark.createDataFrame([], "i long"), store).count() == 0


def echo(rows):
    return pd.DataFrame({"n": [f"{a}/{b}" for a, b in zip(rows["a"], rows["b"], strict=True)]})


def test_different_inputs_have_different_keys(spark, store):
    """Values that hold what a separator or a mark for null could be."""
    pairs = [("a|b", "c"), ("a", "b|c"), (None, "z"), ("<null>", "z"), ("~", "z"), ("1:a", "b"), ("1", "a1:b"), ("", ""), ("", None), (None, ""), ("0:", "")]
    t = memo.Task("echo", 1, echo, ("a", "b"), memo.T._parse_datatype_string("n string"))
    out = memo.submit(t, spark.createDataFrame(pairs, "a string, b string"), store).collect()
    assert len({r.key for r in out}) == len(pairs)
    assert all(r.value.n == f"{r.a}/{r.b}" for r in out)


def test_names_of_answers_in_the_input(spark, store):
    def total(rows):
        return pd.DataFrame({"n": rows["key"] + rows["value"] + rows["error"] + rows["from_cache"]})

    t = memo.Task("total", 1, total, ("key", "value", "error", "from_cache"), memo.T._parse_datatype_string("n long"))
    rows = spark.createDataFrame([(1, 2, 3, 4, "x")], "key long, value long, error long, from_cache long, rest string")
    one = memo.submit(t, rows, store).first()
    assert (one.value.n, one.error, one.from_cache, one.rest) == (10, None, False, "x")
    two = memo.submit(t, rows, store, prefix="memo_").first()
    assert (two.memo_value.n, two.memo_from_cache, two.key, two.value) == (10, True, 1, 2)
    with pytest.raises(memo.SubmissionError):
        memo.submit(t, rows.withColumn(memo.KEY, rows.key), store)


def kinds(rows):
    import datetime
    import decimal

    import numpy as np

    one = {"d": datetime.date(2024, 2, 29), "t": datetime.datetime(2024, 2, 29, 12, 30, 1), "b": b"\x00\xff", "x": decimal.Decimal("1.25"), "a": np.array([1, 2])}
    return pd.DataFrame([one] * len(rows))


def test_results_of_all_kinds_survive_the_store(spark, store):
    t = memo.Task("kinds", 1, kinds, ("i",), memo.T._parse_datatype_string("d date, t timestamp, b binary, x decimal(10,2), a array<long>"))
    rows = spark.createDataFrame([(1,)], "i long")
    fresh, stored = (memo.submit(t, rows, store).first() for _ in range(2))
    assert (fresh.from_cache, stored.from_cache) == (False, True)
    assert fresh.value == stored.value
    assert (str(stored.value.d), str(stored.value.t), bytes(stored.value.b), str(stored.value.x), stored.value.a) == ("2024-02-29", "2024-02-29 12:30:01", b"\x00\xff", "1.25", [1, 2])


def test_result_without_a_stored_form_fails_its_row(spark, store):
    t = memo.Task("bad", 1, lambda rows: pd.DataFrame({"n": [object()] * len(rows)}), ("i",), memo.T._parse_datatype_string("n string"))
    assert "cannot be stored" in memo.submit(t, spark.createDataFrame([(1,)], "i long"), store).first().error


def test_nested_inputs(spark, store):
    rows = spark.sql("SELECT array('a', null) AS v, map('x', 1, 'y', 2) AS m UNION ALL SELECT array('a'), map('y', 2, 'x', 1) UNION ALL SELECT array('a', null), map('y', 2, 'x', 1)")
    t = memo.Task("nested", 1, lambda rows: pd.DataFrame({"n": [len(v) for v in rows["v"]]}), ("v", "m"), memo.T._parse_datatype_string("n long"))
    out = memo.submit(t, rows, store).collect()
    assert sorted(r.value.n for r in out) == [1, 2, 2]
    assert len({r.key for r in out}) == 2


def file_of(rows):
    return pd.DataFrame({"f": [{"path": f"p{i}", "byte_size": i, "hash": 7, "mutable": i == 3} for i in rows["i"]]})


def test_hits_are_verified(spark, store):
    t = memo.Task("files", 1, file_of, ("i",), memo.T._parse_datatype_string("f struct<path string, byte_size long, hash long, mutable boolean>"))
    rows = spark.createDataFrame([(i,) for i in range(1, 5)], "i long")
    memo.submit(t, rows, store)
    listing = spark.createDataFrame([("p1", 1, 7), ("p2", 2, 8), ("p3", 9, 9)], "path string, byte_size long, hash long")
    answers = lambda **kw: {r.i: r.from_cache for r in memo.submit(t, rows, store, no_cache=True, **kw).collect()}
    assert answers() == dict.fromkeys(range(1, 5), True)
    assert answers(listing=listing) == {1: True, 2: False, 3: True, 4: False}
    spark.conf.set("spark.larkspur.check_content", "false")
    try:
        assert answers(listing=listing) == {1: True, 2: True, 3: True, 4: False}
        spark.conf.set("spark.larkspur.verify_files", "false")
        assert answers(listing=listing) == dict.fromkeys(range(1, 5), True)
        spark.conf.set("spark.larkspur.cache_enabled", "false")
        assert answers() == dict.fromkeys(range(1, 5), False)
    finally:
        for name in ("check_content", "verify_files", "cache_enabled"):
            spark.conf.unset(f"spark.larkspur.{name}")


def test_failing_lookup_is_a_miss(spark, store, monkeypatch):
    rows = spark.createDataFrame([(1,)], "i long")
    memo.submit(make(), rows, store)
    monkeypatch.setattr(memo.Store, "table", lambda self, t=None: spark.read.parquet("/nowhere"))
    with pytest.warns(UserWarning, match="lookup"):
        assert not memo.submit(make(), rows, store, no_cache=True).first().from_cache


def test_failed_keys_run_again(spark, store, tmp_path):
    mark = str(tmp_path / "mark")
    t = memo.Task("flaky", 1, flaky, ("i", "mark"), memo.T._parse_datatype_string("n long"))
    rows = spark.createDataFrame([(1, mark)], "i long, mark string")
    assert memo.submit(t, rows, store, attempts=2).first().value.n == 1
    assert memo.submit(t, rows, store).first().from_cache


def flaky(rows):
    import os

    if not os.path.exists(rows["mark"][0]):
        open(rows["mark"][0], "w").close()
        raise OSError("not yet")
    return pd.DataFrame({"n": rows["i"]})


def test_node_local_resource():
    import threading

    made, gone, seen = [], [], []

    def use(hold):
        with memo.node_local("r", lambda: made.append(1) or object(), gone.append) as value:
            seen.append(value)
            hold.wait(5)

    hold = threading.Event()
    users = [threading.Thread(target=use, args=(hold,)) for _ in range(5)]
    for u in users:
        u.start()
    while len(seen) < 5:
        pass
    assert (len(made), len(set(map(id, seen))), gone) == (1, 1, [])
    hold.set()
    for u in users:
        u.join()
    assert len(gone) == 1
    with memo.node_local("r", lambda: made.append(1) or object(), gone.append):
        assert len(made) == 2
    with pytest.raises(ZeroDivisionError), memo.node_local("r", lambda: 1 / 0):
        pass
    with memo.node_local("r", lambda: 5) as value:
        assert value == 5
