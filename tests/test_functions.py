from base64 import b64encode

import pytest
from pyspark.sql import functions as F

from larkspur.functions import keys, resources, scalars
from larkspur.functions.resources import Supply
from larkspur.functions.selectors import And, Has, Not, Or, affinity_labels, from_json, matches, to_json


def holds(spark, selector, labels):
    return spark.createDataFrame([(labels,)], "labels array<string>").select(matches(selector)).first()[0]


@pytest.mark.parametrize(
    ("selector", "cases"),
    [
        (Has("gpu:a100"), [(["gpu:a100"], True), (["gpu:v100"], False), ([], False)]),
        (Not(Has("spot")), [(["on-demand"], True), (["spot"], False)]),
        (And((Has("us-east"), Has("a100"))), [(["us-east", "a100"], True), (["us-east"], False), ([], False)]),
        (Or((Has("a"), Has("b"))), [(["a"], True), (["b"], True), (["c"], False)]),
        (And((Has("us-east"), Not(Has("spot")))), [(["us-east", "on-demand"], True), (["us-east", "spot"], False), (["us-west"], False)]),
        (And(), [([], True)]),
        (Or(), [([], False)]),
        (None, [([], True)]),
    ],
)
def test_selector(spark, selector, cases):
    for labels, want in cases:
        assert holds(spark, selector, labels) is want
    assert from_json(to_json(selector)) == selector


def test_selector_depth():
    text = '{"not":' * 100 + '{"always":true}' + "}" * 100
    with pytest.raises(ValueError, match="nests"):
        from_json(text)


def test_affinity():
    assert affinity_labels(And((Has("prod"), Not(And((Has("spot"),)))))) == ["prod"]
    assert affinity_labels(Or((Has("a"), Has("b"), Has("a")))) == ["a", "b"]


def supply(spark, gpu):
    return spark.createDataFrame([(4, 1000, 10, gpu, None)], "cpu int, memory int, scratch int, gpu array<int>, image string")


def test_gpu_algebra(spark):
    df = supply(spark, [0, 1, 2, 3])
    grant = lambda ids: Supply(F.lit(0), F.lit(0), F.lit(0), F.array(*map(F.lit, ids)), F.lit(None).cast("string"))
    one = resources.subtract(Supply.of(), grant([0, 1]))
    two = resources.subtract(one, grant([2, 3]))
    back = resources.add_back(resources.add_back(two, grant([2, 3])), grant([0, 1]))
    assert df.select(one.gpu, two.gpu, back.gpu).first() == ([2, 3], [], [0, 1, 2, 3])
    with pytest.raises(Exception, match="returned twice"):
        df.select(resources.add_back(Supply.of(), grant([1])).gpu).collect()


def test_gpu_validity(spark):
    for ids, want in (([0, 1], True), ([1, 0], False), ([0, 0, 1], False), ([], True)):
        assert supply(spark, ids).select(resources.valid_gpus("gpu")).first()[0] is want


def test_hashes(spark):
    row = spark.createDataFrame([("abcd",)], "t string").select(scalars.content_hash("t")).first()
    assert row[0] == -486772404
    assert scalars.java_hash("hello") == 99162322
    assert scalars.java_hash("") == 0
    a, b = spark.createDataFrame([(None, "x"), ("", "x")], "a string, b string").select(keys.data_hash("a", "b")).collect()
    assert a != b


def test_base64_is_one_line(spark):
    texts = ["", "é", "x" * 57, "x" * 58, "line\r\n" * 40]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.base64("t")).collect()
    assert [r[0] for r in got] == [b64encode(t.encode()).decode() for t in texts]


def test_new_optional_field_keeps_key(spark):
    one = spark.sql("SELECT named_struct('data1', 1) AS s").select(keys.nested_text("s")).first()[0]
    two = spark.sql("SELECT named_struct('data1', 1, 'data2', CAST(NULL AS INT)) AS s").select(keys.nested_text("s")).first()[0]
    assert one == two


def test_session_of(spark):
    cases = {"abc123~Launcher-x": "abc123", "Launcher-1": None, "abc123~a~b~c": "abc123", "~leading": None}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r[0]: r[1] for r in df.select("p", scalars.session_of("p")).collect()} == cases


def test_part_size(spark):
    cases = {(5, 800): 5, (5, 801): 10, (5, 1601): 20, (5, 2401): 40}
    for (mb, part), want in cases.items():
        assert spark.range(1).select(scalars.part_size(F.lit(part), mb * 1_000_000)).first()[0] == want * 1_000_000
    assert spark.range(1).select(scalars.part_size(F.lit(10_000), 100_000_000)).first()[0] == 1_900_000_000


def test_configured_gpus(spark):
    df = spark.createDataFrame([([2, 0], "1, 2")], "a array<int>, b string")
    assert df.select(scalars.gpu_ids("a", "b")).first()[0] == [0, 1, 2]
    assert df.select(scalars.label_set(F.array(F.lit(" x ")), F.lit("y,,x"))).first()[0] == ["x", "y"]
