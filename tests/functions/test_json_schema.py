import pytest
from pyspark.sql import functions as F

from loomlog.functions import json_schema as js


@pytest.fixture
def tags(spark):
    js.allow_duplicate_keys(spark)

    def of(*texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, v string")
        return [r.t for r in df.select("i", js.fields(F.col("v")).alias("t")).orderBy("i").collect()]

    return of


def test_inference(tags):
    text = '{"city":"Oslo","floors":12,"open":false,"height":41.25,"none":null,"doors":[3],"roof":{"flat":1}}'
    assert tags(text) == [{"city": "string", "floors": "integer", "open": "boolean", "height": "number", "none": "null", "doors": "array", "roof": "object"}]
    assert tags('{"a":1.0,"b":1e2,"c":1e30,"d":1,"d":"x"}') == [{"a": "integer", "b": "integer", "c": "number", "d": "string"}]


def test_strictness(tags):
    bad = ["not json", "", '{"a":1} x', '{"a":1}{"b":2}', '{"a":1},{"b":2}', '{"a":1}],[2', "{'a':1}", '{"a":NaN}', '{"a":01}', "[1]", "1", '"x"', '{"a":1e999}', None]
    assert tags(*bad) == [None] * len(bad)
    assert tags("null", " {} ") == [{}, {}]


@pytest.mark.parametrize(
    ("schema", "payload", "valid"),
    [
        (None, '{"sensor":"t-7","celsius":21.75}', True), (None, "<xml/>", True),
        ({"sensor": "string", "celsius": "number"}, '{"sensor":"t-7","celsius":21.75}', True),
        ({"sensor": "string"}, '{"sensor":[7]}', False),
        ({"sensor": "string", "celsius": "number"}, '{"sensor":"t-7"}', False),
        ({"sensor": "string"}, "<xml/>", False),
        ({"celsius": "number"}, '{"celsius":-3,"wet":true}', True),
        ({"celsius": "integer"}, '{"celsius":0.5}', False), ({}, "null", True), ({}, "[]", False),
    ],
)
def test_validation(spark, schema, payload, valid):
    js.allow_duplicate_keys(spark)
    df = spark.createDataFrame([(payload, schema)], "v string, s map<string,string>")
    assert df.select(js.validates(js.fields(F.col("v")), F.col("s")).alias("x")).first().x is valid
