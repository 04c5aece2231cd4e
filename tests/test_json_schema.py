"""Schemas compiled to expressions against the value-by-value validator, and both on hostile texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bitloom.functions import json_schema as J, variant_schema as V
from bitloom.plans import analysis_queries as Q

from . import oracle

NAMES = ["a", "b", "é", "a b", "A"]
SCALARS = [None, True, False, 0, 1, 1.0, 2.5, -3, 10**17, 1e2, "", "x", "xy", "é1", "1", "\n"]


def value(r, depth=3):
    k = r.random()
    if depth and k < 0.3:
        return [value(r, depth - 1) for _ in range(r.randrange(4))]
    if depth and k < 0.65:
        return {n: value(r, depth - 1) for n in r.sample(NAMES, r.randrange(4))}
    return r.choice(SCALARS)


def schema(r, depth=3):
    s = {}
    few = lambda p: r.random() < p
    if few(0.6):
        s["type"] = r.choice(["object", "array", "string", "integer", "number", "boolean", "null", ["string", "null"], ["object", "array"], ["integer", "boolean"]])
    if few(0.12):
        s["const"] = r.choice([*SCALARS, [1], {"a": 1}])
    if few(0.12):
        s["enum"] = r.sample(SCALARS, 3) + [["x"]]
    for name, v in (("minLength", 1), ("maxLength", 1), ("minimum", 1), ("maximum", 2.5), ("exclusiveMinimum", 0), ("minItems", 1), ("maxItems", 2), ("uniqueItems", True), ("pattern", r.choice(["^x", "\\d", "\\S"]))):
        if few(0.12):
            s[name] = v
    if depth:
        if few(0.5):
            s["properties"] = {n: schema(r, depth - 1) for n in r.sample(NAMES, r.randrange(1, 4))}
        if few(0.3):
            s["required"] = r.sample(NAMES, r.randrange(1, 3))
        if few(0.4):
            s["additionalProperties"] = r.choice([False, True, schema(r, depth - 1)])
        if few(0.4):
            s["items"] = r.choice([schema(r, depth - 1), False])
        if few(0.15):
            s["anyOf"] = [schema(r, depth - 1) for _ in range(2)]
        if few(0.1):
            s["allOf"] = [schema(r, depth - 1)]
        if few(0.1):
            s["not"] = schema(r, depth - 1)
        if few(0.1):
            s["if"], s[r.choice(["then", "else"])] = schema(r, 0), schema(r, depth - 1)
        if few(0.1):
            s["$ref"] = "#/$defs/d"
    return s


@pytest.mark.parametrize("seed", range(2))
def test_random_schemas(spark, seed):
    """The compiled first error is that of the reference validator, for each schema and value."""
    r = random.Random(seed)
    texts = [json.dumps(value(r), ensure_ascii=r.random() < 0.5) for _ in range(80)]
    schemas = []
    for _ in range(10):
        s = schema(r)
        s["$defs"] = {"d": {"type": ["object", "string", "array"], "minLength": 1}}
        schemas.append(s)
    d = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = d.select("id", *(V.first_error(d["t"], s).alias(f"e{i}") for i, s in enumerate(schemas))).collect()
    hits = 0
    for row in out:
        for i, s in enumerate(schemas):
            want = J.first_error(texts[row.id], s)
            hits += want is not None
            assert row[f"e{i}"] == want, (s, texts[row.id])
    assert hits > 100


HOSTILE = [
    None, "", " ", "1 2", '{"a":1}x', "1],[2", '1}x', "[1,]", "{'a':1}", "NaN", '{"a":1,"a":2}', "[" * 200_000, "[" * 200_000 + "]" * 200_000, '{"a":' * 5000 + "1" + "}" * 5000,
    "[" * 999 + "]" * 999, "[" * 1000 + "]" * 1000, '"' + "[" * 5000 + '"', '"\\"' + "{" * 3000 + '"', "01", "1e400", '"a\tb"', " {\n} ", "123456789012345678901234567890", "tru",
]


def test_hostile_texts(spark):
    s = {"type": ["object", "array", "string", "number"]}
    d = spark.createDataFrame([(i, t) for i, t in enumerate(HOSTILE)], "id int, t string")
    got = {r.id: r.problem for r in J.validate(d, "t", s).collect()}
    assert got == {i: J.first_error(t, s) for i, t in enumerate(HOSTILE)}
    assert [i for i, p in got.items() if p is None] == [14, 16, 17, 19, 21, 22]


def test_recursive_schema(spark):
    tree = {"$ref": "#/$defs/n", "$defs": {"n": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer"}, "kids": {"type": "array", "items": {"$ref": "#/$defs/n"}}}}}}
    with pytest.raises(V.Unsupported):
        V.first_error(spark.range(1)["id"], tree)
    rows = ['{"v":1,"kids":[{"v":2},{"v":"x"}]}', '{"v":1,"kids":[{}]}', '{"v":3}', "[" * 5000]
    d = spark.createDataFrame([(t, "kept") for t in rows], "t string, problem string")
    assert [r.problem for r in J.validate(d, "t", tree).collect()] == ["$.kids[1].v: not integer", "$.kids[0]: lacks v", None, "$: not JSON"]


def test_no_python(spark):
    d = spark.createDataFrame([("{}",)], "t string")
    plan = J.validate(d, "t", Q.EVENT_SCHEMA)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["event_schema", "nested_schema"])
def test_queries(spark, name):
    got = oracle.rows(Q.QUERIES[name](spark, oracle.SF))
    assert got == oracle.expected(Q.SQL[name]) and len(got[1]) > 1


def test_checks_of_one_partition_are_dealt_out(spark):
    """A small file is one partition, whose texts would all be checked by one task."""
    d = spark.createDataFrame([(i, '{"a": 1}') for i in range(400)], "k int, t string").coalesce(1)
    checked = J.validate(d, "t", {"type": "object", "required": ["b"]})
    sizes = checked.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(x[1] for x in sizes) <= 150 and checked.where("problem is null").count() == 0
