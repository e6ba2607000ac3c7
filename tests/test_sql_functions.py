"""Functions that SQL can call."""

import json

import pytest

from gatelake.functions import sql
from gatelake.plans import extract


@pytest.fixture(scope="module", autouse=True)
def known(spark):
    sql.register(spark)
    sql.register(spark)


TEXTS = [
    (1, 'Here {it} is: {"v":"1","a":{"b":"}"},"c":"\\"{"} and so on'),
    (2, 'first {"v": "1", "n": 1} then {"x": {"v":"1","n":2}}'),
    (3, '{"v":"2"} {"v":1}'), (4, None), (5, ""), (6, '{"v":"1"'), (7, '[{"v":"1","é":"\\u00e9 ü"}]'), (8, 'deep {"a":{"b":[{"c":{"v":"1"}}]}}'),
]


def test_json_objects_in_a_lateral_join(spark):
    spark.createDataFrame(TEXTS, "id int, text string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT t.id, o.seq, o.object FROM texts t, LATERAL json_objects(t.text, 'v', '1') o ORDER BY id, seq").collect()
    got = [(r.id, r.seq, json.loads(r.object)) for r in rows]
    assert got == [
        (1, 0, {"v": "1", "a": {"b": "}"}, "c": '"{'}), (2, 0, {"v": "1", "n": 2}), (2, 1, {"v": "1", "n": 1}),
        (7, 0, {"v": "1", "é": "é ü"}), (8, 0, {"v": "1"}),
    ]
    assert spark.sql(r"""SELECT * FROM json_objects('x {"k":"a\\"b"}', 'k', 'a"b')""").count() == 1
    assert spark.sql("SELECT * FROM json_objects(NULL, 'k', 'v')").count() == 0


def test_nearest_rank(spark):
    spark.range(1, 21).selectExpr("collect_list(CAST(id AS DOUBLE)) AS v").createOrReplaceTempView("samples")
    assert spark.sql("SELECT nearest_rank(v, 95) AS p95, nearest_rank(v, 50) AS p50, nearest_rank(v, 100) AS top FROM samples").first()[:] == (20.0, 11.0, 20.0)
    assert spark.sql("SELECT nearest_rank(array(3.0D, NULL, 1.0D), 50), nearest_rank(array(), 50), nearest_rank(NULL, 50)").first()[:] == (3.0, None, None)


def test_assistant_text(spark):
    docs = [
        [{"role": "user", "content": "no"}, {"role": "assistant", "content": "one"}],
        {"messages": [{"role": "assistant", "content": [{"type": "text", "text": "two"}, {"type": "tool", "text": "no"}, "x", {"type": "text"}]}, 7,
                      {"role": "assistant", "content": "three"}, {"role": "assistant"}]},
        {"messages": "none"}, 5, [[1]],
    ]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(9, "{broken"), (10, None)]
    got = spark.createDataFrame(rows, "i int, raw string").select("i", extract.assistant_text(extract.F.col("raw")).alias("t")).collect()
    assert {r.i: r.t or "" for r in got} == {0: "one", 1: "two\nthree", 2: "", 3: "", 4: "", 9: "", 10: ""}
