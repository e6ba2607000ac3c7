"""Functions for SQL: objects inside texts, and the nearest-rank percentile.

``register(spark)`` makes both known to ``spark.sql``:

* ``json_objects(text, key, value)``, a table function for lateral joins, gives
  ``seq, object`` for every JSON object inside the text, prose around it allowed,
  whose innermost braces hold ``"key": "value"``; the last place in the text first.
* ``nearest_rank(values, percent)`` is the percentile of an array at place
  ``floor(n * percent / 100)``, counted from 0; nulls in the array don't count.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

NEAREST_RANK = """
    CREATE OR REPLACE TEMPORARY FUNCTION nearest_rank(measured ARRAY<DOUBLE>, percent INT) RETURNS DOUBLE
    RETURN get(array_sort(array_compact(measured)), CAST(least(size(array_compact(measured)) * percent div 100, size(array_compact(measured)) - 1) AS INT))"""


def objects_with(text: str, key: str, value: str) -> Iterator[dict]:
    """JSON objects around each ``"key": "value"`` of a text, last first, innermost only."""
    decoder = json.JSONDecoder()
    named = re.compile(re.escape(json.dumps(key)) + r"\s*:\s*" + re.escape(json.dumps(value)))
    for hit in reversed(list(named.finditer(text))):
        brace = text.rfind("{", 0, hit.start())
        while brace >= 0:
            try:
                found, end = decoder.raw_decode(text, brace)
            except ValueError:
                found, end = None, -1
            if end >= hit.end() and isinstance(found, dict):
                yield found
                break
            brace = text.rfind("{", 0, brace)


def compact(value: dict) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


class JsonObjects:
    """Rows of ``json_objects``; a null text, key or value has none."""

    def eval(self, text: str, key: str, value: str):
        if text is not None and key is not None and value is not None:
            for seq, found in enumerate(objects_with(text, key, value)):
                yield seq, compact(found)


def register(spark: SparkSession) -> None:
    """Make ``json_objects`` and ``nearest_rank`` known to the session; doing it again changes nothing."""
    spark.udtf.register("json_objects", udtf(JsonObjects, returnType="seq int, object string", useArrow=True))
    spark.sql(NEAREST_RANK)
