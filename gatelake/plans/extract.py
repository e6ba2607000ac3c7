"""From transcripts to plans and final texts.

Every strategy looks at one transcript record at a time and yields candidates
with a rank and a position, so the choice per run is an ordinary aggregate and
a long run is never held in one place.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gatelake.functions.sql import compact, objects_with, register
from gatelake.plans.schemas import VERSIONS, fallback_plan

CANDIDATES = T.ArrayType(
    T.StructType(
        [T.StructField("rank", T.IntegerType()), T.StructField("seq", T.IntegerType()), T.StructField("plan", T.StringType())]
    )
)
RECORDS = T.ArrayType(
    T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType())])
)


def walk(value) -> Iterator:
    """A JSON value and everything inside it, parents first."""
    yield value
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        yield from walk(child)


def _record_candidates(raw: str, version: str, head: str) -> list[tuple[int, int, str]]:
    try:
        record = json.loads(raw)
    except ValueError:
        return []
    found = []
    if isinstance(record, dict) and record.get("version") == version:
        found.append((1, 0, compact(record)))
    nodes = list(walk(record))
    for seq, node in enumerate(nodes):
        if isinstance(node, dict):
            if node.get("version") == version:
                found.append((2, seq, compact(node)))
            if head in node or "actions" in node:
                found.append((4, seq, compact({**node, "version": version})))
        elif isinstance(node, str) and version in node:
            plan = next((p for p in objects_with(node, "version", version) if p.get("version") == version), None)
            if plan is not None:
                found.append((3, seq, compact(plan)))
    return found


def plan_candidates(domain: str):
    """Arrow UDF over transcript records for one plan domain."""
    version = VERSIONS[domain]
    head = "reasoning" if domain == "issue" else "summary"

    @F.pandas_udf(CANDIDATES)
    def candidates(raws: pd.Series) -> pd.Series:
        found = [_record_candidates(raw, version, head) for raw in raws]
        return pd.Series([[{"rank": r, "seq": s, "plan": p} for r, s, p in rows] for rows in found])

    return candidates


def assistant_text(raw: Column) -> Column:
    """Texts of the assistant in a transcript that is one document, a list of messages or an object with such a list.

    A message holds a text or typed blocks; what is neither is passed over.
    """
    document = F.try_parse_json(raw)
    as_list = lambda v, path: F.try_variant_get(v, path, "array<variant>")
    messages = F.coalesce(as_list(document, "$"), as_list(document, "$.messages"))
    own = F.filter(messages, lambda m: F.try_variant_get(m, "$.role", "string") == "assistant")
    whole = lambda m: F.array(F.try_variant_get(m, "$.content", "string"))
    typed = lambda m: F.transform(
        F.filter(as_list(m, "$.content"), lambda b: F.try_variant_get(b, "$.type", "string") == "text"),
        lambda b: F.try_variant_get(b, "$.text", "string"),
    )
    return F.array_join(F.flatten(F.transform(own, lambda m: F.coalesce(typed(m), whole(m)))), "\n")


def _docs_plans(transcripts: DataFrame) -> DataFrame:
    """The last docs plan in the assistant's texts of each document; only texts that hold the version are searched."""
    spark, version = transcripts.sparkSession, VERSIONS["docs"]
    register(spark)
    told = transcripts.select("run_id", "line_no", assistant_text(F.col("raw")).alias("text")).filter(F.contains("text", F.lit(version)))
    found = spark.sql(
        "SELECT t.run_id, t.line_no, 1 AS rank, -o.seq AS seq, o.object AS plan "
        f"FROM {{told}} AS t, LATERAL json_objects(t.text, 'version', '{version}') AS o",
        told=told,
    )
    return found.filter(F.get_json_object("plan", "$.version") == version)


def extract_plans(transcripts: DataFrame, runs: DataFrame, domain: str) -> DataFrame:
    """One plan per run, with its hash.

    ``transcripts(run_id, line_no, raw, shape)``, ``runs(run_id, skipped)``.
    Preference: a record that is the plan (first), a nested plan (last), a plan
    inside a text (last), an object that looks like one (last, version added);
    otherwise the fallback plan for a skipped, missing or unreadable run.
    Only records that mention a plan key reach Python.
    """
    keys = ["version"] if domain == "docs" else ["version", "actions", "reasoning" if domain == "issue" else "summary"]
    mention = F.col("raw").rlike("|".join(keys)) & (F.col("shape") != "text")
    if domain == "docs":
        mention = mention & (F.col("shape") == "json")
    if domain == "docs":
        spotted = _docs_plans(transcripts.filter(mention))
    else:
        spotted = (
            transcripts.filter(mention)
            .select("run_id", "line_no", F.explode(plan_candidates(domain)("raw")).alias("c"))
            .select("run_id", "line_no", "c.rank", "c.seq", "c.plan")
        )
    # The first record of rank 1 and the last of every other rank is preferred.
    late = F.when(F.col("rank") == 1, F.col("line_no")).otherwise(-F.col("line_no"))
    order = F.struct("rank", late.alias("line"), (-F.col("seq")).alias("seq"), F.col("plan").alias("plan"))
    chosen = spotted.groupBy("run_id").agg(F.min(order).alias("best"))
    present = transcripts.select("run_id").distinct().withColumn("present", F.lit(True))
    plan = F.when(F.col("skipped"), F.lit(fallback_plan(domain, "skip"))).otherwise(
        F.coalesce(
            F.when(_acceptable(domain), F.col("best.plan")),
            F.when(F.col("present"), F.lit(fallback_plan(domain, "fail"))),
            F.lit(fallback_plan(domain, "missing" if domain == "issue" else "fail")),
        )
    )
    source = (
        F.when(F.col("skipped"), "skipped")
        .when(F.col("present").isNull(), "missing")
        .when(F.col("best").isNull() | ~_acceptable(domain), "fallback")
        .otherwise(F.get(F.array(*[F.lit(s) for s in ("record", "nested", "text", "shaped")]), F.col("best.rank") - 1))
    )
    return (
        runs.join(chosen, "run_id", "left")
        .join(present, "run_id", "left")
        .select("run_id", plan.alias("plan_json"), source.alias("source"))
        .withColumn("plan_hash", F.sha2("plan_json", 256))
    )


def _acceptable(domain: str):
    """Docs plans must be well formed to be taken over their fallback."""
    if domain != "docs":
        return F.col("best").isNotNull()
    from gatelake.plans.evaluate import plan_violations

    return F.size(plan_violations(F.col("best.plan"), "docs")) == 0


@F.pandas_udf(RECORDS)
def _nested_records(raws: pd.Series) -> pd.Series:
    """Result and assistant records at any depth, with their text."""

    def records(raw: str) -> list[dict]:
        try:
            nodes = [n for n in walk(json.loads(raw)) if isinstance(n, dict)]
        except ValueError:
            return []
        out = []
        for node in nodes:
            if node.get("type") == "result" and isinstance(node.get("result"), str):
                out.append({"type": "result", "text": node["result"]})
            elif node.get("type") == "assistant":
                message = node.get("message")
                content = (message.get("content") if isinstance(message, dict) else None) or node.get("content")
                if isinstance(content, list):
                    blocks = [b.get("text") or "" for b in content if isinstance(b, dict) and b.get("type") == "text"]
                    out.append({"type": "assistant", "text": "".join(blocks)})
        return out

    return pd.Series([records(raw) for raw in raws])


def final_text(transcripts: DataFrame) -> DataFrame:
    """Final answer of each run.

    Last non-empty result; else the last assistant text with its blocks joined;
    else the first ``.result`` of a record; else the whole text when the run is
    not JSON; else empty.  A record with a single top-level mark is read by
    built-in JSON functions; only deeper ones go through Python.
    """
    marks = F.size(F.regexp_extract_all("raw", F.lit(r'"type"\s*:\s*"(result|assistant)"'), F.lit(1)))
    json_rows = transcripts.filter("shape <> 'text'").withColumn("marks", marks)
    kind = F.get_json_object("raw", "$.type")
    flat = (F.col("marks") == 0) | ((F.col("marks") == 1) & kind.isin("result", "assistant"))
    blocks = F.coalesce(
        F.from_json("raw", "message struct<content:array<struct<type:string,text:string>>>")["message"]["content"],
        F.from_json("raw", "content array<struct<type:string,text:string>>")["content"],
    )
    joined = F.array_join(
        F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), ""
    )
    text = F.from_json("raw", "result string")["result"]
    quick = json_rows.filter(F.coalesce(flat, F.lit(False))).select(
        "run_id",
        "line_no",
        F.lit(0).alias("seq"),
        F.when(F.col("marks") == 1, kind).alias("type"),
        F.when(F.col("marks") == 1, F.when(kind == "result", text).otherwise(joined)).alias("text"),
        text.alias("own"),
    )
    deep = (
        json_rows.filter(~F.coalesce(flat, F.lit(False)))
        .select("run_id", "line_no", text.alias("own"), F.posexplode_outer(_nested_records("raw")).alias("seq", "r"))
        .select("run_id", "line_no", F.coalesce("seq", F.lit(0)).alias("seq"), "r.type", "r.text", "own")
    )
    plain = transcripts.filter("shape = 'text'").select(
        "run_id", "line_no", F.lit(0).alias("seq"), F.lit("plain").alias("type"), F.col("raw").alias("text"),
        F.lit(None).cast("string").alias("own"),
    )
    rows = quick.unionByName(deep).unionByName(plain)
    where = F.struct("line_no", "seq", "text")
    last = lambda t: F.max(F.when((F.col("type") == t) & (F.col("text") != ""), where))["text"]
    first_own = F.min(F.when(F.col("own").isNotNull(), F.struct("line_no", "own")))["own"]
    return rows.groupBy("run_id").agg(
        F.coalesce(
            last("result"), last("assistant"), F.nullif(F.substring_index(first_own, "\n", 1), F.lit("")), last("plain"), F.lit("")
        ).alias("text")
    )
