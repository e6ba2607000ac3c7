"""Prompt tables for batch inference: resolution and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_prompts(requests: DataFrame, prompts: DataFrame, commands: str = "commands/", skills: str = "skills/") -> DataFrame:
    """Text and source of the prompt of each request.

    ``requests(request_id, task, direct_prompt, caller_path)``,
    ``prompts(path, text)``.  A direct text wins, then a slash command, then
    the caller's file, then the built-in of the task.  A slash command or
    caller file that does not exist is an error and never falls through.
    """
    direct = F.coalesce("direct_prompt", F.lit(""))
    caller = F.coalesce("caller_path", F.lit(""))
    source = (
        F.when(direct.startswith("/"), "slash-command")
        .when(direct != "", "direct")
        .when(caller != "", "caller")
        .otherwise("builtin")
    )
    builtin = F.concat(F.lit(skills), F.regexp_replace("task", "^([^/]*)/", "$1-"), F.lit("/SKILL.md"))
    path = (
        F.when(F.col("source") == "slash-command", F.concat(F.lit(commands), F.substr("direct_prompt", F.lit(2)), F.lit(".md")))
        .when(F.col("source") == "caller", F.col("caller_path"))
        .when(F.col("source") == "builtin", builtin)
    )
    # Of several texts of a path the first in order counts.
    known = prompts.groupBy("path").agg(F.min("text").alias("__text"))
    return (
        requests.withColumn("source", source)
        .withColumn("path", path)
        .join(known, "path", "left")
        .withColumn("text", F.when(F.col("source") == "direct", F.col("direct_prompt")).otherwise(F.col("__text")))
        .withColumn("error", F.when(F.col("text").isNull(), F.concat(F.lit("prompt not found: "), "path")))
        .drop("__text")
    )


def render_prompts(requests: DataFrame, text: str = "text", context: str = "context", automatic: str = "automatic") -> DataFrame:
    """Fill ``{{ key }}`` from the context map, then from the automatic map; unknown keys stay."""

    def fill(acc: Column, entry: Column) -> Column:
        # A key stands for itself, not for a pattern; a missing value fills nothing.
        name = F.concat(F.lit("\\Q"), F.replace(entry["key"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        quoted = F.regexp_replace(F.regexp_replace(entry["value"], r"\\", r"\\\\"), r"\$", r"\\\$")
        filled = F.regexp_replace(acc, F.concat(F.lit(r"\{\{\s*"), name, F.lit(r"\s*\}\}")), quoted)
        return F.coalesce(filled, acc)

    entries = F.concat(F.map_entries(context), F.map_entries(automatic))
    return requests.withColumn("rendered", F.aggregate(entries, F.col(text), fill))
