"""Section-wise updates of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _trim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+$", "")


def _trim_start(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+", "")


def _apply(text: Column, update: Column) -> Column:
    """One update: replace a section up to the next second-level heading, else append."""
    new = F.coalesce(update["content"], F.lit(""))
    section = F.coalesce(update["section"], F.lit(""))
    start = F.when(section != "", F.instr(text, section)).otherwise(0)
    following = F.locate("\n## ", F.substr(text, start + 1), 1)
    tail = F.when(following > 0, F.substr(text, start + following)).otherwise("")
    replaced = F.concat(
        _trim_end(F.substr(text, F.lit(1), start - 1)),
        F.lit("\n\n"),
        _trim_start(_trim_end(new)),
        F.lit("\n\n"),
        _trim_start(tail),
    )
    modified = F.when(start > 0, replaced).otherwise(F.concat(text, F.lit("\n\n"), new))
    return F.when((update["type"] == "modify") & text.isNotNull(), modified).otherwise(new)


def apply_doc_updates(docs: DataFrame, updates: DataFrame) -> DataFrame:
    """Content of every updated document after its updates, in order.

    ``docs(repo, path, content)``, ``updates(repo, path, seq, type, section,
    content)``.  The updates of one document are folded inside one row; a
    missing document is created.
    """
    ordered = updates.groupBy("repo", "path").agg(
        F.sort_array(F.collect_list(F.struct("seq", "type", "section", "content"))).alias("updates")
    )
    return (
        ordered.join(docs, ["repo", "path"], "left")
        .withColumn("existed", F.col("content").isNotNull())
        .withColumn("content", F.aggregate("updates", F.col("content"), _apply))
        .drop("updates")
    )
