"""Five stages that turn ``documents`` into a mixed and sharded training corpus.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next one's input. ``run`` applies them to ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import decontaminate, mixing, sharding, simhash, toxicity
from gatelake.llm.queries import WORD, table
from gatelake.session import configure, cut_lineage


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are more likely toxic than not, by the labelled ones."""
    model = toxicity.train(docs, "doc_id", "text", table(spark, sf_dir, "labels"), "toxic")
    return toxicity.drop_toxic(docs, "text", model)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of fingerprints at most four bits apart."""
    return simhash.keep_one(docs, "doc_id", "text", width=4, radius=4)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    return decontaminate.drop_contaminated(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that each source meets its share of words."""
    return mixing.apply_mix(docs, "doc_id", F.regexp_count("text", F.lit(WORD)), "source")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard, from 0 to 39, of every row."""
    return sharding.assign_shards(docs, "doc_id", [1.0] * 40)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Fingerprints, regression and rounding have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(configure(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
