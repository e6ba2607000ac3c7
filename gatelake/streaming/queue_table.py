"""A queue of delayed requests that retires what has fired.

The queue is a set of Parquet folders and a manifest that names those which count.
Every change writes its folders first and becomes visible by one renaming: that
of the next manifest.  A change that dies before it leaves folders nobody
reads, and is simply done again.

* Requests of a micro-batch are one folder.  A batch that the manifest has seen is
  not taken twice, also after its folder has been merged away.
* A poll writes the due entries as one folder, which is the record of what
  fired and at the same time their tombstones.
* Compaction merges what is still waiting into one folder.  Tombstones are kept for
  ``keep`` behind the newest request; requests older than that are refused, so a
  fired entry can't come back.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.functions.timeline import micros
from gatelake.streaming.queues import schedule

# Fixed values -------------------------------------------------------------
KEEP_HOURS = 24 * 30
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class Manifest:
    """What counts: folders read by the queue, folders of fired entries, batches taken, refused instants."""

    version: int = 0
    live: list[str] = field(default_factory=list)
    fired: list[str] = field(default_factory=list)
    batches: dict[str, int] = field(default_factory=dict)
    polls: list[str] = field(default_factory=list)
    refused_us: int | None = None
    columns: list[list[str]] | None = None

    @property
    def schema(self) -> str | None:
        return self.columns and ", ".join(f"`{name}` {kind}" for name, kind in self.columns)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _versions(spark: SparkSession, base: str) -> list[int]:
    files, where = _files(spark, f"{base}/manifest")
    if not files.exists(where):
        return []
    names = [s.getPath().getName() for s in files.listStatus(where)]
    return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit())


def read_manifest(spark: SparkSession, base: str) -> Manifest:
    versions = _versions(spark, base)
    if not versions:
        return Manifest()
    return Manifest(**json.loads(spark.read.text(f"{base}/manifest/v{versions[-1]}").first()[0]))


def _publish(spark: SparkSession, base: str, manifest: Manifest) -> None:
    """Make the manifest the current one, unless another writer has been faster."""
    row = spark.createDataFrame([(json.dumps(asdict(manifest)),)], "value string")
    draft = f"{base}/manifest/draft-{uuid.uuid4().hex}"
    row.coalesce(1).write.text(draft)
    files, source = _files(spark, draft)
    _, target = _files(spark, f"{base}/manifest/v{manifest.version}")
    if files.exists(target) or not files.rename(source, target):
        raise RuntimeError(f"version {manifest.version} of {base} was written by another job")


def _rows(spark: SparkSession, base: str, names: list[str], schema: str) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/log/{n}" for n in names])


def _newest(rows: DataFrame, key: str) -> DataFrame:
    """The last word on each key: the newest request, or its tombstone."""
    rest = [c for c in rows.columns if c not in (key, "queued_us", "entry_id", "removed")]
    last = F.max(F.struct("queued_us", "entry_id", "removed", *rest)).alias("e")
    return rows.groupBy(key).agg(last).select(key, "e.*").select(*rows.columns)


def add_requests(batch: DataFrame, batch_id: int, base: str, run: str) -> None:
    """Take the requests of a micro-batch; a batch of ``run`` that was taken before changes nothing.

    ``batch(digest, entry_id, stg_deploy_time, observation_minutes, queued_at, ...)``.  The
    newest request of a digest replaces its earlier ones.  Requests without a
    digest, without a queue time, or from before what the queue remembers are refused.
    """
    spark = batch.sparkSession
    now = read_manifest(spark, base)
    if now.batches.get(run, -1) >= batch_id:
        return
    entries = schedule(batch).filter("digest IS NOT NULL AND queued_at IS NOT NULL").withColumn("queued_us", micros("queued_at"))
    if now.refused_us is not None:
        entries = entries.filter(F.col("queued_us") > now.refused_us)
    marked = entries.withColumn("removed", F.lit(False)).withColumn("poll", F.lit(None).cast("string"))
    if now.columns is not None:
        marked = marked.select(*[F.col(f"`{name}`").cast(kind) for name, kind in now.columns])
    name = f"in-{run}-{batch_id}-{uuid.uuid4().hex}"
    _newest(marked, "digest").write.parquet(f"{base}/log/{name}")
    _publish(spark, base, replace(
        now, version=now.version + 1, live=[*now.live, name], batches={**now.batches, run: batch_id},
        columns=now.columns or [[f.name, f.dataType.simpleString()] for f in marked.schema],
    ))


def waiting(spark: SparkSession, base: str) -> DataFrame:
    """Entries that have not fired: only folders that the manifest still reads are opened."""
    now = read_manifest(spark, base)
    if now.schema is None:
        raise ValueError(f"no request was ever added to {base}")
    rows = _rows(spark, base, now.live, now.schema)
    return _newest(rows, "digest").filter("NOT removed").drop("removed", "poll", "queued_us")


def poll(spark: SparkSession, base: str, at: str, name: str) -> DataFrame:
    """Fire what is due at ``at``; an entry whose time can't be read is due.  Returns what this poll fired.

    A poll of the same ``name`` fires once and gives the same rows again.
    """
    now = read_manifest(spark, base)
    if now.schema is None:
        raise ValueError(f"no request was ever added to {base}")
    if name not in now.polls:
        rows = _newest(_rows(spark, base, now.live, now.schema), "digest").filter("NOT removed")
        due = rows.filter(F.col("due").isNull() | (F.col("due") <= F.lit(at).cast("timestamp")))
        folder = f"fired-{uuid.uuid4().hex}"
        due.withColumns({"removed": F.lit(True), "poll": F.lit(name)}).select(*rows.columns).write.parquet(f"{base}/log/{folder}")
        now = replace(now, version=now.version + 1, live=[*now.live, folder], fired=[*now.fired, folder], polls=[*now.polls, name])
        _publish(spark, base, now)
    return fired(spark, base).filter(F.col("poll") == name)


def fired(spark: SparkSession, base: str) -> DataFrame:
    """Everything that ever fired, with the name of its poll."""
    now = read_manifest(spark, base)
    if now.schema is None:
        raise ValueError(f"no request was ever added to {base}")
    return _rows(spark, base, now.fired, now.schema).drop("removed", "queued_us")


def compact(spark: SparkSession, base: str, keep_hours: int = KEEP_HOURS) -> None:
    """Merge the live folders into one that holds waiting entries and young tombstones."""
    now = read_manifest(spark, base)
    if not now.live:
        return
    rows = _rows(spark, base, now.live, now.schema)
    newest = rows.agg(F.max("queued_us")).first()[0]
    refused = now.refused_us if newest is None else max(newest - keep_hours * 3_600_000_000, now.refused_us or 0)
    kept = _newest(rows, "digest")
    if refused is not None:
        kept = kept.filter(~F.col("removed") | (F.col("queued_us") > refused))
    name = f"base-{uuid.uuid4().hex}"
    kept.write.parquet(f"{base}/log/{name}")
    _publish(spark, base, replace(now, version=now.version + 1, live=[name], refused_us=refused))


def vacuum(spark: SparkSession, base: str) -> int:
    """Delete folders and manifests that the current manifest doesn't need; returns how many.

    Only when no other job reads or changes the queue.
    """
    now = read_manifest(spark, base)
    needed = {*now.live, *now.fired, f"v{now.version}"}
    gone = 0
    for folder in ("log", "manifest"):
        files, where = _files(spark, os.path.join(base, folder))
        if files.exists(where):
            for status in files.listStatus(where):
                if status.getPath().getName() not in needed:
                    files.delete(status.getPath(), True)
                    gone += 1
    return gone
