"""SimHash fingerprints and near-duplicate groups by covering hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.graph import components, forest
from gatelake.llm.words import BLANK, LOWER, buffer_of, slices, word_spans
from gatelake.session import cut_lineage

SEED = 42
BITS = 64
#: Fingerprints of one bucket that one task compares at a time.
TILE = 2048
#: Rows of small tiles that one call handles, on average.
ROWS = 20_000


def _majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per text, the bits set in over half of its hashes; zero for no hash."""
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    first = np.concatenate([[0], np.cumsum(counts[has])[:-1]])
    for bit in range(BITS):
        ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), first)
        out[has] |= (2 * ones > counts[has]).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprints(data: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    starts, ends, of = word_spans(data, offsets)
    # The words of the slice with one blank between them, so a shingle is one range of bytes.
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    packed = np.full(int(at[-1]), 0x20, np.uint8)
    keep = np.ones(len(packed), bool)
    keep[at[1:] - 1] = False
    packed[keep] = LOWER[data[~BLANK[data]]]
    raw = memoryview(packed.tobytes())
    words = np.diff(of)
    counts = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    text = np.repeat(np.arange(len(words)), counts)
    begin = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + of[:-1][text]
    stop = np.minimum(begin + width, of[1:][text])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(raw[a:b], SEED) for a, b in zip(at[begin].tolist(), (at[stop] - 1).tolist(), strict=True)),
        dtype=np.uint64, count=len(text),
    )
    return _majority(hashes, counts)


def fingerprints(documents: DataFrame, key: str, text: str, width: int = 4) -> DataFrame:
    """``key, fingerprint``: the 64-bit SimHash of each row's text, as a long.

    Words are runs of bytes without blanks, A-Z in lower case. Each shingle of
    ``width`` words, repeats included, is hashed with XXH64; a text of fewer words
    is one shingle. A null text counts as empty; no word gives fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer_of(batch.column(1))
            for i, j in slices(data, offsets):
                part = _fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(part.view(np.int64))], ["key", "fingerprint"]
                )

    rows = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, fingerprint long").withColumnRenamed("key", key)


def covering_masks(radius: int, seed: int = 1) -> list[int]:
    """``2 ** (radius + 1) - 1`` masks; two fingerprints within the radius agree under one of them.

    Bit positions get vectors over GF(2) of ``radius + 1`` bits, each value about
    equally often; the mask of a non-zero vector ``v`` holds the positions whose
    vector has inner product 1 with ``v``. Up to ``radius`` differing positions
    span at most ``radius`` dimensions, so some ``v`` is orthogonal to all of them
    and its mask holds none of them.
    """
    size = 1 << (radius + 1)
    spread = np.random.default_rng(seed).permutation(BITS)
    vectors = (spread % (size - 1)) + 1  # a zero vector would be in no mask
    return [
        sum(1 << bit for bit in range(BITS) if bin(int(vectors[bit]) & v).count("1") % 2) for v in range(1, size)
    ]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _tile_links(radius: int):
    """Spanning forest of the links inside all tiles of one group of rows."""

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        tile = rows.groupby(["no", "bits", "low", "high"], sort=False).ngroup().to_numpy()
        order = np.argsort(tile, kind="stable")
        tile, side = tile[order], rows["side"].to_numpy()[order]
        fp = rows["fp"].to_numpy().astype(np.int64)[order]
        bits = fp.view(np.uint64)
        end = np.searchsorted(tile, tile, side="right")
        big = small = np.zeros(0, np.int64)
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        at, lag, held = np.arange(len(fp)), 0, 0
        while len(at):
            lag += 1
            at = at[at + lag < end[at]]
            other = at + lag
            # Two rows of one side meet in their own tile.
            near = (np.bitwise_count(bits[at] ^ bits[other]) <= radius) & (
                (side[at] != side[other]) | (side[at] == 1)
            )
            waiting.append((fp[at[near]], fp[other[near]]))
            held += int(near.sum())
            if held > 1_000_000 or not len(at):
                big, small = forest(*(np.concatenate(x) for x in zip((big, small), *waiting, strict=True)))
                waiting, held = [], 0
        return pd.DataFrame({"a": big, "b": small})

    return links


def fingerprint_links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (column ``fp``) that connect all pairs within the radius.

    Every fingerprint enters one table per covering mask, under its masked bits.
    Buckets of two are checked from their minimum and maximum in the aggregate;
    larger ones are dealt into tiles of bounded size, each pair of tiles is
    compared exactly and answers with a spanning forest of its links.
    """
    masks = F.array(*[F.lit(_signed(m)) for m in covering_masks(radius)])
    tables = F.posexplode(F.transform(masks, lambda m: m.bitwiseAND(F.col("fp"))))
    entries = distinct.select("fp", tables.alias("no", "bits"))
    buckets = cut_lineage(
        entries.groupBy("no", "bits")
        .agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
        .where("n > 1"),
        "simhash",
    )
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = buckets.where((F.col("n") == 2) & near).select("a", "b")
    large = buckets.where("n > 2").select(
        F.col("no").alias("t"), F.col("bits").alias("k"), F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), "n"
    )
    members = entries.join(large, (F.col("no") == F.col("t")) & (F.col("bits") == F.col("k")))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    # A tile meets itself (side 1) and every other tile once, as left (0) or right (2).
    meets = F.transform(
        F.sequence(F.lit(0), F.col("tiles") - 1),
        lambda other: F.struct(
            F.least(F.col("own"), other).alias("low"), F.greatest(F.col("own"), other).alias("high"),
            F.when(F.col("own") == other, 1).when(F.col("own") < other, 0).otherwise(2).alias("side"),
        ),
    )
    tiles = members.withColumn("own", own).select("no", "bits", "fp", F.explode(meets).alias("m"))
    dealt = tiles.select("no", "bits", "m.low", "m.high", "m.side", "fp")
    # Whole tiles are dealt to groups of about ROWS rows, as one call for each small tile would cost more than its work.
    total = large.agg(F.sum(F.col("n") * F.col("tiles"))).first()[0] or 0
    group = F.pmod(F.xxhash64("no", "bits", "low", "high"), F.lit(max(1, total // ROWS)))
    tiled = dealt.groupBy(group.alias("group")).applyInPandas(_tile_links(radius), "a long, b long")
    return pairs.union(tiled).distinct()


def near_groups(prints: DataFrame, key: str, radius: int = 4) -> DataFrame:
    """Adds ``component_id``: the smallest key reachable over fingerprints at most ``radius`` bits apart.

    ``prints`` comes from ``fingerprints`` and should be a written table. Rows of
    equal fingerprints are one node, so copies cost nothing. Null keys take part
    in links; a group without any other key has a null id.
    """
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min(key).alias("lowest")), "simhash")
    links = fingerprint_links(nodes.select(F.col("fingerprint").alias("fp")), radius)
    label = components(links)
    labelled = nodes.join(label, nodes["fingerprint"] == label["node"], "left").select(
        F.col("fingerprint").alias("fp"), "lowest", F.coalesce("component", "fingerprint").alias("label")
    )
    lowest = labelled.groupBy(F.col("label").alias("l")).agg(F.min("lowest").alias("component_id"))
    named = labelled.join(lowest, F.col("label") == F.col("l")).select("fp", "component_id")
    return prints.join(named, prints["fingerprint"] == named["fp"]).drop("fp")


def simhash_groups(documents: DataFrame, key: str, text: str, width: int = 4, radius: int = 4) -> DataFrame:
    """``key, fingerprint, component_id`` of every row; see ``fingerprints`` and ``near_groups``."""
    prints = cut_lineage(fingerprints(documents, key, text, width), "simhash")
    return near_groups(prints, key, radius)


def keep_one(documents: DataFrame, key: str, text: str, width: int = 4, radius: int = 4) -> DataFrame:
    """One row of each group: of its smallest key, and of this key's texts in the group the one of smallest hash.

    A row is told by its key and two hashes of its text, so rows of one key in
    other groups are judged on their own. Of rows that repeat both, the one with
    the smallest XXH64 over its sortable columns stays, so reruns agree. Rows
    without a key are told by their text alone and come behind all others.
    """
    name = "_row"
    while name in documents.columns:
        name += "_"
    told = F.struct(F.col(key).isNull().alias("bare"), F.col(key).alias("key"), F.xxhash64(text).alias("a"), F.hash(text).alias("b"))
    marked = documents.withColumn(name, told)
    groups = simhash_groups(marked, name, text, width, radius)
    kept = cut_lineage(
        groups.where(F.col(name) == F.col("component_id")).groupBy(F.col(name).alias("_kept")).agg(F.count("*").alias("_rows")),
        "simhash",
    )

    def those(rows: DataFrame) -> DataFrame:
        return marked.join(rows.select("_kept"), F.col(name) == F.col("_kept"), "left_semi")

    found = those(kept.where("_rows = 1")).drop(name)
    if kept.where("_rows > 1").isEmpty():
        return found
    # Repeated rows are written first, so that each task reduces its own ones before they meet.
    repeated = cut_lineage(those(kept.where("_rows > 1")), "simhash")
    hashed = [F.col(f"`{f.name}`") for f in documents.schema if "map" not in f.dataType.simpleString()]
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    one = repeated.groupBy(name).agg(F.min_by(whole, F.xxhash64(*hashed)).alias("_one")).select("_one.*")
    return found.unionByName(one)
