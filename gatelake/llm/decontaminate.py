"""Benchmark passages in training texts, found by spaced seeds and verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelake.llm.words import buffer_of, mix, slices, span_hashes, word_spans
from gatelake.session import cut_lineage

#: Token positions that a seed looks at. For every window of 8 to 20 tokens with at least 80 % equal
#: tokens, one of these seeds fits somewhere on equal tokens only (``tests/llm`` tries all patterns).
SEEDS = ("101111", "111011", "11100011")
#: An overlap is a window of this many tokens, or the whole item if it is shorter.
WINDOW = 20
#: Share of equal tokens in the window.
SIMILARITY = 0.8
#: A window clipped by the text's edge has at least this many tokens; shorter items must lie in the text whole and equal.
MIN_TOKENS = 8
#: Items below this many tokens are no passage and are not searched.
SHORTEST = 3
#: The filter of seed hashes has 16 bits for each hash, but no more bits than this (16 MB).
MOST_FILTER_BITS = 1 << 27

#: Bytes that end a token: everything but ASCII letters and digits and bytes of longer characters.
_OUTSIDE = np.array([not (b >= 128 or chr(b).isalnum()) for b in range(256)])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each token and token offsets of the texts, which are in lower case."""
    starts, ends, of = word_spans(data, offsets, _OUTSIDE)
    return span_hashes(data, starts, ends), of


def _seed_hashes(tokens: np.ndarray, of: np.ndarray, seeds: tuple[str, ...]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Each seed, its hash at each position and whether it ends inside the text."""
    left = np.repeat(of[1:], np.diff(of)) - np.arange(len(tokens))
    for seed in seeds:
        n = len(tokens) - len(seed) + 1
        if n <= 0:
            continue
        h = np.full(n, int(seed, 2), np.uint64)
        for at, used in enumerate(seed):
            if used == "1":
                h = h * np.uint64(0x9E3779B97F4A7C15) + tokens[at : at + n]
        yield seed, mix(h), left[:n] >= len(seed)


def _whole(length: int) -> str:
    """The seed of a short item: all of its tokens."""
    return "1" * length


def _probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(bits - 1)
    return (h & low).astype(np.int64), ((h >> np.uint64(32)) & low).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        tokens, of = _tokens(data, offsets)
        for i in range(len(offsets) - 1):
            if of[i + 1] - of[i] >= SHORTEST:
                own = tokens[of[i] : of[i + 1]]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, 1), pa.array([own.tobytes()], pa.binary())], ["item", "tokens"]
                )


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw in enumerate(batch.column(1).to_pylist()):
            tokens = np.frombuffer(raw, np.uint64)
            seeds = SEEDS if len(tokens) >= MIN_TOKENS else (_whole(len(tokens)),)
            for _, h, fits in _seed_hashes(tokens, np.array([0, len(tokens)]), seeds):
                at = np.flatnonzero(fits)
                item = batch.column(0).slice(i, 1).take(pa.array(np.zeros(len(at), np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [item, pa.array(at.astype(np.int32)), pa.array(h[at].view(np.int64))], ["item", "item_at", "h"]
                )


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit set of the seed hashes; its size is bounded by ``MOST_FILTER_BITS``."""
    n = seeds.count()
    bits = min(MOST_FILTER_BITS, 1 << max(16, math.ceil(math.log2(16 * max(n, 1)))))
    low = F.lit(bits - 1).cast("long")
    both = F.explode(F.array(F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32).bitwiseAND(low)))
    words = (
        seeds.select(both.alias("bit"))
        .groupBy(F.shiftright("bit", 5).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("mask"))
    )
    table = np.zeros(bits // 32, np.uint32)
    rows = words.toPandas()
    table[rows["word"].to_numpy(np.int64)] = rows["mask"].to_numpy(np.int64).astype(np.uint32)
    return table


def _segments(batches: Iterator[pa.RecordBatch], table: np.ndarray, seeds: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Token runs around seeds that pass the filter, with these seeds' places and hashes."""
    bits, reach = len(table) * 32, WINDOW - 1
    for batch in batches:
        data, offsets = buffer_of(batch.column(1))
        for i, j in slices(data, offsets):
            tokens, of = _tokens(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            places, hashes, ends = [], [], []
            for seed, h, fits in _seed_hashes(tokens, of, seeds):
                at = np.flatnonzero(fits)
                for probe in _probes(h, bits):
                    p = probe[at]
                    at = at[(table[p >> 5] >> (p & 31).astype(np.uint32)) & np.uint32(1) > 0]
                places.append(at)
                hashes.append(h[at])
                ends.append(at + len(seed))
            if not places or not sum(map(len, places)):
                continue
            place, h, end = (np.concatenate(x) for x in (places, hashes, ends))
            order = np.argsort(place, kind="stable")
            place, h, end = place[order], h[order], end[order]
            text = np.searchsorted(of, place, side="right") - 1
            begin = np.maximum(place - reach, of[text])
            stop = np.minimum(end + reach, of[text + 1])
            # Overlapping surroundings of one text make one segment.
            fresh = np.ones(len(place), bool)
            fresh[1:] = (text[1:] != text[:-1]) | (begin[1:] > np.maximum.accumulate(stop)[:-1])
            first = np.flatnonzero(fresh)
            last = np.append(first[1:], len(place))
            longest = np.maximum.reduceat(stop, first)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(i, j - i).take(pa.array(text[first])),
                    pa.array((begin[first] - of[text[first]]).astype(np.int64)),
                    pa.array(longest == of[text[first] + 1]),
                    pa.array([tokens[a:b].tobytes() for a, b in zip(begin[first], longest, strict=True)], pa.binary()),
                    pa.array([(place[a:b] - begin[a]).astype(np.int32) for a, b in zip(first, last, strict=True)],
                             pa.list_(pa.int32())),
                    pa.array([h[a:b].view(np.int64) for a, b in zip(first, last, strict=True)], pa.list_(pa.int64())),
                ],
                ["key", "begin", "ends", "tokens", "at", "h"],
            )


def _best_window(text: np.ndarray, item: np.ndarray, diagonal: int, begins: bool, ends: bool) -> tuple[int, int, int] | None:
    """Place in the item, tokens and equal tokens of the best window of an alignment that is good enough.

    Windows are clipped where the text begins or ends, but not where only the
    segment does.
    """
    low, high = max(0, -diagonal), min(len(item), len(text) - diagonal)
    if high <= low:
        return None
    size = min(WINDOW, len(item))
    equal = np.zeros(len(item) + 1, np.int64)
    equal[low + 1 : high + 1] = item[low:high] == text[low + diagonal : high + diagonal]
    equal = np.cumsum(equal)
    starts = np.arange(len(item) - size + 1)
    first, last = np.maximum(starts, low), np.minimum(starts + size, high)
    length = last - first
    whole = ((first == starts) | begins) & ((last == starts + size) | ends)
    length = np.where(whole & (length >= min(size, MIN_TOKENS)), length, 0)
    same = np.where(length > 0, equal[np.maximum(last, first)] - equal[first], -1)
    share = SIMILARITY if size >= MIN_TOKENS else 1.0
    same = np.where(same >= np.ceil(share * length), same, -1)
    best = int(np.argmax(same))
    return (int(first[best]), int(length[best]), int(same[best])) if same[best] > 0 else None


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The best window of each aligned pair, if enough of its tokens are equal."""
    for batch in batches:
        keep, found = [], []
        columns = [batch.column(k).to_pylist() for k in range(2, 7)]
        for i, (begin, ends, segment, tokens, diagonal) in enumerate(zip(*columns, strict=True)):
            text, item = np.frombuffer(segment, np.uint64), np.frombuffer(tokens, np.uint64)
            window = _best_window(text, item, diagonal, begin == 0, ends)
            if window is not None:
                keep.append(i)
                found.append((begin + window[0] + diagonal, *window[1:]))
        if keep:
            rows = batch.take(pa.array(keep))
            at, size, same = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), at, size, same], ["key", "item", "at", "size", "same"]
            )


def find_overlaps(documents: DataFrame, key: str, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """``key, item_id, first_token, window, equal_tokens`` for each text and item that share a passage.

    A token is a run of letters, digits or non-ASCII characters; letters of every
    alphabet count in lower case. They overlap if some ``WINDOW`` tokens of the item (all of a shorter
    one) lie in the text without gaps and at least ``SIMILARITY`` of them are
    equal; where the text begins or ends inside such a window, its part of
    ``MIN_TOKENS`` tokens or more is judged alike. Items below ``MIN_TOKENS``
    tokens overlap where all their tokens are equal. Spaced seeds of both sides are joined on their hash; a bit set of the
    item hashes, of bounded size, only spares rows that can't join. Each seed hit
    gives an alignment, and each alignment is verified on the tokens around it,
    so every such overlap is found, wherever it is.

    Items of equal tokens count as one, under the smallest id. A null text has no
    token; items below ``SHORTEST`` tokens and empty tables give no rows. Of several windows the
    one with most equal tokens is given, the first of equals. Rows that repeat a
    key are searched each and answer once.
    """
    kinds = [items.schema[item].dataType.simpleString(), documents.schema[key].dataType.simpleString()]
    listed = (
        items.select(F.col(item).alias("item"), F.lower(F.col(item_text).cast("string")).alias("text"))
        .mapInArrow(_item_rows, f"item {kinds[0]}, tokens binary")
        .groupBy("tokens")
        .agg(F.min("item").alias("item"), F.xxhash64("tokens").alias("no"))
    )
    listed = cut_lineage(listed, "decontaminate")
    seeds = cut_lineage(
        listed.select("no", "tokens").mapInArrow(_seed_rows, "item long, item_at int, h long").distinct(),
        "decontaminate",
    )
    table = documents.sparkSession.sparkContext.broadcast(_filter(seeds))
    tokens = (F.octet_length("tokens") / 8).cast("int")
    short = sorted(r[0] for r in listed.where(tokens < MIN_TOKENS).select(tokens).distinct().collect())
    searched = (*SEEDS, *[_whole(n) for n in short])  # at most MIN_TOKENS - SHORTEST more
    texts = documents.select(F.col(key).alias("key"), F.lower(F.col(text).cast("string")).alias("text"))
    segments = texts.mapInArrow(
        lambda batches: _segments(batches, table.value, searched),
        f"key {kinds[1]}, begin long, ends boolean, tokens binary, at array<int>, h array<long>",
    ).withColumn("segment", F.monotonically_increasing_id())
    segments = cut_lineage(segments, "decontaminate")
    hits = segments.select("segment", F.explode(F.arrays_zip("at", "h")).alias("hit"))
    alignments = (
        hits.select("segment", "hit.at", F.col("hit.h").alias("g"))
        .join(seeds, F.col("g") == F.col("h"))
        .select("segment", F.col("item").alias("no"), (F.col("at") - F.col("item_at")).alias("diagonal"))
        .distinct()
    )
    pairs = (
        alignments.join(segments.select("segment", "key", "begin", "ends", F.col("tokens").alias("run")), "segment")
        .join(listed, "no")
        .select("key", "item", "begin", "ends", "run", "tokens", "diagonal")
        .mapInArrow(_verify, f"key {kinds[1]}, item {kinds[0]}, at long, size long, same long")
    )
    best = F.max(F.struct("same", (-F.col("at")).alias("back"), "size")).alias("best")
    return pairs.groupBy("key", "item").agg(best).select(
        F.col("key").alias(key), F.col("item").alias("item_id"), (-F.col("best.back")).alias("first_token"),
        F.col("best.size").alias("window"), F.col("best.same").alias("equal_tokens"),
    )


def drop_contaminated(documents: DataFrame, text: str, items: DataFrame, item: str, item_text: str) -> DataFrame:
    """Documents whose text overlaps no item, with all their columns.

    Rows are matched by two hashes of the text, since the decision follows from
    the text alone; keys may be null or repeat.
    """
    both = F.struct(F.xxhash64(text), F.hash(text))
    name = "_text_hash"
    while name in documents.columns:
        name += "_"
    marked = documents.withColumn(name, F.when(F.col(text).isNotNull(), both))
    bad = find_overlaps(marked, name, text, items, item, item_text).select(F.col(name).alias("bad")).distinct()
    return marked.join(bad, F.col(name) == F.col("bad"), "left_anti").drop(name)
