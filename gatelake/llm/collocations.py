"""Phrases of words that stand together more often than their parts tell, by Toivonen's mining.

A sample of the texts proposes frequent phrases at a lowered count. One pass over
all texts then counts, exactly, the proposed phrases and their negative border:
every phrase whose parts are all proposed. Where the border, or a single word,
turns out to be frequent after all, what it opens up is counted in a further pass,
until nothing frequent is left uncounted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.llm.words import LOWER, buffer_of, mix, slices, word_spans
from gatelake.session import cut_lineage

#: One text of so many is in the sample; its count is lowered to this share of what the sample lets expect.
SAMPLE_ONE_OF = 4
LOWERED = 0.8
#: Bytes of text whose phrases are counted together; a longer text is counted on its own, whole.
SLICE_BYTES = 1 << 20
#: A filter has 32 bits for each phrase of the sample, but no more bits than this (16 MB).
MOST_FILTER_BITS = 1 << 27
#: Seeds tried until no two words share a hash.
MOST_SEEDS = 8
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 32
_BITMAP_BITS = 32768  # of one value of Spark's bitmap_construct_agg

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_OUTSIDE = _BREAK.copy()
_OUTSIDE[[0x20, 0x09]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each span of bytes, another one for each seed: powers of an odd number, as far as the longest span."""
    length = ends - starts
    power = np.multiply.accumulate(np.append(np.uint64(1), np.full(int(length.max(initial=0)), _STEP)))
    values = mix(np.arange(1, 257, dtype=np.uint64) * _STEP + np.uint64(seed))
    skipped = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(skipped, length)
    total = np.zeros(len(place) + 1, np.uint64)
    np.cumsum(values[data[place + np.repeat(starts, length)]] * power[place], out=total[1:])
    return mix(total[skipped + length] - total[skipped])


def _longer(gram: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of each phrase with one more word; only the filters use it."""
    return mix(gram * _STEP + word)


def _passes(gram: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    inside = np.ones(len(gram), bool)
    for at in _places(gram, len(bitmap) * 8):
        inside &= (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & np.uint8(1) > 0
    return inside


def _places(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    low = np.uint64(bits - 1)
    return (gram & low).astype(np.int64), ((gram >> np.uint64(32)) & low).astype(np.int64)


class _Words(NamedTuple):
    """The words of some texts: number and piece of each, and for each number its hash, language and bytes."""

    word: np.ndarray
    piece: np.ndarray
    hashes: np.ndarray
    language: np.ndarray
    listed: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def _words(data: np.ndarray, offsets: np.ndarray, language: np.ndarray, marks: np.ndarray, seed: int) -> _Words | None:
    """Words are told apart by their bytes, and by the language of their text."""
    starts, ends, of = word_spans(data, offsets, _OUTSIDE)
    if not len(starts):
        return None
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))
    breaks = np.cumsum(_BREAK[data], dtype=np.int32)[starts]
    fresh = np.append(True, (breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]))
    body, cuts = data[~_OUTSIDE[data]], np.append(0, np.cumsum(ends - starts))
    coded = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(body)]
    ).dictionary_encode()
    several = len(coded.dictionary)
    own = language[text] * several + coded.indices.to_numpy()
    if len(marks) * several <= 4 * len(own):
        there = np.zeros(len(marks) * several, bool)
        there[own] = True
        which, word = np.flatnonzero(there), (np.cumsum(there) - 1)[own]
    else:
        which, word = np.unique(own, return_inverse=True)
    raw, at = buffer_of(coded.dictionary.cast(pa.large_string()))
    hashes = mix(word_hashes(raw, at[:-1], at[1:], seed)[which % several] + marks[which // several])
    return _Words(word, np.cumsum(fresh), hashes, which // several, which % several, raw, at)


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each comes."""
    key = np.sort(key)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first], np.diff(np.append(first, len(key)))


def _keys(prefix: int, columns: list[np.ndarray], own: np.ndarray, length: np.ndarray) -> pa.Array:
    """A byte, 64-bit hashes and own bytes of each row as one binary value."""
    fixed = np.empty((len(columns[0]), 1 + 8 * len(columns)), np.uint8)
    fixed[:, 0] = prefix
    for k, column in enumerate(columns):
        fixed[:, 1 + 8 * k : 9 + 8 * k] = column.astype("<u8").view(np.uint8).reshape(-1, 8)
    ends = np.append(0, np.cumsum(length + fixed.shape[1])).astype(np.int32)
    if len(own):
        raw = np.empty(int(ends[-1]), np.uint8)
        head = ends[:-1, None] + np.arange(fixed.shape[1])
        raw[head] = fixed
        rest = np.ones(len(raw), bool)
        rest[head] = False
        raw[rest] = own
    else:
        raw = fixed
    return pa.BinaryArray.from_buffers(pa.binary(), len(fixed), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


def _count_slice(
    words: _Words, names: list[bytes], sizes: range, old: dict[int, np.ndarray], new: dict[int, np.ndarray]
) -> Iterator[pa.RecordBatch]:
    word, piece, hashes = words.word, words.piece, words.hashes
    n, several = len(word), len(hashes)
    gram = mix(hashes)[word]
    for size in range(1, max(sizes) + 1):
        if size == 1 and size not in sizes:
            continue
        if size == 1:
            number, counts = np.arange(several), np.bincount(word, minlength=several)
            parts, span = [number], np.diff(words.offsets)[words.listed]
            # The language, behind its length, and the word.
            head = [len(names[k]).to_bytes(4, "little") + names[k] for k in words.language.tolist()]
            raw, at = words.data.tobytes(), words.offsets.tolist()
            text = np.frombuffer(b"".join(x for a, w in zip(head, words.listed.tolist(), strict=True) for x in (a, raw[at[w] : at[w + 1]])), np.uint8)
            length = span + [len(a) for a in head]
        else:
            if n < size:
                return
            gram, before = _longer(gram[: n - size + 1], hashes[word[size - 1 :]]), gram
            opened = _passes(before, new[size - 1])
            opened = opened[:-1] & opened[1:]
            if size - 1 in old:
                closed = _passes(before, old[size - 1])
                opened &= ~(closed[:-1] & closed[1:])
            at = np.flatnonzero((piece[: n - size + 1] == piece[size - 1 :]) & opened)
            if size not in sizes or not len(at):
                continue  # the phrases before were counted, these build on them
            if several**size < 1 << 62:
                key = word[at]
                for step in range(1, size):
                    key = key * several + word[at + step]
                key, counts = _runs(key)
                parts = []
                for _ in range(size):
                    key, part = np.divmod(key, several)
                    parts.insert(0, part)
            else:
                rows, counts = np.unique(np.stack([word[at + k] for k in range(size)]), axis=1, return_counts=True)
                parts = list(rows)
            text, length = np.zeros(0, np.uint8), np.zeros(len(counts), np.int64)
        yield pa.RecordBatch.from_arrays(
            [_keys(size, [hashes[p] for p in parts], text, length), pa.array(counts.astype(np.int64))], ["key", "n"]
        )


def _count(batches, seed: int, sizes: range, old: dict, new: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        listed = batch.column(0).dictionary_encode()
        names = [n.encode("utf-8", "replace") for n in listed.dictionary.to_pylist()]
        marks = np.array([_language_hash(n) for n in names] or [0], np.uint64)
        language = listed.indices.to_numpy().astype(np.int64)
        data, offsets = buffer_of(batch.column(1))
        lower = words = None
        for i, j in slices(None, offsets, SLICE_BYTES):
            lower = LOWER[data[offsets[i] : offsets[j]]]
            words = _words(lower, offsets[i : j + 1] - offsets[i], language[i:j], marks, seed)
            if words is not None:
                yield from _count_slice(words, names, sizes, old, new)
        # Else two batches are held while the next one comes.
        del batch, listed, language, data, offsets, lower, words


def _language_hash(name: bytes) -> np.uint64:
    """Of a seed that words never have, so that no word can stand for a language."""
    return word_hashes(np.frombuffer(name, np.uint8), np.array([0]), np.array([len(name)]), MOST_SEEDS)[0]


def _read_keys(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[pa.RecordBatch]:
    """``lang, word, w0, w1, ..., n`` of keys and counts."""
    for batch in batches:
        keys = batch.column(0).to_pylist()
        sizes = np.array([k[0] for k in keys], np.int64)
        hashes = np.zeros((len(keys), longest), "<i8")
        language: list[str | None] = [None] * len(keys)
        word: list[str | None] = [None] * len(keys)
        for i, k in enumerate(keys):
            hashes[i, : k[0]] = np.frombuffer(k, "<i8", k[0], 1)
            if k[0] == 1:
                end = 13 + int.from_bytes(k[9:13], "little")
                language[i], word[i] = k[13:end].decode("utf-8", "replace"), k[end:].decode("utf-8", "replace")
        yield pa.RecordBatch.from_arrays(
            [pa.array(language, pa.string()), pa.array(word, pa.string()),
             *[pa.array(hashes[:, k], pa.int64(), mask=sizes <= k) for k in range(longest)], batch.column(1)],
            ["lang", "word", *[f"w{k}" for k in range(longest)], "n"],
        )


def _hashes(batch: pa.RecordBatch, size: int) -> np.ndarray:
    """The filter hash of phrases given as ``w0, w1, ...``."""
    words = [batch.column(k).to_numpy().view(np.uint64) for k in range(size)]
    gram = mix(words[0])
    for word in words[1:]:
        gram = _longer(gram, word)
    return gram


def _new_places(batches, size: int, bits: int, known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gram = _hashes(batch, size)
        if known is not None:
            gram = gram[~_passes(gram, known)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_places(gram, bits)))], ["place"])


def _filter(phrases: DataFrame, size: int, bits: int, known: np.ndarray | None = None) -> np.ndarray | None:
    """A bitmap of the phrases, together with a known one; None where it knows all of them."""
    held = None if known is None else phrases.sparkSession.sparkContext.broadcast(known)
    places = phrases.select(*[f"w{k}" for k in range(size)]).mapInArrow(
        lambda batches: _new_places(batches, size, bits, None if held is None else held.value), "place long"
    )
    rows = (
        places.groupBy(F.shiftright("place", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("place") % _BITMAP_BITS).alias("bits"))
        .toArrow()
    )
    if known is not None and not rows.num_rows:
        return None
    whole = np.zeros(max(bits, _BITMAP_BITS) // 8, np.uint8)
    for part, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
        whole[part * len(raw) : (part + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    return whole[: bits // 8] if known is None else whole[: bits // 8] | known


def _passed(
    texts: DataFrame, seed: int, longest: int, sizes: range, old: dict, new: dict, least: int, words: bool
) -> DataFrame:
    """Exact counts from ``least`` on of the phrases that ``new`` opens and ``old`` doesn't; of all ``words`` if asked."""
    held = texts.sparkSession.sparkContext.broadcast((old, new))
    found = texts.mapInArrow(lambda b: _count(b, seed, sizes, *held.value), "key binary, n long")
    rule = F.col("n") >= least
    if words:
        rule = rule | (F.substring("key", 1, 1) == F.lit(b"\x01"))
    kept = found.groupBy("key").agg(F.sum("n").alias("n")).where(rule)
    schema = f"lang string, word string, {', '.join(f'w{k} long' for k in range(longest))}, n long"
    return cut_lineage(kept.mapInArrow(lambda b: _read_keys(b, longest), schema), "collocations")


def _of_size(counts: DataFrame, size: int, longest: int) -> DataFrame:
    rule = F.col(f"w{size - 1}").isNotNull()
    return counts.where(rule & F.col(f"w{size}").isNull() if size < longest else rule)


def _propose(texts: DataFrame, seed: int, longest: int, min_count: int) -> dict[int, np.ndarray]:
    """Filters of what is frequent in the sample, for each size but the longest."""
    sample = texts.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_OF)) == 0)
    least = max(1, math.floor(LOWERED * min_count / SAMPLE_ONE_OF))
    proposed: dict[int, np.ndarray] = {}
    for size in range(1, longest):
        often = _passed(sample, seed, longest, range(size, size + 1), {}, proposed, least, False)
        wanted = 1 << max(16, math.ceil(math.log2(32 * max(often.count(), 1))))
        proposed[size] = _filter(often, size, min(MOST_FILTER_BITS, wanted))
    return proposed


def frequent_phrases(texts: DataFrame, longest: int, min_count: int, seed: int = 0) -> tuple[DataFrame, int]:
    """Exact counts ``lang, word, w0, w1, ..., n`` of all words and of every phrase that comes ``min_count`` times.

    ``texts`` has the columns ``lang`` and ``text``. ``w0, w1, ...`` are hashes of
    the words and their language, null behind the last one; ``lang`` and ``word``
    are told for phrases of one word. No two words of the texts share a hash: where
    they would, all is done again with another seed. Returned with the number of
    full passes.
    """
    opened = _propose(texts, seed, longest, min_count)
    passes: list[DataFrame] = []
    old: dict[int, np.ndarray] = {}
    sizes = range(1, longest + 1)
    while True:
        passes.append(_passed(texts, seed, longest, sizes, old, opened, min_count, not passes))
        found = passes[0]
        for other in passes[1:]:
            found = found.union(other)
        if len(passes) == 1:
            shared = _of_size(found, 1, longest).groupBy("w0").agg(F.count("*").alias("words"))
            if shared.where("words > 1").limit(1).count():
                if seed + 1 >= MOST_SEEDS:
                    raise ValueError("words share hashes under every seed")
                return frequent_phrases(texts, longest, min_count, seed + 1)
        often = found.where(F.col("n") >= min_count)
        more = {
            size: _filter(_of_size(often, size, longest), size, len(opened[size]) * 8, opened[size])
            for size in range(1, longest)
        }
        if all(m is None for m in more.values()):
            return found, len(passes)
        old, sizes = opened, range(2, longest + 1)
        opened = {size: m if m is not None else old[size] for size, m in more.items()}


def _part(counts: DataFrame, size: int, longest: int, at: int, name: str) -> DataFrame:
    """Phrases of a size, their words named as the places from ``at`` on."""
    words = [F.col(f"w{k}").alias(f"w{at + k}") for k in range(size)]
    return _of_size(counts, size, longest).select(*words, F.col("n").alias(name))


def _scored(often: DataFrame, size: int, longest: int, share: int) -> DataFrame:
    words = [f"w{k}" for k in range(size)]
    rows = _part(often, size, longest, 0, "a")
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = []
    for k in range(1, size):
        rows = rows.join(_part(often, k, longest, 0, f"l{k}"), words[:k])
        rows = rows.join(_part(often, size - k, longest, k, f"r{k}"), words[k:])
    for k in range(1, size):
        rows = rows.withColumn(f"top{k}", (F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).cast("decimal(38,0)"))
        rows = rows.withColumn(f"low{k}", (exact(f"l{k}") * exact(f"r{k}")).cast("decimal(38,0)"))
        cuts.append(F.struct(F.expr(f"top{k} div low{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
    rows = rows.withColumn("cut", F.array_min(F.array(*cuts)))
    if size < longest:
        longer = _of_size(often, size + 1, longest)
        inside = longer.select(*words, "n").union(
            longer.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(size)], "n")
        )
        most = inside.groupBy(*words).agg(F.max("n").alias("longer"))
        rows = rows.join(most, words, "left")
        rows = rows.where(F.coalesce(F.col("longer"), F.lit(0)) * 100 < F.col("a") * share)
    listed = _of_size(often, 1, longest)
    for k in range(size):
        named = [F.col("w0").alias(f"w{k}"), F.col("word").alias(f"word{k}"), *([F.col("lang")] if k == 0 else [])]
        rows = rows.join(listed.select(*named), f"w{k}")
    phrase = F.concat_ws(" ", *[f"word{k}" for k in range(size)]).alias("phrase")
    return rows.select("lang", phrase, "a", "cut.l", "cut.r", "cut.score")


def find_collocations(
    documents: DataFrame, text: str, language: Column, longest: int = 3, min_count: int = 10, share: int = 50, top: int = 2000,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of each language.

    A-Z are lower-cased, texts are split at ``. , ; : ! ?`` and line ends into
    pieces and these at blanks and tabs into words. A candidate is a phrase of 2 to
    ``longest`` words that comes ``a >= min_count`` times inside pieces. Its cut of
    lowest score ``floor(1000000 * a * a / (l * r))``, the first of equals, gives
    ``l`` and ``r``, the counts of both parts; ``n`` counts the words of the
    language. A candidate goes if a longer one around it comes at least ``share``
    per cent as often; it is enough to look at those with one word more, since the
    phrases between two such phrases come at least as often as the longer.
    All counts are exact: decimals hold every product of counts below 10^16.

    The sample decides only what is counted early, never the result. Null texts
    count as empty, null languages are the caller's choice (``und`` if still
    null); empty and blank texts have no words, long ones are counted whole,
    repeated rows count each time, ties go by phrase in byte order, an empty
    table gives no rows, other columns are not read.
    """
    texts = documents.select(
        F.coalesce(language.cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    )
    counts, _ = frequent_phrases(texts, longest, min_count)
    totals = _of_size(counts, 1, longest).groupBy("lang").agg(F.sum("n").alias("n"))
    often = cut_lineage(counts.where(F.col("n") >= min_count), "collocations")
    scored = _scored(often, 2, longest, share)
    for size in range(3, longest + 1):
        scored = scored.union(_scored(often, size, longest, share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The first of all are among the first of each part, so no language is sorted in one task.
    part = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    part = part.withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order)))
    ranked = part.where(F.col("place") <= top).withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )
