"""Prediction by partial matching: code length of each text under a byte-context trie."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.llm.words import LOWER, buffer_of, mix, slices, span_hashes, word_spans
from gatelake.session import cut_lineage

#: Bytes of context; a context and its next byte fill 48 bits of a long.
ORDER = 5
#: Text bytes of the documents that ask for model values together.
CHUNK_BYTES = 32 << 20
#: Text bytes cut into grams and words at a time; each takes some sixty bytes of memory.
SLICE_BYTES = 1 << 18
#: Text bytes whose distinct grams and words one task sums, on average.
BUCKET_BYTES = 4 * CHUNK_BYTES
#: Trie leaves that one task turns into probabilities, on average.
LEAVES_PER_TASK = 400_000
#: Least number of such tasks.
LEAST_TASKS = 64
#: Ends every text and stands before it; no word holds it.
END = 0x0A
END_WORD = 1
GRAM, WORD = 0, 1


def _stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts with their next byte, ``n + 1`` offsets of the texts; word hashes and word offsets.

    A text is its words, A-Z in lower case, one blank between them and END after
    the last, seen after ORDER times END.
    """
    starts, ends, of = word_spans(data, offsets)
    lengths, words = ends - starts, np.diff(of)
    low = LOWER[data]
    text = np.repeat(np.arange(len(words)), words)
    size = np.bincount(text, weights=lengths + 1, minlength=len(words)).astype(np.int64)
    size = np.maximum(size, 1)  # END alone
    begin = np.cumsum(size + ORDER) - size
    before = np.concatenate([[0], np.cumsum(lengths + 1)])
    at = before[:-1] - before[of[:-1]][text] + begin[text]
    out = np.full(int(begin[-1] + size[-1]) if len(words) else 0, 0x20, np.uint8)
    out[(begin[:, None] - np.arange(1, ORDER + 1)[None]).ravel()] = END
    out[begin + size - 1] = END
    out[np.repeat(at - starts, lengths) + np.flatnonzero(_inside(starts, ends, len(data)))] = low[
        _inside(starts, ends, len(data))
    ]
    grams = np.zeros(max(0, len(out) - ORDER), np.int64)
    for back in range(ORDER, -1, -1):
        grams = (grams << 8) | out[ORDER - back : len(out) - back]
    # Positions of the padding are no symbols of a text.
    symbol = np.ones(len(out), bool)
    symbol[(begin[:, None] - np.arange(1, ORDER + 1)[None]).ravel()] = False
    grams = grams[symbol[ORDER:]]
    return grams, np.concatenate([[0], np.cumsum(size)]), span_hashes(low, starts, ends).view(np.int64), of


def _inside(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    return np.cumsum(change[:-1], dtype=np.int8) > 0


class _Sums:
    """Counts by key, merged as they come, so that memory follows the distinct keys."""

    def __init__(self) -> None:
        self.keys, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(250_000, len(self.keys) // 4):
            self.merged()

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted keys and their counts; only what waits is sorted, and put between the keys there are."""
        if self.size:
            keys, index = np.unique(np.concatenate([k for k, _ in self.waiting]), return_inverse=True)
            counts = np.zeros(len(keys), np.int64)
            np.add.at(counts, index, np.concatenate([c for _, c in self.waiting]))
            self.waiting, self.size = [], 0
            at = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            known[at < len(self.keys)] = self.keys[at[at < len(self.keys)]] == keys[at < len(self.keys)]
            self.counts[at[known]] += counts[known]
            new = ~known
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.counts = np.insert(self.counts, at[new], counts[new])
        return self.keys, self.counts


def _packed(numbers: np.ndarray) -> bytes:
    """Eight-byte numbers, compressed byte by byte place."""
    return zstandard.compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes(), 3)


def _unpacked(raw: bytes, kind: type = np.int64) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _sorted_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(raw))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents in chunks of about CHUNK_BYTES, each one compressed value."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0

    def chunk() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            for part in held:
                out.write_batch(part)
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "documents"]
        )

    for batch in batches:
        _, offsets = buffer_of(batch.column(1))
        for i, j in slices(None, offsets, CHUNK_BYTES):
            if held and size + offsets[j] - offsets[i] > CHUNK_BYTES:
                yield chunk()
                held, size, number = [], 0, number + 1
            held.append(batch.slice(i, j - i))
            size += int(offsets[j] - offsets[i])
    if held:
        yield chunk()


def _documents(raw: bytes) -> Iterator[pa.RecordBatch]:
    """The documents of a chunk, one batch in memory at a time."""
    yield from pa.ipc.open_stream(raw)


def _ask(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Every distinct gram and word of a chunk, with its count in training texts, by bucket of the key."""
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = {GRAM: _Sums(), WORD: _Sums()}
            learned = 0
            for documents in _documents(raw.as_buffer()):
                data, offsets = buffer_of(documents.column("text"))
                learn = documents.column("learn").to_numpy(zero_copy_only=False).astype(bool)
                learned += int(learn.sum())
                for i, j in slices(data, offsets, SLICE_BYTES):
                    grams, at, words, of = _stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for kind, keys, per in ((GRAM, grams, np.diff(at)), (WORD, words, np.diff(of))):
                        train = np.repeat(learn[i:j], per)
                        found[kind].add(*np.unique(keys[train], return_counts=True))
                        other = np.unique(keys[~train])
                        found[kind].add(other, np.zeros(len(other), np.int64))
            found[WORD].add(np.array([END_WORD]), np.array([learned]))
            for kind in (GRAM, WORD):
                keys, counts = found.pop(kind).merged()
                bucket = np.concatenate([
                    (mix(keys[i : i + SLICE_BYTES].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
                    for i in range(0, len(keys), SLICE_BYTES)
                ])
                order = np.argsort(bucket, kind="stable")
                last = np.cumsum(np.bincount(bucket))
                first = np.concatenate([[0], last[:-1]])
                first, last = first[first < last], last[first < last]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(first), chunk)),
                        pa.array(bucket[order[first]].astype(np.int64) * 2 + kind),
                        pa.array([_packed(np.diff(keys[order[a:b]], prepend=0)) for a, b in zip(first, last, strict=True)],
                                 pa.binary()),
                        pa.array([_packed(counts[order[a:b]]) for a, b in zip(first, last, strict=True)], pa.binary()),
                    ],
                    ["chunk", "bucket", "keys", "counts"],
                )


def _totals(asked: pa.Table) -> pa.Table:
    """Summed counts of the keys of one bucket."""
    bucket = asked.column("bucket")[0].as_py()
    sums = _Sums()
    for more, raw in zip(asked.column("keys"), asked.column("counts"), strict=True):
        sums.add(_sorted_keys(more.as_py()), _unpacked(raw.as_py()))
    keys, counts = sums.merged()
    return pa.table({"bucket": np.full(len(keys), bucket), "key": keys, "n": counts})


def _values(asked: pa.Table, values: pa.Table) -> pa.Table:
    """For each chunk's keys of one bucket, their values."""
    order = np.argsort(values.column("key").to_numpy(), kind="stable")
    known, value = values.column("key").to_numpy()[order], values.column("value").to_numpy()[order]
    found = [_packed(value[np.searchsorted(known, _sorted_keys(raw))]) for raw in asked.column("keys").to_pylist()]
    return pa.table({
        "chunk": asked.column("chunk"), "kind": pa.array(asked.column("bucket").to_numpy() % 2),
        "keys": asked.column("keys"), "found": pa.array(found, pa.binary()),
    })


def _group(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_inverse=True)


class _Level:
    """Counts of one order: of each context with a next byte, and of each context."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int):
        self.pairs, index = _group(keys & ((1 << (8 * order + 8)) - 1))
        self.count = np.bincount(index, weights=n, minlength=len(self.pairs)).astype(np.int64)
        self.contexts, self.context_of = _group(self.pairs >> 8)
        m = len(self.contexts)
        self.total = np.bincount(self.context_of, weights=self.count, minlength=m).astype(np.int64)
        self.kinds = np.bincount(self.context_of, weights=self.count > 0, minlength=m).astype(np.int64)
        self.pair_of_row = index


def leaf_scores(keys: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """log10 probability of the last byte of each key after its ORDER bytes.

    ``keys`` are distinct and hold all keys that share their last two context
    bytes with any of them; ``n`` are training counts, zero for keys only asked
    for; ``pairs`` counts (last context byte, byte). Escapes follow method C: a
    context with ``n`` symbols of ``d`` kinds escapes with ``d / (n + d)``. Bytes
    seen after the longer context are excluded from the shorter one. Bytes never
    seen at all share the last escape evenly.
    """
    levels = {order: _Level(keys, n, order) for order in range(2, ORDER + 1)}
    symbol, last = keys & 255, (keys >> 8) & 255
    score = np.zeros(len(keys))
    open_ = np.ones(len(keys), bool)

    def step(count, total, kinds):
        """Code one level for rows still open: found symbols end, others escape."""
        nonlocal score, open_
        live = open_ & (kinds > 0)
        whole = np.where(live, total + kinds, 1)
        hit = live & (count > 0)
        score += np.where(hit, np.log10(np.maximum(count, 1) / whole), 0.0)
        score += np.where(live & ~hit, np.log10(np.maximum(kinds, 1) / whole), 0.0)
        open_ &= ~hit

    excluded_sum = excluded_kinds = np.zeros(len(keys), np.int64)
    for order in range(ORDER, 1, -1):
        level = levels[order]
        row = level.pair_of_row
        context = level.context_of[row]
        step(level.count[row], level.total[context] - excluded_sum, level.kinds[context] - excluded_kinds)
        # What this context excludes from the next shorter one.
        if order > 2:
            shorter = levels[order - 1]
            below = shorter.count[np.searchsorted(shorter.pairs, level.pairs & ((1 << (8 * order)) - 1))]
        else:
            below = pairs[(level.pairs >> 8) & 255, level.pairs & 255]
        sums = np.bincount(level.context_of, weights=np.where(level.count > 0, below, 0), minlength=len(level.contexts))
        excluded_sum, excluded_kinds = sums.astype(np.int64)[context], level.kinds[context]
    total, kinds = pairs.sum(1), (pairs > 0).sum(1)
    step(pairs[last, symbol], total[last] - excluded_sum, kinds[last] - excluded_kinds)
    single = pairs.sum(0)
    excluded = ((pairs > 0) * single[None]).sum(1)
    step(single[symbol], single.sum() - excluded[last], (single > 0).sum() - kinds[last])
    unseen = 256 - int((single > 0).sum())
    return score + np.where(open_, -math.log10(max(unseen, 1)), 0.0)


def _score_leaves(rows: pa.Table, pairs: np.ndarray) -> pa.Table:
    keys, n = rows.column("key").to_numpy(), rows.column("n").to_numpy()
    return pa.table({"bucket": rows.column("bucket"), "key": keys, "value": leaf_scores(keys, n, pairs)})


def _look_up(keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Values of the asked keys, looked up in order of the keys: neighbours share what is in the cache."""
    order = np.argsort(asked)
    found = np.empty(len(asked), values.dtype)
    found[order] = values[np.searchsorted(keys, asked[order])]
    return found


def _answer(chunk: pa.Table, values: pa.Table) -> pa.Table:
    """Sums of the values of each text's grams and words."""
    kinds = values.column("kind").to_numpy()
    tables = {}
    for kind in (GRAM, WORD):
        own = values.filter(pa.array(kinds == kind))
        key = np.concatenate([_sorted_keys(raw.as_buffer()) for raw in own.column("keys")])
        order = np.argsort(key, kind="stable")
        key = key[order]
        value = np.concatenate([_unpacked(raw.as_buffer(), np.float64) for raw in own.column("found")])
        tables[kind] = key, value[order]
        del own, key, order, value
    end = tables[WORD][1][np.searchsorted(tables[WORD][0], END_WORD)]
    parts = [_answer_batch(batch, tables, end) for batch in _documents(chunk.column("documents")[0].as_buffer())]
    return pa.Table.from_batches(parts)


def _answer_batch(documents: pa.RecordBatch, tables: dict, end: float) -> pa.RecordBatch:
    data, offsets = buffer_of(documents.column("text"))
    n = len(offsets) - 1
    tokens, known = np.zeros(n, np.int64), np.zeros(n, np.int64)
    base, score = np.zeros(n), np.zeros(n)
    for i, j in slices(data, offsets, SLICE_BYTES):
        grams, at, words, of = _stream(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        score[i:j] = np.add.reduceat(_look_up(*tables[GRAM], grams), at[:-1])
        count = _look_up(*tables[WORD], words)
        has = np.flatnonzero(np.diff(of))
        tokens[i:j] = np.diff(of) + 1
        base[i:j] = math.log10(end + 1)
        known[i:j] = int(end > 0)
        if len(has):
            base[i + has] += np.add.reduceat(np.log10(count + 1), of[has])
            known[i + has] += np.add.reduceat((count > 0).astype(np.int64), of[has])
    return pa.RecordBatch.from_pydict({
        "key": documents.column("key"), "learn": documents.column("learn"), "n_tokens": tokens, "n_known": known,
        "base": base, "score": score,
    })


def ppm_scores(documents: DataFrame, key: str, text: str, learn: Column) -> DataFrame:
    """``key, learn, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``score`` is the log10 probability of the text (its words in lower case, one
    blank between them, an end mark) under a PPM model of order ORDER that has
    learned all rows where ``learn`` holds: the pretrained code length with sign
    changed. ``base_score`` is that of single words with add-one counts.

    Documents are put into chunks, kept as compressed values. A chunk asks for
    its distinct grams and words, in sorted lists by bucket of the key; their
    training counts are summed over all chunks, the leaves of the trie become
    probabilities in groups that share two context bytes, and each chunk gets
    back the values of its lists. Nothing that grows with the corpus is collected
    or broadcast; only 65,536 counts of byte pairs are. Words are told apart by a
    64-bit hash. Null texts are empty texts: an end mark. A null ``learn`` counts
    as false. Null and repeated keys are carried along.
    """
    rows = documents.select(
        F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        F.coalesce(learn, F.lit(False)).alias("learn"),
    )
    key_type = rows.schema["key"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(LEAST_TASKS, math.ceil(total / BUCKET_BYTES))
    chunks = cut_lineage(rows.mapInArrow(_chunks, "chunk long, documents binary"), "ppm")
    asked = cut_lineage(
        chunks.mapInArrow(lambda b: _ask(b, buckets), "chunk long, bucket long, keys binary, counts binary"), "ppm"
    )
    totals = cut_lineage(asked.groupBy("bucket").applyInArrow(_totals, "bucket long, key long, n long"), "ppm")
    grams, words = totals.where(F.col("bucket") % 2 == GRAM), totals.where(F.col("bucket") % 2 == WORD)
    counts = words.agg(F.sum("n"), F.sum((F.col("n") > 0).cast("long"))).first()
    trained, kinds = int(counts[0] or 0), int(counts[1] or 0)
    pairs = np.zeros(1 << 16, np.int64)
    pair = F.col("key").bitwiseAND(F.lit(0xFFFF).cast("long"))
    short = grams.groupBy(pair.alias("pair")).agg(F.sum("n").alias("n"), F.count("*").alias("leaves")).toPandas()
    pairs[short["pair"].to_numpy(np.int64)] = short["n"]  # at most 65,536 rows
    shared = documents.sparkSession.sparkContext.broadcast(pairs.reshape(256, 256))
    tasks = max(LEAST_TASKS, math.ceil(int(short["leaves"].sum()) / LEAVES_PER_TASK))
    two = F.shiftright("key", 8).bitwiseAND(F.lit(0xFFFF).cast("long"))
    leaves = (
        grams.withColumn("task", F.pmod(F.xxhash64(two), F.lit(tasks)))
        .groupBy("task")
        .applyInArrow(lambda t: _score_leaves(t, shared.value), "bucket long, key long, value double")
    )
    values = leaves.union(words.select("bucket", "key", F.col("n").cast("double").alias("value")))
    answers = (
        asked.select("chunk", "bucket", "keys")
        .groupBy("bucket")
        .cogroup(values.groupBy("bucket"))
        .applyInArrow(_values, "chunk long, kind long, keys binary, found binary")
    )
    out = (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _answer, f"key {key_type}, learn boolean, n_tokens long, n_known long, base double, score double"
        )
    )
    per_token = math.log10(trained + kinds + 1)
    return out.select(
        F.col("key").alias(key), "learn", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(per_token)).alias("base_score"), "score",
    )
