"""SentencePiece byte-pair encoding and decoding as rounds of array operations.

Symbols of many words lie in one flat numpy array. In each round every word
finds its lowest pair rank, merges all pairs of that rank from left to right at
once, and the array is compacted; words without a pair leave it.
"""

from __future__ import annotations

import codecs
import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from gatelake.llm.words import slices

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Bytes of text whose distinct words are encoded together; a longer text is encoded on its own, whole.
SLICE_BYTES = 1 << 20
#: Longer words are merged one pair at a time from a heap, since a word of n symbols may take n rounds over n symbols.
LONG_WORD = 2048
#: Symbols of characters that are no piece: this and the code point.
_CODE_POINTS = 0x110000
_NONE = np.iinfo(np.int64).max

codecs.register_error("gatelake_each_byte", lambda e: ("�", e.start + 1))


class Pieces(NamedTuple):
    """A vocabulary as tables; their size follows from the vocabulary alone."""

    size: int
    char_code: np.ndarray  # code points that are pieces, sorted
    char_piece: np.ndarray
    bigram: np.ndarray  # neighbouring characters inside some piece, sorted
    pair: np.ndarray  # left symbol * stride + right symbol, sorted
    pair_rank: np.ndarray
    pair_piece: np.ndarray
    byte_piece: np.ndarray  # piece of each byte
    start: np.ndarray  # decoded bytes of each piece: start, end and the bytes
    end: np.ndarray
    data: np.ndarray
    is_byte: np.ndarray
    is_control: np.ndarray
    drops_blank: np.ndarray  # begins with the sign of a blank, which is dropped in front of a text
    unknown: int


def read_pieces(path: str) -> Pieces:
    """The tables of a model file: byte-pair pieces with byte fallback, no change of characters.

    Other kinds of models are refused with ``ValueError``.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind = type(model.pieces[0])
    norm, train = model.normalizer_spec, model.trainer_spec
    plain = not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces
    if train.model_type != train.BPE or not train.byte_fallback or not plain or not norm.escape_whitespaces:
        raise ValueError("only byte-pair models with byte fallback and unchanged characters are supported")
    if any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in model.pieces):
        raise ValueError("user-defined and unused pieces are not supported")
    size, stride = len(model.pieces), len(model.pieces) + _CODE_POINTS
    number = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kind.NORMAL}
    scores = sorted({model.pieces[i].score for i in number.values()}, reverse=True)
    rank = {score: i for i, score in enumerate(scores)}

    def symbol(part: str) -> int | None:
        return number.get(part, size + ord(part) if len(part) == 1 else None)

    pairs: dict[int, tuple[int, int]] = {}
    bigrams = set()
    for piece, i in number.items():
        bigrams.update(ord(a) << 21 | ord(b) for a, b in zip(piece, piece[1:], strict=False))
        for cut in range(1, len(piece)):
            left, right = symbol(piece[:cut]), symbol(piece[cut:])
            if left is not None and right is not None:
                pairs[left * stride + right] = (rank[model.pieces[i].score], i)
    chars = sorted((ord(p), i) for p, i in number.items() if len(p) == 1)
    keys = sorted(pairs)
    byte_piece = np.full(256, model.trainer_spec.unk_id, np.int64)
    decoded = []
    for i, p in enumerate(model.pieces):
        if p.type == kind.BYTE:
            byte_piece[int(p.piece[1:-1], 16)] = i
            decoded.append(bytes([int(p.piece[1:-1], 16)]))
        elif p.type == kind.CONTROL:
            decoded.append(b"")
        elif p.type == kind.UNKNOWN:
            decoded.append(train.unk_surface.encode())
        else:
            decoded.append(p.piece.replace(BLANK, " ").encode())
    ends = np.cumsum([len(d) for d in decoded])
    return Pieces(
        size, *(np.array(x, np.int64) for x in zip(*chars, strict=True)), np.array(sorted(bigrams), np.int64),
        np.array(keys, np.int64), *(np.array([pairs[k][j] for k in keys], np.int64) for j in (0, 1)), byte_piece,
        ends - [len(d) for d in decoded], ends, np.frombuffer(b"".join(decoded), np.uint8),
        *(np.array([p.type == t for p in model.pieces]) for t in (kind.BYTE, kind.CONTROL)),
        np.array([p.type == kind.NORMAL and p.piece.startswith(BLANK) for p in model.pieces]),
        model.trainer_spec.unk_id,
    )


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each value in the sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return at, table[at] == values


def _ranks(left: np.ndarray, right: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each pair of symbols and the piece that they make."""
    at, known = _found(pieces.pair, left * (pieces.size + _CODE_POINTS) + right)
    if not len(pieces.pair):
        return np.full(len(left), _NONE), np.zeros(len(left), np.int64)
    return np.where(known, pieces.pair_rank[at], _NONE), pieces.pair_piece[at]


_TABLES: dict[str, tuple[np.ndarray, dict[int, tuple[int, int]]]] = {}


def _pair_table(pieces: Pieces) -> dict[int, tuple[int, int]]:
    """Rank and piece of each pair, kept for the last vocabulary used."""
    if "last" not in _TABLES or _TABLES["last"][0] is not pieces.pair:
        made = zip(pieces.pair_rank.tolist(), pieces.pair_piece.tolist(), strict=True)
        _TABLES["last"] = pieces.pair, dict(zip(pieces.pair.tolist(), made, strict=True))
    return _TABLES["last"][1]


def _merge_in_turn(symbols: np.ndarray, pieces: Pieces) -> np.ndarray:
    """One word, one pair at a time: always the lowest rank, the leftmost of equals."""
    own = symbols.tolist()
    n = len(own)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    rank, made = _ranks(symbols[:-1], symbols[1:], pieces)
    heap = [(r, i, own[i], own[i + 1], m) for i, (r, m) in enumerate(zip(rank.tolist(), made.tolist(), strict=True)) if r < _NONE]
    heapq.heapify(heap)
    table = _pair_table(pieces)
    stride = pieces.size + _CODE_POINTS
    while heap:
        _, i, left, right, piece = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or own[i] != left or own[j] != right:
            continue  # one of both has been merged since
        own[i], alive[j], after[i] = piece, False, after[j]
        if after[j] < n:
            before[after[j]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (pair := table.get(own[a] * stride + own[b])):
                heapq.heappush(heap, (pair[0], a, own[a], own[b], pair[1]))
    return np.array([s for s, lives in zip(own, alive, strict=True) if lives], np.int64)


def merge_rounds(symbols: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and offsets of all words after every merge, as one merge at a time would leave them.

    A word's pairs of the lowest rank are merged together. That equals merging
    them in turn unless a merge makes a pair that ranks no later than itself;
    such words, and words over ``LONG_WORD``, are merged in turn.
    """
    lengths = np.diff(offsets)
    done: dict[int, np.ndarray] = {}
    for w in np.flatnonzero(lengths > LONG_WORD).tolist():
        done[w] = _merge_in_turn(symbols[offsets[w] : offsets[w + 1]], pieces)
    keep = np.repeat(lengths <= LONG_WORD, lengths)
    sym, word = symbols[keep], np.repeat(np.arange(len(lengths)), lengths)[keep]
    out_sym, out_word = [], []
    rank = np.full(len(sym), _NONE)
    made = np.zeros(len(sym), np.int64)
    fresh = np.flatnonzero(word[1:] == word[:-1])
    rank[fresh], made[fresh] = _ranks(sym[fresh], sym[fresh + 1], pieces)
    while len(sym):
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        length = np.diff(np.append(first, len(sym)))
        lowest = np.minimum.reduceat(rank, first)
        ended = np.repeat(lowest == _NONE, length)
        if ended.any():
            out_sym.append(sym[ended])
            out_word.append(word[ended])
            sym, word, rank, made = (x[~ended] for x in (sym, word, rank, made))
            length, lowest = length[lowest < _NONE], lowest[lowest < _NONE]
            if not len(sym):
                break
        level = np.repeat(lowest, length)
        taken = rank == level
        # Of neighbouring pairs that share a symbol, every second one is merged.
        begins = taken.copy()
        begins[1:] &= ~taken[:-1]
        place = np.arange(len(sym))
        run = np.maximum.accumulate(np.where(begins, place, -1))
        taken &= (place - run) % 2 == 0
        lives = np.ones(len(sym), bool)
        lives[1:] = ~taken[:-1]
        new = np.where(taken, made, sym)[lives]
        changed, new_word, new_level = taken[lives], word[lives], level[lives]
        new_rank, new_made = rank[lives], made[lives]
        near = changed.copy()
        near[:-1] |= changed[1:]
        new_rank[near] = _NONE
        near[:-1] &= new_word[1:] == new_word[:-1]
        near[-1] = False
        at = np.flatnonzero(near)
        new_rank[at], new_made[at] = _ranks(new[at], new[at + 1], pieces)
        early = np.unique(new_word[at[new_rank[at] <= new_level[at]]])
        if len(early):
            edges = np.searchsorted(word, early), np.searchsorted(word, early, side="right")
            for w, a, b in zip(early.tolist(), *edges, strict=True):
                done[w] = _merge_in_turn(sym[a:b], pieces)
            stay = ~np.isin(new_word, early)
            new, new_word, new_rank, new_made = (x[stay] for x in (new, new_word, new_rank, new_made))
        sym, word, rank, made = new, new_word, new_rank, new_made
    for w, own in done.items():
        out_sym.append(own)
        out_word.append(np.full(len(own), w))
    sym, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_sym, out_word))
    order = np.argsort(word, kind="stable")
    return sym[order], np.append(0, np.cumsum(np.bincount(word, minlength=len(lengths))))


def _gather(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places ``start .. start + length - 1`` of every span, one after the other."""
    skipped = np.cumsum(length) - length
    return np.repeat(start - skipped, length) + np.arange(int(length.sum()))


def _as_ids(sym: np.ndarray, offsets: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of symbols: the piece, or the UTF-8 bytes of a character that is none."""
    code = sym - pieces.size
    strange = np.flatnonzero(code >= 0)
    if not len(strange):
        return sym, offsets
    raw = [chr(c).encode("utf-8", "replace") for c in code[strange].tolist()]
    length = np.ones(len(sym), np.int64)
    length[strange] = [len(r) for r in raw]
    total = np.append(0, np.cumsum(length))
    ids = np.repeat(sym, length)
    ids[_gather(total[strange], length[strange])] = pieces.byte_piece[np.frombuffer(b"".join(raw), np.uint8)]
    return ids, total[offsets]


def encode_texts(texts: pa.Array, pieces: Pieces) -> pa.ListArray:
    """Ids of each text; a null or empty text has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    try:
        codes = [t.decode("utf-8") for t in texts.to_pylist()]
    except UnicodeDecodeError:
        codes = [t.decode("utf-8", "gatelake_each_byte") for t in texts.to_pylist()]
    codes = [BLANK + t.replace(" ", BLANK) if t else "" for t in codes]
    ends = np.append(0, np.cumsum([len(t) for t in codes]))
    joined = "".join(codes)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
    if not len(code):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(ends), np.int32)), pa.array([], pa.int32()))
    # No piece holds these neighbours, so no merge ever crosses them.
    whole = np.append(True, ~_found(pieces.bigram, code[:-1] << 21 | code[1:])[1])
    whole[ends[:-1][ends[:-1] < len(code)]] = True
    first = np.flatnonzero(whole)
    raw = np.frombuffer(joined.encode("utf-8"), np.uint8)
    byte_at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    cuts = pa.py_buffer(np.append(byte_at[first], len(raw)).astype(np.int64))
    listed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, cuts, pa.py_buffer(raw)]).dictionary_encode()
    index = listed.indices.to_numpy().astype(np.int64)
    # Every distinct word once, by its first place.
    one = np.full(len(listed.dictionary), len(index))
    np.minimum.at(one, index, np.arange(len(index)))
    length = np.diff(np.append(first, len(code)))
    chars = code[_gather(first[one], length[one])]
    at, known = _found(pieces.char_code, chars)
    symbols = np.where(known, pieces.char_piece[at], chars + pieces.size)
    ids, of = _as_ids(*merge_rounds(symbols, np.append(0, np.cumsum(length[one])), pieces), pieces)
    counts = np.diff(of)[index]
    total = np.append(0, np.cumsum(counts))
    flat = ids[_gather(of[:-1][index], counts)].astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(total[np.searchsorted(first, ends)].astype(np.int32)), pa.array(flat)
    )


def decode_ids(ids: pa.Array, pieces: Pieces) -> pa.Array:
    """Text of each list of ids; null for a null list. Ids outside the vocabulary and nulls are unknown pieces."""
    lists = ids.cast(pa.large_list(pa.int64()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = pc.fill_null(lists.values.slice(offsets[0], offsets[-1] - offsets[0]), -1).to_numpy()
    offsets = offsets - offsets[0]
    values = np.where((values < 0) | (values >= pieces.size), pieces.unknown, values)
    start, length = pieces.start[values], pieces.end[values] - pieces.start[values]
    # The first piece of a text that is no control sign loses the blank it begins with.
    real = np.flatnonzero(~pieces.is_control[values])
    nth = np.searchsorted(real, offsets[:-1])
    has = nth < len(real)
    lead = real[nth[has]]
    lead = lead[lead < offsets[1:][has]]
    lead = lead[pieces.drops_blank[values[lead]]]
    start[lead] += 1
    length[lead] -= 1
    raw = pieces.data[_gather(start, length)]
    total = np.append(0, np.cumsum(length))
    at = total[offsets]
    # Bytes make a character only inside one text and without a control sign between them.
    cuts = np.unique(np.concatenate([at, total[np.flatnonzero(pieces.is_control[values])]]))
    inner = cuts[cuts < len(raw)]
    try:
        if (raw[inner] & 0xC0 == 0x80).any():
            raise ValueError("a character crosses a cut")
        raw.tobytes().decode("utf-8")
        text = pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(raw))
    except ValueError:
        parts = [raw[a:b].tobytes().decode("utf-8", "gatelake_each_byte") for a, b in zip(cuts, cuts[1:], strict=False)]
        edge = np.searchsorted(cuts, at).tolist()
        text = pa.array(["".join(parts[a:b]) for a, b in zip(edge, edge[1:], strict=False)], pa.large_string())
    return pc.if_else(lists.is_valid(), text, pa.scalar(None, pa.large_string())).cast(pa.string())


def _per_slice(batches: Iterator[pa.RecordBatch], column: str, make, made: int) -> Iterator[pa.RecordBatch]:
    """Each batch in slices, the last columns made from ``column``."""
    for batch in batches:
        given = batch.column(batch.schema.get_field_index(column))
        size = pc.fill_null(pc.binary_length(given) if pa.types.is_string(given.type) else pc.list_value_length(given), 0)
        ends = np.append(0, np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64)))
        for i, j in slices(None, ends, SLICE_BYTES):
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-made], *make(given.slice(i, j - i))], names=batch.schema.names
            )


def _with(rows: DataFrame, names: dict[str, DataType], source: str, make) -> DataFrame:
    """``rows`` and columns made in Python; ``source`` travels under a name of its own."""
    others = [c for c in rows.columns if c not in names]
    sent = rows.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)], F.col(f"`{source}`").alias("given"),
        *[F.lit(None).cast(kind).alias(f"m{i}") for i, kind in enumerate(names.values())],
    )
    schema = StructType([StructField(f.name, f.dataType, True) for f in sent.schema])
    back = sent.mapInArrow(lambda batches: _per_slice(batches, "given", make, len(names)), schema)
    return back.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(others)], *[F.col(f"m{i}").alias(n) for i, n in enumerate(names)]
    )


def encode(rows: DataFrame, text: str, pieces: Pieces, ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``rows`` with the array ``ids`` of ``text``, without begin and end signs.

    Blanks become the blank sign and one is put in front. Texts are cut between
    characters that no piece holds side by side; each distinct word of a slice of
    texts is encoded once, by rounds of merges. Characters that are no piece give
    their UTF-8 bytes. Null and empty texts give an empty array, long texts are
    encoded whole, repeated rows alike; an empty table gives an empty one. With
    ``decoded``, the ids are decoded again into a column of that name, as
    :func:`decode` does. A column that is already called like a new one is
    replaced, all others stay.
    """
    tables = rows.sparkSession.sparkContext.broadcast(pieces)
    cast = rows.withColumn(text, F.col(f"`{text}`").cast("string"))
    names: dict[str, DataType] = {ids: ArrayType(IntegerType())}
    if decoded is not None:
        names[decoded] = StringType()

    def make(column: pa.Array) -> list[pa.Array]:
        coded = encode_texts(column, tables.value)
        return [coded] if decoded is None else [coded, decode_ids(coded, tables.value)]

    return _with(cast, names, text, make)


def decode(rows: DataFrame, ids: str, pieces: Pieces, text: str = "decoded") -> DataFrame:
    """``rows`` with the string ``text`` of the array ``ids``.

    Control signs give nothing, ids outside the vocabulary and null ids the
    unknown sign, bytes that are no UTF-8 the replacement character, one for each
    byte. A null array gives null, an empty one the empty text. A column that is
    already called ``text`` is replaced, all others stay.
    """
    tables = rows.sparkSession.sparkContext.broadcast(pieces)
    return _with(rows, {text: StringType()}, ids, lambda column: [decode_ids(column, tables.value)])
