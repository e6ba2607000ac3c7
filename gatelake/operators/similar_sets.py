"""Word sets with a Jaccard similarity above a floor, cell by cell.

A cell holds the sets of a repository in a class of sizes, as the rare words at
the head of each set (32-bit hashes) and one parity bit for many words.  A set
visits its own cell and the one below, so all pairs above the floor meet.  Pairs
leave a cell as lists of partners, and are then checked on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values -------------------------------------------------------------
#: Counters of words or sets, and of them in a slice.
COUNTERS, SLICE = 1 << 22, 1 << 16
#: Counters of cells.
CELLS = 1 << 16
#: Classes of sizes at most; the last one takes all larger sets.
CLASSES = 4_096
#: Bytes of heads and parity bits: in a block of a cell, in a part of the sets that search it, and of those searched together.
BLOCK_BYTES, PART_BYTES, SEARCH_BYTES = 16 << 20, 64 << 20, 4 << 20
#: Shared words, longs of parity bits and parity bits that are held at once.
HITS, LONGS, BITS = 1_000_000, 1_000_000, 4_000_000
#: Sets that are dealt to blocks together.
VISITORS = 1_000
#: Sets that are checked together at most, and their words.
UNIT_SETS, UNIT_WORDS = 1_000, 250_000
# ---------------------------------------------------------------------------


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``begin, begin + 1, ...`` of all ranges, one after another."""
    return np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """One binary value of ``sizes`` bytes a row."""
    ends = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows, and how many each has."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    return np.frombuffer(held or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _hashes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column("hashes")
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy().view(np.uint64), sizes


# -- sizes -----------------------------------------------------------------------


def size_classes(floor: float) -> np.ndarray:
    """Least sizes of the classes: partners above the floor are of one class or of neighbours."""
    begins = [1]
    while floor > 0 and begins[-1] < 1 << 30 and len(begins) < CLASSES:
        least = max(begins[-1] + 1, int(begins[-1] / floor) - 1)
        while floor * least < begins[-1]:
            least += 1
        begins.append(least)
    return np.array(begins)


def parity_bits(classes: np.ndarray) -> np.ndarray:
    """Parity bits of the sets of each class: a power of two, at least two for a word."""
    most = np.minimum(np.r_[classes[1:], 1 << 16], 1 << 16)
    return np.maximum(64, 1 << np.ceil(np.log2(2 * most)).astype(np.int64))


def head_sizes(sizes: np.ndarray, share: float) -> np.ndarray:
    """Words of which one at least is shared by two sets with ``share`` of the words in common."""
    return np.clip(sizes - np.ceil(share * sizes - 1e-9).astype(np.int64) + 1, 0, sizes)


# -- counts ----------------------------------------------------------------------


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(42)).astype(np.int64)


def raise_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``slice, at, n``: the counters that a task raises, as 16-bit places and 32-bit counts."""
    counts = np.zeros(COUNTERS, np.uint32)
    for batch in batches:
        hashes, _ = _hashes(batch)
        places, raised = np.unique(_counter(hashes), return_counts=True)
        counts[places] += raised.astype(np.uint32)
    for no, part in enumerate(counts.reshape(-1, SLICE)):
        at = np.flatnonzero(part)
        if len(at):
            values = [pa.array([no], pa.int32()), pa.array([at.astype(np.uint16).tobytes()]), pa.array([part[at].tobytes()])]
            yield pa.RecordBatch.from_arrays(values, ["slice", "at", "n"])


def add_counters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``slice, ranks``: a byte for each counter of a slice, which grows with the logarithm of its sum; 0 if nothing raised it."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for no, at, n in zip(*(batch.column(c).to_pylist() for c in ("slice", "at", "n")), strict=True):
            sums.setdefault(no, np.zeros(SLICE, np.int64))[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
    for no, part in sums.items():
        ranks = np.where(part > 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(1, part))), 0).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([no], pa.int32()), pa.array([ranks.tobytes()])], ["slice", "ranks"])


def keep_raised(batches: Iterator[pa.RecordBatch], ranks: bytes) -> Iterator[pa.RecordBatch]:
    """The rows whose counter was raised, without its column ``mark``."""
    rank = np.frombuffer(ranks, np.uint8)
    for batch in batches:
        raised = rank[_counter(batch.column("mark").to_numpy().view(np.uint64))] > 0
        yield batch.select([c for c in batch.schema.names if c != "mark"]).filter(pa.array(raised))


# -- heads -----------------------------------------------------------------------


def sort_words(batches: Iterator[pa.RecordBatch], ranks: bytes, floor: float) -> Iterator[pa.RecordBatch]:
    """The other columns with ``n, class, near, head, bits``: the words of a set from rare to frequent.

    The order of words is their counter, then their hash: the same for all sets,
    whatever the counters hold.  ``near`` is the least hash, which similar sets often share.
    """
    rank, classes = np.frombuffer(ranks, np.uint8), size_classes(floor)
    wide = parity_bits(classes)
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "hashes"]
        sizes = pc.list_value_length(batch.column("hashes")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(wide[np.searchsorted(classes, sizes, "right") - 1]) // BITS
        for rows in np.split(np.arange(len(batch)), np.flatnonzero(np.diff(part)) + 1):
            if not len(rows):
                continue
            own = batch.slice(rows[0], len(rows))
            hashes, sizes = _hashes(own)
            low = hashes & np.uint64(0xFFFFFFFF)
            row = np.repeat(np.arange(len(own)), sizes)
            ranked = rank[_counter(hashes)].astype(np.uint64)
            order = np.sort(row.astype(np.uint64) << np.uint64(40) | ranked << np.uint64(32) | low)
            begins = np.cumsum(sizes) - sizes
            held = head_sizes(sizes, floor)
            head = order[_spread(begins, held)].astype(np.uint32)
            kind = np.searchsorted(classes, sizes, "right") - 1
            bits = wide[kind]
            place = np.repeat(np.cumsum(bits) - bits, sizes) + (low.astype(np.int64) & np.repeat(bits - 1, sizes))
            parity = np.packbits((np.bincount(place, minlength=bits.sum()) & 1).astype(np.uint8), bitorder="little")
            values = [pa.array(sizes.astype(np.int32)), pa.array(kind.astype(np.int32)), pa.array(np.minimum.reduceat(low, begins).astype(np.int64)),
                      _binary(head, 4 * held), _binary(parity, bits // 8)]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in kept), *values], [*kept, "n", "class", "near", "head", "bits"])


def visit_cells(batches: Iterator[pa.RecordBatch], weights: dict[int, int]) -> Iterator[pa.RecordBatch]:
    """The visits of each set to the blocks and parts of its own cell and the one below, ``of`` class.

    As a smaller partner (``role`` 0 and 1) it is in a block of its own cell, in all
    parts; as a larger one (``role`` 0 and 2) in a part of either cell, in all blocks.
    """
    held = np.zeros(CELLS, np.int64)
    held[list(weights)] = list(weights.values())
    for batch in (x.slice(begin, VISITORS) for x in batches for begin in range(0, len(x), VISITORS)):
        kept = [c for c in batch.schema.names if c not in ("class", "below", "cell", "above")]
        kind = batch.column("class").to_numpy()
        below, cell, above = (held[batch.column(c).to_numpy()] for c in ("below", "cell", "above"))
        mixed = (batch.column("set").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
        for weight, larger, lower in ((cell, above, 0), (np.where(kind > 0, below, 0), cell, 1)):
            blocks, parts = -(-weight // BLOCK_BYTES), -(-(weight + larger) // PART_BYTES)
            rows = np.repeat(np.arange(len(batch)), blocks * parts)
            place = _spread(np.zeros(len(batch), np.int64), blocks * parts)
            block, part = place // parts[rows], place % parts[rows]
            smaller = block == mixed[rows] % blocks[rows] if not lower else np.zeros(len(rows), bool)
            asks = part == mixed[rows] // 7 % parts[rows]
            role = np.where(smaller, np.where(asks, 0, 1), 2)
            some = smaller | asks
            out = batch.select(kept).take(pa.array(rows[some]))
            values = [pa.array(x[some].astype(np.int32)) for x in (kind[rows] - lower, block, part, role)]
            yield pa.RecordBatch.from_arrays([*out.columns, *values], [*kept, "of", "block", "part", "role"])


# -- cells -----------------------------------------------------------------------


class Rows:
    """Sets with their heads and parity bits."""

    PLAIN = ("cell", "set", "n", "of", "near", "role")

    def __init__(self, plain: dict[str, np.ndarray], head: np.ndarray, heads: np.ndarray, bits: np.ndarray, longs: np.ndarray) -> None:
        self.plain, self.head, self.heads, self.bits, self.longs = plain, head, heads, bits, longs
        self.at_head, self.at_bits = np.cumsum(heads) - heads, np.cumsum(longs) - longs

    @classmethod
    def read(cls, batch: pa.RecordBatch, cell: np.ndarray) -> Rows:
        (head, heads), (bits, longs) = _bytes(batch.column("head")), _bytes(batch.column("bits"))
        plain = {"cell": cell} | {c: batch.column(c).to_numpy().astype(np.int64) for c in cls.PLAIN[1:]}
        return cls(plain, head.copy().view(np.uint32), heads // 4, bits.copy().view(np.uint64), longs // 8)

    @classmethod
    def joined(cls, parts: list[Rows]) -> Rows:
        plain = {c: np.concatenate([x.plain[c] for x in parts]) for c in cls.PLAIN}
        return cls(plain, *(np.concatenate([getattr(x, c) for x in parts]) for c in ("head", "heads", "bits", "longs")))

    def __len__(self) -> int:
        return len(self.heads)

    def __getitem__(self, name: str) -> np.ndarray:
        return self.plain[name]

    def take(self, rows: np.ndarray) -> Rows:
        head, bits = _spread(self.at_head[rows], self.heads[rows]), _spread(self.at_bits[rows], self.longs[rows])
        return Rows({c: v[rows] for c, v in self.plain.items()}, self.head[head], self.heads[rows], self.bits[bits], self.longs[rows])

    def parity(self, rows: np.ndarray, longs: int) -> np.ndarray:
        """Parity bits of rows with equally many, folded to ``longs`` a row."""
        many = self.longs[rows[0]]
        held = self.bits[self.at_bits[rows][:, None] + np.arange(many)]
        while held.shape[1] > longs:
            half = held.shape[1] // 2
            held = held[:, :half] ^ held[:, half:]
        return held


def _units(x: Rows) -> np.ndarray:
    """For each set the number of the first one of those it is checked with: near ones of its cell."""
    order = np.lexsort((x["set"], x["near"], x["cell"]))
    cell, n = x["cell"][order], np.maximum(x["n"][order], UNIT_WORDS // UNIT_SETS)
    first = np.r_[True, cell[1:] != cell[:-1]]
    before = np.cumsum(n) - n
    tile = (before - before[np.flatnonzero(first)][np.cumsum(first) - 1]) // UNIT_WORDS
    first[1:] |= tile[1:] != tile[:-1]
    units = np.empty(len(x), np.int64)
    units[order] = x["set"][order][first][np.cumsum(first) - 1]
    return units


class Index:
    """The smaller partners of some cells by the words of their heads."""

    def __init__(self, x: Rows, floor: float) -> None:
        self.x, self.floor, self.units = x, floor, _units(x)
        held = head_sizes(x["n"], 2 * floor / (1 + floor))
        words = np.repeat(x["cell"], held) << 32 | x.head[_spread(x.at_head, held)].astype(np.int64)
        order = np.argsort(words)
        self.owner = np.repeat(np.arange(len(x), dtype=np.int32), held)[order]
        self.words, self.first, self.many = np.unique(words[order], return_index=True, return_counts=True)

    def partners(self, y: Rows) -> Iterator[pa.RecordBatch]:
        """``set, unit, partners``: for sets of ``y`` the smaller ones of the same cell that can be above the floor; and these, without partners."""
        if not len(self.words) or not len(y):
            return
        x, units = self.x, self.units
        # Sorted words are looked up faster than others.
        asked = np.repeat(y["cell"], y.heads) << 32 | y.head.astype(np.int64)
        order = np.argsort(asked)
        place = np.empty(len(asked), np.int64)
        place[order] = np.minimum(np.searchsorted(self.words, asked[order]), len(self.words) - 1)
        hit = self.words[place] == asked
        place, asker = place[hit], np.repeat(np.arange(len(y)), y.heads)[hit]
        begins, counts = self.first[place], self.many[place]
        # A set of y is never cut in two, so that its pairs are told apart at once.
        total = np.cumsum(np.bincount(asker, weights=counts, minlength=len(y)))
        part = (total // HITS).astype(np.int64)[asker]
        for own in np.split(np.arange(len(asker)), np.flatnonzero(np.diff(part)) + 1):
            if not len(own):
                continue
            i, j = self.owner[_spread(begins[own], counts[own])], np.repeat(asker[own], counts[own])
            nx, ny = x["n"][i], y["n"][j]
            kept = (nx > self.floor * ny) & ((nx < ny) | ((nx == ny) & (x["set"][i] < y["set"][j])))
            pairs = np.unique(j[kept] * len(x) + i[kept])
            i, j = pairs % len(x), pairs // len(x)
            kept = self._few_apart(y, i, j)
            i, j = i[kept], j[kept]
            if not len(i):
                continue
            order = np.lexsort((units[i], j))
            i, j, unit = i[order], j[order], units[i][order]
            cuts = np.flatnonzero(np.r_[True, (j[1:] != j[:-1]) | (unit[1:] != unit[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[cuts, len(i)].astype(np.int32)), pa.array(x["set"][i]))
            yield pa.RecordBatch.from_arrays([pa.array(y["set"][j[cuts]]), pa.array(unit[cuts]), lists], ["set", "unit", "partners"])
            told = np.unique(i)
            yield pa.RecordBatch.from_arrays([pa.array(x["set"][told]), pa.array(units[told]), pa.nulls(len(told), lists.type)], ["set", "unit", "partners"])

    def _few_apart(self, y: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether parity bits differ in no more places than words may."""
        x, kept = self.x, np.zeros(len(i), bool)
        most = (1 - self.floor) / (1 + self.floor) * (x["n"][i] + y["n"][j]) + 1e-6
        sort = x.longs[i] << 32 | y.longs[j]
        for kind in np.unique(sort):
            longs = int(kind >> 32)
            same = np.flatnonzero(sort == kind)
            for some in np.array_split(same, -(-len(same) * int(kind & 0xFFFFFFFF) // LONGS)):
                apart = np.bitwise_count(x.parity(i[some], longs) ^ y.parity(j[some], longs)).sum(axis=1, dtype=np.int64)
                kept[some] = apart <= most[some]
        return kept


def find_partners(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """Lists of partners from rows sorted by ``repo, of, block, part, role``."""
    held: list[Rows] = []
    last, no, index = None, 0, None

    def answers(every: bool) -> Iterator[pa.RecordBatch]:
        """All that is held, but cells whose smaller partners may not have come yet."""
        nonlocal held, index
        rows = Rows.joined(held)
        done = np.full(len(rows), True) if every else (rows["cell"] < no) | bool(rows["role"][-1] == 2)
        held = [] if done.all() else [rows.take(np.flatnonzero(~done))]
        smaller = np.flatnonzero((rows["role"] < 2) & done)
        if len(smaller):
            known = [] if index is None else [index.x.take(np.flatnonzero(index.x["cell"] == rows["cell"][0]))]
            index = Index(Rows.joined([*known, rows.take(smaller)]), floor)
        if index is None:
            return
        asks = np.flatnonzero((rows["role"] != 1) & done)
        part = np.cumsum(4 * rows.heads + 8 * rows.longs)[asks] // SEARCH_BYTES
        for some in np.split(asks, np.flatnonzero(np.diff(part)) + 1):
            yield from index.partners(rows.take(some))

    for batch in batches:
        if not len(batch):
            continue
        keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("repo", "of", "block", "part")]
        new = np.r_[tuple(k[0] for k in keys) != last, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]
        cell = no + np.cumsum(new)
        last, no = tuple(k[-1] for k in keys), int(cell[-1])
        held.append(Rows.read(batch, cell))
        if sum(x.head.nbytes + x.bits.nbytes for x in held) >= SEARCH_BYTES:
            yield from answers(False)
    if held:
        yield from answers(True)


# -- check -----------------------------------------------------------------------


class Unit:
    """Sets that are checked together, as numbers of their words, and the best earlier one that each has met."""

    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows = sorted(rows, key=lambda row: row[0])
        self.sets, self.numbers = (np.array([row[c] for row in rows]) for c in (0, 2))
        self.known: dict[str, int] = {}
        sets = [row[3].split(" ") for row in rows]
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.words = np.array([self.known.setdefault(w, len(self.known) + 1) for x in sets for w in x], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.held = np.zeros(len(self.known) + 1, bool)
        self.sims, self.earlier = np.zeros(len(rows)), self.numbers.copy()

    def similar(self, words: list[str], partners: np.ndarray) -> np.ndarray:
        """The share of common words with each of the partners."""
        own = np.fromiter(map(self.known.get, words, repeat(0)), np.int64, len(words))
        self.held[own] = True
        self.held[0] = False
        sizes = self.sizes[partners]
        at = _spread(self.begins[partners], sizes)
        shared = np.add.reduceat(self.held[self.words[at]], np.cumsum(sizes) - sizes, dtype=np.int64)
        self.held[own] = False
        return shared / (sizes + len(words) - shared)

    def meet(self, row: tuple, sets: np.ndarray, floor: float) -> tuple | None:
        """The best earlier one of a set; the later ones of its partners keep it if it is their best."""
        at = np.searchsorted(self.sets, sets)
        sims = self.similar(row[3].split(" "), at)
        at, sims = at[sims > floor], sims[sims > floor]
        others = self.numbers[at]
        later = others > row[2]
        own, sim = at[later], sims[later]
        better = (sim > self.sims[own]) | ((sim == self.sims[own]) & (self.earlier[own] > row[2]))
        self.sims[own[better]], self.earlier[own[better]] = sim[better], row[2]
        sims, others = sims[others < row[2]], others[others < row[2]]
        return (row[1], row[2], others[sims == sims.max()].min(), sims.max()) if len(sims) else None

    def met(self) -> Iterator[tuple]:
        for i in np.flatnonzero(self.sims > 0):
            yield (*self.rows[i][1:3], self.earlier[i], self.sims[i])


def best_earlier(batches: Iterator[pa.RecordBatch], floor: float) -> Iterator[pa.RecordBatch]:
    """``repo, number, earlier, sim`` from rows sorted by ``unit`` with its sets (``told``) before others that have partners in it.

    Of each unit a set gets its best earlier one: the highest similarity, then the lowest number.
    """
    here, told, unit, best, kinds = None, [], None, [], []

    def opened() -> Unit:
        """The unit, once all its sets have come; those with partners in it meet them."""
        now = Unit([row for row, _ in told])
        best.extend(filter(None, (now.meet(row, partners, floor) for row, partners in told if len(partners))))
        return now

    def answers() -> Iterator[pa.RecordBatch]:
        if best:
            values = [pa.array(x, kind) for x, kind in zip(zip(*best, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(values, ["repo", "number", "earlier", "sim"])
        best.clear()

    for batch in batches:
        kinds = [*(batch.schema.field(c).type for c in ("repo", "number", "number")), pa.float64()]
        sizes = pc.list_value_length(batch.column("partners")).fill_null(0).to_numpy(zero_copy_only=False)
        ends, asked = np.cumsum(sizes), batch.column("partners").flatten().to_numpy()
        rows = zip(*(batch.column(c).to_pylist() for c in ("unit", "told", "set", "repo", "number", "words")), strict=True)
        for i, (at, of_unit, *row) in enumerate(rows):
            if at != here:
                if told:
                    best.extend((unit or opened()).met())
                here, told, unit = at, [], None
            partners = asked[ends[i] - sizes[i] : ends[i]]
            if of_unit:
                told.append((row, partners.copy()))
                continue
            unit = unit or opened()
            best.extend(filter(None, [unit.meet(row, partners, floor)]))
        yield from answers()
    if told:
        best.extend((unit or opened()).met())
    yield from answers()
