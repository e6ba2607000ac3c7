"""Titles that hold all keywords of a search, block by block.

A task reads the titles of a block and then its searches, in Arrow batches.  The
titles become posting lists in order of newness; a search walks the list of the
keyword that is rarest in the block and tests the others, by a bit for frequent
words and by binary search for rare ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Fixed values -------------------------------------------------------------
#: Searches answered together, and hits of the rarest keyword that are held at once.
SEARCHES, HITS = 65_536, 4_000_000
#: Words that at least this share of the titles hold have a bit for each title.
FREQUENT = 64
# ---------------------------------------------------------------------------


def _first_of_each(keys: np.ndarray, most: int) -> np.ndarray:
    """Whether a row is among the first ``most`` of its key; equal keys are neighbours."""
    begins = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return np.arange(len(keys)) - np.repeat(begins, np.diff(np.r_[begins, len(keys)])) < most


def _spread(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The positions ``begin, begin + 1, ...`` of all ranges, one after another."""
    return np.arange(counts.sum()) + np.repeat(begins - np.cumsum(counts) + counts, counts)


def _lists(rows: pa.Table, name: str) -> tuple[pa.Array, np.ndarray]:
    column = rows.column(name).combine_chunks()
    return column.flatten(), pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """Posting lists of the titles of a block, the newest title first."""

    def __init__(self, titles: pa.Table) -> None:
        ids = titles.column("set_id").to_numpy()
        newest = np.argsort(-ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[newest] = np.arange(len(ids))
        words, sizes = _lists(titles, "words")
        coded = words.dictionary_encode()
        self.words, codes, self.size = coded.dictionary, coded.indices.to_numpy().astype(np.int64), len(ids)
        self.df = np.bincount(codes, minlength=len(self.words))
        self.starts = np.cumsum(self.df) - self.df
        self.keys = codes * self.size + np.repeat(place, sizes)
        self.keys.sort()
        self.titles = (self.keys % self.size).astype(np.int32)
        often = np.flatnonzero(self.df * FREQUENT >= self.size)
        self.row = np.full(len(self.words), -1, np.int64)
        self.row[often] = np.arange(len(often))
        self.bits = np.zeros((len(often), (self.size + 7) // 8), np.uint8)
        for row, word in enumerate(often):
            held = np.zeros(self.size, bool)
            held[self.titles[self.starts[word] : self.starts[word] + self.df[word]]] = True
            self.bits[row] = np.packbits(held)
        numbers, counts = _lists(titles, "numbers")
        begins = np.cumsum(counts) - counts
        self.numbers, self.counts, self.begins = numbers.to_numpy(), counts[newest], begins[newest]
        _, same, copies = np.unique(ids[newest], return_inverse=True, return_counts=True)
        self.copies = copies[same]

    def _holds(self, titles: np.ndarray, words: np.ndarray) -> np.ndarray:
        rows = self.row[words]
        out = np.empty(len(titles), bool)
        often = rows >= 0
        at = titles[often]
        out[often] = self.bits[rows[often], at >> 3] >> (7 - (at & 7)) & 1
        key = words[~often] * self.size + titles[~often]
        out[~often] = self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key
        return out

    def answer(self, searches: pa.Table, slots: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Search and candidate: the newest ``slots`` numbers of titles with all keywords."""
        asked = searches.column("query").to_numpy()
        words, sizes = _lists(searches, "words")
        codes = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        nth = _spread(np.zeros(len(sizes), np.int64), sizes)
        needs = np.full((len(asked), sizes.max()), -2, np.int64)
        needs[np.repeat(np.arange(len(asked)), sizes), nth] = codes
        known = (needs != -1).all(axis=1)
        if not known.any():
            return
        asked, needs = asked[known], needs[known]
        often = np.where(needs >= 0, self.df[np.maximum(needs, 0)], np.iinfo(np.int64).max)
        needs = np.take_along_axis(needs, np.argsort(often, axis=1, kind="stable"), axis=1)
        least = self.df[needs[:, 0]]
        part = np.cumsum(least) // HITS
        for own in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(part)) + 1):
            if len(own):
                yield self._newest(asked[own], needs[own], least[own], slots)

    def _newest(self, asked: np.ndarray, needs: np.ndarray, least: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
        search = np.repeat(np.arange(len(asked)), least)
        title = self.titles[_spread(self.starts[needs[:, 0]], least)].astype(np.int64)
        for nth in range(1, needs.shape[1]):
            word = needs[search, nth]
            kept = word < 0
            kept[~kept] = self._holds(title[~kept], word[~kept])
            search, title = search[kept], title[kept]
        # Each title gives its own number at least, so older titles can't reach a slot.
        kept = _first_of_each(search, slots)
        search, title = (np.repeat(x[kept], self.copies[title[kept]]) for x in (search, title))
        counts = self.counts[title]
        search, number = np.repeat(search, counts), self.numbers[_spread(self.begins[title], counts)]
        order = np.lexsort((-number, search))
        search, number = search[order], number[order]
        kept = _first_of_each(search, slots)
        return asked[search[kept]], number[kept]


def search_blocks(batches: Iterator[pa.RecordBatch], slots: int) -> Iterator[pa.RecordBatch]:
    """``query, candidate`` from rows sorted by ``repo, block`` with titles (no ``query``) before searches."""
    here, titles, searches, block = None, [], [], None

    def answers(least: int) -> Iterator[pa.RecordBatch]:
        nonlocal titles, searches, block
        if not searches or sum(map(len, searches)) < least:
            return
        if titles:
            block, titles = Block(pa.Table.from_batches(titles)), []
        asked, searches = pa.Table.from_batches(searches), []
        if block is not None:
            kind = asked.schema.field("set_id").type
            for query, candidate in block.answer(asked, slots):
                yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(candidate, kind)], ["query", "candidate"])

    for batch in batches:
        repos, blocks = batch.column("repo").to_numpy(zero_copy_only=False), batch.column("block").to_numpy()
        cuts = np.flatnonzero((repos[1:] != repos[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for begin, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
            if begin == end:
                continue
            if (repos[begin], blocks[begin]) != here:
                yield from answers(1)
                here, titles, block = (repos[begin], blocks[begin]), [], None
            own = batch.slice(begin, end - begin)
            told = own.column("query").null_count
            if told:
                titles.append(own.slice(0, told))
            if told < len(own):
                searches.append(own.slice(told))
                yield from answers(SEARCHES)
    yield from answers(1)
