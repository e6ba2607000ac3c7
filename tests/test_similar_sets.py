import random

import numpy as np
import pyarrow as pa
import pytest

from gatelake.operators import matching as m
from gatelake.operators import similar_sets as s


def near_copies(seed, repos=("q", "r")):
    """Number to repository and words: groups of near copies of all sizes."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    sets = {}
    for _ in range(60):
        base = rnd.sample(words, rnd.choice([1, 3, 8, 20, 60]))
        for _ in range(rnd.choice([1, 2, 15])):
            sets[len(sets) + 1] = (rnd.choice(repos), sorted({w if rnd.random() > 0.05 else rnd.choice(words) for w in base}))
    return sets


def best_of(sets, floor):
    out = {}
    for n, (repo, words) in sets.items():
        sims = [(len({*words} & {*w}) / len({*words} | {*w}), -o) for o, (r, w) in sets.items() if r == repo and o < n]
        sims = [x for x in sims if x[0] > floor]
        if sims:
            out[n] = (-max(sims)[1], max(sims)[0])
    return out


def batches(table, rows):
    return iter(table.to_batches(max_chunksize=rows))


def searched(sets, floor, rows):
    """The same steps as ``similar_issues``, without Spark."""
    hashed = pa.table({
        "repo": [r for r, _ in sets.values()], "set": pa.array(sets, pa.int64()),
        "hashes": [[hash((r, w)) for w in words] for r, words in sets.values()],
    })
    ranks = bytes(np.random.default_rng(3).integers(1, 4, s.COUNTERS, np.uint8))
    heads = pa.Table.from_batches(s.sort_words(batches(hashed, rows), ranks, floor))
    slots = {}
    for name, i in (("below", -1), ("cell", 0), ("above", 1)):
        of = [(r, c + i) for r, c in zip(*(heads.column(x).to_pylist() for x in ("repo", "class")), strict=True)]
        heads = heads.append_column(name, pa.array([slots.setdefault(x, len(slots)) for x in of], pa.int32()))
    weights = {}
    for cell, head, bits in zip(*(heads.column(c).to_pylist() for c in ("cell", "head", "bits")), strict=True):
        weights[cell] = weights.get(cell, 0) + len(head) + len(bits)
    visits = pa.Table.from_batches(s.visit_cells(batches(heads, rows), weights))
    order = ["repo", "of", "block", "part", "role"]
    visits = visits.sort_by([(c, "ascending") for c in order])
    found = pa.Table.from_batches(s.find_partners(batches(visits, rows), floor))
    units = {}
    for x in found.to_pylist():
        row = units.setdefault((x["unit"], x["set"]), [False, []])
        row[0 if x["partners"] is None else 1] = x["partners"] is None or x["partners"]
    told = [dict(unit=u, told=t, set=n, repo=sets[n][0], number=n, words=" ".join(sets[n][1]), partners=p) for (u, n), (t, p) in units.items()]
    kinds = pa.schema([("unit", pa.int64()), ("told", pa.bool_()), ("set", pa.int64()), ("repo", pa.string()), ("number", pa.int64()),
                       ("words", pa.string()), ("partners", pa.list_(pa.int64()))])
    told = pa.Table.from_pylist(sorted(told, key=lambda x: (x["unit"], not x["told"])), kinds)
    best = {}
    for batch in s.best_earlier(batches(told, rows), floor):
        for x in batch.to_pylist():
            best[x["number"]] = max(best.get(x["number"], (0, 0)), (x["sim"], -x["earlier"]))
    return visits, found, {n: (-earlier, sim) for n, (sim, earlier) in best.items()}


@pytest.mark.parametrize("floor", [0.8, 0.5, 0.95])
def test_blocks_parts_and_units_of_any_size_give_the_same(monkeypatch, floor):
    sets = near_copies(5)
    want = best_of(sets, floor)
    assert len(want) > 100
    plain = searched(sets, floor, 1_000)
    assert plain[2] == want
    for name, value in {"BLOCK_BYTES": 400, "PART_BYTES": 700, "SEARCH_BYTES": 300, "HITS": 20, "LONGS": 8, "BITS": 500, "UNIT_SETS": 3, "UNIT_WORDS": 60, "VISITORS": 7}.items():
        monkeypatch.setattr(s, name, value)
    visits, found, got = searched(sets, floor, 11)
    assert got == want
    assert visits.num_rows > plain[0].num_rows and found.num_rows > plain[1].num_rows
    # A pair meets in one block and part only.
    pairs = [(x["set"], p) for x in found.to_pylist() for p in x["partners"] or ()]
    assert len(pairs) == len({*pairs})


def test_partners_are_of_neighbouring_classes():
    for floor in (0.1, 0.34, 0.5, 0.8, 0.9, 0.99, 1.0):
        classes = s.size_classes(floor)
        least = np.array([1, 2, 3, 5, 17, 100, 999, 12_345])
        most = np.ceil(least / floor).astype(int) + 1
        most = np.where(least > floor * most, most, most - 1)
        most = np.where(least > floor * most, most, np.maximum(least, most - 1))
        of = [np.searchsorted(classes, x, "right") for x in (least, most)]
        assert (of[1] - of[0] <= 1).all() and (np.diff(s.parity_bits(classes)) >= 0).all()
    assert len(s.size_classes(0)) == 1


def test_words_are_not_shuffled_once_a_pair(spark):
    # 150 near copies of a long title make 11,175 pairs.
    rnd = random.Random(23)
    words = [f"word{i}" for i in range(400)]
    titles = {n: " ".join(w if rnd.random() > 0.02 else f"x{rnd.randrange(10**6)}" for w in words) for n in range(150)}
    issues = spark.createDataFrame([("r", n, t) for n, t in titles.items()], "repo string, number bigint, title string")

    def shuffled():
        executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    before = shuffled()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {x.number: (x.duplicate_of, x.similarity) for x in m.similar_issues(issues).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == best_of({n: ("r", t.split()) for n, t in titles.items()}, 0.8)
    assert shuffled() - before < 2_000_000


def test_numbers_and_repositories_of_other_types(spark):
    rows = [(1, 7.5, "a b c d e f g h i j"), (1, 2.5, "a b c d e f g h i j"), (1, 9.0, "a b c d e f g h i j k"), (2, 1.0, "a b c d e f g h i j"), (None, 3.0, "a b"), (1, None, "a b"), (1, 4.0, None)]
    issues = spark.createDataFrame(rows, "repo int, number double, title string")
    got = {(x.repo, x.number): (x.duplicate_of, x.similarity) for x in m.similar_issues(issues).collect()}
    assert got == {(1, 7.5): (2.5, 1.0), (1, 9.0): (2.5, 10 / 11)}
