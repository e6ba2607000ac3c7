"""Hard negatives, collocations and piece encoding against plain Python, and on odd rows."""

import collections
import itertools
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from gatelake.llm import collocations, hard_negatives, pieces, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


# --- hard negatives ---


def _negatives(rows, is_anchor, positives=5, negatives=3):
    used = []
    for key, vector, label in rows:
        if key is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        used.append((key, [math.floor(256 * x) for x in vector], label))
    out = []
    for i, (key, vector, label) in enumerate(used):
        if not is_anchor(key):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(vector, v, strict=False)), k, lab) for j, (k, v, lab) in enumerate(used) if j != i
        )
        for minus, pos, _ in [s for s in scored if s[2] == label][:positives]:
            fits = [s for s in scored if s[2] != label and 50 * -minus <= 100 * -s[0] <= 95 * -minus][:negatives]
            out += [(key, pos, rank, neg, -minus, -score) for rank, (score, neg, _) in enumerate(fits, 1)]
    return sorted(out)


def _mined(spark, rows, every):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = hard_negatives.mine_negatives(frame, "vec_id", "embedding", "label", F.col("vec_id") % every == 0)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block_rows, part_blocks, tile", [(1024, 64, 512), (16, 2, 8)])
def test_negatives_equal_brute_force(spark, monkeypatch, block_rows, part_blocks, tile):
    for name, value in (("BLOCK_ROWS", block_rows), ("PART_BLOCKS", part_blocks), ("TILE", tile)):
        monkeypatch.setattr(hard_negatives, name, value)
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(6, 12))
    rows = [
        (i, [float(np.float32(x)) for x in centres[i % 6] * 0.4 + draw.normal(size=12) * 0.3], int(draw.integers(0, 4)))
        for i in range(300)
    ]
    rows += [(300 + i, rows[7][1], i % 3) for i in range(40)]  # a group of equal vectors: only keys decide
    assert _mined(spark, rows, 10) == _negatives(rows, lambda k: k % 10 == 0)


def test_negatives_of_odd_rows(spark):
    v = [0.5, 0.25, -0.125]
    rows = [
        (0, v, 1), (1, v, 1), (1, v, 1), (2, [0.4, 0.2, 0.0], 2), (3, None, 1), (4, [None, 1.0, 1.0], 2), (None, v, 2),
        (5, [float("nan"), 0.0, 0.0], 2), (6, [float("inf"), 0.0, 0.0], 2), (7, [0.4], 2), (8, [], 2), (9, v, None),
        (10, [-0.5, -0.25, 0.125], 1), (11, [0.3, 0.2, 0.1, 0.9], 3),
    ]
    assert _mined(spark, rows, 1) == _negatives(rows, lambda k: True)
    assert _mined(spark, rows[:1], 1) == [] and _mined(spark, [rows[4]], 1) == []
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [2e38, 0.0], 2), (3, [-3e38, 0.0], 2)]
    assert _mined(spark, huge, 1) is not None  # held at 64 bits
    large = [(i, [float(np.float32(x)) for x in (1e6 + i, 2e6 - i)], i % 2) for i in range(8)]
    assert _mined(spark, large, 2) == _negatives(large, lambda k: k % 2 == 0)  # products past 2**53
    wide = spark.createDataFrame([(1, v, 1, "x", 2)], "vec_id long, embedding array<float>, label int, q string, part int")
    assert hard_negatives.mine_negatives(wide, "vec_id", "embedding", "label", F.lit(None).cast("boolean")).count() == 0
    assert hard_negatives.mine_negatives(wide.limit(0), "vec_id", "embedding", "label", F.lit(True)).count() == 0


@pytest.mark.parametrize("dimensions, bits", [(1, 5), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_neighbours(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = hard_negatives.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def test_zone_maps_skip_blocks(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 20), ("PART_BLOCKS", 4), ("TILE", 16)):
        monkeypatch.setattr(hard_negatives, name, value)
    read = []
    whole = hard_negatives._evaluate
    monkeypatch.setattr(hard_negatives, "_evaluate", lambda *a: (read.append((a[1].count(), a[0].count() * a[2].count())), whole(*a))[1])
    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.eye(8)[i % 8] * 3 + draw.normal(size=8) * 0.01], i // 8 % 2) for i in range(800)]
    assert _mined(spark, rows, 40) == _negatives(rows, lambda k: k % 40 == 0)
    assert read[1][0] < 0.5 * read[1][1] and read[3][0] < 0.5 * read[3][1]


# --- collocations ---


def _phrases(rows, longest=3, least=10, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    import re

    for text, lang in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        gone = set()
        for p, c in often.items():
            for i in range(len(p)):
                for j in range(i + 2, len(p) + 1):
                    q = p[i:j]
                    if len(q) < len(p) and 100 * c >= 50 * often[q]:
                        gone.add(q)
        found = []
        for p, a in often.items():
            if p not in gone:
                score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def _found(frame, **more):
    return sorted(tuple(r) for r in collocations.find_collocations(frame, "text", F.col("lang"), **more).collect())


def _texts():
    draw = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["É", "é", "New", "new", "york", "times", "Ǆ"]
    out = []
    for i in range(260):
        parts = draw.choices(words, k=draw.randint(0, 30)) + (["New", "York", "Times"] if i % 5 == 0 else [])
        seps = draw.choices([" ", "  ", "\t", ". ", ",", "\n", "\x0b", " "], weights=[20, 2, 1, 2, 1, 1, 1, 1], k=len(parts))
        out.append(("".join(itertools.chain(*zip(parts, seps, strict=True))), draw.choice(["en", "de", None])))
    return out


@pytest.mark.parametrize("longest, least, sample, slice_bytes", [(3, 10, 4, 4 << 20), (2, 3, 1, 300), (4, 4, 40, 500), (5, 6, 3, 4 << 20)])
def test_phrases_equal_brute_force(spark, monkeypatch, longest, least, sample, slice_bytes):
    monkeypatch.setattr(collocations, "SAMPLE_ONE_OF", sample)
    monkeypatch.setattr(collocations, "SLICE_BYTES", slice_bytes)
    rows = _texts()
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert _found(frame, longest=longest, min_count=least) == _phrases(rows, longest, least)
    few = _found(frame, longest=longest, min_count=least, top=3)
    assert few == _phrases(rows, longest, least, 3)


def test_border_failures_are_counted_in_further_passes(spark, monkeypatch):
    texts = spark.createDataFrame([("en", t) for t, _ in _texts()], "lang string, text string")
    empty = {size: np.zeros(1 << 13, np.uint8) for size in (1, 2)}
    monkeypatch.setattr(collocations, "_propose", lambda *a: dict(empty))  # a sample that proposes nothing
    counts, passes = collocations.frequent_phrases(texts, 3, 10)
    assert passes == 3
    got = {(r.w0, r.w1, r.w2): r.n for r in counts.where("n >= 10").collect()}
    monkeypatch.setattr(collocations, "_propose", lambda *a: {size: ~z for size, z in empty.items()})  # or everything
    counts, passes = collocations.frequent_phrases(texts, 3, 10)
    assert counts.where("w1 is null and (lang is null or word is null)").count() == 0
    assert passes == 1 and got == {(r.w0, r.w1, r.w2): r.n for r in counts.where("n >= 10").collect()}
    assert counts.where("n < 10 and w1 is not null").count() == 0


def test_words_and_languages_do_not_stand_for_each_other(spark):
    rows = [("en es de en", "es")] * 12 + [("es en de es", "en")] * 11 + [("de en es", "de")] * 10
    frame = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    assert _found(frame) == _phrases(rows)


def test_words_that_share_a_hash_are_kept_apart(spark, monkeypatch):
    hashes = collocations.word_hashes
    # Seed 0 can't tell words of equal length apart.
    weak = lambda data, starts, ends, seed: hashes(data, starts, ends, seed) if seed else (ends - starts).astype(np.uint64)
    monkeypatch.setattr(collocations, "word_hashes", weak)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 2), pa.array(["one two three one", "two"])], ["lang", "text"])
    for seed, shared in ((0, 2), (1, 0)):
        (got,) = collocations._read_keys(collocations._count([batch], seed, range(1, 2), {}, {}), 2)
        assert sorted(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True)) == [("one", 2), ("three", 1), ("two", 2)]
        hashed = collections.Counter(got["w0"].to_pylist())
        assert sum(n for n in hashed.values() if n > 1) == shared


def test_words_that_share_a_hash_start_another_seed(spark, monkeypatch):
    texts = spark.createDataFrame([("en", "a b c " * 20)] * 3, "lang string, text string")
    seeds, counted = [], collocations._passed

    def passed(texts, seed, longest, sizes, old, new, least, words):
        out = counted(texts, seed, longest, sizes, old, new, least, words)
        if words:
            seeds.append(seed)
            if seed == 0:  # as if two words had met
                out = out.union(out.where("w1 is null").limit(1))
        return out

    monkeypatch.setattr(collocations, "_passed", passed)
    found, _ = collocations.frequent_phrases(texts, 2, 10)
    assert seeds == [0, 1] and found.where("w1 is null").count() == 3


def test_phrases_of_odd_rows(spark, odd, odd_rows, nothing):
    rows = [(r[1], r[2]) for r in odd_rows]
    for least in (1, 2, 10):
        assert _found(odd, min_count=least) == _phrases(rows, 3, least)
    assert _found(nothing) == []


# --- pieces ---


@pytest.fixture(scope="module")
def tables():
    return pieces.read_pieces(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_equal_the_library(tables, library):
    draw = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", " aeiou\n\t▁ 0123", "漢字カナ벨執é ñ𝕏\0", "<s></s><unk><0x0A>     ", "    \n\t  a", "abAB{}();=_ "]
    texts = [None, "", " ", "  ", "▁", " " * 5000, "the " * 3000, "x" * 3000, " " * 33 + "the", "".join(draw.choices(alphabets[0], k=9000))]
    for _ in range(3000):
        letters = "".join(draw.sample(alphabets, draw.randint(1, 3)))
        texts.append("".join(draw.choices(letters, k=draw.randint(0, 80))))
    got = pieces.encode_texts(pa.array(texts, pa.string()), tables)
    want = [library.encode(t or "") for t in texts]
    assert got.to_pylist() == want
    assert pieces.decode_ids(got, tables).to_pylist() == [library.decode(w) for w in want]


def test_rounds_equal_merging_in_turn(tables, monkeypatch):
    draw = random.Random(8)
    words = ["".join(draw.choices("abcdeé▁ 12", k=draw.randint(1, 60))) for _ in range(400)]
    rounds = pieces.encode_texts(pa.array(words), tables)
    monkeypatch.setattr(pieces, "LONG_WORD", 0)
    assert pieces.encode_texts(pa.array(words), tables).to_pylist() == rounds.to_pylist()


def test_any_ids_decode_as_in_the_library(tables, library):
    draw = random.Random(9)
    lists = [[draw.choice([0, 1, 2, *range(3, 300), draw.randrange(32000)]) for _ in range(draw.randint(0, 9))] for _ in range(5000)]
    got = pieces.decode_ids(pa.array(lists, pa.list_(pa.int32())), tables).to_pylist()
    assert got == [library.decode(ids) for ids in lists]
    strange = pieces.decode_ids(pa.array([[40000, -1, None], None, []], pa.list_(pa.int32())), tables).to_pylist()
    assert strange == [library.decode([0, 0, 0]), None, ""]


def test_bytes_that_are_no_text_become_replacement_characters(tables, library):
    raw = [b"ok \xff\xfe end", "é".encode()[:1], b"\xed\xa0\x80"]
    got = pieces.encode_texts(pa.array(raw, pa.binary()), tables).to_pylist()
    assert got == [library.encode("ok �� end"), library.encode("�"), library.encode("�" * 3)]


def test_encoding_keeps_rows_and_columns(spark, odd, odd_rows, nothing, tables, library):
    clash = odd.withColumnRenamed("n", "_given").withColumnRenamed("size", "ids").withColumnRenamed("key", "c0")
    coded = pieces.encode(clash, "text", tables)
    assert sorted(coded.columns) == sorted(clash.columns)
    back = pieces.decode(coded, "ids", tables)
    assert back.columns == [*coded.columns, "decoded"]
    got = collections.Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in back.collect())
    want = collections.Counter((r[0], r[1], tuple(library.encode(r[1] or "")), (r[1] or "")) for r in odd_rows)
    assert got == want
    both = pieces.encode(clash, "text", tables, decoded="c0")
    assert collections.Counter((r.doc_id, r.text, tuple(r.ids), r.c0) for r in both.collect()) == want
    assert pieces.decode(pieces.encode(nothing, "text", tables), "ids", tables).count() == 0


def test_query_digests(spark, library):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.JOBS["op13_piece_rounds"](spark, SF).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        want = (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
        assert (got[d.doc_id].n_tokens, got[d.doc_id].ids_sha256, got[d.doc_id].decoded_sha256) == want


@pytest.mark.parametrize("name", ["op11_hilbert_negatives", "op12_toivonen"])
def test_search_queries_equal_their_sql(spark, name):
    import check

    assert check.compare(spark, check.connect(SF), SF, queries.JOBS[name], queries.ORACLES[name]) is None
