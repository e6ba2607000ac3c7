"""Mixing, sharding, vectors, quotations and the pipeline against plain Python, and on odd rows."""

import collections
import hashlib
import math
import zlib

import brute
import corpus_pipeline
import numpy as np
import pytest
from gatelake.llm import mixing, queries, quotes, sharding, vector_dedup
from gatelake.session import shared_dir
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_targets_hand_out_the_excess(spark):
    sizes = {"b": 10, "a": 1000, "c": 400, "é": 50, "Z": 7, None: 300, "zero": 0}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(frame, 1.5).collect()}
    want = brute.targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix_meets_targets_and_is_the_same_again(spark, odd, nothing):
    random = np.random.default_rng(5)
    rows = [(i, int(random.pareto(1.2) * 40), f"s{min(int(random.exponential(3)), 8)}") for i in range(3000)]
    rows += [(5000, 30, "s0")] * 700 + [(None, 12, None)] * 5 + [(6000, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, source string")
    got = mixing.mix(frame, "doc_id", "size", "source").collect()
    assert len(got) == len(rows)
    by_source = collections.defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    sizes = {s: sum(r.size for r in own) for s, own in by_source.items()}
    want = brute.targets(sizes)
    for s, own in by_source.items():
        assert {r.source_size for r in own} == {sizes[s]}
        assert own[0].target == pytest.approx(want[s])
        expected = sum(r.rate * r.size for r in own)
        assert expected == pytest.approx(want[s], rel=1e-4, abs=0.01)
        gap = sum(r.copies * r.size for r in own) - want[s]
        assert abs(gap) <= max(r.size for r in own) + 0.01 * len(own)
        if len(own) > 50:
            assert abs(gap) <= 0.005 * want[s]
    assert {r.copies for r in got} <= {0, 1, 2}
    again = mixing.mix(frame.repartition(7), "doc_id", "size", "source").collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(nothing, "doc_id", "size", "source").count() == 0
    assert mixing.mix(odd, "doc_id", "size", "source").count() == odd.count()


def test_rates_are_tilted_exponentially(spark):
    rows = [(i, 1 + i % 50, "low" if i % 2 else "high") for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, source string")
    for r in mixing.mix(frame, "doc_id", "size", "source", share=0.8).collect():
        r.rate  # noqa: B018
    rates = {(r.source, r.size): r.rate for r in mixing.mix(frame, "doc_id", "size", "source", share=0.8).collect()}
    for source in ("low", "high"):
        sizes = sorted(z for s, z in rates if s == source)
        tilt = [math.log(rates[source, z] / (2 - rates[source, z])) / z for z in sizes]
        assert max(tilt) - min(tilt) < 1e-3 * max(1, abs(tilt[0])) + 2e-4


def test_applied_mix_repeats_rows(odd, nothing):
    size = F.regexp_count("text", F.lit(queries.WORD))
    out = mixing.apply_mix(odd, "doc_id", size, "source")
    assert out.columns == odd.columns
    plan = mixing.mix(odd.withColumn("size", size), "doc_id", "size", "source")
    want = collections.Counter()
    for r in plan.collect():
        want[r.doc_id] += r.copies
    got = collections.Counter(r.doc_id for r in out.collect())
    assert got == +want
    assert mixing.apply_mix(nothing, "doc_id", size, "source").count() == 0


def test_rendezvous_choice_and_growth(spark):
    keys = [*range(3000), None]
    frame = spark.createDataFrame([(k,) for k in keys], "doc_id long")
    rows = sharding.assign_shards(frame, "doc_id", [1.0] * 12, grown="grown").collect()

    def choose(key, n):
        text = "" if key is None else str(key)
        return max(range(n), key=lambda s: hashlib.md5(f"{text}:{s}".encode()).hexdigest()[:13])

    assert [(r.shard, r.grown) for r in rows] == [(choose(k, 12), choose(k, 13)) for k in keys]
    assert all(r.grown in (r.shard, 12) for r in rows)
    assert abs(sum(r.grown == 12 for r in rows) / len(rows) - 1 / 13) < 0.02


def test_weights_set_the_shares(spark):
    weights = [1.0, 2.0, 5.0]
    rows = sharding.assign_shards(spark.range(4000), "id", weights).groupBy("shard").count().collect()
    assert all(abs(r["count"] / 4000 - weights[r.shard] / 8) < 0.03 for r in rows)
    with pytest.raises(ValueError):
        sharding.assign_shards(spark.range(1), "id", [1.0, 0.0])


def test_slots_have_no_gap(spark, odd, nothing, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_RANGE", 20)
    rows = [(i % 500, 7) for i in range(900)] + [(3, 7)] * 400 + [(None, 1)] * 3
    frame = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, size long"), "doc_id", [1.0] * 5)
    got = sharding.number_slots(frame, "shard", "doc_id").collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append((r.slot, hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()))
    for own in by_shard.values():
        own.sort()
        assert [slot for slot, _ in own] == list(range(len(own))) and [m for _, m in own] == sorted(m for _, m in own)
    placed = sharding.assign_shards(odd.withColumn("shard", F.lit("old")), "doc_id", [1.0] * 3)
    assert sharding.number_slots(placed, "shard", "doc_id").count() == odd.count()
    assert sharding.number_slots(sharding.assign_shards(nothing, "doc_id", [1.0]), "shard", "doc_id").count() == 0


def test_shards_are_written_as_folders(spark, odd):
    path = shared_dir(spark, "shards-test")
    sharding.write_shards(sharding.assign_shards(odd, "doc_id", [1.0] * 3), path, files=2)
    assert spark.read.parquet(path).count() == odd.count()


def test_shard_query_columns(spark):
    rows = queries.op6_rendezvous(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))


@pytest.mark.parametrize("block", [4096, 16])
def test_vector_links(spark, monkeypatch, block):
    monkeypatch.setattr(vector_dedup, "BLOCK", block)
    monkeypatch.setattr(vector_dedup, "LEAF", 4)
    random = np.random.default_rng(2)
    rows = []
    for i in range(40):
        centre = random.normal(size=12)
        for _ in range(1 + i % 5):
            rows.append((centre + 0.1 * random.normal(size=12)).tolist())
    rows += [rows[0]] * 9 + [[2 * x for x in rows[0]], [1e200 * x for x in rows[3]], [-x for x in rows[0]]]
    rows += [None, [0.0] * 12, [float("nan")] * 12, [None] * 12, [float("inf")] * 12, [], [1.0, 2.0], [1.0, 2.0] + [0.0] * 10]
    table = [((i * 37) % 1009, v, "clash", "x") for i, v in enumerate(rows)]
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, vector string, key string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.link_vectors(frame, "vec_id", "embedding").collect()}
    filled = [(k, v + [0.0] * (12 - len(v)) if v and len(v) < 12 else v) for k, v, *_ in table]
    assert got == brute.cosine_links(filled)
    assert max(n for n, _ in got.values()) >= 10


def test_vectors_without_any(spark):
    schema = "vec_id long, embedding array<float>"
    assert vector_dedup.link_vectors(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    only_bad = spark.createDataFrame([(1, None), (2, [0.0, 0.0]), (None, [1.0, 0.0])], schema)
    rows = {r.vec_id: r for r in vector_dedup.link_vectors(only_bad, "vec_id", "embedding").collect()}
    assert rows[1].kept and rows[2].n_links == 0 and rows[None].component_id is None and not rows[None].kept


def test_vector_query_on_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in queries.op4_epsilon_grid(spark, SF).collect()}
    assert got == brute.cosine_links([(r.vec_id, r.embedding) for r in table])


MAIL = [
    (1, 0, "ann", "Shall we meet on Friday? The room is free.\nBring the signed forms."),
    (1, 1, "bob", "Friday works.\n\nOn Monday Ann wrote:\n> Shall we meet on\n> Friday? The room is free."),
    (1, 2, "cyd", "Which room is it?\n> > The room is free.\n> Friday works.\n\nThanks."),
    (1, 3, "dan", "I have the forms.\n> Bring the signed FORMS!"),
    (1, 4, "eve", "> nobody ever said this sentence"),
    (2, 0, "ann", "> The room is free.\nA different thread."),
    (2, 0, "ann", "> The room is free.\nA different thread."),
    (2, 1, "bob", None), (2, 2, "bob", ""), (None, 0, "x", "Friday works."), (None, None, "y", "> Friday works."),
]


def test_quotations_are_linked(spark, nothing):
    mail = spark.createDataFrame([(*m, "k", 1) for m in MAIL], "thread long, position long, who string, body string, lines string, no int")
    rows = quotes.link_quotes(mail, "thread", "position", "body", "who").collect()
    got = {(r.thread, r.position): r for r in rows}
    assert len(got) == len(rows) == len(MAIL) - 1 and got[2, 0].copies == 2
    assert [got[1, p].reply_to for p in range(5)] == [None, 0, 1, 0, None]
    assert [(got[1, p].root, got[1, p].depth) for p in range(5)] == [(0, 0), (0, 1), (0, 2), (0, 1), (4, 0)]
    assert [got[1, p].place for p in (0, 1, 3, 2, 4)] == [0, 1, 2, 3, 4]
    assert got[1, 2].levels == 2 and got[1, 2].quoted == 2 and got[1, 1].quoted == 1
    assert got[1, 1].text == "Friday works." and got[1, 2].text == "Which room is it?\n\nThanks."
    assert got[2, 0].reply_to is None and got[2, 0].text == "A different thread." and got[2, 1].text == ""
    assert got[None, None].reply_to is None
    empty = nothing.select(F.col("doc_id").alias("thread"), F.col("size").alias("position"), F.col("text").alias("body"))
    assert quotes.link_quotes(empty, "thread", "position", "body").count() == 0


def test_derived_replies_link_to_what_they_quote(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    said = {(r.conv_id, r.turn): r.text for r in turns.collect()}
    rows = queries.op8_quotations(spark, SF).collect()
    assert len(rows) == len(said)
    quoting = [r for r in rows if r.quoted]
    assert len(quoting) > 10
    linked = sum(r.reply_to == r.turn - 1 for r in quoting)
    assert linked / len(quoting) > 0.95  # short sentences may be said earlier already
    for r in rows:
        assert r.text == said[r.conv_id, r.turn].rstrip(" \n\t")


def test_chains_of_any_depth(spark):
    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 50)], "no long, parent long")
    assert {(r.no, r.root, r.depth) for r in quotes._roots(parents).collect()} == {(i, 0, i) for i in range(1, 50)}


def test_native_operators_run_no_python(spark):
    for name in ("op6_rendezvous", "op8_quotations"):
        plan = queries.JOBS[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        path = shared_dir(spark, f"stage-{name}")
        out = stage(spark, docs, SF)
        out.write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        sizes[name] = docs.count()
        if name != "sharding":
            assert docs.columns == before.columns
        assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
    assert sizes["sharding"] == sizes["mixing"]
    assert corpus_pipeline.run(spark, SF).count() == sizes["sharding"]


def test_pipeline_survives_odd_rows(spark, odd_rows):
    docs = spark.createDataFrame(
        [(r[0], r[1], r[2], r[3], r[5]) for r in odd_rows], "doc_id long, text string, lang string, source string, n_chars long"
    )
    for rows in (docs, docs.where("false")):
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, SF)
        rows.count()
