"""The registered queries of this folder: job over a folder of tables, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gatelake.llm import (
    collocations,
    decontaminate,
    hard_negatives,
    mixing,
    pieces,
    ppm,
    quality,
    quotes,
    sharding,
    simhash,
    surrogates,
    toxicity,
    vector_dedup,
)
from gatelake.session import configure

Job = Callable[[SparkSession, str], DataFrame]
JOBS: dict[str, Job] = {}
ORACLES: dict[str, str] = {}

#: Blanks between words.
WORD = r"[^\x20\x09-\x0D]+"


def query(job: Job) -> Job:
    JOBS[job.__name__] = job
    return job


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return surrogates.replace_personal_data(docs, "text").withColumn("n_replaced", F.size("replaced"))


@query
def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.find_overlaps(docs, "doc_id", "text", items, "item_id", "text")


@query
def op3_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, "doc_id", "text", labels, "toxic")
    scored = toxicity.severity(docs, "doc_id", "text", model)
    return scored.withColumn("toxic", F.col("toxic_probability") >= toxicity.REJECT)


@query
def op4_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.link_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.95)


@query
def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).alias("size"))
    mixed = mixing.mix(sized, "doc_id", "size", "source")
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "source", "rate", "copies")


@query
def op6_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    placed = sharding.assign_shards(docs, "doc_id", [1.0] * 40, "shard", "grown_shard")
    return sharding.number_slots(placed, "shard", "doc_id")


@query
def op7_simhash_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), "doc_id", "text", width=4, radius=4)
    return groups.select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op8_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = quotes.quote_replies(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return quotes.link_quotes(mail, "conv_id", "turn", "text", "role")


@query
def op9_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    docs = table(spark, sf_dir, "documents")
    scored = ppm.ppm_scores(docs, "doc_id", "text", ~F.coalesce(held_out, F.lit(False)))
    return scored.select(
        "doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query
def op10_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = quality.train(docs, "doc_id", "text", labels, "quality", ~held_out)
    scored = quality.quality(docs, "doc_id", "text", model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.GOOD).cast("int").alias("predicted")
    )


@query
def op11_hilbert_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return hard_negatives.mine_negatives(rows, "vec_id", "embedding", "label", F.col("vec_id") % 50 == 0)


#: Integer products of the anchors with all rows, positives, then negatives inside each window.
ORACLES["op11_hilbert_negatives"] = """
WITH used AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
scored AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label, list_dot_product(a.v, b.v)::BIGINT AS score
    FROM used a JOIN used b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
positives AS (
    SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
negatives AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank
    FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3"""


@query
def op12_toivonen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.find_collocations(table(spark, sf_dir, "documents"), "text", F.col("lang"))


#: Languages with words, pieces, phrases of two and three words, their best cut, and the first 2000.
ORACLES["op12_toivonen"] = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
placed AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
counted AS (
    SELECT lang, p, count(*) AS f FROM (
        SELECT lang, w[i:i] AS p FROM placed
        UNION ALL SELECT lang, w[i:i + 1] FROM placed WHERE i + 1 <= len(w)
        UNION ALL SELECT lang, w[i:i + 2] FROM placed WHERE i + 2 <= len(w))
    GROUP BY lang, p),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE len(p) = 1 GROUP BY lang),
often AS (SELECT * FROM counted WHERE f >= 10),
cuts AS (
    SELECT c.lang, c.p, c.f AS a, k, x.f AS l, y.f AS r,
        (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
    FROM (SELECT *, unnest(range(1, len(p))) AS k FROM often WHERE len(p) > 1) c
    JOIN often x ON x.lang = c.lang AND x.p = c.p[1:k]
    JOIN often y ON y.lang = c.lang AND y.p = c.p[k + 1:]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inside AS (
    SELECT lang, q, max(f) AS f FROM (
        SELECT lang, p[1:2] AS q, f FROM often WHERE len(p) = 3
        UNION ALL SELECT lang, p[2:3], f FROM often WHERE len(p) = 3)
    GROUP BY lang, q)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.p, ' ')) AS rank,
    array_to_string(b.p, ' ') AS phrase, a, l, r, t.n, score::BIGINT AS score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN inside i ON i.lang = b.lang AND i.q = b.p
WHERE i.f IS NULL OR 100 * i.f < 50 * a
QUALIFY rank <= 2000"""


@query
def op13_piece_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    tables = pieces.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Both in one pass over the texts; a second one would only start another Python worker for each core.
    return pieces.encode(docs, "text", tables, decoded="decoded").select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
