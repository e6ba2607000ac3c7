"""Errors and known issues matched by similar titles, and noise as a table of patterns.

Titles are sets of words.  Two sets are alike when the weight of their common
words is at least ``floor`` of the weight of all their words; a word weighs more
the fewer titles hold it.  Each distinct set is searched once, whatever number of
errors carries it.  A set is looked up by its heaviest words only, as many as an alike set
must share one of, and among sets whose weight can match; each hit is checked exactly.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatelake.operators.matching import dedupe_errors
from gatelake.session import cut_lineage

# Fixed values -------------------------------------------------------------
TITLE_FLOOR = 0.7
TITLE_STRENGTH = 2
MOST_NOISE_RULES = 1_000
# ---------------------------------------------------------------------------

#: Weights are whole numbers, so that sums don't depend on their order.
_UNIT = 1_000
#: Room for rounding where words are chosen; the check itself has none.
_SLACK = 1e-9
#: Weights of one class differ by this factor at most.
_CLASS = 1.25


def title_words(title: Column | str) -> Column:
    """The distinct words of a title in lower case; runs of digits count as one sign."""
    text = F.regexp_replace(F.lower(F.col(title) if isinstance(title, str) else title), "[0-9]+", "#")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_#]+"), F.lit(0))))


def _weight_class(weight: Column) -> Column:
    return F.floor(F.log(weight) / F.log(F.lit(_CLASS))).cast("int")


def _weighted(sets: DataFrame) -> DataFrame:
    """``words, sum, heavy``: total weight, and for each word its weight with those of heavier words before it."""
    number = sets.count()
    words = sets.select("words", F.explode("words").alias("word"))
    held = words.groupBy("word").agg(F.count(F.lit(1)).alias("titles"))
    weight = F.greatest(F.lit(1), F.round(_UNIT * F.log2(1 + F.lit(float(number)) / F.col("titles")))).cast("bigint")
    weighted = words.join(held.select("word", weight.alias("weight")), "word")
    listed = weighted.groupBy("words").agg(
        F.sort_array(F.collect_list(F.struct("weight", "word")), asc=False).alias("heavy"), F.sum("weight").alias("sum")
    )
    return cut_lineage(listed, "titles")


def _probes(listed: DataFrame, floor: float) -> DataFrame:
    """The heaviest words of each set: without all of them less than ``floor`` of its weight is left."""
    with_rest = listed.withColumn(
        "keys",
        F.aggregate(
            "heavy",
            F.struct(F.col("sum").alias("rest"), F.array().cast("array<string>").alias("keys")),
            lambda acc, x: F.struct(
                (acc["rest"] - x["weight"]).alias("rest"),
                F.when(acc["rest"] >= (floor - _SLACK) * F.col("sum"), F.concat(acc["keys"], F.array(x["word"]))).otherwise(acc["keys"]).alias("keys"),
            ),
            lambda acc: acc["keys"],
        ),
    )
    return with_rest.select("words", "sum", "heavy", F.explode("keys").alias("word"))


def similar_titles(left: DataFrame, right: DataFrame, floor: float = TITLE_FLOOR) -> DataFrame:
    """``words, other, similarity`` of the distinct word sets of both tables that are alike.

    ``left(words)``, ``right(words)`` with sorted arrays of distinct words; empty and
    null ones are like nothing.  The similarity is the weight of the common words
    over the weight of all words of both.
    """
    sides = [d.filter(F.size("words") > 0).select("words").distinct() for d in (left, right)]
    listed = _weighted(sides[0].union(sides[1]).distinct())
    probes = _probes(listed, floor).withColumn("class", _weight_class(F.col("sum")))
    mine, theirs = (probes.join(s, "words", "left_semi") for s in sides)
    # An alike set weighs at least ``floor`` of this one and at most this one over ``floor``.
    low, high = _weight_class(F.col("sum") * floor), _weight_class(F.col("sum") / floor)
    asked = mine.withColumn("class", F.explode(F.sequence(low - 1, high + 1)))
    other = theirs.select("word", "class", F.col("words").alias("other"), F.col("sum").alias("other_sum"))
    pairs = asked.join(other, ["word", "class"]).select("words", "other", "sum", "other_sum", "heavy").distinct()
    common = F.aggregate(
        F.filter("heavy", lambda x: F.array_contains(F.col("other"), x["word"])), F.lit(0).cast("bigint"), lambda a, x: a + x["weight"]
    )
    scored = pairs.withColumn("common", common).withColumn("similarity", F.col("common") / (F.col("sum") + F.col("other_sum") - F.col("common")))
    return scored.filter(F.col("similarity") >= floor).select("words", "other", "similarity")


def noise_rule(noise: DataFrame) -> Column:
    """Whether an error is noise, from ``noise(exc_class, title, below)``: patterns with ``*`` for anything.

    A null pattern fits everything; an error is noise where both patterns fit, in
    any case, and its count is below ``below`` if that is given.  The rules are
    compiled into one expression; more than ``MOST_NOISE_RULES`` are refused.
    """
    rules = noise.select("exc_class", "title", "below").limit(MOST_NOISE_RULES + 1).collect()
    if len(rules) > MOST_NOISE_RULES:
        raise ValueError(f"more than {MOST_NOISE_RULES} noise rules")

    def fits(column: str, pattern: str | None) -> Column:
        if pattern is None:
            return F.lit(True)
        expression = ".*".join(re.escape(part) for part in pattern.lower().split("*"))
        return F.coalesce(F.lower(column).rlike(f"(?s)^{expression}$"), F.lit(False))

    out = F.lit(False)
    for rule in rules:
        few = F.lit(True) if rule.below is None else F.coalesce(F.col("count") < rule.below, F.lit(False))
        out = out | (fits("exc_class", rule.exc_class) & fits("title", rule.title) & few)
    return out


def match_errors(errors: DataFrame, issues: DataFrame, noise: DataFrame, floor: float = TITLE_FLOOR) -> DataFrame:
    """``error_id, decision, duplicate_of, strength, similarity`` of each error.

    Tables as in ``dedupe_errors``; an error is ignored where that says so or where
    the noise table does.  Where nothing stronger is found, the known issue of the
    same class with the most similar title, at least ``floor``, is taken, the lowest
    number of equals, with strength ``TITLE_STRENGTH``.
    """
    loud = errors.withColumn("noise", noise_rule(noise)).select("error_id", "exc_class", title_words("title").alias("words"), "noise")
    # Each of these is asked several times, and worked out once.
    judged = cut_lineage(dedupe_errors(errors, issues).join(loud, "error_id"), "judged")
    # Of equal titles and classes one issue is enough.
    known = cut_lineage(issues.groupBy("exc_class", title_words("title").alias("other")).agg(F.min("number").alias("number")), "known")
    open_ = judged.filter("decision = 'create' AND NOT noise")
    look = cut_lineage(open_.select("exc_class", "words").distinct(), "looks")
    alike = similar_titles(look.select("words"), known.select(F.col("other").alias("words")), floor)
    best = (
        look.join(alike, "words")
        .join(known, ["exc_class", "other"])
        .groupBy("exc_class", "words")
        .agg(F.max(F.struct("similarity", (-F.col("number")).alias("neg"))).alias("near"))
    )
    found = open_.join(best, ["exc_class", "words"]).select("error_id", "near")
    all_ = judged.join(found, "error_id", "left")
    ignored = F.col("noise") | (F.col("decision") == "ignore")
    near = F.col("near").isNotNull()
    return all_.select(
        "error_id",
        F.when(ignored, "ignore").when(near, "duplicate").otherwise(F.col("decision")).alias("decision"),
        F.when(~ignored, F.coalesce(-F.col("near.neg"), F.col("duplicate_of"))).alias("duplicate_of"),
        F.when(~ignored, F.coalesce(F.when(near, F.lit(TITLE_STRENGTH)), F.col("strength"))).alias("strength"),
        F.when(~ignored, F.col("near.similarity")).alias("similarity"),
    )
