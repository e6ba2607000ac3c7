"""Similar titles against a comparison of all pairs, and noise patterns."""

import math
import random
import re

import pytest

from gatelake.operators import error_titles as e


def alike(left, right, floor):
    sets = {tuple(sorted(s)) for s in [*left, *right] if s}
    held = {w: sum(w in s for s in sets) for s in sets for w in s}
    weight = {w: max(1, math.floor(1000 * math.log2(1 + len(sets) / n) + 0.5)) for w, n in held.items()}
    total = lambda s: sum(weight[w] for w in s)
    out = {}
    for a in {tuple(sorted(s)) for s in left if s}:
        for b in {tuple(sorted(s)) for s in right if s}:
            share = total(set(a) & set(b)) / total(set(a) | set(b))
            if share >= floor:
                out[a, b] = share
    return out


@pytest.mark.parametrize("floor", [0.3, 0.5, 0.8, 1.0])
def test_similar_titles_equal_all_pairs(spark, floor):
    draw = random.Random(int(floor * 10))
    vocabulary = ["the", "error", "in"] * 6 + [f"w{i}" for i in range(25)]
    some = lambda n: [sorted(set(draw.choices(vocabulary, k=draw.randint(0, 9)))) for _ in range(n)]
    left, right = some(120), some(90)
    left += [left[3]] * 80 + [[w for w in right[5] if w != "in"], sorted([*right[7], "more"])]
    frame = lambda rows: spark.createDataFrame([(r,) for r in [*rows, None]], "words array<string>")
    got = {(tuple(r.words), tuple(r.other)): r.similarity for r in e.similar_titles(frame(left), frame(right), floor).collect()}
    assert got == pytest.approx(alike(left, right, floor)) and got
    assert e.similar_titles(frame([]), frame(right), floor).count() == 0


ERROR = "error_id int, fingerprint string, title string, exc_class string, frames array<string>, count int, app_frames boolean, bot_4xx boolean"
ISSUE = "number int, fingerprint string, title string, exc_class string, frames array<string>"


def test_titles_that_differ_by_a_word_match(spark):
    title = "Payment gateway refused card of customer 17 during checkout"
    errors = [(1, None, title.replace("17", "99") + " again", "E", [], 9, True, False), (2, None, "something else", "E", [], 9, True, False),
              (3, None, title, "Other", [], 9, True, False), (4, None, None, "E", [], 9, True, False), (5, "f", "x", "E", [], 9, True, False),
              (6, None, "SDK tracker: Payment gateway refused card of customer 1 during checkout", "E", [], 3, True, False)]
    errors += [(10 + i, None, f"Payment gateway refused card of customer {i} during our checkout", "E", [], 9, True, False) for i in range(50)]
    issues = [(30, None, title, "E", []), (20, None, title.upper(), "E", []), (9, "f", "y", "E", []), (8, None, "many other words are here", "E", [])]
    noise = spark.createDataFrame([("*", "sdk tracker*", 5), ("Abort*", None, None)], "exc_class string, title string, below int")
    rows = e.match_errors(spark.createDataFrame(errors, ERROR), spark.createDataFrame(issues, ISSUE), noise, 0.6).collect()
    got = {r.error_id: (r.decision, r.duplicate_of, r.strength) for r in rows}
    assert got[1] == ("duplicate", 20, 2) and all(got[10 + i] == ("duplicate", 20, 2) for i in range(50))
    assert got[2] == got[4] == ("create", None, None) and got[3][0] == "create"
    assert got[5] == ("duplicate", 9, 9) and got[6] == ("ignore", None, None)
    assert next(r.similarity for r in rows if r.error_id == 10) > 0.6


def test_noise_patterns(spark):
    cases = [("AbortError", "x", 9), ("aborterror", "x", 1), ("E", "Extension chrome://a (b) [c]", 4), ("E", "extension", 4), (None, "x", 1), ("E", None, 1)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, exc_class string, title string, count int")
    rules = [("Abort*", None, 5), (None, "*chrome://* ([b]) *", None), ("*", "*://a (b) [c]", 5)]
    noise = spark.createDataFrame(rules, "exc_class string, title string, below int")
    want = {
        i: any((c is None or re.fullmatch(".*".join(map(re.escape, c.lower().split("*"))), (x or "\0").lower()) and x is not None)
               and (t is None or (y is not None and re.fullmatch(".*".join(map(re.escape, t.lower().split("*"))), y.lower())))
               and (b is None or n < b) for c, t, b in rules)
        for i, (x, y, n) in enumerate(cases)
    }
    got = {r.i: r.noise for r in df.withColumn("noise", e.noise_rule(noise)).collect()}
    assert got == {i: bool(v) for i, v in want.items()} and set(got.values()) == {True, False}
    with pytest.raises(ValueError):
        e.noise_rule(spark.range(2000).selectExpr("'a' AS exc_class", "'b' AS title", "1 AS below"))


def test_each_error_is_worked_out_a_few_times_only(spark):
    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(i, f"f{i}", f"Payment {i} refused card of n{i % 7}", "E", ["a", "b", f"c{i % 5}"], 9, True, False) for i in range(60)]
    errors = spark.createDataFrame(rows, ERROR).mapInArrow(told, ERROR)
    issues = spark.createDataFrame([(100 + i, None, f"payment refused card of n{i}", "E", []) for i in range(7)], ISSUE)
    noise = spark.createDataFrame([], "exc_class string, title string, below int")
    assert len(e.match_errors(errors, issues, noise, 0.6).collect()) == len(rows)
    # Looked up, put back, and given words: once each.
    assert seen.value <= 3 * len(rows)
