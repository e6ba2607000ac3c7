"""Entropy balancing: document rates that meet a token target for each source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.session import cut_lineage

#: A rate is at most this many copies of a document.
MOST_COPIES = 2
#: Rates are rounded to this many steps per copy, so that sums of them are exact.
STEP_BITS = 20
STEPS = 1 << STEP_BITS
#: Documents of one source and size that one task numbers at most, on average.
ROWS_PER_BUCKET = 1000
#: Newton steps; the dual of one source is smooth and convex in one variable.
ROUNDS = 60
#: Relative gap between a source's expected tokens and its target that ends the iteration.
TOLERANCE = 1e-9
#: Tilts lie between minus and plus this; a bracket this narrow relative to it ends the iteration too.
WIDEST = 4096.0

_EXACT = "decimal(38,9)"


def targets(sizes: DataFrame, share: float, weights: tuple[float, ...] = (5, 2, 1)) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size`` (one row per source).

    Sources in code point order, null last, weigh ``weights`` in turn and share
    ``share`` times all sizes by weight. Nobody gets more than ``MOST_COPIES``
    times its size; the excess goes to the others by weight until all fit.
    """
    order = F.struct(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order)) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn % len(weights) + 1)
    table = cut_lineage(sizes.withColumn("weight", weight.cast("double")), "mixing")
    most = (MOST_COPIES * F.col("source_size")).cast("double")
    total = share * int(table.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        # Sources whose weight at this level asks for more than they may take are full.
        full = F.col("weight") * level >= most
        row = table.agg(
            F.sum(F.when(full, MOST_COPIES * F.col("source_size")).otherwise(0)), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if not row[1]:
            break
        risen = (total - int(row[0] or 0)) / row[1]
        if risen <= level:
            break
        level = risen
    return table.select("source", "source_size", F.least(F.col("weight") * level, most).alias("target"))


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    """``2 / (1 + exp(-tilt * size / mean))``: 1 without a tilt, never above 2."""
    return MOST_COPIES / (1 + F.exp(-tilt * size / mean))


def solve(classes: DataFrame, goals: DataFrame) -> DataFrame:
    """``source, tilt`` that makes each source's expected tokens equal its target.

    ``classes`` holds ``source, size, n``: rates depend on source and size only,
    so the sums of a Newton step run over sizes with their counts. The dual of a
    source is convex; a step that leaves the bracket of signs seen so far is
    replaced by its middle. Sums are exact decimals, so reruns agree. A source
    whose target is its bound has no finite tilt and gets null.
    """
    state = goals.where("source_size > 0").select(
        "source", "target", F.lit(0.0).alias("tilt"), F.lit(-WIDEST).alias("low"), F.lit(WIDEST).alias("high"),
        (F.col("target") >= MOST_COPIES * F.col("source_size")).alias("full"),
    )
    mean = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = classes.where("size > 0").withColumnRenamed("source", "s")
    state = cut_lineage(
        state.join(mean.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "mixing"
    )
    for _ in range(ROUNDS):
        rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"))
        tokens = F.col("n") * F.col("size") * rate
        slope = tokens * F.col("size") / F.col("mean") * (1 - rate / MOST_COPIES)
        sums = (
            rows.join(state.where("not full"), F.col("s").eqNullSafe(F.col("source")))
            .groupBy("source")
            .agg(F.sum(tokens.cast(_EXACT)).alias("got"), F.sum(slope.cast(_EXACT)).alias("slope"))
            .select(F.col("source").alias("s"), F.col("got").cast("double").alias("got"), F.col("slope").cast("double").alias("slope"))
        )
        gap = F.col("got") - F.col("target")
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "target", "full", "mean", "tilt",
            F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")).alias("low"),
            F.when(gap > 0, F.col("tilt")).otherwise(F.col("high")).alias("high"),
            F.when(F.col("full"), 0.0).otherwise(F.abs(gap) / F.col("target")).alias("off"),
            (F.col("tilt") - gap / F.col("slope")).alias("step"),
        )
        inside = (F.col("step") > F.col("low")) & (F.col("step") < F.col("high"))
        after = F.when(inside, F.col("step")).otherwise((F.col("low") + F.col("high")) / 2)
        # Twelve digits are kept: a later digit is noise of the last step.
        after = F.round(after, 12)
        done = F.col("full") | (F.col("off") <= TOLERANCE) | (F.col("high") - F.col("low") <= 1e-11)
        state = cut_lineage(
            moved.select(
                "source", "target", "full", "mean", F.when(done, F.col("tilt")).otherwise(after).alias("tilt"),
                "low", "high", done.alias("done"),
            ),
            "mixing",
        )
        if state.where("not done").isEmpty():
            break
    return state.select("source", "mean", F.when(~F.col("full"), F.col("tilt")).alias("tilt"))


def mix(documents: DataFrame, key: str, size: str, source: str, share: float = 1.5) -> DataFrame:
    """``key, size, source, source_size, target, rate, copies`` of every row, under these names.

    The rates minimise the relative entropy to one copy each, bounded by two
    copies, under one token constraint per source. Copies come from one running
    sum of rates per source, in order of size, cut at whole numbers, so tokens are
    off by no more than the largest document; then a few documents change by one
    copy until the gap is smaller than any that could still change. Rows of one source and size
    are dealt into buckets by a hash of the key, and only bucket counts are summed
    along a source. A null size counts as 0, a null source is a source of its own;
    equal rows are counted before the shuffle and told apart by number only. An
    empty table stays empty.
    """
    rows = documents.select(
        F.col(key).alias("key"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.col(source).alias("source"),
    ).groupBy("key", "size", "source").agg(F.count("*").alias("same"))
    rows = cut_lineage(rows, "mixing")
    classes = cut_lineage(rows.groupBy("source", "size").agg(F.sum("same").alias("n")), "mixing")
    sizes = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    goals = cut_lineage(targets(sizes, share), "mixing")
    tilts = solve(classes, goals)

    per_class = (
        classes.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
        .drop("s")
        .join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        .drop("s")
    )
    rate = F.when(F.col("source_size") == 0, 1.0).when(F.col("tilt").isNull(), float(MOST_COPIES))
    rate = rate.otherwise(_rate(F.col("tilt"), F.col("size"), F.col("mean")))
    per_class = per_class.select(
        "source", "size", "source_size", "target", F.floor(rate * STEPS + 0.5).alias("steps"),
        F.ceil(F.col("n") / ROWS_PER_BUCKET).cast("long").alias("buckets"),
    )
    by_class = rows.join(
        per_class.withColumnRenamed("source", "s").withColumnRenamed("size", "z"),
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")),
    ).drop("s", "z")
    bucket = F.pmod(F.xxhash64("key"), F.col("buckets"))
    dealt = cut_lineage(by_class.withColumn("bucket", bucket), "mixing")
    counts = dealt.groupBy("source", "size", "bucket", "steps").agg(F.sum("same").alias("n"))
    along = Window.partitionBy("source").orderBy("size", "bucket").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("bucket").alias("b"),
        (F.sum(F.col("steps") * F.col("n")).over(along) - F.col("steps") * F.col("n")).alias("before"),
    )
    nth = F.sum("same").over(
        Window.partitionBy("source", "size", "bucket")
        .orderBy(F.xxhash64("key", F.lit("nth")), "key")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    numbered = dealt.withColumn("nth", nth).join(
        starts,
        F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("bucket") == F.col("b")),
    )
    whole = lambda c: F.shiftright(c + STEPS // 2, STEP_BITS)
    upto = F.col("before") + F.col("nth") * F.col("steps")
    numbered = numbered.withColumn("given", whole(upto) - whole(upto - F.col("same") * F.col("steps")))
    numbered = _with_corrections(cut_lineage(numbered.drop("s", "z", "b"), "mixing"))
    # Equal rows were counted as one; each gets a number of its own again.
    numbered = numbered.withColumn("nth", F.explode(F.sequence(F.col("nth") - F.col("same") + 1, F.col("nth"))))
    copies = (whole(upto) - whole(upto - F.col("steps")) + F.col("more")).cast("int")
    return numbered.select(
        F.col("key").alias(key), F.col("size").alias("size"), F.col("source").alias("source"), "source_size",
        "target", (F.col("steps") / STEPS).alias("rate"), copies.alias("copies"),
    )


def _with_corrections(numbered: DataFrame) -> DataFrame:
    """Adds ``more``: one copy more or less for the few documents that close a source's gap.

    Whole copies leave a source up to one document away from its target. From the
    largest size down, as many documents as still fit into the gap change by one
    copy; those of the first bucket of a size that stand for one row can change.
    One array per source holds its distinct sizes.
    """
    gaps = numbered.groupBy("source").agg(
        (F.round(F.first("target")).cast("long") - F.sum(F.col("given") * F.col("size")).cast("long")).alias("gap")
    )
    gaps = cut_lineage(gaps.select(F.col("source").alias("s"), "gap"), "mixing")
    can = (F.col("bucket") == 0) & (F.col("same") == 1) & (F.col("size") > 0)
    can &= F.when(F.col("gap") > 0, F.col("given") < MOST_COPIES).otherwise((F.col("gap") < 0) & (F.col("given") > 0))
    rows = numbered.join(gaps, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("can", can)
    free = rows.where("can").groupBy("source", "gap", "size").agg(F.count("*").alias("free"))
    listed = free.groupBy("source", "gap").agg(F.sort_array(F.collect_list(F.struct("size", "free")), False).alias("sizes"))
    none = F.expr("cast(array() as array<struct<size:bigint,changed:bigint>>)")

    def take(state: Column, entry: Column) -> Column:
        fit = F.least(entry["free"], F.floor(state["left"] / entry["size"]).cast("long"))
        pick = F.array(F.struct(entry["size"].alias("size"), fit.alias("changed")))
        return F.struct(
            (state["left"] - fit * entry["size"]).alias("left"),
            F.when(fit > 0, F.concat(state["picks"], pick)).otherwise(state["picks"]).alias("picks"),
        )

    start = F.struct(F.abs("gap").alias("left"), none.alias("picks"))
    picks = listed.select(
        F.col("source").alias("s"), F.signum("gap").cast("long").alias("sign"),
        F.inline(F.aggregate("sizes", start, take)["picks"]),
    ).withColumnRenamed("size", "z")
    rank = F.row_number().over(Window.partitionBy("source", "size", "bucket", "can").orderBy("nth"))
    picked = rows.withColumn("rank", rank).join(
        picks, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")), "left"
    )
    chosen = F.coalesce(F.col("can") & (F.col("rank") <= F.col("changed")), F.lit(False))
    return picked.withColumn("more", F.when(chosen, F.col("sign")).otherwise(0)).drop("s", "z", "sign", "changed", "rank")


def apply_mix(documents: DataFrame, key: str, size: Column, source: str, share: float = 1.5) -> DataFrame:
    """The documents themselves, each as many times as its copies say, with their own columns.

    Texts are shuffled once, for the join with the copies. Rows alike in key,
    size and source share the sum of their copies: equal rows are counted first
    and come back as often as their part of the sum says.
    """
    sized = documents.select(F.col(key).alias("key"), size.alias("size"), F.col(source).alias("source"))
    plan = cut_lineage(
        mix(sized, "key", "size", "source", share)
        .groupBy("key", "size", "source")
        .agg(F.count("*").alias("same"), F.sum("copies").alias("copies")),
        "mixing",
    )
    names = documents.columns
    inner = [f"c{i}" for i in range(len(names))]
    rows = documents.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).toDF(*inner, "own")
    at, of = (F.col(f"c{names.index(c)}") for c in (key, source))
    alike = at.eqNullSafe(F.col("key")) & of.eqNullSafe(F.col("source")) & (F.col("own") == F.col("size"))

    def repeated(found: DataFrame) -> DataFrame:
        """Rows as often as ``copies`` says; most need no array."""
        return found.withColumn("_again", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*inner)

    out = repeated(rows.join(plan.where("same = 1 and copies > 0"), alike))
    several = plan.where("same > 1 and copies > 0")
    if not several.isEmpty():
        equal = rows.join(several, alike).groupBy(*inner, "key", "size", "source", "same", "copies").count()
        upto = F.sum("count").over(
            Window.partitionBy("key", "size", "source").orderBy(*inner).rowsBetween(Window.unboundedPreceding, 0)
        )
        part = lambda n: F.floor(n * F.col("copies") / F.col("same"))
        equal = equal.withColumn("upto", upto).withColumn(
            "copies", part(F.col("upto")) - part(F.col("upto") - F.col("count"))
        )
        out = out.unionByName(repeated(equal.where("copies > 0")))
    return out.toDF(*names)
