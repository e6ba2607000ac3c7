"""Links quoted passages to the messages they come from and orders replies.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatelake.session import cut_lineage

#: Quote marks at the start of a line, with blanks between them.
MARKS = r"^(?:[ \t]*>)+"
#: A line that introduces a quotation and belongs to it (fixed phrases of four languages).
INTRODUCES = r"(?i)(?:wrote|writes|schrieb|a écrit|escribió)[^\n]{0,80}:\s*$"
#: Ends a sentence; passages are compared sentence by sentence, as quotes are often cut.
SENTENCE_END = r"(?<=[.!?])\s+"
#: Separates passages while a text is rebuilt; such characters are taken out of texts first.
_CUT, _LEVEL = "\x01", "\x02"


def _lines(text: Column) -> Column:
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), _CUT + _LEVEL + "\r", "")
    return F.transform(
        F.split(plain, "\n"),
        lambda line: F.struct(
            F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 0), "[^>]", "")).alias("level"),
            F.trim(F.regexp_replace(line, MARKS, "")).alias("content"),
            line.alias("whole"),
        ),
    )


def _passages(lines: Column) -> Column:
    """Runs of lines of one quote level without a blank line, each joined to one text."""

    def piece(line: Column, i: Column) -> Column:
        before = F.get(lines, i - 1)
        goes_on = (i > 0) & (before["level"] == line["level"]) & (before["content"] != "") & (line["content"] != "")
        start = F.concat(F.lit(_CUT), line["level"].cast("string"), F.lit(_LEVEL), line["content"])
        return F.when(goes_on, F.concat(F.lit(" "), line["content"])).otherwise(start)

    pieces = F.split(F.array_join(F.transform(lines, piece), ""), _CUT)
    parted = F.transform(
        pieces,
        lambda p: F.struct(
            F.substring_index(p, _LEVEL, 1).try_cast("int").alias("level"), F.substring_index(p, _LEVEL, -1).alias("text")
        ),
    )
    return F.filter(parted, lambda p: p["level"].isNotNull() & (F.trim(p["text"]) != ""))


def _unquoted(lines: Column) -> Column:
    """The lines of level 0, without those that introduce a quotation."""

    def own(line: Column, i: Column) -> Column:
        # Blank lines may stand between the introduction and the quotation.
        after = F.get(lines, i + 1)
        later = F.when(F.coalesce(after["content"], F.lit("")) == "", F.get(lines, i + 2)).otherwise(after)
        quotes = F.coalesce((after["level"] > 0) | (later["level"] > 0), F.lit(False))
        return (line["level"] == 0) & ~(quotes & F.regexp_like(line["content"], F.lit(INTRODUCES)))

    return F.rtrim(F.array_join(F.transform(F.filter(lines, own), lambda line: line["whole"]), "\n"), F.lit(" \n\t"))


def normal_form(text: Column) -> Column:
    """Lower case, every run of other characters than letters and digits one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def messages_of(rows: DataFrame, thread: str, position: str, text: str, role: str | None = None) -> DataFrame:
    """Distinct messages as a written table: ``no, thread, position, role, copies, lines``."""
    own = rows.select(
        F.col(thread).alias("thread"), F.col(position).alias("position"),
        (F.col(role) if role else F.lit(None)).cast("string").alias("role"), F.col(text).cast("string").alias("text"),
    )
    counted = own.groupBy("thread", "position", "role", "text").agg(F.count("*").alias("copies"))
    return cut_lineage(
        counted.select(
            F.monotonically_increasing_id().alias("no"), "thread", "position", "role", "copies", _lines(F.col("text")).alias("lines")
        ),
        "quotes",
    )


def sentence_links(messages: DataFrame) -> DataFrame:
    """``no, level, chars, origin_no, origin_position`` of each quoted sentence with an origin.

    The origin of a sentence is the first message of the thread that says it
    unquoted, if that stands before the quoting message. One row per sentence of
    a thread answers all its quotations, so a sentence that everybody repeats
    makes no pairs.
    """
    passage = messages.select("no", "thread", "position", F.explode(_passages(F.col("lines"))).alias("passage"))
    sentence = passage.select(
        "no", "thread", "position", "passage.level",
        F.explode(F.split(F.col("passage.text"), SENTENCE_END)).alias("sentence"),
    ).withColumn("sentence", normal_form(F.col("sentence")))
    hashed = sentence.where("sentence != ''").select(
        "no", "thread", "position", "level", F.length("sentence").alias("chars"),
        F.xxhash64("sentence", F.length("sentence")).alias("hash"),
    )
    hashed = cut_lineage(hashed, "quotes")
    first = (
        hashed.where("level = 0 and position is not null")
        .groupBy(F.col("thread").alias("t"), F.col("hash").alias("h"))
        .agg(F.min(F.struct("position", "no")).alias("origin"))
    )
    return (
        hashed.where("level > 0")
        .join(first, F.col("thread").eqNullSafe(F.col("t")) & (F.col("hash") == F.col("h")))
        .where(F.col("origin.position") < F.col("position"))
        .select(
            "no", "level", "chars", F.col("origin.no").alias("origin_no"), F.col("origin.position").alias("origin_position")
        )
    )


def _roots(parents: DataFrame) -> DataFrame:
    """``no, root, depth`` of every message with a parent (``no, parent``), by doubling."""
    state = cut_lineage(parents.select("no", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), "quotes")
    while True:
        above = state.select(F.col("no").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        joined = state.join(above, F.col("up") == F.col("n"), "left")
        state = cut_lineage(
            joined.select(
                "no", F.coalesce("up2", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
                F.col("n").isNotNull().alias("moved"),
            ),
            "quotes",
        )
        if state.where("moved").isEmpty():
            return state.select("no", F.col("up").alias("root"), "depth")


def _places(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``place``, gapless from 0 inside each group, in this order.

    Rows are cut into ranges of the whole order, so a large group is numbered by
    many tasks; only the sizes of the ranges are summed.
    """
    ranged = cut_lineage(
        rows.repartitionByRange(F.col(group), *order).withColumn("part", F.spark_partition_id()), "quotes"
    )
    sizes = ranged.groupBy("part").count()
    before = F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(group, *order))
    numbered = cut_lineage(
        ranged.withColumn("inside", inside)
        .join(starts, F.col("part") == F.col("p"))
        .withColumn("index", F.col("before") + F.col("inside") - 1)
        .drop("part", "p", "before", "inside"),
        "quotes",
    )
    first = numbered.groupBy(F.col(group).alias("g")).agg(F.min("index").alias("first"))
    return (
        numbered.join(first, F.col(group).eqNullSafe(F.col("g")))
        .withColumn("place", F.col("index") - F.col("first"))
        .drop("g", "first", "index")
    )


def link_quotes(rows: DataFrame, thread: str, position: str, text: str, role: str | None = None) -> DataFrame:
    """Conversations in reply order, without quotes: one row per distinct message.

    Columns: ``thread, position, role, copies, quoted`` (passages),  ``levels``
    (deepest quote), ``linked_chars, reply_to`` (position of the origin of most
    quoted text at the lowest linked level, the later of equals; null without
    one), ``root`` (position), ``depth, place`` (in the thread: by root, depth,
    position) and ``text`` (own lines only).

    Rows alike in thread, position, role and text count as one, with ``copies``.
    Null texts are empty; messages with a null position quote nothing and come
    first; rows of a null thread form one thread. Other columns are not read.
    """
    messages = messages_of(rows, thread, position, text, role)
    links = sentence_links(messages)
    by_origin = links.groupBy("no", "level", "origin_no", "origin_position").agg(F.sum("chars").alias("chars"))
    rank = F.struct((-F.col("level")).alias("near"), "chars", "origin_position", (-F.col("origin_no")).alias("back"))
    chosen = cut_lineage(by_origin.groupBy("no").agg(F.max(rank).alias("best"), F.sum("chars").alias("linked_chars")), "quotes")
    parents = chosen.select("no", (-F.col("best.back")).alias("parent"), F.col("best.origin_position").alias("reply_to"), "linked_chars")
    tree = _roots(parents).select(F.col("no").alias("m"), "root", "depth")
    lines = F.col("lines")
    summary = messages.select(
        "no", "thread", "position", "role", "copies",
        F.size(F.filter(_passages(lines), lambda p: p["level"] > 0)).alias("quoted"),
        F.array_max(F.transform(lines, lambda line: line["level"])).alias("levels"),
        _unquoted(lines).alias("text"),
    )
    root_position = messages.select(F.col("no").alias("r"), F.col("position").alias("root_position"))
    joined = (
        messages.select("no", "thread", "position")
        .join(parents.withColumnRenamed("no", "c"), F.col("no") == F.col("c"), "left")
        .join(tree, F.col("no") == F.col("m"), "left")
        .withColumn("r0", F.coalesce("root", "no"))
        .join(root_position, F.col("r0") == F.col("r"))
        .select(
            "no", "thread", "position", "reply_to", F.coalesce("linked_chars", F.lit(0)).alias("linked_chars"),
            F.col("root_position").alias("root"), F.coalesce("depth", F.lit(0)).alias("depth"),
        )
    )
    placed = _places(joined, "thread", ["root", "depth", "position", "no"])
    placed = placed.select(F.col("no").alias("k"), "reply_to", "linked_chars", "root", "depth", "place")
    return summary.join(placed, F.col("no") == F.col("k")).select(
        F.col("thread").alias(thread), F.col("position").alias(position), "role", "copies", "quoted", "levels",
        "linked_chars", "reply_to", "root", "depth", "place", "text",
    )


def quote_replies(rows: DataFrame, thread: str, position: str, text: str) -> DataFrame:
    """Messages as mail programs would send them: most replies quote what they answer, two levels deep.

    Derives quoted mail from turns. A reply at position ``p`` quotes ``p - 1``
    under an introducing line, and ``p - 2`` one level deeper, unless a hash of
    its place (one of four) leaves it without quotes.
    """
    one = rows.groupBy(thread, position).agg(F.min(text).alias("said"))

    def before(steps: int) -> DataFrame:
        marked = F.regexp_replace("said", r"(?m)^", "> " * steps)
        return one.select(
            F.col(thread).alias(f"t{steps}"), (F.col(position) + steps).alias(f"p{steps}"), marked.alias(f"q{steps}")
        )

    on = lambda k: F.col(thread).eqNullSafe(F.col(f"t{k}")) & (F.col(position) == F.col(f"p{k}"))
    joined = rows.join(before(1), on(1), "left").join(before(2), on(2), "left")
    quotes = F.col("q1").isNotNull() & (F.pmod(F.xxhash64(thread, position), F.lit(4)) != 0)
    full = F.concat_ws("\n", F.col(text), F.lit(""), F.lit("They wrote:"), F.col("q1"), F.col("q2"))
    return joined.withColumn(text, F.when(quotes, full).otherwise(F.col(text))).select(*rows.columns)
