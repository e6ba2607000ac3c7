"""Commits between two tags on histories with merges.

A commit belongs to the first tag that reaches it.  The history is cut into
chains, each commit followed by one of its children; along a chain the smallest
tag number behind a commit is a running minimum, and only edges that leave a
chain have to be followed one after another.  So the joins grow with the number of
times a way to a commit changes chains, and with the logarithm of the longest
chain, not with the length of the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatelake.operators.release import semver, version_bump
from gatelake.session import cut_lineage

#: Commits of a chain that are scanned in one piece; pieces are linked by one row each.
PIECE = 4096
#: Links whose ways are doubled; a longer history is thinned to as many first.
DOUBLED = 250_000


def _edges(commits: DataFrame) -> DataFrame:
    """One row for each child and parent; ``nth`` 0 is the first parent.  Parents outside the table are left out."""
    told = commits.select("repo", "sha").distinct()
    edges = commits.select("repo", F.col("sha").alias("child"), F.posexplode("parents").alias("nth", "parent"))
    edges = edges.groupBy("repo", "child", "parent").agg(F.min("nth").alias("nth"))
    return edges.join(told.withColumnRenamed("sha", "parent"), ["repo", "parent"], "left_semi")


def _chains(commits: DataFrame, edges: DataFrame) -> DataFrame:
    """``repo, sha, chain, step``: every commit in one chain, ``step`` 0 at its youngest commit.

    A commit is followed by the child that names it as first parent, the smallest
    of several.  While there are more than ``DOUBLED`` links, a commit drawn by its
    hash hands its link to those behind it, where its own child isn't drawn: a
    quarter leaves in a round.  The way to the youngest commit doubles among those
    that are left, and the others are put back in the reverse order.  So all rounds
    together move some times the history, whatever its length.
    """
    heirs = edges.filter("nth = 0").groupBy("repo", F.col("parent").alias("sha")).agg(F.min("child").alias("chain"))
    state = cut_lineage(commits.select("repo", "sha").distinct().join(heirs, ["repo", "sha"], "left"), "chains")
    links = state.filter("chain IS NOT NULL").withColumn("step", F.lit(1).cast("bigint"))
    out = []
    while links.count() > DOUBLED:
        coin = [F.pmod(F.xxhash64("repo", end, F.lit(len(out))), F.lit(2)) == 1 for end in ("sha", "chain")]
        drawn = coin[0] & ~coin[1]
        out.append(cut_lineage(links.filter(drawn), "chains"))
        if out[-1].isEmpty():
            break  # only commits that are their own child are left
        links = cut_lineage(_beyond(links.filter(~drawn), out[-1]).drop("more"), "chains")
    while True:
        links = cut_lineage(_beyond(links, links), "chains")
        done = links.filter("more IS NOT NULL").isEmpty()
        links = links.drop("more")
        if done:
            break
    for back in reversed(out):
        links = cut_lineage(links.union(_beyond(back, links).drop("more")), "chains")
    youngest = state.filter("chain IS NULL").select("repo", "sha", F.col("sha").alias("chain"), F.lit(0).cast("bigint").alias("step"))
    return links.union(youngest)


def _beyond(links: DataFrame, ahead: DataFrame) -> DataFrame:
    """Links that end where those of ``ahead`` go on, with the steps gained; others stay."""
    on = ahead.select("repo", F.col("sha").alias("chain"), F.col("chain").alias("end"), F.col("step").alias("more"))
    return links.join(on, ["repo", "chain"], "left").select(
        "repo", "sha", F.coalesce("end", "chain").alias("chain"), (F.col("step") + F.coalesce("more", F.lit(0))).alias("step"), "more"
    )


def _along(placed: DataFrame) -> DataFrame:
    """The smallest tag at or behind each commit of its chain: a running minimum in pieces, linked by their own."""
    cut = placed.withColumn("piece", F.floor(F.col("step") / PIECE).cast("bigint"))
    inside = Window.partitionBy("repo", "chain", "piece").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("repo", "chain").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    carry = cut.groupBy("repo", "chain", "piece").agg(F.min("tag_no").alias("own")).withColumn("carry", F.min("own").over(before)).drop("own")
    low = F.least(F.min("tag_no").over(inside), F.col("carry"))
    return cut.join(carry, ["repo", "chain", "piece"]).withColumn("tag_no", low).drop("piece", "carry")


def first_tags(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """``repo, sha, tag_no``: the smallest number of a tag that reaches the commit, null where none does.

    ``commits(repo, sha, parents)`` with the array of parents, first one first;
    ``tags(repo, sha, tag_no)``.  A commit that has no row but is named as a parent
    ends the history.
    """
    edges = cut_lineage(_edges(commits), "edges")
    chains = _chains(commits, edges)
    marks = tags.groupBy("repo", "sha").agg(F.min("tag_no").alias("tag_no"))
    state = cut_lineage(_along(chains.join(marks, ["repo", "sha"], "left")), "tags")
    # Edges along a chain are done; the others hand the child's number to the parent.
    places = chains.select("repo", "sha", "chain", "step")
    crossing = (
        edges.join(places.withColumnsRenamed({"sha": "child", "chain": "c", "step": "cs"}), ["repo", "child"])
        .join(places.withColumnsRenamed({"sha": "parent", "chain": "p", "step": "ps"}), ["repo", "parent"])
        .filter("c <> p OR ps <> cs + 1")
        .select("repo", "child", "parent")
    )
    crossing = cut_lineage(crossing, "crossing")
    while True:
        handed = (
            crossing.join(state.select("repo", F.col("sha").alias("child"), "tag_no"), ["repo", "child"])
            .groupBy("repo", F.col("parent").alias("sha"))
            .agg(F.min("tag_no").alias("handed"))
        )
        merged = cut_lineage(state.join(handed, ["repo", "sha"], "left"), "tags")
        better = F.col("handed").isNotNull() & (F.col("tag_no").isNull() | (F.col("handed") < F.col("tag_no")))
        if merged.filter(better).isEmpty():
            return state.select("repo", "sha", "tag_no")
        lowered = merged.withColumn("tag_no", F.least("tag_no", "handed")).drop("handed")
        state = cut_lineage(_along(lowered), "tags")


def commit_ranges(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """``repo, tag, previous, sha`` of the commits that each tag has and no lower tag of the repository.

    ``commits(repo, sha, parents)``, ``tags(repo, tag, sha)``.  Tags are ordered as
    versions; names that are none don't count.  ``previous`` is the next lower tag,
    null for the first.  Commits that no tag reaches come with a null tag: what the
    next release will hold; their ``previous`` is the highest tag.
    """
    order = Window.partitionBy("repo").orderBy(semver("tag"), "tag")
    numbered = tags.filter(semver("tag").isNotNull()).select("repo", "tag", "sha", F.row_number().over(order).alias("tag_no"))
    numbered = cut_lineage(numbered, "tags")
    names = numbered.select("repo", "tag_no", "tag")
    first = first_tags(commits, numbered)
    highest = numbered.groupBy("repo").agg(F.max("tag_no").alias("highest"))
    before = names.select("repo", F.col("tag_no").alias("before_no"), F.col("tag").alias("previous"))
    return (
        first.join(names, ["repo", "tag_no"], "left")
        .join(highest, "repo", "left")
        .withColumn("before_no", F.coalesce(F.col("tag_no") - 1, F.col("highest")))
        .join(before, ["repo", "before_no"], "left")
        .select("repo", "tag", "previous", "sha")
    )


def next_release(commits: DataFrame, tags: DataFrame) -> DataFrame:
    """Bump and next version of each repository from the commits behind its highest tag.

    ``commits(repo, sha, parents, subject, body)``, ``tags(repo, tag, sha)``; a
    repository without such commits has no next release.
    """
    pending = commit_ranges(commits, tags).filter("tag IS NULL").select("repo", "sha")
    return version_bump(commits.join(pending, ["repo", "sha"], "left_semi"), tags)
