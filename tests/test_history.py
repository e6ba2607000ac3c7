"""Commit ranges against a plain walk of the graph."""

import random

import pytest

from gatelake.operators import history
from gatelake.operators.history import commit_ranges

COMMIT, TAG = "repo string, sha string, parents array<string>", "repo string, tag string, sha string"


def walked(commits, tags):
    """Ancestors of each tag, less those of all lower ones."""
    out = []
    for repo in {c[0] for c in commits}:
        parents = {c[1]: [p for p in c[2] or [] if p] for c in commits if c[0] == repo}

        def reach(sha, parents=parents):
            seen, todo = set(), [sha]
            while todo:
                at = todo.pop()
                if at in parents and at not in seen:
                    seen.add(at)
                    todo += parents[at]
            return seen

        own = [(tuple(int(x) for x in t[1].lstrip("v").split(".")), t[1], t[2]) for t in tags if t[0] == repo and t[1].lstrip("v").replace(".", "").isdigit()]
        done, previous = set(), None
        for _, tag, sha in sorted(own):
            out += [(repo, tag, previous, s) for s in reach(sha) - done]
            done |= reach(sha)
            previous = tag
        out += [(repo, None, previous, s) for s in set(parents) - done]
    return sorted(out, key=repr)


def ranges(spark, commits, tags):
    rows = commit_ranges(spark.createDataFrame(commits, COMMIT), spark.createDataFrame(tags, TAG)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("seed, piece", [(1, 4096), (2, 5)])
def test_ranges_of_histories_with_merges(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(history, "PIECE", piece)
    draw = random.Random(seed)
    commits, tags = [], []
    for repo in ("a", "b", "c"):
        for i in range(90):
            young = [f"{repo}{j}" for j in range(max(0, i - 6), i)]
            parents = draw.sample(young, min(len(young), draw.choice([1, 1, 1, 2, 2, 3])))
            commits.append((repo, f"{repo}{i}", parents))
        at = sorted(draw.sample(range(90), 6))
        names = ["v0.9.0", "v0.10.0", "v1.0.0", "1.0.1", "v1.1.0", "nightly"]
        tags += [(repo, n, f"{repo}{i}") for n, i in zip(names, at, strict=True)]
    tags.append(("c", "v2.0.0", "c5"))  # a higher tag on an older commit adds nothing
    assert ranges(spark, commits, tags) == walked(commits, tags)


def test_odd_histories(spark):
    commits = [
        ("r", "1", []), ("r", "2", ["1", "gone"]), ("r", "3", None), ("r", "4", ["2", "2"]), ("r", "4", ["2"]),
        ("r", "5", ["4", "3"]), ("s", "1", []), ("t", "1", ["0"]),
    ]
    tags = [("r", "v1.0.0", "2"), ("r", "v1.0.0-rc", "1"), ("r", "v1.1.0", "5"), ("s", "v1.0.0", "missing")]
    once = [c for c in commits if c != ("r", "4", ["2", "2"])]
    assert ranges(spark, commits, tags) == walked(once, tags)
    assert ranges(spark, [], []) == []


def test_a_long_history_takes_few_joins(spark, monkeypatch):
    rounds = []
    cut = history.cut_lineage
    monkeypatch.setattr(history, "cut_lineage", lambda df, name: (rounds.append(name), cut(df, name))[1])
    n = 10_000
    # A side branch of three commits is merged every ten commits.
    commits = []
    for i in range(n):
        k = i % 10
        parents = [] if i == 0 else [str(i - 1)] if k not in (4, 7) else [str(i - 1 - 1 if k == 4 else i - 4), str(i - 1)] if k == 7 else [str(i - 2)]
        commits.append(("r", str(i), parents))
    tags = [("r", f"v1.{j}.0", str(1000 * j + 999)) for j in range(9)]
    assert ranges(spark, commits, tags) == walked(commits, tags)
    assert len(rounds) < 40


def test_chains_move_some_times_the_history(spark, monkeypatch):
    moved = []
    cut = history.cut_lineage

    def counted(df, name):
        kept = cut(df, name)
        moved.append(kept.count())
        return kept

    n = 10_000
    commits = spark.createDataFrame([("r", str(i), [str(i - 1)] if i else []) for i in range(n)], COMMIT)
    monkeypatch.setattr(history, "cut_lineage", counted)
    monkeypatch.setattr(history, "DOUBLED", 500, raising=False)
    chains = history._chains(commits, history._edges(commits))
    assert {(x.sha, x.chain, x.step) for x in chains.collect()} == {(str(i), str(n - 1), n - 1 - i) for i in range(n)}
    # Doubling alone takes fifteen rounds of all commits.
    assert sum(moved) < 11 * n
