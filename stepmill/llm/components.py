"""Splits that keep related records together (problem 1).

Hash-to-min connected components over a DataFrame of edges, then weighted rendezvous hashing of components to splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepmill.session import cut


def repo_key(repo: Column) -> Column:
    """owner/name in one spelling: letter case, blanks, address forms, `.git`, trailing slashes and `owner__name` aside.

    NULL, blank and text without an owner give NULL: a name alone identifies no repository.
    """
    t = F.lower(F.regexp_replace(repo, r"\s+", ""))
    t = F.regexp_replace(t, r"[?#].*$", "")
    t = F.regexp_replace(t, r"^(?:[a-z][a-z0-9+.-]*://)(?:[^/@]*@)?[^/]+/+", "")
    t = F.regexp_replace(t, r"^(?:[^/@:]+@)?[^/@:]*\.[^/@:]*:/*", "")
    t = F.regexp_replace(t, r"^[a-z0-9.-]+\.[a-z]+/+(?=[^/]+/+[^/]+)", "")
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"^[/.]+|[/]+$", ""), r"\.git$", ""), r"/+$", "")
    # each step uses the one before once, so that the expression grows with their number only
    t = F.regexp_replace(F.regexp_replace(t, r"^([^/]+?)__([^/]+)$", "$1/$2"), "/+", "/")
    return F.nullif(F.regexp_extract(t, "^[^/]+/[^/]+", 0), F.lit(""))


def instance_repo_key(instance_id: Column) -> Column:
    """owner/name out of owner__name-number; NULL where the text has another form."""
    t = F.regexp_extract(F.lower(F.trim(instance_id)), r"^(.+?__.+)-\d+$", 1)
    return F.nullif(F.regexp_replace(t, "^(.+?)__(.+)$", "$1/$2"), F.lit(""))


def commit_key(commits: DataFrame, column: str) -> DataFrame:
    """(commit, commit_key) for each distinct cleaned commit: a shortened commit gets the longest commit that it begins.

    Commits are compared within their first 12 digits, so the window's partitions are the forms of one commit. In order,
    every continuation of a prefix follows it; a prefix that begins several different commits takes the first of them.
    """
    d = commits.select(clean_commit(F.col(column)).alias("commit")).filter("commit IS NOT NULL").groupBy("commit").agg(F.lit(1).alias("n"))
    w = Window.partitionBy(F.substring("commit", 1, 12)).orderBy("commit")
    d = d.withColumn("new", F.when(F.col("commit").startswith(F.lag("commit").over(w)), 0).otherwise(1))
    d = d.withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.select("commit", F.max("commit").over(Window.partitionBy(F.substring("commit", 1, 12), "g")).alias("commit_key"))


def clean_commit(c: Column) -> Column:
    t = F.lower(F.regexp_replace(c, r"\s+", ""))
    return F.when(t != "", t)


def hash_to_min(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the edges (src, dst): (node, component) with the smallest node of the component.

    Clusters are kept as rows (v, u), never as arrays. In each round every node sends its cluster to the cluster's
    minimum and that minimum to every member; rounds end when no row changes. The minimum is a combinable aggregate and
    the join of minima back to the rows is left to AQE, so a giant component neither fills one task nor the driver.
    Each round is cut through the shared checkpoint folder. NULL ends are dropped; no edges give an empty result; loops
    and repeated edges do no harm. More than `max_rounds` rounds raise an error instead of returning a wrong result.
    """
    e = edges.select(F.col("src").alias("v"), F.col("dst").alias("u")).filter("v IS NOT NULL AND u IS NOT NULL")
    both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
    pairs = cut(both.unionByName(both.select("v", F.col("v").alias("u"))).distinct())
    state = _signature(pairs)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        minima = pairs.groupBy("v").agg(F.min("u").alias("m"))
        sent = pairs.join(minima, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("p"))
        pairs = cut(sent.select("p.v", "p.u").distinct())
        before, state = state, _signature(pairs)
        if before == state:
            break
    else:
        raise RuntimeError(f"components not stable after {max_rounds} rounds")
    return pairs.groupBy("v").agg(F.min("u").alias("component")).withColumnRenamed("v", "node")


def _signature(pairs: DataFrame) -> tuple:
    h = F.xxhash64("v", "u")
    return tuple(pairs.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 20)), F.lit(0))).first())


def related_groups(tasks: DataFrame, aliases: DataFrame) -> DataFrame:
    """(task_id, group) for every task, group being the smallest task_id related to it.

    Tasks are edges between their repository and their commit. Only commits that occur with several repositories, and
    the renamings of `aliases`, can link repositories, so the graph given to hash_to_min has one node per repository and
    no node per task. A task without repository hangs on its commit; without both it stands alone. Rows of tasks with
    equal task_id belong to one record; NULL task_id rows are left out; extra columns are ignored.
    """
    t = tasks.filter("task_id IS NOT NULL").select("task_id", F.coalesce(repo_key(F.col("repo")), instance_repo_key(F.col("instance_id"))).alias("r"), clean_commit(F.col("base_commit")).alias("commit"))
    keys = commit_key(tasks, "base_commit")
    t = cut(_left_join(t, keys, "commit").select("task_id", "r", F.col("commit_key").alias("c")))
    rc = t.filter("r IS NOT NULL AND c IS NOT NULL").groupBy("c", "r").agg(F.lit(1).alias("one"))
    by_commit = rc.groupBy("c").agg(F.min("r").alias("first_r"), F.count("r").alias("n"))
    links = rc.join(by_commit.filter("n > 1"), "c").filter("r <> first_r").select(F.col("first_r").alias("src"), F.col("r").alias("dst"))
    renames = aliases.select(repo_key(F.col("old_repo")).alias("src"), repo_key(F.col("new_repo")).alias("dst"))
    comp = hash_to_min(links.unionByName(renames).distinct())
    # a commit's node is its first repository, if it has one
    nodes = _left_join(t, by_commit.select("c", "first_r"), "c").withColumn("node", F.coalesce("r", "first_r", F.concat(F.lit("commit "), "c"), F.concat(F.lit("task "), F.col("task_id").cast("string"))))
    nodes = nodes.groupBy("node", "task_id").agg(F.lit(1).alias("one"))
    firsts = nodes.groupBy("node").agg(F.min("task_id").alias("least")).join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labels = firsts.join(firsts.groupBy("component").agg(F.min("least").alias("group")), "component").select("node", "group")
    return nodes.join(labels, "node").groupBy("task_id").agg(F.min("group").alias("group"))


def _left_join(tasks: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join by a text key; tasks without one match nothing and are spread by their id instead of meeting in one task."""
    spread = F.coalesce(F.col(key), F.concat(F.lit("\x00"), F.col("task_id").cast("string")))
    return tasks.withColumn("__key", spread).join(right.withColumnRenamed(key, "__key"), "__key", "left").drop("__key")


SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def choose_weights(sizes: DataFrame, shares: dict[str, float] | None = None, seeds: int = 64, rounds: int = 3) -> tuple[int, dict[str, float]]:
    """(seed, weights) of the rendezvous hashing whose rows per split come nearest to `shares`; sizes has (group, n).

    Whole groups hash to splits, so shares are met in expectation only, and a group with a third of all rows can upset
    them. All `seeds` are tried in one pass over the groups, then the weights of the best seeds are corrected by what
    each split lacks, several steps at a time. Only one sum per trial and split reaches the driver.
    """
    shares = shares or SHARES
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    best: list[tuple[float, int, dict[str, float], dict[str, int]]] = []
    trials = [(seed, dict(shares)) for seed in range(seeds)]
    for _ in range(rounds if total else 0):
        got: dict[int, dict[str, int]] = {}
        for r in _trial_rows(sizes, trials).collect():  # trials x splits rows
            got.setdefault(r["trial"], {})[r["split"]] = r["rows"]
        for i, (seed, weights) in enumerate(trials):
            rows = got.get(i, {})
            best.append((sum(abs(shares[s] * total - rows.get(s, 0)) for s in shares), seed, weights, rows))
        best = sorted(best, key=lambda b: (b[0], b[1], sorted(b[2].items())))[:8]
        if best[0][0] <= 0.001 * total:
            break
        trials = []
        for _, seed, weights, rows in best:
            ratio = {s: shares[s] * total / max(rows.get(s, 0), 0.02 * shares[s] * total, 1) for s in shares}
            trials.extend((seed, {s: weights[s] * ratio[s] ** power for s in shares}) for power in (0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.2, 1.5))
    return best[0][1:3] if best else (0, dict(shares))


def assign_splits(groups: DataFrame, shares: dict[str, float] | None = None, choice: tuple[int, dict[str, float]] | None = None) -> DataFrame:
    """(task_id, group, split): whole groups to splits by weighted rendezvous hashing.

    A group goes to the split with the highest -weight/ln(hash(group, split)), whatever its size and whatever other groups
    there are. Seed and weights come from choose_weights; given as `choice`, those of an earlier run keep every group in
    its split when rows are added. Ties break by split name. Empty input gives an empty result.
    """
    sizes = cut(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))) if choice is None else groups.select("group").distinct()
    seed, weights = choice or choose_weights(sizes, shares)
    where = sizes.select("group", _rendezvous(F.lit(seed), {s: F.lit(float(w)) for s, w in weights.items()}).alias("split"))
    return groups.join(where, "group").select("task_id", "group", "split")


def _trial_rows(sizes: DataFrame, trials: list[tuple[int, dict[str, float]]]) -> DataFrame:
    names = sorted(trials[0][1])
    rows = F.array(*(F.struct(F.lit(i).alias("trial"), F.lit(seed).alias("seed"), *(F.lit(float(w[s])).alias(f"w_{s}") for s in names)) for i, (seed, w) in enumerate(trials)))
    t = sizes.select("group", "n", F.explode(rows).alias("t"))
    return t.groupBy(F.col("t.trial").alias("trial"), _rendezvous(F.col("t.seed"), {s: F.col(f"t.w_{s}") for s in names}).alias("split")).agg(F.sum("n").alias("rows"))


def _rendezvous(seed: Column, weights: dict[str, Column]) -> Column:
    """Name of the split with the highest score."""
    def score(split: str) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64("group", F.lit(split), seed), 11).cast("double") + 0.5) / float(2**53)
        return -weights[split] / F.log(unit)

    top = F.array_max(F.array(*(F.struct(score(s).alias("score"), F.lit(s).alias("split")) for s in sorted(weights))))
    return top["split"]
