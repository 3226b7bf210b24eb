"""URL filters: fixed host and path rules, then a tree of path templates judged by their labels."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.settle import settled

DEPTH = 3                    # segments that the tree in SQL takes apart; here all are
VARIABLE_VALUES = 8          # a place with more different segments than this
VARIABLE_SHARE = 0.1         # and more than this share of its pages is a wildcard
OWN_PAGES = 8                # a segment of a wildcard place with so many pages keeps its node
OWN_LABELS = 2               # or with so many labels
SIMILAR_Z = 1.96             # branches whose bad shares differ less than this are merged
SMOOTHING = 8.0              # labelled pages that a parent's share counts for
REJECT_SHARE = 0.5

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: str) -> Column:
    """The host, A-Z in lower case; empty for a null or a url without ``://``."""
    found = F.regexp_extract(F.col(url), r"^(?s).*?://([^/?#]*)", 1)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(found, letters, letters.lower()), F.lit(""))


def path_of(url: str) -> Column:
    """From the end of the host up to ``?`` or ``#``; empty for a null or a url without ``://``."""
    return F.coalesce(F.regexp_extract(F.col(url), r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(rules: Sequence[Rule], host: str = "host", path: str = "path") -> Column:
    """Verdict and text of the longest rule that fits, as a struct; null if none does.

    A rule fits its host and all subdomains where the path starts with the rule's. Host
    and path together decide the length; of equal ones a block goes first, then by text.
    """
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2]))
    cases = [
        F.when(((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p),
               F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule")))
        for verdict, h, p in order
    ]
    nothing = F.lit(None).cast("struct<verdict:string,rule:string>")
    return F.coalesce(*cases, nothing)


def _segments(path: str) -> Column:
    """All segments, runs of digits written as ``#``."""
    return F.split(F.regexp_replace(F.ltrim(F.col(path), F.lit("/")), r"[0-9]+", "#"), "/")


def templates(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``host``, ``shape``, ``template``, ``bad_share`` of every host's path shapes.

    ``pages``: page_id, host, path; ``labels``: page_id, bad (boolean), one row a page.
    A place in a host's tree whose segments vary is a wildcard: more than VARIABLE_VALUES
    different ones, and more than VARIABLE_SHARE of its pages. Only its rare segments share
    the wildcard: one with OWN_PAGES pages or OWN_LABELS labels keeps a node. A branch
    whose bad share is like that of its parent (a z-test at SIMILAR_Z, or fewer than two
    labels) is merged with it and takes its share. The others of a place are pooled, in the
    order of their bad shares, as long as the next is like the pool by a two-sample z-test;
    a pool's share is smoothed towards the parent's by SMOOTHING pages. The parent of a host
    is all pages, and hosts are not pooled. The paths that end
    at a place are one of its branches; a branch with all labels of its place takes the
    place's share, in which they count already.

    Pages are first counted by host and shape, with partial counts before the shuffle, so
    the tree works on shapes and a hot host is small. It grows by a branching at a time while
    a place has several shapes: segments that all shapes of a place share are passed in one turn,
    so turns follow branchings, not the length of paths. A shape that stands alone is done.
    """
    known = pages.join(labels.filter("bad is not null").select("page_id", F.col("bad").cast("int").alias("bad")),
                       "page_id", "left")
    shapes = (
        known.groupBy("host", _segments("path").alias("shape"))
        .agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    )
    shapes = settled(shapes, "url-shapes", pages.count())
    n_shapes = shapes.count()
    total = shapes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()     # one row
    every = F.lit(((total["bad"] or 0) + 1) / ((total["n"] or 0) + 2))
    hosts = shapes.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("all_share", every)
    nodes = shapes.withColumns({"node": F.lit(""), "depth": F.lit(0)}).join(hosts.select("host", _own("all_share").alias("share")), "host")
    found = []
    while True:
        level = settled(_level(nodes), "url-level", n_shapes)      # else the plan doubles with each
        found.append(level.filter("done").select("host", "shape", F.col("node").alias("template"), F.col("share").alias("bad_share")))
        nodes = level.filter("not done").drop("done")
        if nodes.isEmpty():
            return reduce(DataFrame.unionAll, found)


def _passed(nodes: DataFrame) -> DataFrame:
    """``nodes`` beyond the segments that all shapes of their place share, to which nothing else happens there.

    What the first and the last of a place in order have in common at their start, all have.
    """
    rest = F.slice("shape", F.col("depth") + 1, F.size("shape") - F.col("depth"))
    ends = nodes.groupBy("host", "node").agg(F.min(rest).alias("first"), F.max(rest).alias("last"))
    start = F.struct(F.lit(True).alias("on"), F.lit(0).alias("n"))
    common = F.aggregate(F.arrays_zip("first", "last"), start, lambda so_far, pair: F.struct(
        (so_far["on"] & pair["first"].eqNullSafe(pair["last"])).alias("on"),
        (so_far["n"] + (so_far["on"] & pair["first"].eqNullSafe(pair["last"])).cast("int")).alias("n")))
    shared = F.transform(F.slice("shape", F.col("depth") + 1, F.col("common")), lambda s: F.concat(F.lit("/"), s))
    return nodes.join(ends.select("host", "node", common["n"].alias("common")), ["host", "node"]).withColumns(
        {"node": F.concat("node", F.array_join(shared, "")), "depth": F.col("depth") + F.col("common")}).drop("common")


def _level(nodes: DataFrame) -> DataFrame:
    """``nodes`` one branching further down; ``done`` where a shape has its whole template."""
    nodes = _passed(nodes)
    here = F.get(F.col("shape"), F.col("depth"))
    nodes = nodes.withColumn("step", F.when(here.isNull(), "").otherwise(F.concat(F.lit("/"), here)))
    steps = nodes.groupBy("host", "node", "share", "step").agg(
        F.count("*").alias("shapes"), *(F.sum(c).alias(c) for c in ("pages", "n", "bad")))
    values = F.count(F.when(~F.col("step").isin("", "/"), 1)) + F.max(F.col("step").isin("", "/").cast("int"))
    places = steps.groupBy("host", "node").agg(
        F.sum("n").alias("labels"),
        ((values > VARIABLE_VALUES) & (values > VARIABLE_SHARE * F.sum("pages"))).alias("varies"))
    rare = (F.col("step") != "") & (F.col("pages") < OWN_PAGES) & (F.col("n") < OWN_LABELS)
    steps = steps.join(places, ["host", "node"]).withColumn(
        "branch", F.when(F.col("varies") & rare, "/*").otherwise(F.col("step")))
    branches = steps.groupBy("host", "node", "share", "labels", "branch").agg(
        *(F.sum(c).alias(c) for c in ("shapes", "n", "bad")))
    branches = _pooled(branches).select(
        "host", "node", "branch", "shapes",
        F.when(~F.col("unlike") | (F.col("n") == F.col("labels")), F.col("share")).otherwise(_smoothed("share")).alias("branch_share"))
    moved = steps.select("host", "node", "step", "branch").join(branches, ["host", "node", "branch"])
    done = (F.col("shapes") == 1) | (F.col("step") == "")
    rest = F.slice("shape", F.col("depth") + 2, F.greatest(F.size("shape"), F.lit(1)))
    rest = F.when(F.col("done"), F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), s)), "")).otherwise("")
    return nodes.drop("share").join(moved, ["host", "node", "step"]).withColumn("done", done).select(
        "host", "shape", "pages", "n", "bad", F.concat("node", "branch", rest).alias("node"),
        F.col("branch_share").alias("share"), "done", (F.col("depth") + 1).alias("depth"))


def _pooled(branches: DataFrame) -> DataFrame:
    """``branches`` and ``unlike``: whether one is unlike its parent; such have the labels of their whole pool.

    Siblings with equal counts go together, so a place brings one row for each pair of counts.
    """
    own = F.col("bad") / F.col("n")
    unlike = F.coalesce(~_similar("share"), F.lit(False))
    counts = branches.filter(unlike).groupBy("host", "node", "n", "bad").agg(F.count("*").alias("times"))
    pools = counts.groupBy("host", "node").agg(
        F.array_sort(F.collect_list(F.struct(own.alias("own"), "n", "bad", "times"))).alias("counts"))
    kind = "array<struct<n:bigint,bad:bigint,own:double,last:bigint>>"

    def pool(n: Column, bad: Column, some: Column) -> Column:
        """The pool whose highest share and size are those of ``some``."""
        return F.array(F.struct(n.alias("n"), bad.alias("bad"), some["own"].alias("own"), some["n"].alias("last")))

    def add(before: Column, some: Column) -> Column:
        pool_, n, bad = F.get(before, F.size(before) - 1), some["n"] * some["times"], some["bad"] * some["times"]
        p = (pool_["bad"] + some["bad"]) / (pool_["n"] + some["n"])
        like = F.abs(pool_["bad"] / pool_["n"] - some["own"]) <= SIMILAR_Z * F.sqrt(p * (1 - p) * (1 / pool_["n"] + 1 / some["n"]))
        return F.when(like, F.concat(F.slice(before, 1, F.size(before) - 1), pool(pool_["n"] + n, pool_["bad"] + bad, some))
                      ).otherwise(F.concat(before, pool(n, bad, some)))

    pools = pools.select("host", "node", F.aggregate("counts", F.array().cast(kind), add).alias("pools"))
    mine = F.get(F.filter("pools", lambda g: F.struct(g["own"], g["last"]) >= F.struct(own, F.col("n"))), F.lit(0))
    return branches.join(pools, ["host", "node"], "left").withColumn("unlike", unlike).withColumn(
        "pool", F.when(F.col("unlike"), mine)).withColumns(
        {"n": F.coalesce("pool.n", "n"), "bad": F.coalesce("pool.bad", "bad")}).drop("pools", "pool")


def _similar(parent: str) -> Column:
    """Whether ``n`` labels, ``bad`` of them bad, are like a parent's share or too few to tell."""
    p = F.col(parent)
    return (F.col("n") < 2) | (F.abs(F.col("bad") / F.col("n") - p) <= SIMILAR_Z * F.sqrt(p * (1 - p) / F.col("n")))


def _own(parent: str) -> Column:
    """The share of a node with ``n`` labels, ``bad`` of them bad, below a parent's share."""
    return F.when(_similar(parent), F.col(parent)).otherwise(_smoothed(parent))


def _smoothed(parent: str) -> Column:
    return (F.col("bad") + SMOOTHING * F.col(parent)) / (F.col("n") + SMOOTHING)


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], url: str = "url",
          id_col: str = "page_id") -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict``, ``template``, ``bad_share`` of every page.

    The longest fitting rule decides; other pages are blocked if the smoothed share of bad
    pages of their template exceeds REJECT_SHARE. ``labels``: ``id_col`` and ``bad``; several labels of a page
    count as bad if one is. Without labels every share is one half, which blocks nothing.

    A null url, or one without ``://``, has an empty host and path and stands in the tree
    of the empty host. Null ids and repeated rows are kept (null ids take no label);
    an empty table gives none; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    marks = labels.groupBy(F.col(id_col).alias("page_id")).agg(F.max(F.col("bad").cast("boolean")).alias("bad"))
    tree = templates(rows, marks)
    shape = _segments("path")
    judged = (
        rows.withColumn("shape", shape).join(tree, ["host", "shape"], "left")
        .withColumn("found", matching_rule(rules))
    )
    method = F.when(F.col("bad_share") > REJECT_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("page_id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"),
        F.coalesce("found.verdict", method).alias("verdict"), "template", "bad_share")
