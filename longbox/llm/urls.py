"""Which urls to take images and pages from: stated rules, then learned path templates.

Each host has a tree of path segments. From the root down, the children of a
node are counted: segments that are rare at their place, as ids and names are,
become one wildcard, unless their labels show that they are unlike their
siblings; of those that stay, children whose shares of labelled bad urls do not
differ significantly are one branch. The leaves are templates; one whose
labelled urls are mostly bad, smoothed by the rate of all, is rejected.

A level of all trees is one aggregation over (host, node, segment) counts, so a
host with a third of all urls is only ever counts. What all paths of a node have
in common next is taken in one step, so there are as many rounds as places where
paths part, not as segments.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.storage import stored

# A segment stays itself if it has this share of the urls at its node,
COMMON = 0.05
# or so many urls, and a bad share that its siblings' would give with this probability at most, for all segments tested.
FEW, LEVEL = 5, 0.05
# Shares of bad urls are told apart in steps of one in so many.
STEPS = 1000
# Segments that a branch's name lists.
NAMED = 20
# Branches join while their shares of bad urls differ by less than so many standard errors.
ERRORS = 1.96
# Smoothing counts as so many labelled urls at the overall rate; beyond this share, rejected.
PRIOR = 4.0
PURITY = 0.5
ALLOW, BLOCK = "allow", "block"
# Parts that the counts of a hot node are spread over when they meet their totals.
PARTS = 16


def host(url: Column) -> Column:
    """After the first ``://`` up to /, ?, # or the end, A-Z in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ? or # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest of ``rules`` that fits, null if none does.

    A rule (``example.net/en/``, verdict) fits its host, all subdomains of it and
    paths that start with its path. Of equally long rules the later one counts.
    """
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = (host == name) | host.endswith(f".{name}")
        if rest:
            fits = fits & path.startswith(slash + rest)
        elif slash:
            fits = fits & path.startswith(slash)
        chosen = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def _by_key(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sorted join: the driver builds no table of it."""
    return df.hint("merge")


def _unlike(bad: Column, labelled: Column, rate: Column) -> Column:
    """Log likelihood of the labels by their own share of bad ones, less that by ``rate``."""
    good = labelled - bad
    own = F.when(bad > 0, bad * F.log(bad / (labelled * rate))).otherwise(0.0)
    return own + F.when(good > 0, good * F.log(good / (labelled * (1 - rate)))).otherwise(0.0)


def _kept(counts: DataFrame) -> DataFrame:
    """Rows of ``counts`` (host, node, segment, n, labelled, bad) of segments that stay themselves.

    The test is a likelihood ratio of segment and siblings against one share for
    both. Its level is divided by the number of segments tested at the node, so
    more labels always tell more, and chance among many ids nothing.
    """
    tested = (F.col("n") >= FEW) & (F.col("labelled") > 0)
    totals = counts.groupBy("host", "node").agg(
        F.sum("n").alias("_n"), F.sum("labelled").alias("_labelled"), F.sum("bad").alias("_bad"), F.count(F.when(tested, 1)).alias("_tested")
    )
    rate = F.col("_bad") / F.col("_labelled")
    ratio = _unlike(F.col("bad"), F.col("labelled"), rate) + _unlike(
        F.col("_bad") - F.col("bad"), F.col("_labelled") - F.col("labelled"), rate
    )
    differs = F.when(tested & (F.col("_bad") > 0) & (F.col("_bad") < F.col("_labelled")), ratio >= F.log(F.col("_tested") / LEVEL))
    common = F.col("n") >= COMMON * F.col("_n")
    salted = counts.withColumn("_part", F.pmod(F.xxhash64("segment"), F.lit(PARTS)))
    totals = totals.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PARTS - 1).cast("bigint"))))
    return salted.join(_by_key(totals), ["host", "node", "_part"]).filter(common | F.coalesce(differs, F.lit(False))).select(*counts.columns)


def _name(segment: Column) -> Column:
    """A segment in a template, where ``*``, ``|`` and ``...`` have a meaning of their own."""
    marked = F.regexp_replace(segment, r"([\\|*])", r"\\$1")
    return F.when(segment == "...", F.lit("\\...")).otherwise(marked)


def _extended(node: Column, segments: Column) -> Column:
    return F.concat(node, F.array_join(F.transform(segments, lambda x: F.concat(F.lit("/"), _name(x))), ""))


def _common(nodes: DataFrame) -> DataFrame:
    """``nodes`` moved past the segments that all their paths have in common next.

    Such a segment has all the urls of its node, so it stays and is a branch of
    its own. The first and last path of a node in order tell what all share.
    """
    ends = nodes.groupBy("host", "node").agg(F.min("rest").alias("_a"), F.max("rest").alias("_b"))
    differs = F.array_position(F.zip_with("_a", "_b", lambda a, b: a.eqNullSafe(b)), False)
    shared = F.when(differs > 0, differs - 1).otherwise(F.size("_a")).cast("int")
    moved = ends.select("host", "node", shared.alias("_n"), _extended(F.col("node"), F.slice("_a", 1, shared)).alias("_to"))
    moved = moved.filter("_n > 0")
    rest = F.slice("rest", F.col("_n") + 1, F.greatest(F.size("rest") - F.col("_n"), F.lit(0)))
    joined = nodes.join(_by_key(moved), ["host", "node"], "left")
    return joined.withColumns({"node": F.coalesce("_to", "node"), "rest": F.when(F.col("_n").isNull(), F.col("rest")).otherwise(rest)}).drop("_n", "_to")


def _level(nodes: DataFrame) -> DataFrame:
    """Branch of the next segment of each path: (host, node, segment, branch).

    ``nodes``: host, node, rest (segments), n, labelled, bad, one row per distinct
    path. Segments that stay are in order of their share of bad urls, and a
    branch goes on as long as neighbours do not differ; the rest are ``*``.
    """
    counts = (
        nodes.filter(F.size("rest") > 0)
        .groupBy("host", "node", F.col("rest")[0].alias("segment"))
        .agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    )
    share = (F.col("bad") + 0.5) / (F.col("labelled") + 1)
    kept = _kept(counts).withColumn("_step", F.round(share * STEPS).cast("int"))
    # However many segments stay, a node has at most STEPS + 1 shares to list.
    steps = kept.groupBy("host", "node", "_step").agg(F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
    entry = F.struct(share.alias("share"), "_step", "labelled", "bad")
    listed = steps.groupBy("host", "node").agg(F.array_sort(F.collect_list(entry)).alias("_list"))

    def step(acc, x):
        pooled = (acc["bad"] + x["bad"] + 0.5) / (acc["labelled"] + x["labelled"] + 1)
        error = F.sqrt(pooled * (1 - pooled) * (1 / (acc["labelled"] + 1) + 1 / (x["labelled"] + 1)))
        gap = x["share"] - (acc["bad"] + 0.5) / (acc["labelled"] + 1)
        joins = (acc["branch"] > 0) & (gap < ERRORS * error)
        branch = F.when(joins, acc["branch"]).otherwise(acc["branch"] + 1)
        keep = lambda name: F.when(joins, acc[name] + x[name]).otherwise(x[name])
        made = F.struct(x["_step"].alias("_step"), branch.alias("branch"))
        return F.struct(branch.alias("branch"), keep("labelled").alias("labelled"), keep("bad").alias("bad"), F.concat(acc["out"], F.array(made)).alias("out"))

    zero = F.struct(
        F.lit(0).alias("branch"), F.lit(0).cast("bigint").alias("labelled"), F.lit(0).cast("bigint").alias("bad"),
        F.array().cast("array<struct<_step:int,branch:int>>").alias("out"),
    )
    branches = F.aggregate("_list", zero, step, lambda acc: acc["out"])
    placed = listed.select("host", "node", F.explode(branches).alias("_b")).select("host", "node", "_b._step", "_b.branch")
    named = kept.join(_by_key(placed), ["host", "node", "_step"])
    # A branch is called after its segments, a single one after itself; the first ones tell branches apart.
    order = Window.partitionBy("host", "node", "branch").orderBy("segment")
    first = named.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= NAMED + 1)
    parts = F.transform(F.array_sort(F.collect_list("segment")), _name)
    called = F.when(F.size(parts) > NAMED, F.concat(F.slice(parts, 1, NAMED), F.array(F.lit("...")))).otherwise(parts)
    names = first.groupBy("host", "node", "branch").agg(F.array_join(called, "|").alias("name"))
    return named.join(_by_key(names), ["host", "node", "branch"]).select("host", "node", "segment", "name")


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template, n, labelled, bad, rejected) of ``urls``: host, path, bad.

    ``bad`` is 1 or 0 for labelled urls and null otherwise. One row per distinct
    host and path. The empty path is a template of its own, as is ``/``. Without
    labels nothing is rejected; no urls give no rows.
    """
    held = F.col("bad").isNotNull().cast("bigint")
    nodes = urls.groupBy("host", "path").agg(
        F.count("*").alias("n"), F.sum(held).alias("labelled"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad")
    )
    # Every step writes its slash, so the first character of a node is no part of its template.
    nodes = stored(_common(nodes.withColumns({"rest": F.split("path", "/"), "node": F.lit("")})), "paths")
    while not nodes.filter(F.size("rest") > 0).isEmpty():
        segment = F.when(F.size("rest") > 0, F.col("rest")[0])
        placed = nodes.withColumn("segment", segment).join(_by_key(_level(nodes)), ["host", "node", "segment"], "left")
        step = F.concat("node", F.lit("/"), F.coalesce("name", F.lit("*")))
        rest = F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0)))
        moved = placed.withColumns({"node": F.when(segment.isNull(), F.col("node")).otherwise(step), "rest": rest})
        nodes = stored(_common(moved.drop("segment", "name")), "paths")
    nodes = nodes.withColumn("node", F.substr("node", F.lit(2)))
    leaves = nodes.groupBy("host", F.col("node").alias("template")).agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad")
    )
    overall = nodes.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labelled")), F.lit(0.0)).alias("rate"))
    purity = (F.col("bad") + PRIOR * overall.scalar()) / (F.col("labelled") + PRIOR)
    judged = leaves.withColumn("rejected", purity > PURITY)
    return nodes.select("host", "path", F.col("node").alias("template")).join(_by_key(judged), ["host", "template"])


def judge(cached_images: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(url_hash, host, path, rule, verdict) of ``cached_images``: url_hash, url, bad.

    The longest rule that fits decides; without one, a url of a rejected template
    is blocked and any other allowed. ``bad`` labels urls (1, 0 or null). One row
    per row, repeated ones too. A null url, or one without ``://``, has an empty
    host and path, which no rule fits. An empty table gives no rows. Other
    columns are ignored.
    """
    parts = cached_images.select("url_hash", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "bad")
    rejected = templates(parts).filter("rejected").select("host", "path", "rejected")
    found = parts.join(_by_key(rejected), ["host", "path"], "left").withColumn("_rule", rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("rejected"), BLOCK).otherwise(ALLOW)
    return found.select("url_hash", "host", "path", "_rule.rule", F.coalesce("_rule.verdict", learned).alias("verdict"))
