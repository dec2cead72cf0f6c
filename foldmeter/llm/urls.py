"""URL filters: rules for hosts and paths, and for the rest a tree of path templates judged by the purity of labelled pages.

Everything is a column expression, a grouping or a join.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmeter.llm.text import beside
from foldmeter.session import broadcast_if_small, cut_lineage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (size, verdict, rule), else null.  ``rules``: (verdict, host, path)."""
    fits = [
        F.when(
            ((host == h) | host.endswith(f".{h}")) & path.startswith(p),
            F.struct(F.lit(len(h + p)).alias("size"), F.lit(v).alias("verdict"), F.lit(h + p).alias("rule")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))


def wildcard(segment: Column) -> Column:
    """What a variable segment becomes: its kind and its extension."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    kind = F.when(stem.rlike("^[0-9]+$"), "<number>").when(stem.rlike("^[0-9A-Fa-f-]{8,}$"), "<hex>").otherwise("<any>")
    return F.concat(kind, extension)


def templates(pages: DataFrame, depth: int = 4, least_labelled: int = 5, z: float = 1.96) -> DataFrame:
    """``pages`` (host, path, label, ...) with ``template``: the path with its variable segments generalised.

    The tree grows level by level.  Below a node a segment with ``least_labelled`` labelled pages or more, however small a part
    of the node, stays as it is where its share of good labels differs from the node's by ``z`` standard errors, and becomes
    ``<alike>`` where it does not; the others become the wildcard of their kind.  From level ``depth`` on only nodes that can
    still have a branch that differs grow, those with more labels than ``least_labelled``, good and bad; below others the rest
    of a path is one wildcard.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    out = pages.withColumns({"_segments": segments, "template": F.lit("")})
    ended = []
    for level in count():
        out = out.withColumn("_segment", F.get("_segments", F.lit(level)))
        here = out.filter("_segment is not null")
        good, known = F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)), F.count("label")
        node = cut_lineage(here.groupBy("host", "template").agg(good.alias("g"), known.alias("k")))
        if level >= depth:
            grows = broadcast_if_small(cut_lineage(node.filter((F.col("g") > 0) & (F.col("g") < F.col("k")) & (F.col("k") > least_labelled))))
            rest = here.join(grows, ["host", "template"], "left_anti").withColumn("template", F.concat("template", F.lit("/<rest>")))
            ended += [out.filter("_segment is null"), rest]
            if grows.isEmpty():
                break
            here = out = cut_lineage(here.join(grows, ["host", "template"], "left_semi"))
        branch = here.groupBy("host", "template", "_segment").agg(good.alias("bg"), known.alias("bk"))
        branch = cut_lineage(branch.filter(F.col("bk") >= least_labelled))
        both = branch.join(broadcast_if_small(node), ["host", "template"])
        # the error of a branch of bk labels if it were like its node; add-one, so that it is never 0
        p = (F.col("g") + 1) / (F.col("k") + 2)
        differs = F.abs(F.col("bg") / F.col("bk") - F.col("g") / F.col("k")) > z * F.sqrt(p * (1 - p) / F.col("bk"))
        stay = both.select(
            F.col("host").alias("_host"),
            F.col("template").alias("_template"),
            F.col("_segment").alias("_own"),
            F.when(differs, F.col("_segment")).otherwise(F.lit("<alike>")).alias("_named"),
        )
        side = broadcast_if_small(cut_lineage(stay))
        out = out.join(side, (F.col("host") == F.col("_host")) & (F.col("template") == F.col("_template")) & (F.col("_segment") == F.col("_own")), "left")
        step = F.concat("template", F.lit("/"), F.coalesce("_named", wildcard(F.col("_segment"))))
        out = out.withColumn("template", F.when(F.col("_segment").isNull(), F.col("template")).otherwise(step))
        out = out.drop("_host", "_template", "_own", "_named", "_segment")
    return reduce(DataFrame.unionByName, ended).drop("_segments", "_segment")


def url_filter(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    least_purity: float = 0.5,
    weight: float = 10.0,
    **tree,
) -> DataFrame:
    """``pages`` (url, label: 1 good, 0 bad or null, and any columns) with host, path, rule, template, purity and verdict.

    The longest rule that fits decides.  Else the template does: its share of good labels, smoothed towards the host's share
    and that towards the share of all, each with ``weight`` pages; below ``least_purity`` the verdict is block.  Without any
    label the share counts as 1.  Null and odd urls have an empty host and path and are judged like any others.
    """
    return beside(pages, ["url", "label"], lambda d: _url_filter(d, rules, least_purity, weight, **tree))


def _url_filter(pages: DataFrame, rules: list[tuple[str, str, str]], least_purity: float, weight: float, **tree) -> DataFrame:
    made = ["host", "path", "rule", "template", "purity", "verdict"]
    pages = pages.drop(*made).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    placed = cut_lineage(templates(pages, **tree))
    good, known = F.coalesce(F.sum(F.col("label").cast("long")), F.lit(0)), F.count("label")
    leaf = placed.groupBy("host", "template").agg(good.alias("g"), known.alias("k"))
    hosts = placed.groupBy("host").agg(good.alias("hg"), known.alias("hk"))
    g, k = placed.agg(good, known).first()
    overall = g / k if k else 1.0
    hosts = cut_lineage(hosts.withColumn("share", (F.col("hg") + weight * overall) / (F.col("hk") + weight)).select("host", "share"))
    leaf = leaf.join(broadcast_if_small(hosts), "host")
    leaf = leaf.withColumn("purity", (F.col("g") + weight * F.col("share")) / (F.col("k") + weight)).select("host", "template", "purity")
    out = placed.join(broadcast_if_small(cut_lineage(leaf)), ["host", "template"])
    decided = ruled(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("purity") < least_purity, "block").otherwise("allow")
    return (
        out.withColumn("_rule", decided)
        .withColumn("rule", F.col("_rule.rule"))
        .withColumn("verdict", F.coalesce("_rule.verdict", own))
        .select(*[c for c in pages.columns if c not in made], *made)
    )
