"""URL filtering: host and path rules, then a path-template tree learned from labelled URLs.

Rules first: a rule (host, path) fits its host and all subdomains where the
URL's path starts with the rule's; the longest (host and path together) wins.

The rest by templates. Segments with digits lose them (``825.html`` becomes
``<n>.html``), so URLs collapse into shapes per host. From the root down, a
segment keeps a branch of its own if it has enough support and its share of
allowed, blocked and unlabelled URLs differs from its siblings' (G-test against
the rest of the branch). Such siblings merge into one, named by its first and
``~``, if they are alike (to a tenth) in those shares and in what lies below them:
how many URLs end there, and how many go on with a variable segment. The others
merge into a wildcard ``*`` if all of them or none are labelled; else those with
unlabelled URLs stay apart under their own segments, so no wildcard carries labels
over to other segments. A template is rejected if the purity of its labelled URLs,
(allowed + 1) / (allowed + blocked + 2), is below ``PURITY`` and there are
``SUPPORT`` of them at least. With fewer it goes by the deepest branch of its own
above it, under the same two conditions, and else is let through. Where a branch
has fewer than ``SUPPORT`` labels left, or one shape, nothing below it can change a
verdict: it ends in ``**``, and the levels below aren't looked at.

All of it is DataFrame code on counts: one row per host and shape, aggregated
before anything is shuffled by host, so a hot host or a million pages under one
branch are one row. Only the last join goes back to the URLs.

Defined results: null or without ``://``: host and path are empty, no rule fits,
and the path is one empty segment. ``judged`` goes as deep as labels do; with a ``depth``, segments beyond it
form the last one (``**``).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, written

DEPTH = 6
SUPPORT = 5
#: G statistic beyond which a branch differs from its siblings (chi-square, two degrees of freedom, p = 0.001).
DIFFERS = 13.8
PURITY = 0.5


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.when(F.instr(url, F.lit("://")) > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_verdict(rules: list[tuple[str, str, bool]], host: Column, path: Column) -> tuple[Column, Column]:
    """(rule, allowed) of the longest rule (host, path, allowed) that fits; nulls if none does."""
    name, allowed = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for h, p, ok in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, allowed = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(ok)).otherwise(allowed)
    return name, allowed


def shape(path: Column, depth: int | None = DEPTH) -> Column:
    """Segments with runs of digits made alike."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "<n>"), "/", -1)
    if depth is None:
        return parts
    return F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth), F.array(F.lit("**")))).otherwise(parts)


def _g(rows: list[tuple[str, str]]) -> Column:
    """G statistic of a 2-by-k table: (branch count, all siblings' count) columns; the other row is the rest."""
    a, t = sum((F.col(x) for x, _ in rows), F.lit(0)), sum((F.col(y) for _, y in rows), F.lit(0))
    out = F.lit(0.0)
    for x, y in rows:
        for seen, whole in ((F.col(x), a), (F.col(y) - F.col(x), t - a)):
            expected = whole * F.col(y) / t
            out = out + F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)
    return out


def template_tree(urls: DataFrame, depth: int | None = DEPTH, support: int = SUPPORT) -> DataFrame:
    """host, shape, template of all ``urls`` (host, shape, allowed: null where unlabelled), with the counts of the
    template (n_) and of the labels of the deepest branch of its own (own_)."""
    tree = (urls.groupBy("host", "shape").agg(
        F.count(F.when(F.col("allowed"), 1)).alias("ok"), F.count(F.when(~F.col("allowed"), 1)).alias("bad"),
        F.count(F.when(F.col("allowed").isNull(), 1)).alias("open"))
        .withColumns({"template": F.lit(""), "own_ok": F.lit(0).cast("long"), "own_bad": F.lit(0).cast("long")}))
    kinds = ["ok", "bad", "open"]
    going = written(tree, "shapes")
    ended = []
    for level in count() if depth is None else range(depth + 1):
        part, after = F.get("shape", F.lit(level)), F.get("shape", F.lit(level + 1))
        rows = going.where(F.size("shape") > level)
        live = (rows.groupBy("host", "template").agg(F.sum(F.col("ok") + F.col("bad")).alias("labels"), F.count("*").alias("shapes"))
                .where((F.col("labels") >= support) & (F.col("shapes") > 1)).select("host", "template"))
        last = rows.join(live, ["host", "template"], "left_anti").withColumn("template", F.concat("template", F.lit("/**")))
        ended.append(written(going.where(F.size("shape") <= level).unionByName(last), "templates"))
        rows = written(rows.join(live, ["host", "template"]), "rows")
        drop(going)
        if rows.isEmpty():
            break
        total = sum((F.col(k) for k in kinds), F.lit(0))
        branch = (rows.withColumn("part", part).groupBy("host", "template", "part")
                  .agg(*(F.sum(k).alias(k) for k in kinds), F.sum(F.when(after.isNull(), total)).alias("ends"),
                       F.sum(F.when(F.contains(after, F.lit("<n>")), total)).alias("varies")))
        whole = branch.groupBy("host", "template").agg(*(F.sum(k).alias(f"all_{k}") for k in kinds))
        differs = (total >= support) & (_g([(k, f"all_{k}") for k in kinds]) >= DIFFERS)
        branch = written(branch.join(whole, ["host", "template"]).select(
            "host", "template", "part", *kinds, differs.alias("differs"),
            F.array(*(F.round(10 * F.coalesce(k, F.lit(0)) / total) for k in (*kinds, "ends", "varies"))).alias("profile")), "branches")
        own = branch.where("differs")
        alike = own.groupBy("host", "template", "profile").agg(
            F.min("part").alias("name"), F.count("*").alias("n"), F.sum("ok").alias("to_ok"), F.sum("bad").alias("to_bad"))
        own = own.join(alike, ["host", "template", "profile"]).select("host", "template", "part", F.when(
            F.col("n") > 1, F.concat("name", F.lit("~"))).otherwise(F.col("name")).alias("own"), "to_ok", "to_bad")
        # Where labelled and unlabelled URLs would meet in the wildcard, branches with unlabelled ones keep their segments.
        mixed = (branch.where("not differs").groupBy("host", "template")
                 .agg(F.sum(F.col("ok") + F.col("bad")).alias("known"), F.sum("open").alias("unknown"))
                 .where("known > 0 and unknown > 0").select("host", "template"))
        apart = branch.where("not differs and open > 0").join(mixed, ["host", "template"]).select(
            "host", "template", "part", F.col("part").alias("own"), F.lit(None).cast("long").alias("to_ok"),
            F.lit(None).cast("long").alias("to_bad"))
        going = written(rows.withColumn("part", part).join(own.unionByName(apart), ["host", "template", "part"], "left")
                        .withColumn("template", F.concat("template", F.lit("/"), F.coalesce("own", F.lit("*"))))
                        .withColumns({f"own_{k}": F.coalesce(f"to_{k}", f"own_{k}") for k in ("ok", "bad")})
                        .drop("part", "own", "to_ok", "to_bad"), "going")
        drop(rows, branch)
        if level == depth:
            ended.append(going)
    tree = ended[0]
    for more in ended[1:]:
        tree = tree.unionByName(more)
    counts = tree.groupBy("host", "template").agg(*(F.sum(k).alias(f"n_{k}") for k in kinds))
    return tree.select("host", "shape", "template", "own_ok", "own_bad").join(counts, ["host", "template"])


def purity(support: int = SUPPORT) -> Column:
    """Of the template, or of the branch above it where only that has enough labels."""
    n, own = F.col("n_ok") + F.col("n_bad"), F.col("own_ok") + F.col("own_bad")
    return F.when((n < support) & (own >= support), (F.col("own_ok") + 1) / (own + 2)).otherwise((F.col("n_ok") + 1) / (n + 2))


def enough(support: int = SUPPORT) -> Column:
    return (F.col("n_ok") + F.col("n_bad") >= support) | (F.col("own_ok") + F.col("own_bad") >= support)


def verdicts(urls: DataFrame) -> DataFrame:
    """``urls`` (host, shape, allowed) plus template, purity and ``fine``: whether its label, or else its template, lets it in."""
    tree = template_tree(urls.select("host", "shape", "allowed"), None).withColumns({"purity": purity(), "enough": enough()})
    out = urls.join(tree.select("host", "shape", "template", "purity", "enough"), ["host", "shape"])
    return out.withColumn("fine", F.coalesce("allowed", (F.col("purity") >= PURITY) | ~F.col("enough")))


def judged(pages: DataFrame, rules: list[tuple[str, str, bool]], keep: list[str] | None = None) -> DataFrame:
    """The ``keep`` columns (``page_id`` by default), host, path, rule, verdict, template and purity of every row."""
    keep = keep or ["page_id"]
    url = F.col("url").cast("string")
    placed = pages.select(*keep, host_of(url).alias("host"), path_of(url).alias("path"))
    name, allowed = rule_verdict(rules, F.col("host"), F.col("path"))
    ruled = placed.withColumns({"rule": name, "allowed": allowed, "shape": shape(F.col("path"), None)})
    return verdicts(ruled).select(*keep, "host", "path", "rule", F.when(F.col("fine"), "allow").otherwise("block").alias("verdict"),
                                  "template", "purity")
