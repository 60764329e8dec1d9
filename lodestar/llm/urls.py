"""URL filtering by rules and path templates.

Rules decide first. Their verdicts also label URLs, and the labels judge path
templates, which decide the URLs that no rule fits. Per host, the paths form a tree by
segments. Numbers and segments that carry digits are variable by their shape. Then,
level by level from the root:

1. Below any node with more than ``most_children`` different segments, all of them are
   replaced by a wildcard.
2. Sibling branches that have the same rest of the template are merged if their labels
   are alike: in the order of their smoothed shares, a group ends where the next branch
   differs significantly from the last (two-proportion test). Branches without labels
   join the group if there is just one, and are a group of their own if there are more.
   Merged branches count as one for the levels below.

A template whose smoothed share of blocked URLs reaches ``purity`` is rejected, and all
URLs of it without a rule are blocked; any other URL without a rule is allowed.

At scale: URLs are counted by host and shape first, so everything that follows runs
over distinct shapes. Each level of the tree is an aggregate over (host, prefix); no
host is ever gathered in a task. A level is worked on where URLs still share a node: what
is alone below its node is settled, so the number of levels is that of the deepest
shared path, not of the longest one. Only rejected shapes are joined back, by an
equi-join that Spark may split.

Defined cases: a null URL or one without :// has an empty host and path, fits no
rule and is allowed; null ids and repeated rows are kept; further columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import written


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


#: The fixed rules: verdict, host, start of the path.
RULES = (
    UrlRule("allow", "org", "/"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


@dataclass(frozen=True)
class TemplateSettings:
    most_children: int = 12
    #: Labelled URLs that a template needs, the weight of the prior, and the share of blocked ones from which it is rejected.
    least_labelled: int = 10
    prior: float = 1.0
    purity: float = 0.9
    #: Standard errors from which two branches differ.
    differs: float = 2.0


SETTINGS = TemplateSettings()


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + F.lit(1)), r"^([^?#]*)", 1)
    return F.translate(raw, ascii_uppercase, ascii_lowercase), path


def rule_of(host: Column, path: Column, rules: Sequence[UrlRule] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shapes(path: Column) -> Column:
    """Segments with what varies by its looks replaced: runs of digits, and long mixes of letters and digits."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    shaped = F.transform(parts, lambda s: F.when(s.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{12,}$"), F.lit("<id>")).otherwise(F.regexp_replace(s, r"[0-9]+", "<n>")))
    return F.when(F.size(parts) > 0, shaped).otherwise(F.array().cast("array<string>"))


WILD = "<*>"


def _with_wild(template: str, level: int) -> Column:
    return F.transform(template, lambda s, i: F.when(i == level, F.lit(WILD)).otherwise(s))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def generalised(tree: DataFrame, most_children: int) -> DataFrame:
    """(host, shape, ...) with template: the shape with wildcards below nodes of too many children."""
    done, active, level = [], tree.withColumn("template", F.col("shape")), 0
    while True:
        deep = active.withColumn("prefix", F.slice("template", 1, level)).withColumn("child", F.get("template", F.lit(level)))
        children = deep.groupBy("host", "prefix", "child").agg(F.count("*").alias("n"))
        nodes = children.groupBy("host", "prefix").agg(F.count("child").alias("children"), F.sum("n").alias("shapes"))
        joined = deep.join(nodes, ["host", "prefix"])
        wide = F.col("child").isNotNull() & (F.col("children") > most_children)
        # Fewer shapes than that below a node can't have too many children at any deeper one.
        more = F.col("child").isNotNull() & (F.col("shapes") > most_children)
        now = written(joined.withColumn("template", F.when(wide, _with_wild("template", level)).otherwise(F.col("template"))).withColumn("more", more).drop("prefix", "child", "children", "shapes"))
        done.append(now.where("not more").drop("more"))
        active, level = now.where("more").drop("more"), level + 1
        if active.isEmpty():
            return _union(done)


def _groups(siblings: DataFrame, level: int, differs: float) -> DataFrame:
    """(host, final, moved): what siblings (host, kin, final, own, bad) are renamed to. A kin has no more members than a node may have children."""
    kin = Window.partitionBy("host", "kin")
    ordered = kin.orderBy(F.col("own") > 0, "share", "final")
    share = (F.col("bad") + 0.5) / (F.col("own") + 1)
    placed = siblings.withColumn("share", share).withColumns({"p": F.lag("share").over(ordered), "m": F.lag("own").over(ordered)})
    error = F.sqrt(F.col("share") * (1 - F.col("share")) / (F.col("own") + 1) + F.col("p") * (1 - F.col("p")) / (F.col("m") + 1))
    begins = (F.col("own") > 0) & (F.coalesce(F.col("m") == 0, F.lit(True)) | (F.abs(F.col("share") - F.col("p")) > differs * error))
    numbered = placed.withColumn("number", F.sum(F.when(begins, 1).otherwise(0)).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    alone = numbered.withColumn("groups", F.max("number").over(kin))
    joined = alone.withColumn("number", F.when(F.col("groups") == 1, 1).otherwise(F.col("number")))
    sized = joined.withColumns({"members": F.count("*").over(Window.partitionBy("host", "kin", "number")), "all": F.count("*").over(kin)})
    name = F.when(F.col("members") == F.col("all"), F.lit(WILD)).otherwise(F.concat(F.lit("<*"), F.col("number"), F.lit(">")))
    return sized.where("members > 1").select("host", "final", F.transform("final", lambda s, i: F.when(i == level, name).otherwise(s)).alias("moved"))


def merged(branches: DataFrame, differs: float) -> DataFrame:
    """(host, template, own, bad) with final: the template after merging siblings, level by level."""
    done, active, level = [], branches.withColumn("final", F.col("template")), 0
    while True:
        finals = active.groupBy("host", "final").agg(F.sum("own").alias("own"), F.sum("bad").alias("bad"))
        siblings = finals.where(F.size("final") > level).withColumn("kin", _with_wild("final", level))
        joined = active.join(_groups(siblings, level, differs), ["host", "final"], "left").withColumn("final", F.coalesce("moved", "final")).drop("moved")
        below = joined.select("host", F.slice("final", 1, level + 1).alias("prefix"), "final").distinct().groupBy("host", "prefix").agg(F.count("*").alias("finals"))
        deep = joined.withColumn("prefix", F.slice("final", 1, level + 1)).join(below, ["host", "prefix"])
        now = written(deep.withColumn("more", (F.size("final") > level + 1) & (F.col("finals") > 1)).drop("prefix", "finals"))
        done.append(now.where("not more").drop("more"))
        active, level = now.where("more").drop("more"), level + 1
        if active.isEmpty():
            return _union(done)


def template_verdicts(urls: DataFrame, settings: TemplateSettings = SETTINGS) -> DataFrame:
    """(host, path, label: 1 blocked, 0 allowed, null unknown) -> (host, shape, template, n, labelled, blocked, purity, rejected)."""
    counted = urls.groupBy("host", shapes(F.col("path")).alias("shape")).agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
    tree = generalised(written(counted), settings.most_children)
    branches = written(tree.groupBy("host", "template").agg(F.sum("labelled").alias("own"), F.sum("blocked").alias("bad")))
    judged = merged(branches, settings.differs)
    group = judged.groupBy("host", "final").agg(F.sum("own").alias("group_labelled"), F.sum("bad").alias("group_blocked"))
    purity = (F.col("group_blocked") + settings.prior * 0.5) / (F.col("group_labelled") + settings.prior)
    rejected = (F.col("group_labelled") >= settings.least_labelled) & (purity >= settings.purity)
    verdicts = judged.join(group, ["host", "final"]).select("host", "template", "final", purity.alias("purity"), rejected.alias("rejected"))
    return tree.join(verdicts, ["host", "template"]).select("host", "shape", F.concat(F.lit("/"), F.array_join("final", "/")).alias("template"), "n", "labelled", "blocked", "purity", "rejected")


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] = RULES, settings: TemplateSettings = SETTINGS) -> DataFrame:
    """page_id, host, path, rule, verdict, template (of rejected URLs) for every row."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": name, "ruled": verdict})
    label = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    rejected = written(template_verdicts(ruled.select("host", "path", label.alias("label")), settings).where("rejected").select("host", "shape", "template"))
    joined = ruled.withColumn("shape", shapes(F.col("path"))).join(rejected, ["host", "shape"], "left")
    final = F.coalesce("ruled", F.when(F.col("template").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", final.alias("verdict"), "template")
