"""URL filter: explicit rules first, else the purity of learnt path templates.

Every host has a tree of path segments. Segments are generalised (digits and long hex runs
become marks, and below a node with too many children the rare ones become one wildcard),
branches that are statistically similar are merged, and a template is rejected if its share of blocked
pages is high after smoothing: every node is smoothed by its parent, the first node of a host by the overall share, so a
branch without labels has what its parent has. All steps are DataFrame operations on distinct
shapes of paths, which are counted before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

DEPTH = 6                # segments of a template; what lies deeper is one wildcard tail
FAN_OUT = 32             # children a node keeps apart; beyond it, children below 1 / FAN_OUT of its pages merge
SIMILAR = 1.96           # |z| of a branch against all labelled pages below its parent, to be merged with them
PRIOR_PAGES = 4.0        # weight of the parent's share of blocked pages
MOST_PRIOR = 0.5         # of the overall share: hosts without labels are not rejected for the others' sake
REJECT = 0.7             # smoothed share of blocked pages from which a template is rejected
TAIL, RARE, PLAIN = "**", "*", "~"


class Rule(NamedTuple):
    verdict: str         # allow or block
    rule: str            # host/ or host/path


class Parsed(NamedTuple):
    host: Column
    path: Column


def parsed(url: Column) -> Parsed:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return Parsed(host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule whose host is the url's or a parent domain and whose path begins the url's, else null.

    Of equally long rules a blocking one wins, then the first in order of text.
    """
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.rule), r.verdict == "block", [-ord(c) for c in r.rule])):
        domain, slash, rest = rule.rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule.rule)).otherwise(out)
    return out


def segments(path: Column) -> Column:
    """Generalised segments of a path: digit runs are {n}, long hex runs {x}; at most DEPTH, then a tail."""
    shaped = F.regexp_replace(path, r"[0-9a-fA-F]{16,}|[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", "{x}")
    shaped = F.regexp_replace(shaped, r"[0-9]+", "{n}")
    parts = F.filter(F.split(shaped, "/"), lambda s: s != "")
    return F.when(F.size(parts) > DEPTH, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit(TAIL)))).otherwise(parts)


def _level(shapes: DataFrame, k: int) -> DataFrame:
    """Append segment k (from 0) to `node` of every shape, after generalising and merging branches; `impure` is the node's smoothed share."""
    segment = F.get("parts", F.lit(k))
    shapes = shapes.withColumn("segment", segment)
    # `impure` belongs to the node, so any row of it has the same
    branches = shapes.where("segment is not null").groupBy("host", "node", "segment").agg(
        F.first("impure").alias("impure"), F.sum("pages").alias("pages"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    branches = stored(branches, "branches")
    parents = branches.groupBy("host", "node").agg(
        F.count("*").alias("children"), F.sum("pages").alias("all_pages"), F.first("impure").alias("impure"),
        F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    judged = branches.drop("impure").join(parents, ["host", "node"])
    rare = (F.col("children") > FAN_OUT) & (F.col("pages") * FAN_OUT < F.col("all_pages"))
    others, p = F.col("all_labelled") - F.col("labelled"), F.col("all_blocked") / F.col("all_labelled")
    spread = F.sqrt(p * (1 - p) * (1 / F.col("labelled") + 1 / others))
    share = F.col("blocked") / F.col("labelled")
    other = (F.col("all_blocked") - F.col("blocked")) / others
    similar = (others > 0) & ((spread == 0) | (F.abs(share - other) < SIMILAR * spread))
    name = F.when(rare, F.lit(RARE)).when(F.col("labelled") == 0, F.lit(PLAIN)).when(similar, F.lit(RARE)).otherwise(F.col("segment"))
    named = judged.withColumn("name", name)
    inner = named.groupBy("host", "node", "name").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.first("impure")).alias("inner"))
    names = named.select("host", "node", "segment", "name").join(inner, ["host", "node", "name"])
    joined = shapes.join(names, ["host", "node", "segment"], "left")
    node = F.when(F.col("segment").isNull(), F.col("node")).otherwise(F.concat("node", F.lit("/"), F.col("name")))
    return joined.select("host", "parts", node.alias("node"), F.coalesce("inner", "impure").alias("impure"), "pages", "labelled", "blocked")


def _smoothed(blocked: Column, labelled: Column, around: Column) -> Column:
    return (blocked + PRIOR_PAGES * around) / (labelled + PRIOR_PAGES)


def templates(pages: DataFrame) -> DataFrame:
    """(host, parts, template, verdict) of `pages(host, parts, label)`.

    label: 1 blocked, 0 allowed, null unlabelled. A branch is merged with its labelled
    siblings if its share of blocked pages does not differ from theirs in a two-proportion
    test; branches without labels merge with each other only and have their parent's share. Without any
    label nothing is rejected.
    """
    shapes = pages.groupBy("host", "parts").agg(
        F.count("*").alias("pages"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("blocked"))
    shapes = stored(shapes, "shapes")
    about = shapes.agg(F.max(F.size("parts")).alias("depth"), F.sum("labelled").alias("n"), F.sum("blocked").alias("b")).first()
    prior = min(MOST_PRIOR, (about["b"] or 0) / about["n"]) if about["n"] else 0.0
    hosts = shapes.groupBy("host").agg(_smoothed(F.sum("blocked"), F.sum("labelled"), F.lit(prior)).alias("impure"))
    shapes = shapes.join(hosts, "host").select("host", "parts", F.lit("").alias("node"), "impure", "pages", "labelled", "blocked")
    for k in range(about["depth"] or 0):
        shapes = stored(_level(shapes, k), "templates")
    verdict = F.when(F.col("impure") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    return shapes.select("host", "parts", F.concat("host", "node").alias("template"), verdict.alias("learnt"))


def judge(pages: DataFrame, rules: Sequence[Rule], id: str = "page_id", url: str = "url", label: str | None = None) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, template.

    A page with a rule has the rule's verdict; the others that of their template. Pages that
    a rule fits are the labelled pages, and so are those whose column `label` (1 blocked, 0
    allowed) is not null. Null and malformed urls have empty host and path, match no rule and
    are allowed unless labels say otherwise. Repeated rows stay; an empty table gives none.
    """
    p = parsed(F.col(f"`{url}`"))
    rows = pages.select(F.col(f"`{id}`").alias("id"), p.host.alias("host"), p.path.alias("path"),
                        (F.col(f"`{label}`") if label else F.lit(None)).cast("int").alias("given"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules)).withColumn("parts", segments(F.col("path")))
    blocked = [r.rule for r in rules if r.verdict == "block"]
    of_rule = F.when(F.col("rule").isin(blocked), F.lit("block")).when(F.col("rule").isNotNull(), F.lit("allow"))
    known = F.coalesce(F.col("given"), (of_rule == "block").cast("int"))
    learnt = templates(rows.select("host", "parts", known.alias("label")))
    # a shape may hold a third of all pages, and its row is one: such joins split the pages' side
    return rows.join(learnt, ["host", "parts"]).select(
        F.col("id").alias(id), "host", "path", "rule", F.coalesce(of_rule, F.col("learnt")).alias("verdict"), "template")
