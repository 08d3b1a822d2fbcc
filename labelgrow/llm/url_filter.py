"""URL filter by rules and by a tree of path templates.

Rules decide first: the longest one that fits a URL. For the others, templates do. In each path every
run of digits becomes a variable; these paths form a tree per host, and one of all hosts together. The
trees are generalised level by level from the root, each level below parents that are generalised
already. Where the children of a node are many and mostly rare, the rare ones become one wildcard.
Children whose share of blocked URLs is within ``z`` standard errors of their parent's, and those
without labels, merge into that wildcard with all that is below them; only those that differ keep
their branch. Segments from ``depth`` on are one.

A template is rejected if its purity, the share of blocked among its labelled URLs, is above ``reject``.
It is smoothed by the share of its host, that by the share of the template that the path has in the tree
of all hosts, so that hosts without labels borrow from others with paths of the same form, and that by
the share of all labelled URLs. Labels are the rules' own verdicts, or those given.

URLs are aggregated to (host, path with variables) before any shuffle of the tree. What is known of a
node goes back to its rows by joins in which nodes of many rows are split (``split_join``).

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged with the others
of that kind. Repeated rows stay. Without any label, templates have the purity ``prior`` and pass.
Other columns ride along; if the table has one of the new names, the new column gets a leading underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ascii_lower, fresh, split_join, stored

#: Host, path, verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def url_host(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]], value: int | None = None) -> Column:
    """The longest fitting rule as ``host/path``, or with ``value`` 2 its verdict; null if none fits."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda x: len(x[0] + x[1])):
        fits = ((host == rule[0]) | F.endswith(host, F.lit(f".{rule[0]}"))) & F.startswith(path, F.lit(rule[1]))
        out = F.when(fits, F.lit(rule[0] + rule[1] if value is None else rule[value])).otherwise(out)
    return out


def with_variables(path: Column) -> Column:
    """The path with each run of digits as a variable."""
    return F.regexp_replace(path, r"[0-9]+", "{n}")


SUMS = ("n", "labelled", "blocked")


def _sums(*more: Column) -> list[Column]:
    return [*[F.sum(c).alias(c) for c in SUMS], *more]


def generalised(shapes: DataFrame, z: float = 2.0, many: int = 16, rare: float = 4.0, depth: int = 12) -> DataFrame:
    """(tree, shape, n, labelled, blocked, template) of a table (tree, shape, n, labelled, blocked)."""
    parts = F.split("shape", "/", -1)
    parts = F.when(F.size(parts) > depth, F.concat(F.slice(parts, 1, depth - 1), F.array(F.array_join(F.slice(parts, depth, F.size(parts)), "/")))).otherwise(parts)
    now = stored(shapes.withColumn("parts", parts).withColumn("template", F.lit("")), "tree")
    total, done = now.count(), None
    for level in range(now.agg(F.max(F.size("parts"))).first()[0] or 0):
        ended = now.filter(F.size("parts") <= level)
        done = ended if done is None else done.unionByName(ended)
        here = now.filter(F.size("parts") > level).withColumn("child", F.col("parts")[level])
        children = stored(here.groupBy("tree", "template", "child").agg(*_sums(F.count("*").alias("n_rows"))), "children")
        parents = children.groupBy("tree", "template").agg(F.count("*").alias("n_children"), *[F.sum(c).alias(f"all_{c}") for c in SUMS])
        both = split_join(children, parents.withColumn("rows", F.col("n_children")), ["tree", "template"], "rows", total)
        share = F.try_divide("all_blocked", "all_labelled")
        error = F.sqrt(share * (1 - share) / F.greatest("labelled", F.lit(1)) + F.lit(0.25) / F.greatest("labelled", F.lit(1)) / F.lit(4))
        similar = (F.col("labelled") == 0) | (F.abs(F.try_divide("blocked", "labelled") - share) <= z * error)
        variable = (F.col("n_children") > many) & (F.col("all_n") < rare * F.col("n_children")) & (F.col("n") < rare)
        branch = F.when(variable | (similar & (F.col("n_children") > 1)), F.lit("*")).otherwise(F.col("child"))
        branches = stored(both.select("tree", "template", "child", "n_rows", branch.alias("branch")), "branches")
        named = split_join(here, branches, ["tree", "template", "child"], "n_rows", total)
        grown = F.col("branch") if level == 0 else F.concat("template", F.lit("/"), "branch")
        now = stored(named.withColumn("template", grown).select(*now.columns), "tree")
    return (now if done is None else done.unionByName(now)).select("tree", "shape", *SUMS, "template")


def template_purity(urls: DataFrame, weight: float = 10.0, prior: float = 0.5, **tree: float) -> DataFrame:
    """(host, shape, n, template, purity) of every (host, shape) of a table (host, shape, blocked int or null)."""
    counts = [F.count("*").alias("n"), F.count("blocked").alias("labelled"), F.coalesce(F.sum("blocked"), F.lit(0)).cast("long").alias("blocked")]
    shapes = stored(urls.groupBy("host", "shape").agg(*counts), "shapes")
    total = shapes.count()
    every = shapes.withColumn("tree", F.concat(F.lit("@"), "host")).unionByName(shapes.withColumns({"tree": F.lit(""), "host": F.lit("")}))
    trees = stored(generalised(every.groupBy("tree", "shape").agg(*_sums()), **tree), "trees")  # that of all hosts has no name
    own = trees.filter("tree <> ''").withColumn("host", F.substring("tree", 2, F.length("tree"))).drop("tree")
    pooled = trees.filter("tree = ''").select("shape", *SUMS, "template")
    as_level = lambda rows, level, *by: rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.sum("labelled").alias(f"{level}_labelled"), F.sum("blocked").alias(f"{level}_blocked")
    )
    known = own.select("host", "shape", "n", "template")
    known = split_join(known, as_level(own, "template", "host", "template"), ["host", "template"], "rows", total)
    known = split_join(known, as_level(own, "host", "host"), "host", "rows", total)
    others = split_join(pooled.select("shape", "template"), as_level(pooled, "pooled", "template"), "template", "rows", total).drop("template")
    others = others.join(shapes.groupBy("shape").agg(F.count("*").alias("rows")), "shape")
    known = split_join(known, stored(others, "others"), "shape", "rows", total)
    everything = pooled.agg(F.sum("labelled").alias("all_labelled"), F.sum("blocked").alias("all_blocked"))
    smooth = lambda level, below: (F.coalesce(F.col(f"{level}_blocked"), F.lit(0)) + weight * below) / (F.coalesce(F.col(f"{level}_labelled"), F.lit(0)) + weight)
    purity = smooth("template", smooth("host", smooth("pooled", smooth("all", F.lit(prior)))))
    return known.join(F.broadcast(everything)).select("host", "shape", "n", "template", purity.alias("purity"))


def judge_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: list[tuple[str, str, str]] | None = None,
    reject: float = 0.5,
    label_col: str | None = None,
    **tree: float,
) -> DataFrame:
    """The table with host, path, rule, verdict, template and purity.

    ``label_col`` may name a boolean column (true: to block) to learn from instead of the rules' verdicts.
    """
    rules = RULES if rules is None else rules
    new = fresh(pages, "host", "path", "rule", "verdict", "template", "purity")
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    base = pages.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), (F.col(label_col) if label_col else F.lit(None)).cast("int").alias("label"))
    base = base.select("row", "label", host.alias("host"), path.alias("path"))
    rule = {name: longest_rule(F.col("host"), F.col("path"), rules, value) for name, value in (("rule", None), ("ruled", 2))}
    base = base.select("*", *[c.alias(name) for name, c in rule.items()], with_variables(F.col("path")).alias("shape"))
    blocked = F.col("label") if label_col else (F.col("ruled") == "block").cast("int")
    purity = stored(template_purity(base.select("host", "shape", blocked.alias("blocked")), **tree), "templates")
    learnt = F.when(F.col("purity") > reject, F.lit("block")).otherwise(F.lit("allow"))
    judged = split_join(base, purity, ["host", "shape"], "n", purity.agg(F.sum("n")).first()[0] or 0)
    made = ["host", "path", "rule", F.coalesce("ruled", learnt), "template", "purity"]
    return judged.select("row.*", *[(F.col(c) if isinstance(c, str) else c).alias(name) for c, name in zip(made, new, strict=True)])
