"""URL verdicts from fixed rules and, where none fits, from a tree of path templates.

Each host has a tree of path segments. Segments that vary (numbers, long codes, and
children without labels) become wildcards, and sibling branches with statistically alike
labels are merged. A branch whose labels differ stays. How many siblings a branch has
decides nothing. A template is rejected by its labelled purity, smoothed toward the
purity of the wider templates above it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlume.operators.skew import salted_join
from airlume.session import materialize

# A segment is variable where this share of its characters are digits ...
DIGIT_SHARE = 0.3
# ... or it is this long.
LONG_SEGMENT = 24
# Name of merged siblings; a path has no "?", so it is free where a variable child
# stays apart under its own "*".
MERGED, OTHERS = "*", "?"
# What follows these names where no merged sibling has labels: such urls are a template
# of their own, which tells nothing of labelled ones and is shown without the mark.
UNKNOWN = "?"
# Labelled urls the wider template counts for.
PRIOR_WEIGHT = 4.0
# Share of blocked urls everywhere, before any label is seen.
PRIOR = 0.5
# Two branches are alike if their block rates differ by less than this many
# standard errors.
ALIKE = 2.0
# Templates whose smoothed share of blocked urls exceeds this are rejected.
REJECT = 0.5


@dataclass(frozen=True)
class Rule:
    """Verdict for a host, its subdomains, and paths that begin with ``path``."""

    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    lowered = F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    filled = F.coalesce(url, F.lit(""))
    at = F.locate("://", filled)
    return F.when(at > 0, F.substring(filled, at + 3, F.length(filled))).otherwise("")


def judge(pages: DataFrame, rules: list[Rule]) -> DataFrame:
    """page_id, host, path, rule, verdict and template of every row of ``pages`` (page_id, url).

    The longest fitting rule decides (at equal length the one named first, then
    the first listed). Urls that a rule decides are the labels of the template
    tree, which decides the others. A null url, or one without ``://``, has empty
    host and path. Rows that share a page_id, or have none, are judged each on
    their own. Other columns are ignored; an empty table gives none.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parsed.withColumn("_rule", _longest(rules))
    ruled = ruled.select(
        "page_id", "host", "path", F.col("_rule.text").alias("rule"), F.col("_rule.allow").alias("_allow"),
        segments(F.col("path")).alias("_parts"),
    )
    # A url counts once for its template however often its kind occurs in a task.
    counts = materialize(
        ruled.groupBy("host", "_parts").agg(
            F.count(F.lit(1)).alias("_n"),
            F.count("_allow").alias("_labelled"),
            F.count(F.when(~F.col("_allow"), True)).alias("_blocked"),
        ),
        "url-shapes",
    )
    named = materialize(_templates(counts), "url-templates")
    judged = salted_join(ruled.withColumn("_key", F.xxhash64("host", "_parts")), named, ["_key", "host", "_parts"], "left")
    return judged.select(
        "page_id", "host", "path", "rule",
        F.when(F.col("_allow"), "allow").when(~F.col("_allow"), "block")
        .when(F.col("_share") > REJECT, "block").otherwise("allow").alias("verdict"),
        F.col("_template").alias("template"),
        F.col("_share").alias("share"),
    )


def _longest(rules: list[Rule]) -> Column:
    """The rule that decides (text, allow), or null."""
    chosen = F.lit(None).cast("struct<text:string,allow:boolean>")
    for rule in sorted(enumerate(rules), key=lambda r: (len(r[1].text), -r[0])):
        r = rule[1]
        host = F.col("host")
        fits = ((host == r.host) | host.endswith("." + r.host)) & F.col("path").startswith(r.path)
        chosen = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.allow).alias("allow"))).otherwise(chosen)
    return chosen


def segments(path: Column) -> Column:
    """All segments of a path, variable ones as ``*``."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _shape)


def _shape(segment: Column) -> Column:
    digits = F.length(F.regexp_replace(segment, r"[^0-9]", ""))
    # A file ending says what kind of page it is and stays.
    ending = F.regexp_extract(segment, r"\.[A-Za-z]{1,5}$", 0)
    body = F.length(segment) - F.length(ending)
    variable = (digits >= body * DIGIT_SHARE) | (body > LONG_SEGMENT)
    return F.when(variable & (body > 0), F.concat(F.lit("*"), ending)).otherwise(segment)


def _templates(counts: DataFrame) -> DataFrame:
    """(host, _parts) with template and smoothed share of blocked urls."""
    shapes = materialize(_named(counts), "url-names")
    # Purity, from the widest template down: everywhere, the first segment on all
    # hosts, the host, the whole template. Each is the prior of the next. Members of a
    # template differ in their first segment where it was merged; those with labels
    # speak for it, so that others do not change what it is known for.
    total = shapes.agg(F.sum("_labelled").alias("n"), F.sum("_blocked").alias("b")).first()
    share = _smoothed(F.lit(total["b"] or 0), F.lit(total["n"] or 0), F.lit(PRIOR))
    shapes = shapes.withColumn("_first", F.coalesce(F.get("_parts", F.lit(0)), F.lit("")))
    first = _sums(shapes, ["_first"], "_n0", "_b0").withColumn("_own", _smoothed(F.col("_b0"), F.col("_n0"), share))
    shapes = salted_join(shapes, materialize(first.select("_first", "_own"), "url-first"), ["_first"])
    shapes = materialize(shapes, "url-priors")
    spoken = F.try_divide(F.sum(F.col("_labelled") * F.col("_own")), F.sum("_labelled"))
    whole = shapes.groupBy("host", "_name").agg(
        F.sum("_labelled").alias("_n2"), F.sum("_blocked").alias("_b2"), spoken.alias("_spoken")
    )
    shapes = salted_join(shapes, materialize(_sums(shapes, ["host"], "_n1", "_b1"), "url-hosts"), ["host"])
    shapes = salted_join(shapes, materialize(whole, "url-wholes"), ["host", "_name"])
    share = _smoothed(F.col("_b1"), F.col("_n1"), F.coalesce("_spoken", "_own"))
    share = _smoothed(F.col("_b2"), F.col("_n2"), share)
    shown = F.transform("_name", lambda s: F.when(s.isin(MERGED + UNKNOWN, OTHERS + UNKNOWN), F.substring(s, 1, 1)).otherwise(s))
    template = F.concat(F.col("host"), F.lit("/"), F.array_join(shown, "/"))
    return shapes.select(
        F.xxhash64("host", "_parts").alias("_key"), "host", "_parts", template.alias("_template"), share.alias("_share")
    )


def _sums(shapes: DataFrame, keys: list[str], n: str, b: str) -> DataFrame:
    return shapes.groupBy(*keys).agg(F.sum("_labelled").alias(n), F.sum("_blocked").alias(b))


def _named(counts: DataFrame) -> DataFrame:
    """``counts`` with the generalised segments of each shape as _name.

    One pass per level, as long as shapes share a node there. A shape that ends
    above the level, or is the only one below its node, has its name.
    """
    going, done = counts.withColumn("_name", F.col("_parts")), []
    level = 0
    while True:
        done.append(going.where(F.size("_parts") <= level))
        going = going.where(F.size("_parts") > level)
        if going.isEmpty():
            return reduce(DataFrame.unionByName, done)
        passed = materialize(_generalised(going, level), "url-level")
        done.append(passed.where("_alone").drop("_alone"))
        going = passed.where("not _alone").drop("_alone")
        level += 1


def _smoothed(blocked: Column, labelled: Column, prior: Column) -> Column:
    return (blocked + PRIOR_WEIGHT * prior) / (labelled + PRIOR_WEIGHT)


def _generalised(shapes: DataFrame, level: int) -> DataFrame:
    """Siblings at ``level`` whose labels do not tell them apart become a wildcard.

    Children do whose block rate lies within ALIKE standard errors of the rate of the
    node. Children without labels become a wildcard apart from them, so they change
    nothing for the others however many they are. An only child keeps its name. ``_alone`` says that no other
    shape is below the node.
    """
    node = ["host", "_above"]
    keyed = shapes.withColumns({"_above": F.slice("_name", 1, level), "_child": F.get("_name", F.lit(level))})
    branch = keyed.where("_child is not null").groupBy(*node, "_child").agg(
        F.sum("_labelled").alias("_n_branch"), F.sum("_blocked").alias("_b_branch"), F.count(F.lit(1)).alias("_shapes_branch")
    )
    variable = F.col("_child") == MERGED
    whole = branch.groupBy(*node).agg(
        F.count(F.lit(1)).alias("_children"), F.sum("_shapes_branch").alias("_shapes"),
        F.sum("_n_branch").alias("_n_node"), F.sum("_b_branch").alias("_b_node"),
        F.coalesce(F.sum(F.when(variable, F.col("_n_branch"))), F.lit(0)).alias("_n_variable"),
        F.coalesce(F.sum(F.when(variable, F.col("_b_branch"))), F.lit(0)).alias("_b_variable"),
    )
    mean = (F.col("_b_node") + 1) / (F.col("_n_node") + 2)

    def alike(b: str, n: str) -> Column:
        return F.abs(F.try_divide(b, n) - mean) <= ALIKE * F.sqrt(F.try_divide(mean * (1 - mean), F.col(n)))

    n = F.col("_n_branch")
    folds = (F.col("_children") > 1) & F.when(n > 0, alike("_b_branch", "_n_branch")).otherwise(F.lit(True))
    apart = (F.col("_n_variable") > 0) & ~F.coalesce(alike("_b_variable", "_n_variable"), F.lit(True))
    merged = F.when(folds, F.concat(F.when(apart, OTHERS).otherwise(MERGED), F.when(n > 0, "").otherwise(UNKNOWN)))
    told = branch.join(whole, node).where(folds | (F.col("_shapes") == 1))
    told = materialize(told.select(*node, "_child", merged.alias("_fold"), (F.col("_shapes") == 1).alias("_alone")), "url-folds")
    out = salted_join(keyed, told, [*node, "_child"], "left")
    name = F.transform("_name", lambda s, i: F.when(i == level, F.col("_fold")).otherwise(s))
    return out.withColumns({
        "_name": F.when(F.col("_fold").isNotNull(), name).otherwise(F.col("_name")),
        "_alone": F.coalesce("_alone", F.lit(False)),
    }).drop("_fold", "_above", "_child")
