"""URL verdicts: host and path rules, then a path-template tree per host with labelled purity.

Paths become templates in two steps. Segments that look like ids, and the rare children of a branch with many
children, turn into ``*``. Then, from the deepest level up, sibling branches whose sub-templates are spread alike
are merged into ``{*}``: the distance between a branch's spread and that of all its siblings together must lie within
what chance allows for a branch of its size, and its labels, if it has any, must not contradict theirs. So the labels of one
branch speak for its twins. A template is rejected when its block rate, smoothed towards its host and the host
towards the whole table, reaches the threshold, and it has ``min_labels`` labels at least. Labels are the rules' own
verdicts, or a column of them. A rule's verdict stands in any case.

Segments beyond ``max_depth`` stand together as one segment, so no path is cut. A null url, or one without ``://``, has
empty host and path and no rule. Repeated rows are judged alike, an empty table gives no rows, other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.session import materialize

#: Fixed values: (verdict, host, path) of the standing rules.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Segments that are ids by their look: digits, long hex, or words with digits in them.
ID_LIKE = r"^([0-9]+|[0-9a-f]{8,}|[^0-9]*[0-9].*)$"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path that follows it."""
    text = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(text, pattern, 1), UPPER, LOWER), F.regexp_extract(text, pattern, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))

    def pick(value):
        def fits(r):
            return ((host == r[1]) | F.endswith(host, F.lit("." + r[1]))) & F.startswith(path, F.lit(r[2]))

        out = F.lit(None).cast("string")
        for r in reversed(ordered):
            out = F.when(fits(r), F.lit(value(r))).otherwise(out)
        return out

    return pick(lambda r: r[1] + r[2]), pick(lambda r: r[0])


def _shapes(base: DataFrame, max_depth: int) -> DataFrame:
    """Add ``_segs``: the path's segments with ids as ``*``; what lies deeper than ``max_depth`` is the last one."""
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    starred = F.transform(
        parts, lambda s: F.when(s.rlike(ID_LIKE), F.regexp_replace(s, r"^[^.]*[0-9][^.]*", "*")).otherwise(s)
    )
    deep = F.concat(F.slice(starred, 1, max_depth), F.array(F.array_join(F.slice(starred, max_depth + 1, F.size(starred)), "/")))
    return base.withColumn("_segs", F.when(F.size(starred) > max_depth + 1, deep).otherwise(starred))


def _generalised(shapes: DataFrame, max_children: int, min_share: float) -> DataFrame:
    """Turn the rare children of crowded branches into ``*``, at all depths."""
    nodes = shapes.select("host", "shape", "n", "_segs", F.posexplode("_segs").alias("_depth", "_child")).withColumn(
        "_up", F.array_join(F.slice("_segs", 1, F.col("_depth")), "/")
    )
    at = ["host", "_depth", "_up"]
    children = nodes.groupBy(*at, "_child").agg(F.sum("n").alias("_n"))
    totals = children.groupBy(*at).agg(F.count("*").alias("_kids"), F.sum("_n").alias("_all"))
    rare = (
        children.join(totals, at)
        .where((F.col("_kids") > max_children) & (F.col("_n") < min_share * F.col("_all")))
        .select(*at, "_child", F.lit("*").alias("_star"))
    )
    named = nodes.join(rare, [*at, "_child"], "left").groupBy("host", "shape").agg(
        F.array_sort(F.collect_list(F.struct("_depth", F.coalesce("_star", "_child").alias("s")))).alias("_new")
    )
    # A path without segments has no node.
    return shapes.drop("_segs").join(named, ["host", "shape"], "left").select(
        *[c for c in shapes.columns if c != "_segs"],
        F.coalesce(F.transform("_new", lambda x: x["s"]), F.array().cast("array<string>")).alias("_segs"),
    )


def _merged(shapes: DataFrame, depth: int, doubt: float, same_z: float) -> DataFrame:
    """Merge the sibling branches at one depth whose sub-templates are spread alike."""
    inner = F.size("_segs") > depth + 1
    shapes = shapes.withColumns(
        {
            "_up": F.array_join(F.slice("_segs", 1, depth), "/"),
            "_child": F.when(inner, F.get("_segs", F.lit(depth))),
            "_rest": F.array_join(F.slice("_segs", depth + 2, F.size("_segs")), "/"),
        }
    )
    up = ["host", "_up"]
    nodes = shapes.where("_child is not null")
    cells = nodes.groupBy(*up, "_child", "_rest").agg(F.sum("n").alias("n"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
    branches = cells.groupBy(*up, "_child").agg(F.sum("n").alias("nc"), F.sum("l").alias("lc"), F.sum("b").alias("bc"))
    pool = branches.groupBy(*up).agg(
        F.count("*").alias("kids"), F.sum("nc").alias("na"), F.sum("lc").alias("la"), F.sum("bc").alias("ba")
    )
    spread = cells.groupBy(*up, "_rest").agg(F.sum("n").alias("nr"))
    kinds = spread.groupBy(*up).agg(F.count("*").alias("rests"))
    sizes = branches.join(pool, up).join(kinds, up)
    # What two spreads have in common is summed over the branch's own cells only.
    common = (
        cells.select(*up, "_child", "_rest", "n")
        .join(spread, [*up, "_rest"])
        .join(sizes.select(*up, "_child", "nc", "na"), [*up, "_child"])
        .groupBy(*up, "_child")
        .agg(F.sum(F.least(F.col("n") / F.col("nc"), F.col("nr") / F.col("na"))).alias("common"))
    )
    chance = F.sqrt(F.col("rests") / (4 * F.col("nc"))) + F.sqrt(F.lit(math.log(1 / doubt) / 2) / F.col("nc"))
    rate = F.col("ba") / F.col("la").cast("double")
    apart = F.col("bc") - F.col("lc") * rate
    agree = (F.col("lc") == 0) | (apart * apart <= same_z**2 * F.col("lc") * rate * (1 - rate))
    alike = (F.col("kids") > 1) & (1 - F.col("common") <= chance) & agree
    twins = sizes.join(common, [*up, "_child"]).where(alike).select(*up, "_child", F.lit("{*}").alias("_twin"))
    named = shapes.join(twins, [*up, "_child"], "left")
    segs = F.when(
        F.col("_twin").isNotNull(), F.transform("_segs", lambda s, i: F.when(i == depth, F.col("_twin")).otherwise(s))
    ).otherwise(F.col("_segs"))
    return named.withColumn("_segs", segs).drop("_up", "_child", "_rest", "_twin")


def verdicts(
    urls: DataFrame,
    rules=RULES,
    label: str | None = None,
    max_depth: int = 5,
    max_children: int = 20,
    min_share: float = 0.05,
    doubt: float = 0.05,
    same_z: float = 1.96,
    weight: float = 4.0,
    reject_at: float = 0.5,
    min_labels: int = 3,
) -> DataFrame:
    """``(page_id, host, path, rule, template, purity, verdict)``; one row per row of ``urls``.

    ``label`` names an optional column (1 block, 0 allow); without it the rules' verdicts label
    the urls they cover. ``doubt`` is the chance at which branches that are alike are held apart.
    """
    host, path = split_url(F.col("url"))
    picked = [F.col("page_id"), host.alias("host"), path.alias("path")]
    if label:
        picked.append(F.col(label).cast("double").alias("_label"))
    base = urls.select(*picked)
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "_said": said})
    if not label:
        base = base.withColumn("_label", F.when(F.col("_said") == "block", 1.0).when(F.col("_said") == "allow", 0.0))
    base = _shapes(base, max_depth)
    base = base.withColumn("shape", F.array_join("_segs", "/"))

    shapes = base.groupBy("host", "shape").agg(
        F.count("*").alias("n"),
        F.count("_label").alias("labelled"),
        F.coalesce(F.sum("_label"), F.lit(0.0)).alias("bad"),
        F.min("_segs").alias("_segs"),
    )
    shapes = materialize(_generalised(materialize(shapes, "url-shapes"), max_children, min_share), "url-general")
    for depth in range(max_depth - 1, -1, -1):
        shapes = materialize(_merged(shapes, depth, doubt, same_z), "url-merged")
    shapes = shapes.withColumn("template", F.concat(F.lit("/"), F.array_join("_segs", "/")))

    counted = shapes.groupBy("host", "template").agg(F.sum("labelled").alias("_l"), F.sum("bad").alias("_b"))
    hosts = counted.groupBy("host").agg(F.sum("_l").alias("_hl"), F.sum("_b").alias("_hb"))
    whole = shapes.agg(F.coalesce(F.sum("labelled"), F.lit(0)).alias("l"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("b")).first()
    at_host = (F.col("_hb") + weight * (whole["b"] + 1) / (whole["l"] + 2)) / (F.col("_hl") + weight)
    purity = counted.join(hosts, "host").select(
        "host", "template", F.col("_l").alias("labelled"), F.round((F.col("_b") + weight * at_host) / (F.col("_l") + weight), 6).alias("purity")
    )
    judged = shapes.select("host", "shape", "template").join(purity, ["host", "template"])
    method = F.when((F.col("purity") >= reject_at) & (F.col("labelled") >= min_labels), "block").otherwise("allow")
    return base.join(judged, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", "template", "purity", F.coalesce("_said", method).alias("verdict")
    )
