"""URL filter by path templates learned per host.

Paths of a host form a tree of segments. Segments that vary (numbers, hex strings, or
many rare values below one node) become wildcards, and sibling branches whose children
and labels are distributed alike are merged into one. What remains are templates such as
`/en/{n}.html`; one whose labelled URLs are bad by a smoothed share above a limit is
rejected. A host with few labels borrows from the same template on other hosts. Labels come from the caller: any table of judged URLs, or the verdicts of a
short list of rules.

Everything is built-in expressions, joins and aggregations. Shapes of paths are counted
before anything is shuffled, so a host with a third of all URLs moves one row per shape
and task, and the per-level work is on shapes.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txloom.llm.common import ascii_lower, fresh
from txloom.operators.skew import join_spreading_hot_keys
from txloom.session import shared_folder


@dataclass(frozen=True)
class Settings:
    """Limits of the tree.

    depth: segments that get a node of their own; those below share one `**`.
    max_children: a node with more distinct children generalises the rare ones.
    rare_share: a child is rare with less of its node's URLs than this.
    distance: branches merge up to this total-variation distance from their siblings.
    label_gap: and up to this difference of the share of bad, and of good, URLs.
    prior, strength: share of bad URLs before any label is seen, and its weight.
    least_labelled: templates with fewer labelled URLs are not rejected.
    reject_at: a template is rejected from this smoothed share of bad URLs on.
    """

    depth: int = 6
    max_children: int = 20
    rare_share: float = 0.02
    distance: float = 0.1
    label_gap: float = 0.1
    prior: float = 0.5
    strength: float = 4.0
    least_labelled: int = 5
    reject_at: float = 0.8


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null without one.

    A rule such as `("example.net/en/", "allow")` fits its host and all subdomains where
    the path starts with the rule's. `rules` is a short list written by people; it becomes
    one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, decision in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def shapes(path: Column, depth: int) -> Column:
    """Path segments with numbers and hex strings generalised, `depth` of them and a rest."""
    segments = F.split(path, "/")
    segments = F.when(F.size(segments) > depth + 1, F.concat(F.slice(segments, 1, depth + 1), F.array(F.lit("**")))).otherwise(segments)

    def shape(segment: Column) -> Column:
        text = F.regexp_replace(segment, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|\b(?=[a-f]*[0-9])[0-9a-f]{12,}\b", "{x}")
        return F.regexp_replace(text, "[0-9]+", "{n}")

    return F.transform(segments, shape)


def _children(trees: DataFrame, s: Settings, level: int) -> DataFrame:
    """`trees` with the segment at `level` made a wildcard where it varies.

    trees: host, prefix (templates so far), segments, n, bad, good.
    """
    here = trees.withColumn("segment", F.get("segments", F.lit(level)))
    inner = here.where("segment is not null")
    each = inner.groupBy("host", "prefix", "segment").agg(F.sum("n").alias("here"))
    node = each.groupBy("host", "prefix").agg(F.sum("here").alias("whole"), F.count("*").alias("children"))
    crowded = node.where(F.col("children") > s.max_children)
    rare = (
        each.join(crowded, ["host", "prefix"])
        .where(F.col("here") < F.col("whole") * s.rare_share)
        .select("host", "prefix", "segment", F.lit("*").alias("wild"))
    )
    return (
        here.join(rare, ["host", "prefix", "segment"], "left")
        .withColumn("segment", F.coalesce("wild", "segment"))
        .drop("wild")
    )


def _merged(trees: DataFrame, s: Settings, level: int) -> DataFrame:
    """`trees` with like branches at `level` under one wildcard `+`.

    A branch is compared with all branches of its node pooled: the distribution of the
    next segment, and the shares of bad and of good URLs. Branches that pass are the merged.
    """
    inner = trees.where("segment is not null").withColumn("next", F.coalesce(F.get("segments", F.lit(level + 1)), F.lit("")))
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "good")]
    cells = inner.groupBy("host", "prefix", "segment", "next").agg(*sums)
    pooled = cells.groupBy("host", "prefix", "next").agg(F.sum("n").alias("pool_next"))
    branch = cells.groupBy("host", "prefix", "segment").agg(*sums, F.count("*").alias("cells"))
    node = branch.groupBy("host", "prefix").agg(
        *[F.sum(c).alias(f"all_{c}") for c in ("n", "bad", "good")], F.count("*").alias("branches")
    )
    # Half the sum of |p - q| is the sum of what p has over q; absent cells add nothing.
    over = F.greatest(F.lit(0.0), F.col("n") / F.col("branch_n") - F.col("pool_next") / F.col("all_n"))
    alike = (
        cells.join(branch.select("host", "prefix", "segment", F.col("n").alias("branch_n")), ["host", "prefix", "segment"])
        .join(pooled, ["host", "prefix", "next"])
        .join(node.select("host", "prefix", "all_n"), ["host", "prefix"])
        .groupBy("host", "prefix", "segment")
        .agg(F.sum(over).alias("distance"))
        .where(F.col("distance") <= s.distance)
    )
    gaps = [F.abs(F.col(c) / F.col("n") - F.col(f"all_{c}") / F.col("all_n")) <= s.label_gap for c in ("bad", "good")]
    similar = (
        branch.join(alike, ["host", "prefix", "segment"])
        .join(node.where("branches > 1"), ["host", "prefix"])
        .where(reduce(Column.__and__, gaps))
        .select("host", "prefix", "segment", F.lit("+").alias("like"))
    )
    return trees.join(similar, ["host", "prefix", "segment"], "left").withColumn("segment", F.coalesce("like", "segment")).drop("like")


def _templates(urls: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """(host, shape, template), and per host and template the sums n, bad and labelled."""
    counted = (
        urls.select(
            F.coalesce("host", F.lit("")).alias("host"),
            shapes(F.coalesce("path", F.lit("")), s.depth).alias("segments"),
            "label",
        )
        .groupBy("host", "segments")
        .agg(
            F.count("*").alias("n"),
            F.count_if(F.col("label") == 1).alias("bad"),
            F.count_if(F.col("label") == 0).alias("good"),
        )
    )
    trees = counted.withColumn("shape", F.concat_ws("/", "segments")).withColumn("prefix", F.lit(""))
    shared_folder(urls.sparkSession)
    # The first segment stands before the leading slash.
    for level in range(1, s.depth + 2):
        if trees.where(F.size("segments") > level).isEmpty():
            break
        trees = _merged(_children(trees, s, level), s, level)
        added = F.coalesce(F.concat(F.lit("/"), F.col("segment")), F.lit(""))
        trees = trees.withColumn("prefix", F.concat("prefix", added)).drop("segment").checkpoint()
    sums = trees.groupBy("host", F.col("prefix").alias("template")).agg(
        F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") + F.col("good")).alias("labelled")
    )
    return trees.select("host", "shape", F.col("prefix").alias("template")), sums


def path_templates(urls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Templates of a table (host, path, label), one row per host and path shape.

    `label` is 1 for bad, 0 for good, null for unlabelled URLs. Returns host, shape,
    template, labelled, purity (smoothed share of bad among the template's labelled URLs)
    and rejected. Null hosts or paths count as empty. An empty table gives no rows.
    """
    s = settings
    named, sums = _templates(urls, s)
    purity = (F.col("bad") + s.prior * s.strength) / (F.col("labelled") + s.strength)
    judged = sums.withColumn("purity", purity).withColumn(
        "rejected", (F.col("labelled") >= s.least_labelled) & (F.col("purity") >= s.reject_at)
    )
    return named.join(judged.drop("bad", "n"), ["host", "template"])


def shared_templates(urls: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """`path_templates` whose purity borrows from the same template elsewhere.

    Before a host's own labels are counted, its template has the purity of the other hosts
    of its domain (the last two names), which start from that of all other domains, which
    start from `prior`; each counts `strength` labels. No label counts twice. Unlabelled
    URLs of a template with rare values (`*`) hold it at what it borrows, as they may have
    little in common with the labelled ones. `labelled` counts the labels of all hosts.
    """
    s = settings
    named, sums = _templates(urls, s)
    mixed = F.array_contains(F.split("template", "/"), "*")
    loose = F.when(mixed, F.col("n") - F.col("labelled")).otherwise(0)
    domain = F.substring_index("host", ".", -2)
    # No slash is in a domain and each template but the empty one begins with one.
    own = sums.select(
        "host", "template", "bad", F.col("labelled").alias("own_labelled"), loose.alias("loose"),
        domain.alias("domain"), F.concat(domain, "template").alias("place"),
    ).checkpoint()
    domains = own.groupBy("place", "domain", "template").agg(
        F.sum("bad").alias("domain_bad"), F.sum("own_labelled").alias("domain_labelled")
    )
    everywhere = domains.groupBy("template").agg(
        F.sum("domain_bad").alias("all_bad"), F.sum("domain_labelled").alias("labelled")
    )

    def smoothed(bad: Column, labelled: Column, start: Column, weight: Column) -> Column:
        return (bad + start * weight) / (labelled + weight)

    strength = F.lit(s.strength)
    elsewhere = smoothed(
        F.col("all_bad") - F.col("domain_bad"), F.col("labelled") - F.col("domain_labelled"), F.lit(s.prior), strength
    )
    domains = join_spreading_hot_keys(domains, everywhere, "template", ["domain"])
    domains = domains.select("place", "domain_bad", "domain_labelled", "labelled", elsewhere.alias("elsewhere")).checkpoint()
    judged = join_spreading_hot_keys(own, domains, "place", ["host"])
    beside = smoothed(
        F.col("domain_bad") - F.col("bad"), F.col("domain_labelled") - F.col("own_labelled"), F.col("elsewhere"), strength
    )
    purity = smoothed(F.col("bad"), F.col("own_labelled"), beside, strength + F.col("loose"))
    rejected = (F.col("labelled") >= s.least_labelled) & (F.col("purity") >= s.reject_at)
    judged = judged.withColumn("purity", purity).select("host", "template", "labelled", "purity", rejected.alias("rejected"))
    return named.join(judged, ["host", "template"])


def filter_urls(
    pages: DataFrame, url: str, rules: Sequence[tuple[str, str]], settings: Settings = Settings()
) -> DataFrame:
    """`pages` with host, path, rule, verdict, template and purity of the column `url`.

    The verdict is the rule's where one fits, else `block` for a rejected template and
    `allow` for any other. The rules' own verdicts are the labels that templates are
    judged by, as in `shared_templates`. Null URLs and those without `://` have empty host and path, and are judged
    by the template of these. Repeated rows are kept, each judged alike; columns of `pages`
    with the names of the added ones are replaced.
    """
    added = ["host", "path", "rule", "verdict", "template", "purity"]
    if url.lower() in added:
        pages, url = pages.withColumn(fresh(pages, "_url"), F.col(url)), fresh(pages, "_url")
    base = pages.drop(*added).withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    base = base.withColumns({c: F.coalesce(c, F.lit("")) for c in ("host", "path")})
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    label = F.when(verdict == "block", 1).when(verdict == "allow", 0)
    templates = shared_templates(base.select("host", "path", label.alias("label")), settings)
    shape, rejected = fresh(base, "_shape"), fresh(base, "_rejected")
    # Host and shape as one key; a frequent one is spread by the URL.
    known = templates.select(
        F.concat("host", F.lit("\n"), "shape").alias(shape), "template", "purity", F.col("rejected").alias(rejected)
    ).checkpoint()
    place = F.concat_ws("/", shapes(F.col("path"), settings.depth))
    judged = base.withColumn(shape, F.concat("host", F.lit("\n"), place))
    judged = join_spreading_hot_keys(judged, known, shape, ["path"], "left")
    own = F.when(F.col(rejected), F.lit("block")).otherwise(F.lit("allow"))
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own)).drop(shape, rejected)
