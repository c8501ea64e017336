"""URL verdicts from rules and from a tree of path templates for each host.

Digits and long hexadecimal parts of a path are generalised at once; segments
that hardly repeat under their parent become wildcards, and branches whose
continuations do not differ from their siblings' are merged.  A template whose
labelled urls are mostly blocked, after smoothing towards its host and the
whole table, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentiloom.llm.common import packed, store

#: Levels of the tree; what lies deeper is one last segment ``**``.
DEPTH = 8
#: A parent's children vary if there are so many and each occurs fewer times on average.
VARIED, REPEATS = 8, 4
#: The G test of two verdicts: one degree of freedom and three deviations.
LABEL_G = 1 + 3 * 2**0.5
#: Labelled urls that a template's prior counts for, and the purity that rejects it.
PRIOR, REJECT = 5.0, 0.7

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct ``(length, verdict, rule)``, or null.

    A rule is a host and the start of a path; it fits its host and all
    subdomains.  Of a rule listed with both verdicts ``block`` counts.  The
    list is part of the query: one lookup for each ending of the host.
    """
    if not rules:
        return F.lit(None).cast("struct<length:int,verdict:string,rule:string>")
    by_host: dict[str, list[tuple[str, str, str]]] = {}
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        by_host.setdefault(name, []).append((slash + start, verdict, rule))
    entries = []
    for name, own in sorted(by_host.items()):
        listed = [
            F.struct(F.lit(start).alias("start"), F.lit(len(rule)).alias("length"), F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
            for start, verdict, rule in own
        ]
        entries += [F.lit(name), F.array(*listed)]
    known = F.create_map(*entries)
    labels = F.split(host, r"\.")
    endings = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    found = F.flatten(F.filter(F.transform(endings, lambda e: F.element_at(known, e)), lambda x: x.isNotNull()))
    fits = F.filter(found, lambda r: F.startswith(path, r["start"]))
    return F.array_max(
        F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))
    )


def form(path: Column, depth: int = DEPTH) -> Column:
    """The path's segments with digits and hexadecimal parts generalised."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    general = F.transform(
        F.slice(segments, 1, depth),
        lambda s: F.when(F.rlike(s, F.lit("^[0-9a-fA-F-]{8,}$")) & F.rlike(s, F.lit("[0-9]")) & F.rlike(s, F.lit("[a-fA-F-]")), F.lit("<hex>")).otherwise(
            F.regexp_replace(s, "[0-9]+", "<n>")
        ),
    )
    deep = F.when(F.size(segments) > depth, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(general, deep), "/")


def templates(forms: DataFrame, depth: int = DEPTH, varied: int = VARIED, repeats: int = REPEATS) -> DataFrame:
    """``(host, form, template)`` from ``(host, form, n, blocked, labelled)``.

    A segment turns into ``*`` if its parent's children vary, or if neither
    what follows it nor the verdicts of its labelled urls differ from those of
    its siblings (G tests, three standard deviations above their means).
    """
    segments = F.split("form", "/")
    steps = forms.select(
        *forms.columns,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size(segments)),
                lambda i: F.struct(
                    F.array_join(F.slice(segments, 1, i - 1), "/").alias("parent"),
                    F.get(segments, i - 1).alias("segment"),
                    F.coalesce(F.get(segments, i), F.lit("")).alias("next"),
                ),
            )
        ).alias("level", "step"),
    ).select(*forms.columns, "level", "step.*")
    node = ["host", "level", "parent"]
    follow = steps.groupBy(*node, "segment", "next").agg(F.sum("n").alias("n"))
    branch = steps.groupBy(*node, "segment").agg(
        F.sum("n").alias("total"), F.sum("blocked").alias("b"), F.sum("labelled").alias("l")
    )
    parent = branch.groupBy(*node).agg(
        F.count("*").alias("children"), F.sum("total").alias("all"), F.sum("b").alias("all_b"), F.sum("l").alias("all_l")
    )
    pooled = follow.groupBy(*node, "next").agg(F.sum("n").alias("pool"))
    kinds = pooled.groupBy(*node).agg(F.count("*").alias("kinds"))
    differs = (
        follow.join(branch, [*node, "segment"])
        .join(pooled, [*node, "next"])
        .join(parent, node)
        .groupBy(*node, "segment", "b", "l")
        .agg((2 * F.sum(F.col("n") * F.log(F.col("n") * F.col("all") / (F.col("total") * F.col("pool"))))).alias("g"))
    )
    free = F.col("kinds") - 1
    part = lambda x, every: F.when(x > 0, x * F.log(x * F.col("all_l") / (F.col("l") * every))).otherwise(0.0)
    by_label = 2 * (part(F.col("b"), F.col("all_b")) + part(F.col("l") - F.col("b"), F.col("all_l") - F.col("all_b")))
    merged = F.when(
        ((F.col("children") >= varied) & (F.col("all") < repeats * F.col("children")))
        | ((F.col("children") > 1) & (F.col("g") <= free + 3 * F.sqrt(2 * free) + 1e-9) & (by_label <= LABEL_G)),
        F.lit("*"),
    ).otherwise(F.col("segment"))
    names = (
        differs.join(parent, node).join(kinds, node)
        .select(*node, "segment", merged.alias("name"))
    )
    spelled = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda x: x["name"]), "/")
    return steps.join(names, [*node, "segment"]).groupBy("host", "form").agg(spelled.alias("template"))


def judged(
    df: DataFrame,
    rules: list[tuple[str, str]],
    url: str = "url",
    prior: float = PRIOR,
    reject: float = REJECT,
    depth: int = DEPTH,
) -> DataFrame:
    """``row``, ``host``, ``path``, ``rule``, ``verdict``, ``template`` and ``purity``.

    The rules come first, and what they say of urls labels the templates; a
    url without a rule is blocked if its template is rejected.  ``purity`` is
    the smoothed part of blocked urls among a template's labelled ones.  Null
    urls and those without ``://`` have an empty host and path, and a template
    of their own; repeated rows are judged alike; without labels all is
    allowed.  Urls meet as counts of generalised paths, so a host with most of
    the urls is a few sums.
    """
    address = F.col("row").getField(url)
    host, path = parts(address)
    rows = (
        packed(df)
        .select("row", host.alias("host"), path.alias("path"))
        .withColumn("ruled", ruled(F.col("host"), F.col("path"), rules))
        .withColumn("form", form(F.col("path"), depth))
    )
    blocked = F.sum((F.col("ruled.verdict") == "block").cast("long"))
    forms = store(
        rows.groupBy("host", "form").agg(
            F.count("*").alias("n"),
            F.coalesce(blocked, F.lit(0)).alias("blocked"),
            F.count("ruled.verdict").alias("labelled"),
        ),
        "forms",
    )
    sums = [F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")]
    placed = store(templates(forms, depth).join(forms, ["host", "form"]), "templates")
    smooth = lambda b, n, p: (b + prior * p) / (n + prior)
    every = smooth(F.sum("blocked"), F.sum("labelled"), F.lit(0.5))
    # one number; a scalar subquery
    overall = placed.agg(F.coalesce(every, F.lit(0.5))).scalar()
    hosts = placed.groupBy("host").agg(*sums).select("host", smooth(F.col("blocked"), F.col("labelled"), overall).alias("host_purity"))
    known = (
        placed.groupBy("host", "template").agg(*sums)
        .join(hosts, "host")
        .select("host", "template", smooth(F.col("blocked"), F.col("labelled"), F.col("host_purity")).alias("purity"))
    )
    verdicts = placed.select("host", "form", "template").join(known, ["host", "template"])
    verdict = F.coalesce(F.col("ruled.verdict"), F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow")))
    return rows.join(verdicts, ["host", "form"]).select(
        "row", "host", "path", F.col("ruled.rule").alias("rule"), verdict.alias("verdict"), "template", "purity"
    )
