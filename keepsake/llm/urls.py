"""URL filters: host and path rules, and their spread over redirects and canonical links.

Everything here is DataFrame and SQL functions.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.components import connected_components
from keepsake.llm.decontaminate import bounded, let
from keepsake.llm.staging import staged

#: (action, host, path). A rule fits its host and every subdomain below it.
Rule = tuple[str, str, str]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null if the url is null or has none."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """The host: up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    found = F.regexp_extract(after_scheme(url), "^([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """The path: from the host's end up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(after_scheme(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _host(rest: Column) -> Column:
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)


def node_of(url: Column) -> Column:
    """The name under which a url is a node of the alias graph: host, path and query; no fragment. Null without a host."""
    whole = lambda rest: F.concat(_host(rest), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))
    return let(after_scheme(url), lambda rest: F.when(F.length(_host(rest)) > 0, whole(rest)))


def rule_map(rules: Sequence[Rule]) -> Column:
    """The rules as a literal map: host to its rules, the longest first."""
    by_host: dict[str, list[Rule]] = defaultdict(list)
    for rule in rules:
        by_host[rule[1]].append(rule)
    parts = []
    for host, own in sorted(by_host.items()):
        own = sorted(own, key=lambda r: (-len(r[2]), r[2], r[0]))
        parts += [F.lit(host), F.array(*[F.struct(F.lit(a).alias("action"), F.lit(h + p).alias("rule"), F.lit(p).alias("path")) for a, h, p in own])]
    return F.create_map(*parts)


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as struct<action, rule, path>, or null.

    The policy is configuration, a literal of the plan: each url looks up the suffixes of its own host, so
    no join or shuffle is needed and a host with a third of all rows costs no more than any other row.
    """
    if not rules:
        return F.lit(None).cast("struct<action:string,rule:string,path:string>")
    known = rule_map(rules)
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    own = F.flatten(F.transform(suffixes, lambda s: F.filter(F.coalesce(F.try_element_at(known, s), F.array().cast("array<struct<action:string,rule:string,path:string>>")), lambda r: path.startswith(r["path"]))))
    return F.reduce(own, F.lit(None).cast("struct<action:string,rule:string,path:string>"), lambda best, r: F.when(best.isNull() | (F.length(r["rule"]) > F.length(best["rule"])), r).otherwise(best))


def fitting_rules(places: DataFrame, rules: DataFrame, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(host, path, action, rule): the longest fitting rule of each distinct place (host, path) that has one.

    ``rules``: action, host, path; a policy too large to be part of a plan. Each place looks up the suffixes
    of its host by an equality join, in which a short rule table is broadcast after a count. Of equal rules an
    allow stands.
    """
    known = staged(rules.where("host is not null and path is not null").select("action", F.col("host").alias("_suffix"), F.col("path").alias("_pre")).distinct(), "rules")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = places.select("host", "path").distinct().withColumn("_suffix", F.explode(suffixes))
    met = asked.join(bounded(known, broadcast_rows), "_suffix").where(F.col("path").startswith(F.col("_pre"))).withColumn("_rule", F.concat("_suffix", "_pre"))
    best = F.max_by(F.struct("action", F.col("_rule").alias("rule")), F.struct(F.length("_rule"), F.col("action") == "allow", "action"))
    return met.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.*")


def plain_target(raw: Column) -> Column:
    """A link's address as it is meant: trimmed, with the character references that addresses are written with."""
    for told, meant in (("&quot;", '"'), ("&#39;", "'"), ("&#x2F;", "/"), ("&#x27;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        raw = F.regexp_replace(raw, f"(?i){told}", meant)
    return F.trim(raw)


def absolute(target: Column, url: Column) -> Column:
    """``target`` as a url, read from the page at ``url``; null for other schemes, bare fragments and empty targets.

    Targets may be whole, begin with ``//``, ``/`` or ``?``, or be relative to the page's folder, where ``.``
    and ``..`` are resolved.
    """
    named = F.struct(host_of(url).alias("host"), path_of(url).alias("path"), F.regexp_extract(target, "^([^?#]*)", 1).alias("own"), F.regexp_extract(target, r"^[^?#]*(\?[^#]*)", 1).alias("query"))

    def placed(x: Column) -> Column:
        base = F.concat(F.lit("x://"), x["host"])
        return (
            F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | (target == "") | target.startswith("#") | (x["host"] == ""), F.lit(None).cast("string"))
            .when(target.startswith("//"), F.concat(F.lit("x:"), target))
            .when(target.startswith("?"), F.concat(base, x["path"], x["query"]))
            .otherwise(F.concat(base, _resolved(x["own"], x["path"]), x["query"]))
        )

    return let(named, placed)


def _resolved(own: Column, path: Column) -> Column:
    """A link's path, seen from the page's, without ``.`` and ``..``; a folder named by its dots alone ends in a slash."""
    folder = F.regexp_extract(F.when(path == "", F.lit("/")).otherwise(path), "^(.*/)", 1)
    whole = F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))
    steps = let(whole, lambda w: F.split(F.substring(w, F.lit(2), F.length(w)), "/", -1))
    walk = lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).when(s == ".", a).otherwise(F.concat(a, F.array(s)))
    both = let(steps, lambda st: F.struct(F.reduce(st, F.array().cast("array<string>"), walk).alias("done"), F.element_at(st, -1).alias("last")))
    return let(both, lambda x: F.concat(F.lit("/"), F.array_join(x["done"], "/"), F.when(x["last"].isin(".", "..") & (F.size(x["done"]) > 0), F.lit("/")).otherwise(F.lit(""))))


def declared_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(src, dst) nodes from every ``<link rel=canonical>`` and ``<meta http-equiv=refresh>``; ``absolute`` reads their targets.

    A ``<base>`` tag is not heeded. Null urls and urls without a host have no edges.
    """
    head = F.col(html)
    value = lambda tag, name: F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*{form}", 1), F.lit("")) for form in ('"([^"]*)"', "'([^']*)'", "([^\"'\\s>]+)")])
    tags = lambda name, needs: F.filter(F.regexp_extract_all(head, F.lit(rf"(?is)<{name}\b[^>]*>"), F.lit(0)), lambda t: t.rlike(rf"(?is)\b{needs}\b"))
    canonical = F.transform(tags("link", r"rel\s*=\s*[\"']?[^\"'>]*\bcanonical"), lambda t: plain_target(value(t, "href")))
    refresh = F.transform(tags("meta", r"http-equiv\s*=\s*[\"']?refresh"), lambda t: F.regexp_extract(plain_target(value(t, "content")), r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    # most pages declare neither: one cheap look for the words spares them the patterns
    some = F.lower(head).contains("canonical") | F.lower(head).contains("refresh")
    return (
        pages.where(some).select(F.col(url).alias("_from"), F.explode(F.concat(canonical, refresh)).alias("_to"))
        .select(node_of(F.col("_from")).alias("src"), node_of(absolute(F.col("_to"), F.col("_from"))).alias("dst"))
        .where("src is not null and dst is not null and src <> dst")
        .distinct()
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule] | DataFrame, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """Judge every page by the longest fitting rule, else by what its aliases were judged.

    Urls that redirect to each other or name a common canonical link are aliases: the connected components
    of those edges. A page with a rule of its own keeps that rule's action, so an explicit allow stands even
    among blocked aliases. A page without one is blocked if any alias was blocked by a rule, else allowed.

    ``rules`` is a short list, which becomes part of the plan, or a table (action, host, path), which is joined
    (``fitting_rules``). ``redirects`` may add edges as columns (src, dst) of urls. Null urls and urls without
    ``://`` have an empty host and path, no rule and no aliases: they are allowed. Repeated rows are judged
    alike and all kept; empty tables give empty results; further columns of ``pages`` are not read.

    Returns page id, host, path, rule, verdict, component (null for pages without aliases).
    """
    u = F.col(url)
    placed = pages.select(F.col(page_id), node_of(u).alias("_node"), host_of(u).alias("host"), path_of(u).alias("path"))
    judged = _by_rule(placed, rules)
    edges = declared_edges(pages, url, html) if html and html in pages.columns else None
    if redirects is not None:
        more = redirects.select(node_of(F.col("src")).alias("src"), node_of(F.col("dst")).alias("dst")).where("src is not null and dst is not null and src <> dst").distinct()
        edges = more if edges is None else edges.unionByName(more).distinct()
    if edges is None:
        return judged.select(page_id, "host", "path", "rule", F.coalesce("_action", F.lit("allow")).alias("verdict"), F.lit(None).cast("string").alias("component"))
    member = connected_components(edges).withColumnsRenamed({"node": "_node", "component": "_component"})
    # targets that are no page of the table still carry their own rule to their aliases
    as_url = F.concat(F.lit("x://"), F.col("_node"))
    of_nodes = _by_rule(member.select("_node", "_component", host_of(as_url).alias("host"), path_of(as_url).alias("path")), rules)
    blocked = of_nodes.groupBy("_component").agg((F.max(F.when(F.col("_action") == "block", 1).otherwise(0)) == 1).alias("_blocked"))
    alias = member.join(blocked, "_component")
    return (
        judged.join(alias, "_node", "left")
        .select(page_id, "host", "path", "rule", F.coalesce("_action", F.when(F.col("_blocked"), F.lit("block")), F.lit("allow")).alias("verdict"), F.col("_component").alias("component"))
    )


def _by_rule(placed: DataFrame, rules: Sequence[Rule] | DataFrame) -> DataFrame:
    """``placed`` (with host and path) with the fitting rule's ``rule`` and ``_action``, or nulls."""
    if isinstance(rules, DataFrame):
        return placed.join(fitting_rules(placed, rules).withColumnRenamed("action", "_action"), ["host", "path"], "left")
    return placed.withColumn("_fit", fitting_rule(F.col("host"), F.col("path"), rules)).select(*placed.columns, F.col("_fit.rule").alias("rule"), F.col("_fit.action").alias("_action"))
