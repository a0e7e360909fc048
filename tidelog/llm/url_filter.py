"""URL rules whose decisions spread over redirect equivalence.

A node is an address: host, path and query string; neither scheme nor fragment tell addresses apart. Allow and block rules judge
a node by host and path; the longest rule that fits
wins, an allow before a block of equal length. Redirects (meta refresh) and canonical links in the pages, and any
further edges given, join nodes into classes by distributed connected components. A class with a
block has its unruled aliases blocked, unless a rule explicitly allows one of its nodes: an explicit
allow takes precedence over what spreads, but never over a node's own rule. A class without rules is allowed.

Links are resolved against their page's URL as RFC 3986 says, dot segments included; links of schemes without ``//`` (mail, scripts)
and links to a place in the page itself join nothing, and ``base`` tags are not read.

Defined cases: a null URL, or one without ``://``, has empty host and path, its links are not read and it is in no class; null html has
no links; very long html is searched whole; repeated pages
get equal results; an empty table gives an empty result; other columns of the input are not read,
whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import drop_written, written
from tidelog.llm.components import connected_components

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns for Java and RE2 alike: the tags that name another address, and the address in them.
CANONICAL_TAG = r"(?i)<link\s[^>]*rel\s*=\s*[\x22\x27]?canonical[\x22\x27\s>][^>]*"
CANONICAL_HREF = r"(?i)href\s*=\s*[\x22\x27]?([^\x22\x27\s>]+)"
REFRESH_TAG = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\x22\x27]?refresh[\x22\x27\s>][^>]*"
REFRESH_URL = r"(?i)url\s*=\s*[\x22\x27]?([^\x22\x27\s>;]+)"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL column; both empty without ``://``."""
    own = F.col(url)
    at = F.instr(own, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: str, path: str, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The rule that judges a node and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[0] != "allow", r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in reversed(ordered):
        domain, slash, prefix = text.partition("/")
        fits = ((F.col(host) == domain) | F.endswith(F.col(host), F.lit("." + domain))) & F.startswith(F.col(path), F.lit(slash + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url) of the canonical links and meta refreshes of pages."""
    tags = F.concat(
        F.transform(F.regexp_extract_all(F.col(html), F.lit(f"({CANONICAL_TAG})"), 1), lambda t: F.regexp_extract(t, CANONICAL_HREF, 1)),
        F.transform(F.regexp_extract_all(F.col(html), F.lit(f"({REFRESH_TAG})"), 1), lambda t: F.regexp_extract(t, REFRESH_URL, 1)),
    )
    # Both tags are rare: the cheap test spares most pages the patterns.
    likely = F.lower(F.col(html)).contains("canonical") | F.lower(F.col(html)).contains("refresh")
    found = pages.where(likely & F.col(url).contains("://")).select(F.col(url).alias("from_url"), F.explode(tags).alias("link"))
    found = found.select("from_url", F.replace(F.col("link"), F.lit("&amp;"), F.lit("&")).alias("link"))
    return found.select("from_url", resolved("from_url", "link").alias("to_url")).where(F.col("to_url").isNotNull())


def without_dots(path: Column) -> Column:
    """A path that starts with a slash without its ``.`` and ``..`` segments."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        F.slice(parts, 2, F.size(parts)), F.array(F.lit("")),
        lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))),
    )
    last = F.element_at(parts, -1)
    whole = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.contains(path, F.lit("/.")), F.array_join(whole, "/")).otherwise(path)


def resolved(base: str, link: str) -> Column:
    """The absolute address of a link in the page at ``base``; null where it leads to no other page."""
    own = F.col(link)
    host, path = host_and_path(base)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)?", 0))
    rest = (
        F.when(own.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.expr(f"substring({link}, instr({link}, '://') + 3)"))
        .when(own.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (own == "") | own.startswith("#"), None)
        .when(own.startswith("//"), F.substring(own, 3, 1 << 30))
        .when(own.startswith("/"), F.concat(host, own))
        .when(own.startswith("?"), F.concat(host, path, own))
        .otherwise(F.concat(host, folder, own))
    )
    part = lambda pattern: F.regexp_extract(rest, pattern, 1)
    way = part("^[^/?#]*([^?#]*)")
    # a link that is a query alone has its page's path, as that is
    return F.concat(F.lit("://"), part("^([^/?#]*)"), F.when(own.startswith("?"), way).otherwise(without_dots(way)), part("^[^?#]*([^#]*)"))


def node(url: str) -> Column:
    """Host (A-Z lower-cased), path and query string of a URL column; empty without ``://``."""
    at = F.instr(F.col(url), "://")
    rest = F.coalesce(F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")), F.lit(""))
    return F.concat(F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^#]*)", 1))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES, more_edges: DataFrame | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` of every page; ``more_edges``: (from_url, to_url) of known redirects."""
    if bad := [r for r in rules if r[0] not in ("allow", "block") or not re.match(r"[^/]+/", r[1])]:
        raise ValueError(f"not a rule: {bad[0]}")
    links = page_links(pages)
    if more_edges is not None:
        links = links.unionByName(more_edges.select("from_url", "to_url").where(F.col("from_url").contains("://") & F.col("to_url").contains("://")))
    edges = links.select(node("from_url").alias("a"), node("to_url").alias("b"))
    roots = written(connected_components(edges, "a", "b"), "aliases")

    named = roots.withColumns({"host": F.regexp_extract("node", "^[^/?]*", 0), "path": F.regexp_extract("node", "^[^/?]*([^?]*)", 1)})
    named = named.withColumn("own", rule_for("host", "path", rules)[1])
    classes = written(named.groupBy("root").agg(F.max(F.col("own") == "allow").alias("allowed"), F.max(F.col("own") == "block").alias("blocked")), "classes")
    blocked = F.coalesce("blocked", F.lit(False)) & ~F.coalesce("allowed", F.lit(False))
    spread = written(roots.join(classes, "root").where(blocked).select(F.col("node").alias("blocked_node")), "blocked")
    drop_written(roots)
    drop_written(classes)

    host, path = host_and_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), node("url").alias("node"))
    rule, verdict = rule_for("host", "path", rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("own"), "node")
    judged = rows.join(spread, F.col("node") == F.col("blocked_node"), "left")
    method = F.when(F.col("blocked_node").isNotNull(), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("own", method).alias("verdict"))
