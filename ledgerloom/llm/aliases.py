"""URL filters with redirect equivalence.

Pages that redirect to or name one another as canonical are aliases. Spellings of one address (scheme, `www.` or `m.`,
default port, tracking parameters, order of parameters, fragment) are one node of a graph, redirects and canonical links
are its edges, and connected components are the classes of aliases. Rules decide what they fit; a page that no rule fits
takes the decision of its class: allowed if a rule allows any alias, else blocked if a rule blocks one, else allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .components import components

#: Query parameters that say where a visitor came from.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"

_CANONICAL = r"""(?is)<link\s[^>]*?rel\s*=\s*["']?canonical["'\s][^>]*>"""
_REFRESH = r"""(?is)<meta\s[^>]*?http-equiv\s*=\s*["']?refresh["'\s][^>]*>"""
_HREF = r"""(?is)\shref\s*=\s*["']?([^"'\s>]+)"""
_TARGET = r"""(?is)url\s*=\s*["']?([^"'\s>]+)"""


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL; both empty for a null and without `://`."""
    find = lambda part: F.coalesce(F.regexp_extract(url, f"(?s)^.*?://{part}", 1), F.lit(""))
    return lower_ascii(find("([^/?#]*)")), find("[^/?#]*([^?#]*)")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict. `rules` has (verdict, host/path) pairs written by people."""
    rule = verdict = F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def node(url: Column) -> Column:
    """One spelling for all spellings of an address; null without `://`."""
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)?$", ""), r"^(www|m)\.", "")
    given = F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.array_sort(F.filter(given, lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    path = F.when(path == "", "/").otherwise(path)
    return F.when(F.locate("://", url) > 0, F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def link_targets(url: Column, html: Column) -> Column:
    """The absolute addresses that a page's canonical links and refreshes name."""
    tags = F.concat(
        F.transform(F.regexp_extract_all(html, F.lit(_CANONICAL), 0), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all(html, F.lit(_REFRESH), 0), lambda t: F.regexp_extract(t, _TARGET, 1)),
    )
    scheme, site = F.regexp_extract(url, "^(.*?)://", 1), F.regexp_extract(url, "^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, "^(.*?://[^/?#]*[^?#]*/)", 1)

    def absolute(target: Column) -> Column:
        target = F.replace(target, F.lit("&amp;"), F.lit("&"))
        return (
            F.when(target.contains("://"), target)
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .when(target.startswith("/"), F.concat(site, target))
            .when(folder != "", F.concat(folder, target))
            .otherwise(F.concat(site, F.lit("/"), target))
        )

    return F.transform(F.filter(tags, lambda t: t != ""), absolute)


def judge_pages(
    pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", html: str = "html", links: DataFrame | None = None
) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `verdict` and `alias_class` (the smallest node of its class).

    `links` may name further redirects (columns `from_url`, `to_url`), such as a crawler's log. URLs that are null or have
    no `://` have no host, path, rule or class and are allowed. Repeated pages are judged alike, long addresses and pages whole. Columns so
    named are replaced, others stay as they are; names beginning with two underscores are for the operator. An empty table
    gives an empty one.
    """
    made = ("host", "path", "rule", "verdict", "alias_class")
    address = F.col(url).cast("string")
    host, path = host_and_path(address)
    rows = pages.drop(*made).withColumns({"host": host, "path": path, "__node": node(address)})
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "verdict": verdict})
    named = pages.select(address.alias("from_url"), F.explode(link_targets(address, F.col(html))).alias("to_url"))
    if links is not None:
        named = named.unionByName(links.select("from_url", "to_url"))
    named = materialize(named.where("from_url like '%://%' and to_url like '%://%'").distinct(), "page-links")
    edges = named.select(node(F.col("from_url")).alias("a"), node(F.col("to_url")).alias("b"))
    classes = components(edges)
    urls = pages.select(address.alias("u")).union(named.select("to_url")).union(named.select("from_url"))
    _, decided = rule_for(*host_and_path(F.col("u")), rules)
    # Per node first, which is combined before the shuffle, then per class.
    nodes = urls.select(node(F.col("u")).alias("node"), decided.alias("d")).where("node is not null").groupBy("node").agg(
        F.coalesce(F.bool_or(F.col("d") == "allow"), F.lit(False)).alias("allows"),
        F.coalesce(F.bool_or(F.col("d") == "block"), F.lit(False)).alias("blocks"),
    )
    placed = nodes.join(classes, "node", "left").withColumn("alias_class", F.coalesce("component", "node"))
    of_class = placed.groupBy("alias_class").agg(F.bool_or("allows").alias("allows"), F.bool_or("blocks").alias("blocks"))
    spread = placed.select("node", "alias_class").join(of_class, "alias_class").withColumnsRenamed(
        {"node": "__own", "allows": "__allows", "blocks": "__blocks"}  # apart from what pages may have
    )
    judged = rows.join(spread, F.col("__node") == F.col("__own"), "left")
    inherited = F.when(F.col("__blocks") & ~F.col("__allows"), "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce("verdict", inherited)).drop("__node", "__own", "__allows", "__blocks")
