"""URL filters by redirect equivalence (native DataFrame operations only).

A url's own rule decides first: the longest rule whose host is the url's host or
a parent domain and whose path begins the url's path. Urls without a rule take
the decision of their aliases: pages linked by redirects or canonical links,
followed through distributed connected components. A component with an explicit
allow is allowed, otherwise one with a block is blocked, otherwise allowed; an
explicit rule of the url itself always stands.

Null urls, and urls without ``://``, have an empty host and path, match no rule,
have no aliases and are allowed. A null HTML has no links. Repeated rows each get
a row, an empty table gives an empty result, and columns other than the page's
id, url and HTML are not used and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import cut, drop

#: Rules kept as one expression up to this many; beyond, they are joined by host.
INLINE_RULES = 64


def url_host(url: Column) -> Column:
    """Host, A-Z lower-cased, other letters as they are."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: tuple[str, str, str]) -> Column:
    _, h, p = rule
    return ((host == h) | host.endswith("." + h)) & path.startswith(p)


def match_rules(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """Adds ``rule`` (host + path) and ``rule_verdict`` to ``host, path``.

    ``rules``: (verdict, host, path) triples, or for long lists a DataFrame with
    those columns. The longest rule wins; of equally long ones the allow.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE_RULES:
        rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
        # built from the inside out, so the longest rule is asked first
        for r in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "allow", r[1:])):
            hit = _fits(F.col("host"), F.col("path"), r)
            rule = F.when(hit, F.lit(r[1] + r[2])).otherwise(rule)
            verdict = F.when(hit, F.lit(r[0])).otherwise(verdict)
        return urls.withColumns({"rule": rule, "rule_verdict": verdict})
    if not isinstance(rules, DataFrame):
        rules = urls.sparkSession.createDataFrame(rules, "verdict string, host string, path string")
    # parent domains of each distinct (host, path) meet the rules of that host
    seen = urls.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cand = seen.withColumn("h", F.explode(parents)).join(rules.select(F.col("verdict").alias("v"), F.col("host").alias("h"), F.col("path").alias("p")), "h")
    hit = cand.where(F.col("path").startswith(F.col("p")))
    order = F.struct((F.length("h") + F.length("p")).alias("n"), (F.col("v") == "allow").cast("int").alias("a"), "h", "p", "v")
    best = hit.groupBy("host", "path").agg(F.max(order).alias("b")).select("host", "path", F.concat("b.h", "b.p").alias("rule"), F.col("b.v").alias("rule_verdict"))
    return urls.join(best, ["host", "path"], "left")


def canonical_form(url: Column) -> Column:
    """The address that a server names as canonical for the usual variants.

    Scheme, ``www.``, a fragment, feed and referral parameters, a trailing slash
    and ``.html`` do not make another page; null for urls without ``://``.
    """
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(url_path(url), r"\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(r"^(utm_\w*|ref|fbclid|gclid)="))), "&")
    return F.when(url.contains("://"), F.concat(F.lit("//"), host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit(""))))


def _plain(path: Column) -> Column:
    """A path from ``/`` on without its ``.`` and ``..`` steps."""
    up = lambda acc: F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == "..", up(acc)).when(x == ".", acc).otherwise(F.concat(acc, F.array(x)))
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    walked = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"/\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(walked, "/"))).otherwise(path)


def resolve(base: Column, target: Column) -> Column:
    """Address that ``target`` means on a page at ``base``; null for an empty
    target and for other schemes, such as ``mailto:``."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, tail = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(url_path(base), r"(?s)^(.*/)", 1)
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path))
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when((target == "") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("?"), F.concat(origin, url_path(base), target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(origin, _plain(joined), tail))
    )


def _unescape(x: Column) -> Column:
    """Character references that a url in an attribute may have, decoded once."""
    for name, char in (("quot|#34|#x22", '"'), ("apos|#39|#x27", "'"), ("lt|#60|#x3c", "<"), ("gt|#62|#x3e", ">"), ("amp|#38|#x26", "&")):
        x = F.regexp_replace(x, rf"(?i)&(?:{name});", char)
    return x


#: A comment, also one that never ends, and the tags that may hold links.
_COMMENT = r"(?s)<!--.*?(?:-->|\z)"
_TAG = r"(?is)(<(?:link|meta|base)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>)"
#: An attribute with a value; what stands in another one's quotes is part of that.
_ATTRIBUTE = r"(?s)([^\s\"'<>/=]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'<>]+)"


def attribute(tag: Column, name: str) -> Column:
    """Value of a tag's first attribute of that name, unquoted, with its references
    decoded and blanks around it left out; null if it has none."""
    names = F.transform(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), F.lower)
    raw = F.try_element_at(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)), F.nullif(F.array_position(names, name), F.lit(0)).cast("int"))
    return F.trim(_unescape(F.regexp_replace(raw, r"(?s)^([\"'])(.*)\1$", "$2")))


def link_edges(pages: DataFrame) -> DataFrame:
    """``src, dst`` alias edges of all pages with a url.

    Each page is tied to the targets of all its ``<link>`` tags one of whose ``rel``
    words is ``canonical``, and ``<meta http-equiv="refresh">`` tags. Relative targets
    start from the page's ``<base>``, or else from its url; character references are
    decoded, and comments are no tags.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    tags = F.regexp_extract_all(F.regexp_replace(html, _COMMENT, ""), F.lit(_TAG), F.lit(1))
    kind = lambda x, name: F.lower(F.substring(x, 2, len(name))) == name
    found = pages.where(F.col("url").contains("://")).select("url", tags.alias("tags")).where(F.size("tags") > 0)
    canonical = lambda x: kind(x, "link") & F.array_contains(F.split(F.lower(attribute(x, "rel")), r"\s+"), "canonical")
    refresh = lambda x: kind(x, "meta") & (F.lower(attribute(x, "http-equiv")) == "refresh")
    links = F.transform(F.filter("tags", canonical), lambda x: attribute(x, "href"))
    moves = F.transform(F.filter("tags", refresh), lambda x: F.trim(F.regexp_extract(attribute(x, "content"), r"(?is)^[^;,]*[;,]\s*(?:url\s*=\s*)?[\"']?([^\"']*)", 1)))
    based = F.try_element_at(F.filter(F.transform(F.filter("tags", lambda x: kind(x, "base")), lambda x: attribute(x, "href")), lambda x: x.isNotNull()), F.lit(1))
    told = found.select("url", based.alias("based"), F.filter(F.concat(links, moves), lambda x: x != "").alias("to"))
    each = told.select("url", "based", F.explode("to").alias("to"))
    from_ = F.coalesce(resolve(F.col("url"), F.col("based")), F.col("url"))
    out = each.select(canonical_form(F.col("url")).alias("src"), canonical_form(resolve(from_, F.col("to"))).alias("dst"))
    return out.where("dst is not null and dst <> src").distinct()


def judge_pages(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict, component, decided_by`` per page.

    ``edges`` (src, dst of urls) adds redirects known from elsewhere, such as a
    crawl log. ``component`` is the least address among a url's aliases.
    """
    base = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), canonical_form(F.col("url")).alias("address"))
    ruled = match_rules(base, rules)
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(canonical_form(F.col("src")).alias("src"), canonical_form(F.col("dst")).alias("dst"))).where("src <> dst").distinct()
    comp = connected_components(links).withColumnRenamed("id", "address")
    # one decision per address, then one per component: both combine ahead of the shuffle
    flags = [F.max(F.when(F.col("rule_verdict") == v, True).otherwise(False)).alias(v) for v in ("allow", "block")]
    merge = [F.max(v).alias(v) for v in ("allow", "block")]
    own = ruled.where("address is not null").groupBy("address").agg(*flags)
    linked = cut(own.join(comp, "address", "left").withColumn("component", F.coalesce("component", "address")), "url-own")
    whole = cut(linked.groupBy("component").agg(*merge), "url-whole")
    fate = cut(linked.select("address", "component").join(whole, "component"), "url-fate")
    drop(comp, linked, whole)
    out = ruled.join(fate, "address", "left")
    alias = F.when(F.col("allow"), F.lit("allow")).when(F.col("block"), F.lit("block"))
    by = F.when(F.col("rule_verdict").isNotNull(), "rule").when(alias.isNotNull(), "alias").otherwise("default")
    return out.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", alias, F.lit("allow")).alias("verdict"), "component", by.alias("decided_by"))
