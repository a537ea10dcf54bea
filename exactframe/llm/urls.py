"""Operator 3, URL filters: block decisions travel along redirects and canonical links, by Spark expressions only.

Rules decide the addresses they fit; the longest rule wins. Other addresses take a block from any address that is the
same page by redirects (meta refresh, or a given table) and canonical links, however many steps away: connected
components over those edges. An address that a rule allows stays allowed whatever its aliases are, and never passes
a block on.

Defined results: a null address, or one without ``://``, has an empty host and path, fits no rule, is linked with
nothing and is allowed; a null page has no links; repeated rows give repeated results; an empty table gives an empty
table; the caller's columns are kept, and those added are in one struct, whose name the caller can choose.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, stored, unused
from .graph import components


class Rule(NamedTuple):
    """``verdict`` for a host and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two addresses of one page have in common: all but the scheme, the case of the host, and the fragment. Null without a host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    whole = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(host_of(url) != "", F.concat(host_of(url), F.when(F.contains(whole, F.lit("/.")), undotted(whole)).otherwise(whole)))


def undotted(rest: Column) -> Column:
    """A path, and the query after it, without steps such as ``.`` and ``..``."""
    path, query = F.regexp_extract(rest, r"(?s)^([^?]*)", 1), F.regexp_extract(rest, r"(?s)^[^?]*(.*)$", 1)
    none = F.array().cast("array<string>")
    back = lambda done: F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
    step = lambda done, s: F.when(s == ".", done).when(s == "..", back(done)).otherwise(F.concat(done, F.array(s)))
    done = F.aggregate(F.slice(F.split(path, "/"), 2, 1 << 30), none, step)
    tail = F.when(F.rlike(path, F.lit(r"/\.{1,2}$")) & (F.size(done) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(done, "/"), tail, query)


def matched(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. The rules are a configured list, written into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.trim(F.regexp_replace(value, r"""^["']|["']$""", ""))


def declared_links(html: Column) -> Column:
    """The addresses that a page gives as its canonical one or redirects to, as written."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<(?:link|meta)\s[^>]*+>"), F.lit(0))

    def of(tag: Column) -> Column:
        canonical = F.rlike(_attribute(tag, "rel"), F.lit(r"(?i)(^|\s)canonical(\s|$)"))
        refresh = F.lower(_attribute(tag, "http-equiv")) == "refresh"
        to = F.regexp_extract(_attribute(tag, "content"), r"""(?is)url\s*=\s*["']?([^"']+)""", 1)
        return F.when(canonical, _attribute(tag, "href")).when(refresh, F.trim(to))

    found = F.transform(tags, lambda t: F.replace(of(t), F.lit("&amp;"), F.lit("&")))
    return F.when(F.rlike(html, F.lit("(?i)canonical|http-equiv")), F.filter(found, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def declared_base(html: Column) -> Column:
    """The address that a page's links start from, as written; empty where none is given."""
    return F.replace(_attribute(F.regexp_extract(html, r"(?is)<base\s[^>]*+>", 0), "href"), F.lit("&amp;"), F.lit("&"))


def absolute(link: Column, url: Column) -> Column:
    """``link`` as an absolute address; ``url``: that of its page."""
    scheme = F.regexp_extract(url, r"^([^:/?#]*)://", 1)
    site = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1)
    return (
        F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), link))
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str | None = "html", redirects: DataFrame | None = None, out: str = "url_filter") -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, rule, verdict, and ``component``, the alias group's least address or null.

    ``redirects``: further edges, as columns (from_url, to_url).
    """
    address, x = F.col(url), unused(pages)
    edges = []
    if html:
        linking = pages.filter(F.rlike(html, F.lit("(?i)canonical|http-equiv")))
        links = linking.select(address.alias("from_url"), declared_base(F.col(html)).alias("base"), F.explode(declared_links(F.col(html))).alias("link"))
        base = F.when(F.col("base") == "", F.col("from_url")).otherwise(absolute(F.col("base"), F.col("from_url")))
        edges.append(links.select("from_url", absolute(F.col("link"), base).alias("to_url")))
    if redirects is not None:
        edges.append(redirects.select("from_url", "to_url"))
    judged = pages.withColumn(out, F.struct(host_of(address).alias("host"), path_of(address).alias("path"), node_of(address).alias("node")))
    rule = matched(F.col(out)["host"], F.col(out)["path"], rules)
    judged = judged.withColumn(out, let(rule, lambda r: F.struct(F.col(out)["host"].alias("host"), F.col(out)["path"].alias("path"), F.col(out)["node"].alias("node"), r.alias("r"))))
    if not edges:
        return judged.withColumn(out, _final(out, F.lit(None).cast("string"), F.lit(False)))
    both = edges[0]
    for e in edges[1:]:
        both = both.unionByName(e)
    # an address seen only as a link's end is judged by its rules too, and can block its aliases
    ends = both.select("from_url", "to_url", node_of(F.col("from_url")).alias("a"), node_of(F.col("to_url")).alias("b")).filter("a is not null and b is not null")
    ends = stored(ends, "links")  # the pages are gone through once
    group = components(ends, "a", "b")
    plain = lambda c: F.concat(F.lit("x://"), F.col(c))  # noqa: E731 - as written, and without dots in the path
    seen = ends.select(F.explode(F.array("from_url", "to_url", plain("a"), plain("b"))).alias("u")).distinct()
    seen = seen.select(node_of(F.col("u")).alias("id"), matched(host_of(F.col("u")), path_of(F.col("u")), rules)["verdict"].alias("v"))
    blocked = group.join(seen.filter("v = 'block'").select("id"), "id", "left_semi").select("component").distinct().withColumn("blocked", F.lit(True))
    alias = group.join(blocked, "component", "left").select(F.col("id").alias(x + "alias"), F.col("component").alias(x + "component"), F.col("blocked").alias(x + "blocked"))
    joined = judged.join(alias, F.col(out)["node"] == F.col(x + "alias"), "left")
    return joined.withColumn(out, _final(out, F.col(x + "component"), F.coalesce(x + "blocked", F.lit(False)))).select(*(judged[c] if c != out else F.col(out) for c in pages.columns + [out]))


def _final(out: str, component: Column, blocked: Column) -> Column:
    x = F.col(out)
    verdict = F.coalesce(x["r"]["verdict"], F.when(blocked, "block").otherwise("allow"))
    return F.struct(x["host"].alias("host"), x["path"].alias("path"), x["r"]["rule"].alias("rule"), verdict.alias("verdict"), component.alias("component"))
