"""URL columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from gleaner.functions.text import column


def site_host(url) -> Column:
    """Authority in lower case, port kept."""
    return F.lower(F.regexp_extract(column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def path(url) -> Column:
    return F.regexp_extract(column(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def path_prefix(url) -> Column:
    """First segment of the path, with its slash."""
    return F.concat(F.lit("/"), F.regexp_extract(path(url), r"^/*([^/]*)", 1))


def has_query(url) -> Column:
    return F.when(F.instr(F.regexp_replace(column(url), "#.*$", ""), "?") > 0, 1).otherwise(0)


def without_fragment(url) -> Column:
    return F.regexp_replace(column(url), "#.*$", "")


def uri_rank(url) -> Column:
    """Order of aliases: without query first, shorter first, then by text."""
    return F.struct(has_query(url).alias("q"), F.length(column(url)).alias("n"), column(url).alias("u"))


@dataclass(frozen=True)
class Rewrite:
    """One canonicalisation rule. ``host`` in lower case; ``path`` must match whole, ``prefix`` at the start; what is None is not asked."""

    host: str | None = None
    path: str | None = None
    prefix: str | None = None
    to_host: str | None = None
    to_path: str | None = None


def canonical_url(url, rules: list[Rewrite]) -> Column:
    """Rules in order, each on the outcome of those before; a URL that none changes is returned as it stands, port and user kept."""
    url = column(url)
    full = r"^([A-Za-z][A-Za-z0-9+.-]*://)([^/?#@]*@)?([^/?#:@]*)(:\d+)?([^?#]*)(.*)$"
    part = lambda k: F.regexp_extract(url, full, k)
    host, where = F.lower(part(3)), part(5)
    for r in rules:
        hit = F.lit(True)
        if r.host is not None:
            hit = hit & (host == r.host)
        if r.path is not None:
            hit = hit & (where == r.path)
        if r.prefix is not None:
            hit = hit & where.startswith(r.prefix)
        now_host = F.when(hit, F.lit(r.to_host)).otherwise(host) if r.to_host is not None else host
        if r.to_path is not None:
            rest = F.expr("''") if r.prefix is None else F.substr(where, F.lit(len(r.prefix) + 1))
            where = F.when(hit, F.concat(F.lit(r.to_path), rest)).otherwise(where)
        host = now_host
    changed = (host != F.lower(part(3))) | (where != part(5))
    return F.when(changed, F.concat(part(1), part(2), host, part(4), where, part(6))).otherwise(url)


def admitted(url, allow_hosts=(), deny_hosts=(), allow=(), deny=()) -> Column:
    """Host allowed and not denied (subdomains included); any allow pattern found, no deny pattern found."""
    host = F.regexp_replace(site_host(url), r":\d+$", "")

    def under(hosts) -> Column:
        out = F.lit(False)
        for h in hosts:
            out = out | (host == h) | host.endswith("." + h)
        return out

    ok = host != ""
    if allow_hosts:
        ok = ok & under(allow_hosts)
    if deny_hosts:
        ok = ok & ~under(deny_hosts)
    if allow:
        ok = ok & column(url).rlike("|".join(f"(?:{p})" for p in allow))
    if deny:
        ok = ok & ~column(url).rlike("|".join(f"(?:{p})" for p in deny))
    return ok


def rewritten_in_text(text, pairs: list[tuple[str, str]]) -> Column:
    """URL prefixes replaced wherever a URL stands in a text."""
    out = column(text)
    for old, new in pairs:
        out = F.regexp_replace(out, F.lit(r"\Q" + old + r"\E(?=[^\s<>\]\[()\"']*)"), F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return out
