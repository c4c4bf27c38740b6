"""Sitemaps, feeds and robots files."""

from __future__ import annotations

import json
import re
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from . import urls

MAX_BODY = 5 * 1024 * 1024


def _local(name: str) -> str:
    return name.rsplit(":", 1)[-1].lower()


def parse_sitemap(body: bytes | None) -> dict | None:
    """{kind: urlset|index, entries: [{loc, lastmod}], children: [loc], error}; truncated input is accepted, a mismatched end tag is an error."""
    if body is None:
        return None
    entries, children, stack, text = [], [], [], []
    parser = expat.ParserCreate()

    def start(name, _):
        stack.append(_local(name))
        text.clear()

    def end(name):
        tag, owner = stack.pop(), stack[-1] if stack else ""
        value = "".join(text).strip()
        if tag == "loc" and value:
            if "sitemap" in stack:
                children.append(value)
            elif "url" in stack:
                entries.append({"loc": value, "lastmod": None})
        elif tag == "lastmod" and owner == "url" and entries and value:
            entries[-1]["lastmod"] = value
        text.clear()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    error = None
    try:
        parser.Parse(body, False)
    except expat.ExpatError as e:
        error = str(e)
    if error:
        return {"kind": None, "entries": [], "children": [], "error": error}
    return {"kind": "index" if children else "urlset", "entries": [] if children else entries, "children": children, "error": None}


def sitemap_urls(content_type: str | None, body: bytes | None, limit: int = 200, max_body: int = MAX_BODY) -> dict:
    """One map's links or children, capped; another type gives nothing, an oversized body an error."""
    if body is not None and len(body) > max_body:
        return {"urls": [], "children": [], "error": "body too large"}
    if body is None or "xml" not in (content_type or "").lower():
        return {"urls": [], "children": [], "error": None}
    found = parse_sitemap(body)
    return {"urls": [e["loc"] for e in found["entries"]][:limit], "children": found["children"], "error": found["error"]}


def harvested_sitemaps(maps: DataFrame, bodies: DataFrame, max_children: int = 8, per_map: int = 200) -> DataFrame:
    """(url, link, place): page links of fetched sitemaps. `maps` has url, content_type and body; `bodies` the same for child maps that were fetched.

    An index gives the links of its first `max_children` children, one level deep: a child that is itself an index, was not
    fetched or does not parse gives nothing. Each map gives `per_map` links at most.
    """
    top = maps.select("url", _harvest_col("content_type", "body").alias("m"))
    own = top.select("url", F.lit(0).alias("child"), F.posexplode(F.slice("m.urls", 1, per_map)).alias("at", "link"))
    children = top.select("url", F.posexplode(F.slice("m.children", 1, max_children)).alias("child", "loc"))
    found = bodies.select(F.col("url").alias("loc"), _harvest_col("content_type", "body").alias("c")).filter(F.size("c.children") == 0)
    below = children.join(found, "loc").select("url", (F.col("child") + 1).alias("child"), F.posexplode(F.slice("c.urls", 1, per_map)).alias("at", "link"))
    return own.unionByName(below).select("url", "link", (F.col("child").cast("long") * per_map + F.col("at")).alias("place"))


def _audio(url: str, mime: str | None) -> bool:
    mime = (mime or "").lower()
    path = re.split(r"[?#]", url, maxsplit=1)[0]
    return mime.startswith("audio/") or mime == "application/ogg" or ("." in path and path.rsplit(".", 1)[-1].lower() in urls.FEED_AUDIO)


def feed_entries(body: bytes | None, base: str | None) -> list[dict] | None:
    """Entries of an RSS, Atom or JSON feed: {title, links: [(href, rel, mime)], media: [(url, mime)]}, hrefs resolved; None if it is none of these."""
    if body is None:
        return None
    head = body.lstrip()[:1]
    if head == b"{":
        try:
            feed = json.loads(body)
        except ValueError:
            return None
        out = []
        for item in feed.get("items", []):
            media = [(a.get("url"), a.get("mime_type")) for a in item.get("attachments", []) if a.get("url")]
            out.append({"title": item.get("title"), "links": [(item["url"], None, None)] if item.get("url") else [], "media": media})
        return [_resolved(e, base) for e in out]
    entries, stack, text, current = [], [], [], None
    parser = expat.ParserCreate()

    def start(name, attrs):
        nonlocal current
        tag = _local(name)
        stack.append(tag)
        text.clear()
        if tag in ("item", "entry"):
            current = {"title": None, "links": [], "media": []}
        elif current is not None:
            if tag == "link" and "href" in attrs:
                current["links"].append((attrs["href"], attrs.get("rel"), attrs.get("type")))
            elif tag == "enclosure" and "url" in attrs:
                current["media"].append((attrs["url"], attrs.get("type")))
            elif tag == "content" and "url" in attrs:
                current["media"].append((attrs["url"], attrs.get("type")))

    def end(name):
        nonlocal current
        tag = stack.pop()
        value = "".join(text).strip()
        if tag in ("item", "entry") and current is not None:
            entries.append(current)
            current = None
        elif current is not None and stack and stack[-1] in ("item", "entry"):
            if tag == "title":
                current["title"] = current["title"] or value
            elif tag == "link" and value:
                current["links"].append((value, None, None))
        text.clear()

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        return None
    return [_resolved(e, base) for e in entries]


def _resolved(entry: dict, base: str | None) -> dict:
    fix = lambda u: urls.resolve(base, u, keep_fragment=True) or u
    return {"title": entry["title"], "links": [(fix(u), r, m) for u, r, m in entry["links"]], "media": [(fix(u), m) for u, m in entry["media"]]}


def harvest_feed(content_type: str | None, body: bytes | None, base: str | None) -> dict:
    """Entry links (no rel, or alternate) and audio enclosures."""
    if not re.search("xml|rss|atom|feed", (content_type or "").lower()):
        return {"links": [], "enclosures": []}
    links, enclosures = [], []
    for e in feed_entries(body, base) or []:
        for href, rel, mime in e["links"]:
            if rel in (None, "alternate"):
                links.append(href)
            elif rel == "enclosure" and _audio(href, mime):
                enclosures.append(href)
        enclosures += [u for u, mime in e["media"] if _audio(u, mime)]
    return {"links": links, "enclosures": enclosures}


def parse_feed(body: bytes | None, base: str | None) -> list[dict]:
    """Per entry its first link, title and all media (url, mime)."""
    return [{"link": e["links"][0][0] if e["links"] else None, "title": e["title"], "media": [{"url": u, "mime": m} for u, m in e["media"]]} for e in feed_entries(body, base) or []]


# Robots


def robots_sitemaps(body: bytes | None, base: str | None) -> list[str]:
    try:
        text = (body or b"").decode("utf-8")
    except UnicodeDecodeError:
        return []
    out = []
    for line in text.splitlines():
        key, _, value = line.strip().partition(":")
        if key.strip().lower() == "sitemap" and value.strip():
            url = urls.resolve(base, value.strip(), keep_fragment=True)
            if url:
                out.append(url)
    return out


def delay_ms(text: str) -> int | None:
    try:
        seconds = float(text)
    except ValueError:
        return None
    return int(seconds * 1000) if 0 <= seconds < float("inf") else None


def crawl_delay(body: bytes | None, token: str) -> int | None:
    """Milliseconds of the group that names the token, else of the * group. Any line but User-agent closes a group; later groups overwrite earlier ones."""
    try:
        text = (body or b"").decode("utf-8")
    except UnicodeDecodeError:
        return None
    groups: list[tuple[list[str], list[str]]] = []
    for raw in text.splitlines():
        line = raw.split("#", 1)[0].strip().lower()
        if not line:
            continue
        key, _, value = line.partition(":")
        if key == "user-agent":
            if not groups or groups[-1][1]:
                groups.append(([], []))
            groups[-1][0].append(value.strip())
        elif groups:
            groups[-1][1].append(line)
    by_agent: dict[str, int | None] = {}
    for agents, lines in groups:
        values = [x.partition(":")[2].strip() for x in lines if x.startswith("crawl-delay:")]
        for agent in agents:
            by_agent[agent] = delay_ms(values[-1]) if values else None
    own = by_agent.get(token.lower())
    return own if own is not None else by_agent.get("*")


def _rules(text: str, token: str) -> list[tuple[bool, str]]:
    groups: list[tuple[list[str], list[tuple[bool, str]]]] = []
    open_ = False
    for raw in text.splitlines():
        key, sep, value = raw.split("#", 1)[0].strip().partition(":")
        key, value = key.strip().lower(), value.strip()
        if not sep:
            continue
        if key == "user-agent":
            if not open_:
                groups.append(([], []))
            groups[-1][0].append(value.lower())
            open_ = True
        elif key in ("allow", "disallow"):
            open_ = False
            if groups and value:
                groups[-1][1].append((key == "allow", value))
    named = [r for agents, r in groups if token.lower() in agents]
    return [x for r in (named or [r for agents, r in groups if "*" in agents]) for x in r]


def robots_allowed(body: bytes | None, token: str, url: str | None) -> bool:
    """RFC 9309: the longest matching rule decides, allow wins a tie, * and $ are wild; an unreadable file allows."""
    target = urls.parse(url)
    try:
        text = (body or b"").decode("utf-8")
    except UnicodeDecodeError:
        return True
    if target is None or target.path == "/robots.txt":
        return True
    path = target.path + (f"?{target.query}" if target.query is not None else "")
    best = (-1, True)
    for allow, rule in _rules(text, token):
        pattern = "".join(".*" if c == "*" else re.escape(c) for c in rule.removesuffix("$")) + ("$" if rule.endswith("$") else "")
        if re.match(pattern, path) and (len(rule), allow) > best:
            best = (len(rule), allow)
    return best[1]


SITEMAP = StructType([StructField("kind", StringType()), StructField("entries", ArrayType(StructType([StructField("loc", StringType()), StructField("lastmod", StringType())]))), StructField("children", ArrayType(StringType())), StructField("error", StringType())])
FEED = StructType([StructField("links", ArrayType(StringType())), StructField("enclosures", ArrayType(StringType()))])
ROBOTS = StructType([StructField("delay_ms", LongType()), StructField("sitemaps", ArrayType(StringType())), StructField("allowed", BooleanType())])


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})


def _raw(x) -> bytes | None:
    return None if x is None else x.encode("utf-8") if isinstance(x, str) else bytes(x)


@F.pandas_udf(SITEMAP)
def sitemap_col(body: pd.Series) -> pd.DataFrame:
    return _frame([parse_sitemap(_raw(b)) or {} for b in body], SITEMAP.names)


HARVEST = StructType([StructField("urls", ArrayType(StringType())), StructField("children", ArrayType(StringType())), StructField("error", StringType())])


@F.pandas_udf(HARVEST)
def _harvest_col(content_type: pd.Series, body: pd.Series) -> pd.DataFrame:
    return _frame([sitemap_urls(c, _raw(b), limit=2**31) for c, b in zip(content_type, body, strict=True)], HARVEST.names)


@F.pandas_udf(FEED)
def feed_col(content_type: pd.Series, body: pd.Series, base: pd.Series) -> pd.DataFrame:
    return _frame([harvest_feed(c, _raw(b), u) for c, b, u in zip(content_type, body, base, strict=True)], FEED.names)


@F.pandas_udf(ROBOTS)
def robots_col(body: pd.Series, token: pd.Series, url: pd.Series) -> pd.DataFrame:
    return _frame([{"delay_ms": crawl_delay(_raw(b), t), "sitemaps": robots_sitemaps(_raw(b), u), "allowed": robots_allowed(_raw(b), t, u)} for b, t, u in zip(body, token, url, strict=True)], ROBOTS.names)
