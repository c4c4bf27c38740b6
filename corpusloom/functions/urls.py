"""URL parsing, normalisation, registrable domains and the egress guard.

`parse` follows the URL standard for the special schemes and keeps other schemes as they stand. The column functions at
the end wrap the scalar ones in Arrow-batched UDFs; where a rule is expressible by built-in functions it is.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from . import psl

DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
ALLOWED_PORTS = {80, 443, 8080, 8443}
#: Networks that must never be fetched (fixed values).
BLOCKED_V4 = [ipaddress.ip_network(x) for x in ("0.0.0.0/8", "127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "100.64.0.0/10", "198.18.0.0/15", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")]
BLOCKED_V6 = [ipaddress.ip_network(x) for x in ("::1/128", "::/128", "fc00::/7", "fe80::/10")]
BLOCKED_SUFFIXES = (".local", ".localhost", ".internal", ".lan")
#: Reasons for which a redirect is refused (fixed values).
TOO_MANY_REDIRECTS = "too many redirects"
NON_HTTP_REDIRECT = "non-http redirect blocked by egress guard"
HOP_BLOCKED = "redirect target blocked by egress guard"

_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.\-]*):")
_FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


@dataclass(frozen=True)
class Url:
    scheme: str
    host: str | None = None
    port: int | None = None
    path: str = ""
    query: str | None = None
    fragment: str | None = None
    userinfo: str = ""
    opaque: bool = False

    def __str__(self) -> str:
        tail = (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")
        if self.opaque:
            return f"{self.scheme}:{self.path}{tail}"
        user = f"{self.userinfo}@" if self.userinfo else ""
        port = f":{self.port}" if self.port is not None else ""
        return f"{self.scheme}://{user}{self.host or ''}{port}{self.path}{tail}"

    @property
    def ip(self) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
        if self.host is None:
            return None
        try:
            return ipaddress.ip_address(self.host.strip("[]"))
        except ValueError:
            return None


def _encode(text: str, extra: str) -> str:
    out = []
    for c in text:
        if c in extra or c <= " " or c > "~":
            out.append("".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")))
        else:
            out.append(c)
    return "".join(out)


def _number(part: str) -> int | None:
    try:
        if part[:2] in ("0x", "0X"):
            return int(part[2:], 16) if part[2:] else 0
        return int(part, 8) if len(part) > 1 and part[0] == "0" else int(part, 10)
    except ValueError:
        return None


def _host(text: str) -> str | None:
    if text.startswith("["):
        if not text.endswith("]"):
            return None
        try:
            return f"[{ipaddress.IPv6Address(text[1:-1]).compressed}]"
        except ValueError:
            return None
    raw = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)
    if raw != text:
        try:
            raw = raw.encode("latin-1").decode("utf-8")
        except UnicodeError:
            return None
    if raw.isascii():
        name = raw.lower()
    else:
        try:
            import idna

            name = idna.encode(raw, uts46=True).decode()
        except (ImportError, UnicodeError):
            try:
                name = raw.encode("idna").decode().lower()
            except UnicodeError:
                return None
    if not name or _FORBIDDEN_HOST.search(name):
        return None
    parts = name.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts = parts[:-1]
    if parts[-1].isdigit() or re.fullmatch(r"0[xX][0-9A-Fa-f]*", parts[-1]):
        numbers = [_number(p) if p else None for p in parts]
        if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
            return None
        value = numbers[-1] + sum(n << (8 * (3 - i)) for i, n in enumerate(numbers[:-1]))
        return str(ipaddress.IPv4Address(value))
    return name


def _path(text: str, start: list[str]) -> str:
    out, parts = list(start), re.split(r"[/\\]", text)
    for i, part in enumerate(parts):
        last, plain = i == len(parts) - 1, part.lower().replace("%2e", ".")
        if plain == "..":
            out = out[:-1]
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(_encode(part, '"#<>?`{}^'))
    return "/" + "/".join(out)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """Parse an absolute URL, or one relative to base; None if it is invalid."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    found = _SCHEME.match(text)
    rest, fragment = (text.split("#", 1) + [None])[:2]
    fragment = _encode(fragment, '"<>`') if fragment is not None else None
    if found:
        scheme, rest = found[1].lower(), rest[found.end() :]
        if scheme not in DEFAULT_PORTS:
            if scheme == "file" or rest.startswith("//"):
                host, path = re.match(r"//([^/?]*)([^?]*)", rest).groups() if rest.startswith("//") else ("", rest)
                query = rest.split("?", 1)[1] if "?" in rest else None
                return Url(scheme, host.lower() or None, None, path, query, fragment)
            path, query = (rest.split("?", 1) + [None])[:2]
            return Url(scheme, None, None, _encode(path, "") if not path.isascii() else path, query, fragment, opaque=True)
        if base is None or base.scheme != scheme or rest[:1] in ("/", "\\"):
            return _authority(scheme, rest.lstrip("/\\"), fragment)
    if base is None:
        return None
    if base.opaque:
        return replace(base, fragment=fragment) if text.startswith("#") else None
    flat = rest.replace("\\", "/") if base.scheme in DEFAULT_PORTS else rest
    if flat.startswith("//"):
        return _authority(base.scheme, rest.lstrip("/\\"), fragment)
    path, query = (rest.split("?", 1) + [None])[:2]
    query = _encode(query, "\"#<>'") if query is not None else None
    if path == "":
        return replace(base, query=base.query if query is None else query, fragment=fragment)
    start = [] if flat.startswith("/") else base.path.split("/")[1:-1]
    return replace(base, path=_path(path[1:] if flat.startswith("/") else path, start), query=query, fragment=fragment)


def _authority(scheme: str, rest: str, fragment: str | None) -> Url | None:
    m = re.match(r"[^/\\?]*", rest)
    authority, tail = m[0], rest[m.end() :]
    userinfo, _, place = authority.rpartition("@")
    port = None
    m = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::(\d*))?", place)
    if m is None:
        return None
    if m[2]:
        port = int(m[2])
        if port > 65535:
            return None
        port = None if port == DEFAULT_PORTS[scheme] else port
    host = _host(m[1]) if m[1] else None
    if host is None:
        return None
    path, query = (tail.split("?", 1) + [None])[:2]
    query = _encode(query, "\"#<>'") if query is not None else None
    return Url(scheme, host, port, _path(path[1:], []), query, fragment, _encode(userinfo, '"#<>?`{}/;=@[\\]^|'))


def _blocked(ip: ipaddress.IPv4Address | ipaddress.IPv6Address) -> bool:
    if ip.version == 4:
        return any(ip in net for net in BLOCKED_V4)
    if any(ip in net for net in BLOCKED_V6):
        return True
    if ip.ipv4_mapped is not None:
        return _blocked(ip.ipv4_mapped)
    if ip.packed[:4] == b"\x00\x64\xff\x9b":
        return _blocked(ipaddress.IPv4Address(ip.packed[12:]))
    return False


def safe(url: Url | None) -> bool:
    """Whether a parsed URL may be fetched: http(s), a usual port, and no private or reserved target."""
    if url is None or url.scheme not in ("http", "https") or url.host is None:
        return False
    if url.port is not None and url.port not in ALLOWED_PORTS:
        return False
    ip = url.ip
    if ip is not None:
        return not _blocked(ip)
    name = url.host[:-1].lower() if url.host.endswith(".") else url.host.lower()
    return name != "localhost" and not name.endswith(BLOCKED_SUFFIXES)


def is_safe_egress_url(text: str | None) -> bool:
    return safe(parse(text))


def normalize_url(text: str | None) -> str | None:
    """Canonical http(s) form without fragment and one trailing slash; None if invalid or not safe to fetch."""
    if text is None:
        return None
    url = parse(text if "://" in text else f"https://{text}")
    if not safe(url):
        return None
    out = str(replace(url, fragment=None))
    return out[:-1] if out.endswith("/") else out


def host_of(text: str | None) -> str | None:
    url = parse(text)
    return url.host if url else None


def root_domain(text: str | None) -> str | None:
    """An IP literal as text, else the registrable domain, else the host; None without a host."""
    url = parse(text)
    if url is None or not url.host:
        return None
    if url.ip is not None:
        return str(url.ip)
    return psl.registrable(url.host) or url.host


def hop_reason(previous: int, target: str | None, most: int) -> str | None:
    """Why a redirect hop is refused, or None: too many hops first, then the scheme, then the guard."""
    if previous > most:
        return TOO_MANY_REDIRECTS
    url = parse(target)
    if url is None or url.scheme not in ("http", "https"):
        return NON_HTTP_REDIRECT
    return None if safe(url) else HOP_BLOCKED


def resolve(base: str | None, href: str | None, keep_fragment: bool = False) -> str | None:
    """href against base, any scheme; None if it does not resolve."""
    url = parse(href, parse(base))
    if url is None:
        return None
    return str(url if keep_fragment else replace(url, fragment=None))


@lru_cache(maxsize=1)
def _memo() -> dict:
    """The scalar functions with a cache each, made once in every worker."""
    return {f.__name__: lru_cache(maxsize=16384)(f) for f in (is_safe_egress_url, normalize_url, host_of, root_domain)}


def _each(name: str, kind):
    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        f = _memo()[name]
        if text.isna().all():
            return pd.Series([f(None)] * len(text), dtype=object)
        return text.map(lambda x: f(x if isinstance(x, str) else None))

    return run


normalize_url_col = _each("normalize_url", StringType())
root_domain_col = _each("root_domain", StringType())
host_col = _each("host_of", StringType())
is_safe_egress_col = _each("is_safe_egress_url", BooleanType())

PARTS = StructType([StructField("norm", StringType()), StructField("host", StringType()), StructField("root", StringType()), StructField("safe", BooleanType())])


@F.pandas_udf(PARTS)
def url_parts(text: pd.Series) -> pd.DataFrame:
    """Normal form, host, registrable domain (of the normal form, else of the URL) and guard verdict in one pass."""
    norm = text.map(lambda x: _memo()["normalize_url"](x if isinstance(x, str) else None))
    whole = norm.where(norm.notna(), text)
    return pd.DataFrame({"norm": norm, "host": whole.map(lambda x: _memo()["host_of"](x if isinstance(x, str) else None)), "root": whole.map(lambda x: _memo()["root_domain"](x if isinstance(x, str) else None)), "safe": text.map(lambda x: _memo()["is_safe_egress_url"](x if isinstance(x, str) else None))})


@F.pandas_udf(StringType())
def resolve_col(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve(b, h) for b, h in zip(base, href, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def hop_reason_col(previous: pd.Series, target: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([hop_reason(int(p), t, int(m)) for p, t, m in zip(previous, target, most, strict=True)], dtype=object)


def quick_host(url: Column) -> Column:
    """Host of a plain http(s) URL by built-in functions: a prefilter for scans, not the definition."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^:/?#]*)", 1), F.lit("")))


def safe_ipv4(ip: Column) -> Column:
    """The guard's verdict on a dotted IPv4 address by built-in functions."""
    part = F.split(ip, r"\.")
    a, b, c = (part[i].cast("int") for i in range(3))
    bad = a.isin(0, 10, 127) | (a >= 240) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((a == 198) & b.isin(18, 19))
    return ~(bad | ((a == 192) & (b == 0) & (c == 2)) | ((a == 198) & (b == 51) & (c == 100)) | ((a == 203) & (b == 0) & (c == 113)))


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_REST = rf"(?::(?:{'|'.join(map(str, sorted(ALLOWED_PORTS)))}))?(?:[/?#]|\z)"


#: A host of BLOCKED_V4 in decimal numbers, as a pattern of its beginning (fixed values).
_BLOCKED_IPV4 = r"(?:(?:0|10|127|24\d|25[0-5])\.|172\.(?:1[6-9]|2\d|3[01])\.|192\.168\.|169\.254\.|100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.|198\.1[89]\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.)"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_NAME = r"(?:[a-z0-9-]+\.)*+[a-z]+"
_BLOCKED_NAME = rf"(?:localhost|(?:[a-z0-9-]+\.)+(?:{'|'.join(x[1:] for x in BLOCKED_SUFFIXES)}))"


def is_safe_egress(url: Column) -> Column:
    """The guard's verdict. A URL as most are written (http or https in lower case, no user, no or an allowed port, a host of four decimal numbers or an ASCII name that
    ends in letters) is judged by two patterns; only the others are parsed in Python."""
    plain = F.coalesce(url.rlike(rf"^https?://(?:{_IPV4}|{_NAME}){_REST}"), F.lit(False))
    blocked = url.rlike(rf"^https?://(?:(?={_IPV4}{_REST}){_BLOCKED_IPV4}|{_BLOCKED_NAME}{_REST})")
    parsed = is_safe_egress_col(F.when(~plain, url))
    return F.when(plain, ~blocked).otherwise(parsed)


def last_segment(url: Column) -> Column:
    """Text after the last slash, before ? and #."""
    return F.element_at(F.split(F.regexp_extract(url, r"^[^?#]*", 0), "/"), -1)


def _extension(url: Column) -> Column:
    return F.lower(F.regexp_extract(last_segment(url), r"\.([^.]*)$", 1))


#: Extensions by kind (fixed values).
AUDIO = ["mp3", "flac", "ogg", "oga", "wav", "m4a", "opus", "aac"]
VIDEO = ["mp4", "m4v", "mkv", "webm", "avi", "mov", "mpg", "mpeg"]
DOCUMENT = ["pdf", "epub", "doc", "docx", "ppt", "pptx", "txt"]
FEED_AUDIO = [*AUDIO, "wma"]


def has_audio_extension(url: Column) -> Column:
    return _extension(url).isin(AUDIO)


def has_video_extension(url: Column) -> Column:
    return _extension(url).isin(VIDEO)


def has_document_extension(url: Column) -> Column:
    return _extension(url).isin(DOCUMENT)


def has_feed_audio_extension(url: Column) -> Column:
    """As has_audio_extension, with wma, over the text after the last dot of the whole path."""
    return F.lower(F.regexp_extract(F.regexp_extract(url, r"^[^?#]*", 0), r"\.([^.]*)$", 1)).isin(FEED_AUDIO)


def task_kind(url: Column) -> Column:
    """AudioFile, VideoFile, DocumentFile or Page, in this order of precedence."""
    return F.when(has_audio_extension(url), "AudioFile").when(has_video_extension(url), "VideoFile").when(has_document_extension(url), "DocumentFile").otherwise("Page")


def discovery_class(url: Column) -> Column:
    """feed, sitemap or null. The path tested for /feed includes scheme and host."""
    path, last = F.lower(F.regexp_extract(url, r"^[^?#]*", 0)), F.lower(last_segment(url))
    feed = path.contains("/feed") | last.contains("rss") | last.contains("atom") | last.contains("feed")
    return F.when(feed, "feed").when(last.endswith(".xml"), "sitemap")


def discovery_candidates(links: Column, sitemaps: int = 3, feeds: int = 3) -> Column:
    """struct(sitemaps, feeds): the first distinct links of each class in link order."""
    distinct = F.array_distinct(links)
    return F.struct(F.slice(F.filter(distinct, lambda x: discovery_class(x) == "sitemap"), 1, sitemaps).alias("sitemaps"), F.slice(F.filter(distinct, lambda x: discovery_class(x) == "feed"), 1, feeds).alias("feeds"))


def encode_segment(text: Column) -> Column:
    """Percent-encoding of all bytes but A-Z a-z 0-9 - _ . ~"""
    return F.replace(F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def stable_id(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 16)


def staging_key(url: Column) -> Column:
    return F.substring(F.sha2(url, 256), 1, 24)


def product_token(agent: Column) -> Column:
    return F.trim(F.split_part(agent, F.lit("/"), F.lit(1)))


def subset_path(track: Column) -> Column:
    """NNN/NNNNNN.mp3 of a track number."""
    name = F.format_string("%06d", track)
    return F.concat(F.substring(name, 1, 3), F.lit("/"), name, F.lit(".mp3"))


def archive_download_url(identifier: Column, name: Column) -> Column:
    return F.concat(F.lit("https://archive.org/download/"), encode_segment(identifier), F.lit("/"), encode_segment(name))


def archive_details_url(identifier: Column) -> Column:
    return F.concat(F.lit("https://archive.org/details/"), identifier)


def jamendo_download_url(track: Column, fmt: str = "mp32") -> Column:
    return F.concat(F.lit("https://prod-1.storage.jamendo.com/download/track/"), track.cast("string"), F.lit(f"/{fmt}/"))
