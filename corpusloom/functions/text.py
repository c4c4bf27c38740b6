"""String, license, path and date functions, and the small predicates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Result codes by outcome; an HTTP error has its own status as its code (fixed values).
STATUS_CODES = {"Success": 0, "FetchError": -1, "RobotsBlocked": -2, "ContentTooLarge": -3, "InvalidContentType": -4, "Timeout": -5, "ProbeFailed": -6, "QualityRejected": -7, "ChecksumMismatch": -8}
TRACK_STATUSES = ["pending", "downloading", "done", "rejected", "failed"]
JOB_STATUSES = ["Pending", "Running", "Paused", "Completed", "Failed"]
#: License codes that may be passed on (fixed values).
REDISTRIBUTABLE = ["cc-by", "cc-by-sa", "cc0-1.0", "pd-mark", "pd-us"]
REDISTRIBUTABLE_FMA = ["cc-by", "cc-by-sa", "cc0-1.0"]
#: Device names that no path segment may be (fixed values).
RESERVED_NAMES = ["con", "prn", "aux", "nul", *[f"com{i}" for i in range(1, 10)], *[f"lpt{i}" for i in range(1, 10)]]


def status_code(kind: Column, http: Column) -> Column:
    out = F.when(kind == "HttpError", http.cast("int"))
    for name, code in STATUS_CODES.items():
        out = out.when(kind == name, F.lit(code))
    return out


def track_status(text: Column) -> Column:
    """Unknown text counts as pending."""
    return F.when(text.isin(TRACK_STATUSES), text).otherwise("pending")


def is_media(kind: Column) -> Column:
    return F.coalesce(kind, F.lit("Page")) != "Page"


# Licenses


def _license_segment(url: Column) -> Column:
    return F.split_part(F.split_part(F.lower(url), F.lit("/licenses/"), F.lit(2)), F.lit("/"), F.lit(1))


def license_from_cc_url(url: Column) -> Column:
    """cc-<segment> of a licenses URL whose segment starts with by."""
    seg = _license_segment(url)
    return F.when(F.lower(url).contains("/licenses/") & seg.startswith("by"), F.concat(F.lit("cc-"), seg))


def license_from_url_and_rights(url: Column, rights: Column) -> Column:
    low, stated = F.lower(url), F.lower(F.trim(rights))
    return F.coalesce(license_from_cc_url(url), F.when(low.contains("publicdomain/mark"), "pd-mark").when(low.contains("publicdomain/zero"), "cc0-1.0"), F.when(stated.isin("public domain in the usa.", "public domain in the usa"), "pd-us"))


def license_from_title(title: Column) -> Column:
    low = F.lower(title)
    part = lambda cond, text: F.when(cond, text).otherwise("")
    code = F.concat(F.lit("cc-by"), part(low.contains("noncommercial"), "-nc"), part(low.contains("noderivs") | low.contains("no derivative"), "-nd"), part(low.contains("sharealike"), "-sa"))
    public = low.contains("public domain")
    return F.when(public | (low.contains("creative commons") & low.contains("cc0")), "cc0-1.0").when(low.contains("creative commons"), code)


def redistributable(code: Column, source: str = "archive") -> Column:
    """Per catalog: `fma` has the narrow set, `jamendo` takes any code, all others the wide set."""
    if source == "jamendo":
        return code.isNotNull()
    return code.isin(REDISTRIBUTABLE_FMA if source == "fma" else REDISTRIBUTABLE)


def track_exported(status: Column, license: Column, include_incomplete: bool = False, all_licenses: bool = False) -> Column:
    return (F.lit(include_incomplete) | (status == "done")) & (F.lit(all_licenses) | license.isin(REDISTRIBUTABLE))


def format_preference(fmt: Column) -> Column:
    low = F.lower(fmt)
    return F.when(low.contains("vbr mp3"), 0).when((low == "flac") | low.contains("24bit flac"), 1).when(low.contains("ogg vorbis"), 2)


# Sizes, paths, dates, CSV


def parse_size(text: Column) -> Column:
    """Bytes of '<integer>[KB|MB|GB]', 1024-based; null if it is none."""
    up = F.upper(F.trim(text))
    number = F.regexp_extract(up, r"^([0-9]+)\s*(KB|MB|GB)?$", 1).try_cast("bigint")
    unit = F.regexp_extract(up, r"^([0-9]+)\s*(KB|MB|GB)?$", 2)
    return number * F.when(unit == "GB", 1 << 30).when(unit == "MB", 1 << 20).when(unit == "KB", 1 << 10).otherwise(1)


def sanitize_path_segment(text: Column) -> Column:
    """Separators and control characters to _, 200 characters at most, device names prefixed, trailing dots and blanks off."""
    out = F.substring(F.regexp_replace(text, r'[/\\:*?"<>|\x00-\x1f\x7f]', "_"), 1, 200)
    stem = F.lower(F.split_part(out, F.lit("."), F.lit(1)))
    out = F.when(stem.isin(RESERVED_NAMES), F.concat(F.lit("_"), out)).otherwise(out)
    out = F.regexp_replace(out, r"[. ]+$", "")
    return F.when(out == "", "_").otherwise(out)


def object_path(source: Column, collection: Column, sha256: Column, extension: Column) -> Column:
    """<source>/<collection or misc>/<two digits>/<hash>.<extension>"""
    return F.concat_ws("/", sanitize_path_segment(source), sanitize_path_segment(F.coalesce(collection, F.lit("misc"))), F.substring(sha256, 1, 2), F.concat(sha256, F.lit("."), sanitize_path_segment(extension)))


def page_artifact_path(folder: str, domain: Column, sha256: Column) -> Column:
    return F.concat(F.lit(folder.rstrip("/") + "/"), domain, F.lit("/"), sha256, F.lit(".html"))


def csv_field(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(text, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def format_epoch_ms(ms: Column) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))


def format_listing_time(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm")


def truncate_bytes(text: Column, most: int) -> Column:
    """A text of more than `most` bytes is cut before the last character that starts below that byte, and gets an ellipsis."""
    state = F.aggregate(F.split(text, ""), F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("last")), lambda s, c: F.struct((s["at"] + F.octet_length(c)).alias("at"), (s["n"] + 1).alias("n"), F.when(s["at"] < most, s["n"]).otherwise(s["last"]).alias("last")), lambda s: s["last"])
    return F.when(F.octet_length(text) > most, F.concat(F.substring(text, F.lit(1), state), F.lit("…"))).otherwise(text)


def user_agent(name: str, version: str, contact: Column) -> Column:
    return F.when(contact.isNull() | (F.trim(contact) == ""), F.lit(f"{name}/{version}")).otherwise(F.format_string(f"{name}/{version} (+%s)", contact))


def retry_backoff_ms(base_ms: Column, attempt: Column) -> Column:
    return base_ms * attempt


def quota_wait_secs(retry: Column, most: int = 5) -> Column:
    """Minutes' ladder of an over-quota page; null beyond the last rung."""
    return F.when(retry.between(1, most), 60 * retry)


def param_value(text: Column, key: str) -> Column:
    """Value after key=, quoted or up to a blank, tab, ; or >"""
    quoted = F.regexp_extract(text, rf"(?i){key}=(?:\"([^\"]*)\"|'([^']*)'|([^ \t;>]*))", 0)
    bare = F.regexp_replace(quoted, rf"(?i)^{key}=", "")
    return F.nullif(F.regexp_replace(bare, "^[\"']|[\"']$", ""), F.lit(""))


def normalize_domain_token(text: Column) -> Column:
    """Trimmed, one pair of quotes off."""
    return F.regexp_replace(F.trim(text), "^(['\"])(.*)\\1$", "$2")


# Predicates


def is_html_content_type(content_type: Column) -> Column:
    return F.lower(content_type).contains("text/html")


def is_acceptable_content_type(content_type: Column, accepted: list[str]) -> Column:
    """Whether the type contains one of the accepted ones; an empty list accepts all."""
    if not accepted:
        return F.lit(True)
    low, out = F.lower(content_type), F.lit(False)
    for x in accepted:
        out = out | low.contains(x.lower())
    return out


def is_within_size_limit(size: Column, most: Column | int) -> Column:
    return size <= most


def looks_like_xml(content_type: Column) -> Column:
    return F.lower(content_type).contains("xml")


def looks_like_syndication(content_type: Column) -> Column:
    return F.lower(content_type).rlike("xml|rss|atom|feed")


def is_audio_mime(mime: Column) -> Column:
    low = F.lower(mime)
    return low.startswith("audio/") | (low == "application/ogg")


def is_retryable_status(status: Column) -> Column:
    return status.isin(408, 429) | status.between(500, 599)


def topic_relevant(title: Column, text: Column, keywords: Column, window: int = 2000) -> Column:
    """No keywords, or a keyword in the title or among the first `window` characters of the text, whatever the case."""
    wanted = F.filter(F.transform(F.coalesce(keywords, F.array().cast("array<string>")), lambda k: F.lower(F.trim(k))), lambda k: k != "")
    head = F.lower(F.substring(F.coalesce(text, F.lit("")), 1, window))
    named = F.lower(F.coalesce(title, F.lit("")))
    return (F.size(F.coalesce(keywords, F.array().cast("array<string>"))) == 0) | F.exists(wanted, lambda k: named.contains(k) | head.contains(k))


def robots_class(status: Column) -> Column:
    return F.when(status.isin(401, 403), "Denied").when(status.between(200, 299), "Success").otherwise("Absent")


def robots_allowed(status: Column, rule_allows: Column) -> Column:
    kind = robots_class(status)
    return F.when(kind == "Denied", False).when(kind == "Absent", True).otherwise(F.coalesce(rule_allows, F.lit(True)))


def parse_delay_ms(text: Column) -> Column:
    seconds = F.trim(text).try_cast("double")
    return F.when((seconds >= 0) & ~F.isnan(seconds) & (seconds < float("inf")), F.floor(seconds * 1000).cast("long"))


def effective_crawl_delay(robots_ms: Column, job_ms: Column, default_ms: int) -> Column:
    return F.coalesce(robots_ms, job_ms, F.lit(default_ms)).cast("long")


def clamp_delay(delay_ms: Column, most_ms: int) -> Column:
    return F.least(delay_ms, F.lit(most_ms))


def audio_quality(duration: Column, bitrate: Column, shortest: float = 30, longest: float = 1800, lowest: int = 96) -> Column:
    """Why a probe is refused, or null; bounds are inclusive and an unknown bitrate passes."""
    return F.when(duration < shortest, F.format_string("duration %.1fs below minimum", duration)).when(duration > longest, F.format_string("duration %.1fs above maximum", duration)).when(bitrate < lowest, F.format_string("bitrate %dkbps below minimum", bitrate.cast("int")))
