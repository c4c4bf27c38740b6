"""Verification of downloaded media by their first bytes."""

from __future__ import annotations

import io
import wave

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

#: Types accepted for each kind (fixed values).
AUDIO_TYPES = ["audio/mpeg", "audio/x-flac", "audio/opus", "audio/ogg", "audio/x-wav", "audio/m4a", "video/mp4", "audio/aac"]
VIDEO_TYPES = ["video/mp4", "video/x-m4v", "video/webm", "video/x-matroska", "video/quicktime", "video/x-msvideo", "audio/m4a"]
DOCUMENT_TYPES = ["application/pdf", "application/zip", "application/x-ole-storage", "application/epub+zip", "application/x-mobipocket-ebook", "text/plain"]
DOCUMENT_PREFIXES = ("application/vnd.openxmlformats-officedocument",)
CANONICAL = {"audio/mpeg": "mp3", "audio/x-flac": "flac", "audio/opus": "ogg", "audio/ogg": "ogg", "audio/x-wav": "wav"}
AUDIO_CAP, OTHER_CAP = 500 * 1024 * 1024, 8 * 1024**3


def sniff(head: bytes | None) -> tuple[str, str] | None:
    """(type, extension) by magic bytes, or None."""
    b = head or b""
    if b[:3] == b"ID3" or (len(b) > 1 and b[0] == 0xFF and b[1] in (0xFB, 0xF3, 0xF2)):
        return "audio/mpeg", "mp3"
    if b[:4] == b"fLaC":
        return "audio/x-flac", "flac"
    if b[:4] == b"OggS":
        return ("audio/opus", "opus") if b[28:36] == b"OpusHead" else ("audio/ogg", "ogg")
    if b[:4] == b"RIFF" and b[8:12] == b"WAVE":
        return "audio/x-wav", "wav"
    if b[:4] == b"RIFF" and b[8:12] == b"AVI ":
        return "video/x-msvideo", "avi"
    if len(b) > 1 and b[0] == 0xFF and b[1] in (0xF1, 0xF9):
        return "audio/aac", "aac"
    if b[4:8] == b"ftyp":
        brand = b[8:12]
        if brand == b"M4A ":
            return "audio/m4a", "m4a"
        if brand in (b"M4V ", b"M4VH", b"M4VP"):
            return "video/x-m4v", "m4v"
        if brand == b"qt  ":
            return "video/quicktime", "mov"
        return "video/mp4", "mp4"
    if b[:4] == b"\x1a\x45\xdf\xa3":
        return ("video/webm", "webm") if b"webm" in b[:64] else ("video/x-matroska", "mkv")
    if b[:4] == b"%PDF":
        return "application/pdf", "pdf"
    if b[:8] == b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        return "application/x-ole-storage", "msi"
    if b[60:68] == b"BOOKMOBI":
        return "application/x-mobipocket-ebook", "mobi"
    if b[:4] in (b"PK\x03\x04", b"PK\x05\x06", b"PK\x07\x08"):
        if b[30:58] == b"mimetypeapplication/epub+zip":
            return "application/epub+zip", "epub"
        for mark, ext, kind in ((b"word/", "docx", "wordprocessingml.document"), (b"xl/", "xlsx", "spreadsheetml.sheet"), (b"ppt/", "pptx", "presentationml.presentation")):
            if mark in b[:4096]:
                return f"application/vnd.openxmlformats-officedocument.{kind}", ext
        return "application/zip", "zip"
    return None


def looks_like_text(head: bytes | None) -> bool:
    """UTF-8 without NUL in the first 4096 bytes, of which nine in ten are printable ASCII or white space; empty counts."""
    part = (head or b"")[:4096]
    try:
        part.decode("utf-8")
    except UnicodeDecodeError:
        return False
    plain = sum(0x21 <= c <= 0x7E or c in b" \t\n\r\x0c" for c in part)
    return 0 not in part and plain * 100 >= len(part) * 90


def verify(kind: str, source_id: str | None, head: bytes | None) -> tuple[bool, str]:
    """(True, extension) or (False, reason)."""
    found = sniff(head)
    if found is None:
        if kind == "BinaryFile":
            return True, "bin"
        if kind == "DocumentFile" and looks_like_text(head):
            return True, "txt"
        return False, "unrecognized magic bytes"
    mime, ext = found
    if kind == "AudioFile":
        ok = mime in AUDIO_TYPES or (mime == "application/zip" and (source_id or "").endswith("-archive"))
    elif kind == "VideoFile":
        ok = mime in VIDEO_TYPES
    elif kind == "DocumentFile":
        ok = mime in DOCUMENT_TYPES or mime.startswith(DOCUMENT_PREFIXES)
    else:
        ok = True
    return (True, CANONICAL.get(mime, ext.lower())) if ok else (False, f"magic bytes say {mime}, expected {kind}")


def final_extension(kind: str, url: str | None, head: bytes | None) -> str:
    """The stored extension: by type, else the URL's suffix in lower case."""
    found = sniff(head)
    if found is None:
        return (url or "").split("?")[0].split("#")[0].rsplit(".", 1)[-1].lower()
    mime, ext = found
    if mime in ("audio/m4a", "video/mp4") and kind != "VideoFile":
        return "m4a"
    return CANONICAL.get(mime, ext)


def wav_probe(body: bytes | None) -> dict:
    """Duration and bitrate of a PCM WAV header; empty for anything else. Other formats come with probe columns."""
    try:
        with wave.open(io.BytesIO(body or b""), "rb") as w:
            seconds = w.getnframes() / w.getframerate()
            return {"duration_secs": seconds, "bitrate_kbps": w.getframerate() * w.getnchannels() * w.getsampwidth() * 8 // 1000}
    except (wave.Error, EOFError, ZeroDivisionError):
        return {}


VERDICT = StructType([StructField("ok", BooleanType()), StructField("extension", StringType()), StructField("reason", StringType())])
PROBE = StructType([StructField("duration_secs", DoubleType()), StructField("bitrate_kbps", IntegerType())])


@F.pandas_udf(VERDICT)
def verify_col(kind: pd.Series, source_id: pd.Series, head: pd.Series) -> pd.DataFrame:
    rows = [verify(k, s, bytes(h) if h is not None else None) for k, s, h in zip(kind, source_id, head, strict=True)]
    return pd.DataFrame({"ok": [r[0] for r in rows], "extension": pd.Series([r[1] if r[0] else None for r in rows], dtype=object), "reason": pd.Series([None if r[0] else r[1] for r in rows], dtype=object)})


@F.pandas_udf(StringType())
def final_extension_col(kind: pd.Series, url: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([final_extension(k, u, bytes(h) if h is not None else None) for k, u, h in zip(kind, url, head, strict=True)], dtype=object)


@F.pandas_udf(PROBE)
def wav_probe_col(body: pd.Series) -> pd.DataFrame:
    rows = [wav_probe(bytes(b) if b is not None else None) for b in body]
    return pd.DataFrame({n: pd.Series([r.get(n) for r in rows]) for n in PROBE.names})


def text_sniff(body: Column) -> Column:
    """looks_like_text by built-in functions; `body` is binary."""
    part = F.substring(F.coalesce(body, F.lit(b"")), 1, 4096)
    text = F.decode(part, "ISO-8859-1")
    plain = F.length(F.regexp_replace(text, r"[^\x21-\x7e \t\n\r\x0c]", ""))
    return F.is_valid_utf8(part.cast("string")) & ~text.contains("\x00") & (plain * 100 >= F.length(text) * 90)


def content_range_start(header: Column) -> Column:
    """N of 'bytes N-...', else null."""
    return F.nullif(F.regexp_extract(F.trim(header), r"^bytes\s+(\d+)-", 1), F.lit("")).try_cast("long")


def may_resume(header: Column, expected: Column) -> Column:
    return F.coalesce(content_range_start(header) == expected, F.lit(False))


def is_bulk_archive(kind: Column, source_id: Column) -> Column:
    return (kind == "AudioFile") & F.coalesce(source_id.endswith("-archive"), F.lit(False))


def size_cap(kind: Column, audio_cap: int = AUDIO_CAP) -> Column:
    return F.when(kind == "AudioFile", F.lit(audio_cap)).otherwise(F.lit(OTHER_CAP))


def outcome_class(status: Column) -> Column:
    """harvested, rejected or failed."""
    return F.when(status == "Success", "harvested").when(status.isin("ProbeFailed", "QualityRejected"), "rejected").otherwise("failed")
