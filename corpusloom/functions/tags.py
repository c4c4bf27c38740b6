"""Duration, bitrate and tags of audio files from their bytes: WAV, MP3, FLAC, Ogg Vorbis and Opus, MPEG-4.

Only headers and tags are read; no sound is decoded. What a file does not say is None, and bytes of no known kind give an
empty result.
"""

from __future__ import annotations

import io
import re
import struct
import wave

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

TAGS = ("title", "artist", "album", "genre", "year")
#: kbit/s of MPEG-1 layer III and of MPEG-2/2.5 layer III, by the header's index; sample rates of MPEG-1 (fixed values).
MPEG1_RATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
MPEG2_RATES = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
MPEG1_HZ = [44100, 48000, 32000]
#: Frames of ID3v2 (versions 2.3 and 2.4, and 2.2) and atoms of MPEG-4 by tag (fixed values).
ID3_FRAMES = {"TIT2": "title", "TPE1": "artist", "TALB": "album", "TCON": "genre", "TDRC": "year", "TYER": "year", "TT2": "title", "TP1": "artist", "TAL": "album", "TCO": "genre", "TYE": "year"}
MP4_ATOMS = {b"\xa9nam": "title", b"\xa9ART": "artist", b"\xa9alb": "album", b"\xa9gen": "genre", b"\xa9day": "year"}
VORBIS_FIELDS = {"title": "title", "artist": "artist", "album": "album", "genre": "genre", "date": "year", "year": "year"}


def _kept(found: dict[str, str]) -> dict:
    """Tags without blank ones; a year is its first four digits."""
    out: dict = {k: v for k, v in found.items() if v and v.strip() and k != "year"}
    year = re.match(r"\s*(\d{4})", found.get("year") or "")
    return out | ({"year": int(year[1])} if year else {})


def _rate(size: int, seconds: float) -> int | None:
    return int(size * 8 / seconds / 1000) if seconds else None


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3_text(data: bytes) -> str:
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(data[0] if data else 0, "latin-1")
    return data[1:].decode(codec, "replace").split("\0")[0]


def _id3(body: bytes) -> tuple[dict, int]:
    """Tags of a leading ID3v2 block and where it ends."""
    if body[:3] != b"ID3" or len(body) < 10:
        return {}, 0
    version, end, at, found = body[3], 10 + _synchsafe(body[6:10]), 10, {}
    head = 6 if version == 2 else 10
    while at + head <= min(end, len(body)):
        name = body[at : at + (3 if version == 2 else 4)].decode("latin-1")
        if not name.strip("\0"):
            break
        raw = body[at + 3 : at + 6] if version == 2 else body[at + 4 : at + 8]
        size = _synchsafe(raw) if version == 4 else int.from_bytes(raw, "big")
        if name in ID3_FRAMES:
            found.setdefault(ID3_FRAMES[name], _id3_text(body[at + head : at + head + size]))
        at += head + size
    return _kept(found), end


def _mp3(body: bytes) -> dict:
    tags, at = _id3(body)
    while at + 4 <= len(body):
        a, b, c, d = body[at : at + 4]
        version, layer, index, hz = b >> 3 & 3, b >> 1 & 3, c >> 4, c >> 2 & 3
        if a == 0xFF and b & 0xE0 == 0xE0 and version != 1 and layer == 1 and 0 < index < 15 and hz < 3:
            break
        at += 1
    else:
        return tags
    first = version == 3
    kbps, rate = (MPEG1_RATES if first else MPEG2_RATES)[index], MPEG1_HZ[hz] >> (0 if first else 1 if version == 2 else 2)
    samples, mono = 1152 if first else 576, d >> 6 == 3
    side = at + 4 + ((17 if mono else 32) if first else (9 if mono else 17))
    size = len(body) - at - (128 if body[-128:-125] == b"TAG" else 0)
    if body[side : side + 4] in (b"Xing", b"Info") and body[side + 7] & 1:
        seconds = int.from_bytes(body[side + 8 : side + 12], "big") * samples / rate
        return tags | {"duration_secs": seconds, "bitrate_kbps": _rate(size, seconds)}
    return tags | {"duration_secs": size / (kbps * 125), "bitrate_kbps": kbps}


def _comments(data: bytes) -> dict:
    """Vorbis comments: vendor, then fields of the form name=value."""
    found: dict[str, str] = {}
    at = 4 + int.from_bytes(data[:4], "little")
    count, at = int.from_bytes(data[at : at + 4], "little"), at + 4
    for _ in range(count):
        size = int.from_bytes(data[at : at + 4], "little")
        name, _, value = data[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if name.lower() in VORBIS_FIELDS:
            found.setdefault(VORBIS_FIELDS[name.lower()], value)
        at += 4 + size
        if at >= len(data):
            break
    return _kept(found)


def _flac(body: bytes) -> dict:
    at, out, last = 4, {}, False
    while not last and at + 4 <= len(body):
        last, kind, size = bool(body[at] >> 7), body[at] & 127, int.from_bytes(body[at + 1 : at + 4], "big")
        data, at = body[at + 4 : at + 4 + size], at + 4 + size
        if kind == 0 and len(data) >= 18:
            packed = int.from_bytes(data[10:18], "big")
            rate, total = packed >> 44, packed & (1 << 36) - 1
            if rate:
                out["duration_secs"] = total / rate
        elif kind == 4:
            out |= _comments(data)
    return out | ({"bitrate_kbps": _rate(len(body) - at, out["duration_secs"])} if out.get("duration_secs") else {})


def _ogg(body: bytes) -> dict:
    at, packets, open_, granule = 0, [], b"", 0
    while body[at : at + 4] == b"OggS" and at + 27 <= len(body):
        place = struct.unpack_from("<q", body, at + 6)[0]
        granule = place if place > 0 else granule
        sizes = body[at + 27 : at + 27 + body[at + 26]]
        at += 27 + len(sizes)
        for size in sizes:
            if len(packets) < 2:
                open_ += body[at : at + size]
                if size < 255:
                    packets.append(open_)
                    open_ = b""
            at += size
    if not packets:
        return {}
    head, tags = packets[0], packets[1] if len(packets) > 1 else b""
    if head[:8] == b"OpusHead":
        seconds, notes = max(0, granule - int.from_bytes(head[10:12], "little")) / 48000, _comments(tags[8:]) if tags[:8] == b"OpusTags" else {}
        return notes | {"duration_secs": seconds, "bitrate_kbps": _rate(len(body), seconds)}
    if head[:7] == b"\x01vorbis":
        rate, nominal = struct.unpack_from("<I", head, 12)[0], struct.unpack_from("<i", head, 20)[0]
        seconds = granule / rate if rate else 0.0
        notes = _comments(tags[7:]) if tags[:7] == b"\x03vorbis" else {}
        return notes | {"duration_secs": seconds, "bitrate_kbps": nominal // 1000 if nominal > 0 else _rate(len(body), seconds)}
    return {}


def _atoms(body: bytes, at: int, end: int):
    while at + 8 <= end:
        size, name, head = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(body[at + 8 : at + 16], "big"), 16
        size = size or end - at
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def _mp4(body: bytes) -> dict:
    out, found, media = {}, {}, 0

    def walk(at: int, end: int) -> None:
        nonlocal media
        for name, a, b in _atoms(body, at, end):
            if name in (b"moov", b"udta", b"ilst"):
                walk(a, b)
            elif name == b"meta":
                walk(a + 4, b)
            elif name == b"mvhd":
                scale, length = struct.unpack_from(">IQ", body, a + 20) if body[a] == 1 else struct.unpack_from(">II", body, a + 12)
                if scale:
                    out["duration_secs"] = length / scale
            elif name == b"mdat":
                media += b - a
            elif name in MP4_ATOMS:
                for kind, c, d in _atoms(body, a, b):
                    if kind == b"data":
                        found.setdefault(MP4_ATOMS[name], body[c + 8 : d].decode("utf-8", "replace"))

    walk(0, len(body))
    return out | _kept(found) | ({"bitrate_kbps": _rate(media, out["duration_secs"])} if out.get("duration_secs") and media else {})


def _wav(body: bytes) -> dict:
    with wave.open(io.BytesIO(body), "rb") as w:
        return {"duration_secs": w.getnframes() / w.getframerate(), "bitrate_kbps": w.getframerate() * w.getnchannels() * w.getsampwidth() * 8 // 1000}


def probe(body: bytes | None) -> dict:
    """What the bytes say of duration_secs, bitrate_kbps, title, artist, album, genre and year."""
    b = body or b""
    try:
        if b[:4] == b"RIFF":
            return _wav(b)
        if b[:4] == b"fLaC":
            return _flac(b)
        if b[:4] == b"OggS":
            return _ogg(b)
        if b[4:8] == b"ftyp":
            return _mp4(b)
        if b[:3] == b"ID3" or (len(b) > 1 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0):
            return _mp3(b)
    except (struct.error, IndexError, wave.Error, EOFError, ZeroDivisionError):
        pass
    return {}


PROBED = StructType([StructField("duration_secs", DoubleType()), StructField("bitrate_kbps", IntegerType()), *[StructField(t, StringType()) for t in TAGS[:4]], StructField("year", IntegerType())])


@F.pandas_udf(PROBED)
def probe_col(body: pd.Series) -> pd.DataFrame:
    rows = [probe(bytes(b) if b is not None else None) for b in body]
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype="Int32" if isinstance(f.dataType, IntegerType) else object if isinstance(f.dataType, StringType) else float) for f in PROBED.fields})
