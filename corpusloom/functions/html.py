"""Page extraction: decode bytes, parse once, return all fields as one struct."""

from __future__ import annotations

import codecs
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from . import tree, urls
from .memory import release

#: Labels that the encoding standard reads as another encoding (fixed values).
LABELS = {"iso-8859-1": "windows-1252", "latin1": "windows-1252", "l1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "iso8859-1": "windows-1252", "gb2312": "gbk", "x-sjis": "shift_jis", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8"}


def codec(label: str | None) -> str | None:
    if not label:
        return None
    name = label.strip().strip("\"'").lower()
    try:
        return codecs.lookup(LABELS.get(name, name)).name
    except LookupError:
        return None


def param(text: str, key: str) -> str | None:
    m = re.search(rf"{key}=(?:\"([^\"]*)\"|'([^']*)'|([^ \t;>]*))", text, re.I)
    return next((x for x in m.groups() if x), None) if m else None


def decode_page(body: bytes | None, content_type: str | None) -> str | None:
    """Header charset, then byte order mark, then a meta charset in the first 2048 bytes, then UTF-8; unknown labels fall through."""
    if body is None:
        return None
    name = codec(param(content_type or "", "charset"))
    if name is None:
        for mark, kind in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
            if body.startswith(mark):
                return body[len(mark) :].decode(kind, "replace")
        head = body[:2048].decode("latin-1")
        for m in re.finditer(r"<meta", head, re.I):
            name = codec(param(head[m.start() :].split(">", 1)[0] + ">", "charset"))
            if name:
                break
    text = body.decode(name or "utf-8", "replace")
    return text.removeprefix("﻿")


def _extension(url: str) -> str:
    last = re.split(r"[?#]", url, maxsplit=1)[0].rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[-1].lower() if "." in last else ""


def extract(html: str | None, base: str | None) -> dict | None:
    """title, description, lang, canonical, text, skeleton, links, audio, video, docs of a page; None without html."""
    if html is None:
        return None
    page = tree.parse(html)
    elements = [n for n in tree.walk(page.document) if n.name[0] != "#"]
    first = lambda fits: next((n for n in elements if fits(n)), None)
    title, top = first(lambda n: n.name == "title"), first(lambda n: n.name == "html")
    described = first(lambda n: n.name == "meta" and n.attrs.get("name") == "description")
    canonical = first(lambda n: n.name == "link" and n.attrs.get("rel") == "canonical")
    root = urls.parse(base)
    links, media = [], {"audio": [], "video": [], "docs": []}

    def push(kind: str, href: str) -> None:
        url = urls.parse(href, root) if href else None
        if url is not None and url.scheme in ("http", "https") and str(url) not in media[kind]:
            media[kind].append(str(url))

    kinds = [(k, dict.fromkeys(v)) for k, v in (("audio", urls.AUDIO), ("video", urls.VIDEO), ("docs", urls.DOCUMENT))]
    for href, rel in [(n.attrs["href"], n.attrs.get("rel", "")) for n in elements if n.name == "a" and "href" in n.attrs]:
        url = urls.parse(href, root)
        if url is not None:
            links.append(str(urls.replace(url, fragment=None)))
        ext = _extension(href)
        for kind, known in kinds:
            if ext in known or (kind == "audio" and "enclosure" in rel.lower().split()):
                push(kind, href)
    for src in [n.attrs["src"] for n in elements if n.name in ("audio", "source", "embed") and "src" in n.attrs]:
        push("audio", src)
    return {
        "title": None if title is None else " ".join(n.text for n in tree.walk(title) if n.name == "#text"),
        "description": described and described.attrs.get("content"),
        "lang": top and top.attrs.get("lang"),
        "canonical": canonical and canonical.attrs.get("href"),
        # texts and names in the order in which the parser made them, which for repaired markup is not that of the tree
        "text": " ".join(t for n in page.created if n.name == "#text" and (t := n.text.strip())),
        "skeleton": "".join(f"<{n.name}>" for n in page.created if n.name != "#text"),
        "links": links,
        **media,
    }


_TEXTS = ["title", "description", "lang", "canonical", "text", "skeleton"]
_LISTS = ["links", "audio", "video", "docs"]
PAGE = StructType([StructField(n, StringType()) for n in _TEXTS] + [StructField(n, ArrayType(StringType())) for n in _LISTS])


#: Pages that are parsed before their fields are packed.
PACK = 64
_PACKED = pa.struct([(n, pa.string()) for n in _TEXTS] + [(n, pa.list_(pa.string())) for n in _LISTS])


@F.arrow_udf(PAGE)
def extract_page(html: pa.Array, base: pa.Array) -> pa.Array:
    """All fields of a page from one parse. Select the struct once and read its fields after it.

    The fields are packed PACK pages at a time, so a worker holds the Python objects of these alone, however many pages Spark hands over at once, and gives back what
    it no longer needs."""
    packed = []
    for first in range(0, len(html), PACK):
        pages = zip(html.slice(first, PACK).to_pylist(), base.slice(first, PACK).to_pylist(), strict=True)
        packed.append(pa.array([extract(h, b) or {} for h, b in pages], _PACKED))
    whole = pa.concat_arrays(packed) if packed else pa.array([], _PACKED)
    release()
    return whole


@F.pandas_udf(StringType())
def decode_page_col(body: pd.Series, content_type: pd.Series) -> pd.Series:
    return pd.Series([decode_page(bytes(b) if b is not None else None, c) for b, c in zip(body, content_type, strict=True)], dtype=object)
