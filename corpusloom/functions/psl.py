"""Registrable domains by the public suffix list.

The list is the copy inside one of Spark's own jars; each Python worker reads it once, and it is evaluated by longest rule. Without it
there is no right answer, so its absence is an error.
"""

from __future__ import annotations

import glob
import os
import zipfile
from functools import lru_cache


def jar_folder() -> str:
    import pyspark

    home = os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__)
    return os.path.join(home, "jars")


@lru_cache(maxsize=1)
def rules() -> frozenset[str]:
    """All rules, private ones included, as written ('*.ck', '!www.ck', 'co.uk')."""
    import pyspark

    for folder in (jar_folder(), os.path.join(os.path.dirname(pyspark.__file__), "jars")):
        for jar in sorted(glob.glob(os.path.join(folder, "httpclient-4*.jar"))):
            with zipfile.ZipFile(jar) as z:
                text = z.read("mozilla/public-suffix-list.txt").decode("utf-8")
            found = set()
            for line in text.splitlines():
                rule = line.strip().split(" ")[0]
                if rule and not rule.startswith("//"):
                    found.add(rule)
                    if not rule.isascii():
                        try:
                            found.add(".".join(x if x in ("*",) else x.encode("idna").decode() for x in rule.split(".")))
                        except UnicodeError:
                            pass
            return frozenset(found)
    raise FileNotFoundError("no public suffix list: Spark's httpclient jar was not found under " + jar_folder())


def registrable(host: str, known: frozenset[str] | None = None) -> str | None:
    """The public suffix of a lower-case host and one label more; None if the host is itself a suffix."""
    known = rules() if known is None else known
    labels = host.rstrip(".").split(".")
    if not all(labels):
        return None
    size = 1
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        if "!" + name in known:
            size = len(labels) - i - 1
            break
        if name in known:
            size = max(size, len(labels) - i)
        if i + 1 < len(labels) and "*." + ".".join(labels[i + 1 :]) in known:
            size = max(size, len(labels) - i)
    return ".".join(labels[-size - 1 :]) if len(labels) > size else None
