"""Python data sources over landed files: catalog pages by ranges of their offset, and messages pulled in bounded batches.

Tasks read the files through Arrow's file systems, from a folder that all executors see. Register both with `register`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Most messages of a pulled batch (fixed value).
PULL = 500


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)
    spark.dataSource.register(PulledMessages)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Offsets(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class LandedPages(DataSource):
    """(offset, body): pages that were landed as one file for each offset, `name` with the offset filled in.

    Options: path, name ({offset}.json), page (200: from one offset to the next), pages (100: offsets of a task) and last, the
    greatest offset; without it the folder's names are looked through for it. Offsets without a file give no row; nothing of a page is seen by the driver.
    """

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self) -> str:
        return "offset long, body string"

    def reader(self, schema) -> DataSourceReader:
        return LandedPagesReader(self.options)


class LandedPagesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.pattern = options["path"].rstrip("/"), options.get("name", "{offset}.json")
        self.page, self.pages, self.end = int(options.get("page", 200)), int(options.get("pages", 100)), options.get("last")

    def _last(self) -> int:
        """The greatest offset of any name; one number is kept."""
        system, top = _place(self.path)
        before, after = (len(x) for x in self.pattern.split("{offset}"))
        most = -1
        for info in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)):
            number = info.base_name[before : len(info.base_name) - after or None]
            if number.isdigit() and self.pattern.format(offset=number) == info.base_name:
                most = max(most, int(number))
        return most

    def partitions(self) -> list[Offsets]:
        last, step = int(self.end) if self.end is not None else self._last(), self.page * self.pages
        return [Offsets(first, min(first + step, last + 1)) for first in range(0, last + 1, step)] or [Offsets(0, 0)]

    def read(self, partition: Offsets) -> Iterator[pa.RecordBatch]:
        system, top = _place(self.path)
        for offset in range(partition.first, partition.last, self.page):
            name = f"{top}/{self.pattern.format(offset=offset)}"
            if system.get_file_info(name).type == pafs.FileType.File:
                with system.open_input_stream(name) as f:
                    yield pa.RecordBatch.from_pydict({"offset": pa.array([offset], pa.int64()), "body": pa.array([f.read().decode("utf-8", "replace")])})


class Lines(InputPartition):
    def __init__(self, name: str, first: int, last: int):
        self.name, self.first, self.last = name, first, last


class PulledMessages(DataSource):
    """A stream of (value, file, line) of text files of messages, in order of file names, at most min(`batch`, 500) a micro-batch.

    Options: path, batch (500). An offset is the file and line that were read last, so a restart goes on behind it; landed files
    do not change, and later files have greater names.
    """

    @classmethod
    def name(cls) -> str:
        return "pulled_messages"

    def schema(self) -> str:
        return "value string, file string, line long"

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return PulledMessagesReader(self.options)


class PulledMessagesReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.most = options["path"].rstrip("/"), min(int(options.get("batch", PULL)), PULL)
        self.at: dict | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"file": "", "line": 0}

    def _files(self, start: str) -> list[str]:
        """Names not before one, hidden ones left out."""
        system, top = _place(self.path)
        names = [i.base_name for i in system.get_file_info(pafs.FileSelector(top, allow_not_found=True)) if i.type == pafs.FileType.File]
        return sorted(n for n in names if n >= start and not n.startswith((".", "_")))

    def _lines(self, name: str) -> Iterator[bytes]:
        """The lines of a file, some bytes at a time."""
        system, top = _place(self.path)
        rest = b""
        with system.open_input_stream(f"{top}/{name}") as f:
            while piece := f.read(1 << 20):
                *whole, rest = (rest + piece).split(b"\n")
                yield from whole
        if rest:
            yield rest

    def _spans(self, start: dict, most: int) -> Iterator[Lines]:
        """Runs of lines behind an offset, `most` lines in all."""
        for name in self._files(start["file"]):
            first = start["line"] if name == start["file"] else 0
            n = 0
            for k, _ in enumerate(self._lines(name)):
                n += k >= first
                if n == most:
                    break
            if n:
                yield Lines(name, first, first + n)
            most -= n
            if not most:
                return

    def latestOffset(self) -> dict:  # noqa: N802
        if self.at is None:
            self.at = self.initialOffset()
        for span in self._spans(self.at, self.most):
            self.at = {"file": span.name, "line": span.last}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Lines]:
        if self.at is None:  # the first call after a restart is for the last batch that was planned
            self.at = end
        found = []
        for name in self._files(start["file"]):
            if name > end["file"]:
                break
            found.append(Lines(name, start["line"] if name == start["file"] else 0, end["line"] if name == end["file"] else -1))
        return found

    def read(self, partition: Lines) -> Iterator[tuple]:
        for k, line in enumerate(self._lines(partition.name)):
            if partition.last >= 0 and k >= partition.last:
                break
            if k >= partition.first:
                yield line.decode("utf-8", "replace"), partition.name, k

    def commit(self, end: dict) -> None:
        pass
