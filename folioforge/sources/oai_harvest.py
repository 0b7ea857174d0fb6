"""OAI-PMH feeds as a Spark data source: windows of days, read in the tasks."""

from __future__ import annotations

import datetime as dt
import importlib
import urllib.parse
import urllib.request
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .oai import following, is_empty

SCHEMA = "start string, until string, page int, value string"


def get(url: str, params: dict[str, str]) -> str:
    with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(params)}", timeout=300) as answer:
        return answer.read().decode()


class Window(InputPartition):
    """Days from ``start`` until ``until``, both included."""

    def __init__(self, start: str, until: str) -> None:
        super().__init__((start, until))
        self.start, self.until = start, until


def windows(start: str, end: str, days: int) -> list[Window]:
    """Windows of ``days`` days from start up to end, which is not included."""
    at, stop, out = dt.date.fromisoformat(start), dt.date.fromisoformat(end), []
    while at < stop:
        after = min(at + dt.timedelta(days), stop)
        out.append(Window(at.isoformat(), (after - dt.timedelta(1)).isoformat()))
        at = after
    return out


class Harvest:
    """How a window is read, as options say (see OaiDataSource)."""

    def __init__(self, options: dict[str, str]) -> None:
        for needed in ("url", "from", "pages"):
            if needed not in options:
                raise ValueError(f"the source needs the option {needed}")
        self.url, self.folder, self.start = options["url"], options["pages"], options["from"]
        self.prefix, self.days, self.until, self.fetch = options.get("prefix", "oai_dc"), int(options.get("days", "1")), options.get("until"), options.get("fetch")
        if self.days < 1:
            raise ValueError("a window has 1 day or more")

    def end(self) -> str:
        """The day after the last one to read: that of ``until``, else today, which is not over."""
        return (dt.date.fromisoformat(self.until) + dt.timedelta(1)).isoformat() if self.until else dt.datetime.now(dt.UTC).date().isoformat()

    def read(self, window: Window) -> Iterator[tuple[str, str, int, str]]:
        """A window's pages. Each is saved before it is given on, and says itself which
        one follows; so a window that broke off goes on after its last saved page."""
        ask, n = get, 0
        if self.fetch:
            module, _, name = self.fetch.partition(":")
            ask = getattr(importlib.import_module(module), name)
        files, base = fs.FileSystem.from_uri(self.folder)
        base = f"{base}/{window.start}_{window.until}"
        asked: dict[str, str] | None = {"verb": "ListRecords", "metadataPrefix": self.prefix, "from": window.start, "until": window.until}
        while asked is not None:
            path = f"{base}/{n:06d}.xml"
            if files.get_file_info(path).type == fs.FileType.File:
                with files.open_input_stream(path) as f:
                    page = f.read().decode()
            else:
                page = ask(self.url, asked)
                is_empty(page)  # raises what is not to be saved
                files.create_dir(base)
                part = f"{base}/_{uuid.uuid4().hex}"
                with files.open_output_stream(part) as f:
                    f.write(page.encode())
                files.move(part, path)
            if is_empty(page):
                return
            yield window.start, window.until, n, page
            asked, n = following(page), n + 1


class _Batch(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.harvest = Harvest(options)

    def partitions(self) -> list[Window]:
        return windows(self.harvest.start, self.harvest.end(), self.harvest.days)

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.harvest.read(partition)


class _Stream(DataSourceStreamReader):
    """Offsets are days not yet read."""

    def __init__(self, options: dict[str, str]) -> None:
        self.harvest = Harvest(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"day": self.harvest.start}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"day": max(self.harvest.start, self.harvest.end())}

    def partitions(self, start: dict, end: dict) -> list[Window]:
        return windows(start["day"], end["day"], self.harvest.days)

    def read(self, partition: Window) -> Iterator[tuple]:
        return self.harvest.read(partition)


class OaiDataSource(DataSource):
    """``oai``: (start, until, page, value), a feed's ListRecords pages by window.

    Options: ``url``; ``from`` and ``until``, days included (until: yesterday);
    ``days`` of a window (1), each of which is a task; ``prefix`` of the metadata;
    ``pages``, a folder all executors share, as a URI or absolute path, where pages
    are saved as ``start_until/number.xml``; ``fetch``, a function
    ``module:name`` of (url, parameters) to the response's text, in place of HTTP.

    A page that is saved is not asked for again, so a folder belongs to one feed and
    prefix; without its folder a window is read anew. A window without records has
    no page. A feed that no longer knows a token raises an error: delete its window.
    A stream's checkpoint holds the days that were read.
    """

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Batch(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ANN001, N802
        return _Stream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(OaiDataSource)
