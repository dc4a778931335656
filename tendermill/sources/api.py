"""A live paged JSON API as a Spark data source: one partition for each mode and state, pages read inside the tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition

from ..runtime import ship


class Pages(InputPartition):
    """Pages of a mode and state: from ``page`` on, or of that page alone the rows ``lo`` to ``hi``."""

    def __init__(self, mode: str, state: str, page: int = 1, lo: int = 0, hi: int | None = None):
        self.mode, self.state, self.page, self.lo, self.hi = mode, state, page, lo, hi


class _Client:
    """Asks for pages; what a batch reader and a stream reader share."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def listed(self, name: str) -> list[str]:
        return [x.strip() for x in self.options.get(name, "").split(",") if x.strip()]

    def rows(self, mode: str, state: str, page: int) -> tuple[list[dict], int | None]:
        """The rows of a page, and how many pages there are, if the answer says so."""
        got = self._page(self.options["url"].format(mode=mode, state=state, page=page)) or {}
        total = got.get("totalPaginas")
        return got.get("data") or [], None if total is None else int(total)

    def _page(self, url: str) -> dict | None:
        """A page, or null where there is none (204, 404, an empty body); other errors are tried again, then raised."""
        tries = int(self.options.get("tries", "3"))
        for n in range(tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as reply:
                    body = reply.read()
                return json.loads(body) if body.strip() else None
            except urllib.error.HTTPError as e:
                if e.code in (204, 404):
                    return None
                last: Exception = e
            except urllib.error.URLError as e:
                if isinstance(e.reason, FileNotFoundError):
                    return None
                last = e
            time.sleep(min(30, 2**n))
        raise last


class PagedApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.client = _Client(options)

    def partitions(self) -> list[InputPartition]:
        # Spark makes one empty partition of an empty list, and the reader answers it with nothing
        return [Pages(m, s) for m in self.client.listed("modes") for s in self.client.listed("states")]

    def read(self, partition: Pages | None) -> Iterator[tuple[str, str, int, str]]:
        if partition is None:
            return
        mode, state, page = partition.mode, partition.state, partition.page
        while True:
            rows, total = self.client.rows(mode, state, page)
            for r in rows:
                yield mode, state, page, json.dumps(r, ensure_ascii=False)
            if not rows or (total is not None and page >= total):
                return
            page += 1


class PushingReader(PagedApiReader):
    """Also takes equality and lists on ``mode`` and ``state``, so that other partitions are never asked for; the rest is Spark's."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        options = self.client.options
        for f in filters:
            allowed = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if allowed is not None and f.attribute in (("mode",), ("state",)):
                name = f"{f.attribute[0]}s"
                options[name] = ",".join(x for x in self.client.listed(name) if x in allowed)
            else:
                yield f


class PagedApiStream(DataSourceStreamReader):
    """Pages as a stream: of every mode and state, the offset is the last page and how many of its rows have been read.

    The API only ever adds rows, at the end of the last page or on new pages. An offset is made from what the API has just now, so a
    batch is the rows between two offsets, a partition for each page, and reads the same rows when it is run again.
    """

    def __init__(self, options: dict[str, str]):
        self.client = _Client(options)

    def initialOffset(self) -> dict:
        return {f"{m}|{s}": [1, 0] for m in self.client.listed("modes") for s in self.client.listed("states")}

    def latestOffset(self) -> dict:
        return {key: self._end(*key.split("|", 1)) for key in self.initialOffset()}

    def _end(self, mode: str, state: str) -> list[int]:
        rows, total = self.client.rows(mode, state, 1)
        page = 1
        if total is None:  # unknown: as far as there are rows
            while rows and (more := self.client.rows(mode, state, page + 1)[0]):
                page, rows = page + 1, more
        elif total > 1:
            page, rows = total, self.client.rows(mode, state, total)[0]
        return [page, len(rows)]

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = []
        for key, (last, rows) in end.items():
            mode, state = key.split("|", 1)
            first, seen = start.get(key, [1, 0])
            for page in range(first, last + 1):
                lo, hi = seen if page == first else 0, rows if page == last else None
                if hi is None or lo < hi:
                    found.append(Pages(mode, state, page, lo, hi))
        return found

    def read(self, partition: Pages | None) -> Iterator[tuple[str, str, int, str]]:
        if partition is None:
            return
        rows, _ = self.client.rows(partition.mode, partition.state, partition.page)
        for r in rows[partition.lo : partition.hi]:
            yield partition.mode, partition.state, partition.page, json.dumps(r, ensure_ascii=False)


class PagedApi(DataSource):
    """Options: ``url`` with ``{mode}``, ``{state}`` and ``{page}``; ``modes`` and ``states`` as lists with commas; ``tries``; ``pushdown``.

    ``spark.dataSource.register(PagedApi)``, then ``spark.read.format("paged_api")`` or ``spark.readStream``. ``pushdown=true`` takes
    filters, for sessions with ``spark.sql.python.filterPushdown.enabled`` (Spark refuses such a reader otherwise); ``read_api`` sets
    it as the session has it. Land the rows of a batch read before use, as the API may answer differently when a lost task reads again.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_api"

    def schema(self) -> str:
        return "mode string, state string, page int, json string"

    def reader(self, schema) -> DataSourceReader:
        kind = PushingReader if str(self.options.get("pushdown", "false")).lower() == "true" else PagedApiReader
        return kind(dict(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedApiStream(dict(self.options))


def read_api(spark: SparkSession, **options: str) -> DataFrame:
    """The live source as a table, with filters pushed where the session allows it."""
    ship(spark)
    spark.dataSource.register(PagedApi)
    push = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("paged_api").options(pushdown=push, **options).load()


def stream_api(spark: SparkSession, **options: str) -> DataFrame:
    """The live source as a stream; a restarted query goes on at the row where its checkpoint is."""
    ship(spark)
    spark.dataSource.register(PagedApi)
    return spark.readStream.format("paged_api").options(**options).load()
