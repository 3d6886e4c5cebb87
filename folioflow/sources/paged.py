"""A source of paged records, in batch and as a stream: one partition for each page.

Pages come from a function of (start, count) that is a public HTTP endpoint in use and local files in tests.
A page that fails is asked for again, each time after a longer wait; a page without rows before the end is an error.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "type string, name string, agency string, title string, level string, docDate string, amended string"


class Page(InputPartition):
    def __init__(self, start: int, count: int) -> None:
        super().__init__((start, count))
        self.start, self.count = start, count


class PagedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.url = options["url"]
        self.size = int(options.get("pagesize", 1000))
        self.attempts = int(options.get("attempts", 4))
        self.wait = float(options.get("wait", 3))
        self.timeout = float(options.get("timeout", 30))
        self.delay = float(options.get("delay", 2))

    def fetch(self, start: int, count: int) -> dict:
        address = self.url.format(start=start, count=count)
        for attempt in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(address, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError):
                if attempt == self.attempts:
                    raise
                time.sleep(self.wait * attempt)
        raise AssertionError

    def partitions(self) -> list[Page]:
        total = int(self.fetch(0, 1).get("recordsTotal") or 0)
        if total <= 0:
            raise ValueError("the source declares no records")
        return [Page(at, min(self.size, total - at)) for at in range(0, total, self.size)]

    def rows(self, page: Page) -> list[dict]:
        # Pages are read side by side, so each waits its own turn before it asks; the first doesn't.
        time.sleep(self.delay if page.start else 0)
        rows = self.fetch(page.start, page.count).get("data") or []
        if not rows:
            raise ValueError(f"no rows from {page.start} on, before the declared end")
        return rows

    def read(self, partition: Page) -> Iterator[tuple]:
        yield from map(_record, self.rows(partition))


def _record(row: dict) -> tuple:
    return tuple(row.get(f.split()[0]) for f in SCHEMA.split(", "))


class PagedStream(DataSourceStreamReader):
    """New records of a source that adds them at its end, each once. An offset is the number of records before it.

    A batch goes from the last offset to the number of records that the source declares, in pages; Spark keeps both in the
    query's checkpoint before it reads, so a batch that broke off is read again with the same bounds. A page must have all the rows
    that were declared, for those it lacks would never be asked for again. Option from: the first offset of a new query.
    """

    def __init__(self, options: dict) -> None:
        self.pages = PagedReader(options)
        self.first = int(options.get("from", 0))
        self.committed = self.first

    def initialOffset(self) -> dict:
        return {"records": self.first}

    def latestOffset(self) -> dict:
        total = int(self.pages.fetch(0, 1).get("recordsTotal") or 0)
        if total < self.committed:
            raise ValueError(f"the source declares {total} records, {self.committed} were read before")
        return {"records": max(total, self.first)}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        low, high = start["records"], end["records"]
        if high < low:
            raise ValueError(f"the source declares {high} records, {low} were read before")
        return [Page(at, min(self.pages.size, high - at)) for at in range(low, high, self.pages.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        rows = self.pages.rows(partition)
        if len(rows) < partition.count:
            raise ValueError(f"{len(rows)} of {partition.count} rows from {partition.start} on")
        yield from map(_record, rows[: partition.count])

    def commit(self, end: dict) -> None:
        self.committed = end["records"]


class PagedSource(DataSource):
    """Options: url with {start} and {count}, pagesize, attempts, wait, timeout, delay (seconds before each page but the first); of a stream also from."""

    @classmethod
    def name(cls) -> str:
        return "paged_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
