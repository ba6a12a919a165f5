"""Sources that come in pages or date slices, as Python data sources; the fetch is injected, so that nothing here needs a network."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date, timedelta
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


def bisected(since: date, until: date, count: Callable[[date, date], int], most: int) -> list[tuple[date, date]]:
    """Slices of a span of days, halved until each has at most that many records or is one day."""
    if since >= until or count(since, until) <= most:
        return [(since, until)]
    mid = since + timedelta(days=(until - since).days // 2)
    return bisected(since, mid, count, most) + bisected(mid + timedelta(days=1), until, count, most)


def resolved(name: str) -> Callable:
    module, _, f = name.partition(":")
    return getattr(import_module(module), f)


#: Answers after which a request may be tried again.
AGAIN = (429, 500, 502, 503, 504)


def waits(tries: int, first: float = 1.0, most: float = 60.0, jitter: Callable[[], float] = lambda: 0.0) -> list[float]:
    """Seconds before each new try: doubled from the first up to the most, with up to as much again."""
    return [min(most, first * 2**k) * (1 + jitter()) for k in range(tries)]


def patient(request: Callable[[], tuple[int, dict, object]], sleep: Callable[[float], None], tries: int = 5, **kind) -> object:
    """The body of the first good answer. request gives status, headers and body; a server that names a wait is waited for as long, other refusals are errors at once."""
    for wait in [*waits(tries - 1, **kind), None]:
        status, headers, body = request()
        if status < 400:
            return body
        if status not in AGAIN or wait is None:
            raise OSError(f"status {status}")
        named = headers.get("Retry-After", "")
        sleep(float(named) if named.replace(".", "", 1).isdigit() else wait)
    raise AssertionError


class Paced:
    """At least so many seconds between two requests to one host."""

    def __init__(self, seconds: float, clock: Callable[[], float], sleep: Callable[[float], None]) -> None:
        self.seconds, self.clock, self.sleep, self.last = seconds, clock, sleep, {}

    def wait(self, host: str) -> None:
        if (early := self.last.get(host, float("-inf")) + self.seconds - self.clock()) > 0:
            self.sleep(early)
        self.last[host] = self.clock()


class Slice(InputPartition):
    def __init__(self, since: str, until: str) -> None:
        self.since, self.until = since, until


class SlicedSource(DataSource):
    """spark.read.format("sliced"): options since, until, most, count and fetch (module:function); one partition a slice."""

    @classmethod
    def name(cls) -> str:
        return "sliced"

    def schema(self) -> str:
        return "id string, title string, day string"

    def reader(self, schema):
        return SlicedReader(self.options)


class SlicedReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.options = options

    def partitions(self):
        o = self.options
        slices = bisected(date.fromisoformat(o["since"]), date.fromisoformat(o["until"]), resolved(o["count"]), int(o.get("most", "1000")))
        return [Slice(a.isoformat(), b.isoformat()) for a, b in slices]

    def read(self, partition: Slice) -> Iterator[tuple]:
        yield from resolved(self.options["fetch"])(date.fromisoformat(partition.since), date.fromisoformat(partition.until))


class PagedSource(DataSource):
    """spark.readStream.format("paged"): option fetch (module:function from a cursor to rows and the next cursor); Spark's log keeps the cursor."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "id string, title string"

    def simpleStreamReader(self, schema):
        return PagedReader(self.options)


class PagedReader(SimpleDataSourceStreamReader):
    def __init__(self, options) -> None:
        self.fetch = resolved(options["fetch"])

    def initialOffset(self) -> dict:
        return {"cursor": 0}

    def read(self, start: dict):
        rows, cursor = self.fetch(start["cursor"])
        return iter(rows), {"cursor": cursor}

    def readBetweenOffsets(self, start: dict, end: dict):
        cursor = start["cursor"]
        while cursor != end["cursor"]:
            rows, cursor = self.fetch(cursor)
            yield from rows
