"""A paged REST scan as a Python data source: runs of dates as partitions (SRC1), or one for an index list (SRC2).

``spark.read.format("disclosure_rest").option("start", "2022-01-01").option("days", 3).option("url", ...)``; ``readStream``
takes the same options and goes on from date to date. Options: ``dates_per_task`` (1), ``paged`` (false: one answer a
date; true: ?page=0, 1, ... until an answer has no records), ``path`` of the records in the answer, ``pause`` between
requests, ``header.<name>``, ``fetcher`` (module:function of url and headers; a plain HTTP GET by default).
Comparisons of ``date`` with constants are pushed down where ``registered`` has set that up: other dates are not
asked for. A status other than 200 gives no rows; connections are closed; requests of one partition are paced.
"""

from __future__ import annotations

import datetime as dt
import importlib
import itertools
import json
import operator
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual


def http_get(url: str, headers: dict[str, str], timeout: float = 15.0) -> tuple[int, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, r.read().decode("utf-8")
    except urllib.error.HTTPError as e:
        return e.code, ""


def date_urls(base: str, start: str, days: int) -> list[tuple[str, str]]:
    """(ISO date, URL) with unpadded year/month/day."""
    first = dt.date.fromisoformat(start)
    dates = [first + dt.timedelta(days=k) for k in range(days)]
    return [(d.isoformat(), f"{base.rstrip('/')}/{d.year}/{d.month}/{d.day}") for d in dates]


def registered(spark: SparkSession) -> None:
    """Make the source known to the session, and let Spark offer it filters."""
    spark.dataSource.register(RestSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of(options: dict, dated: list[tuple[str, str]]) -> Iterator[tuple]:
    """(date, record as JSON) of all pages of some dates."""
    o = options
    module, _, name = o.get("fetcher", "disclore.sources.rest:http_get").partition(":")
    fetch = getattr(importlib.import_module(module), name)
    headers = {k[7:]: v for k, v in o.items() if k.startswith("header.")}
    for date, url in dated:
        for page in itertools.count():
            time.sleep(float(o.get("pause", 0.1)))
            paged = o.get("paged", "false").lower() == "true"
            status, body = fetch(f"{url}?page={page}" if paged else url, headers)
            if status != 200:
                break
            node = json.loads(body)
            for part in o.get("path", "mayaReports.result").split("."):
                node = node.get(part) if isinstance(node, dict) else None
            for record in node or []:
                yield date, json.dumps(record, ensure_ascii=False)
            if not paged or not node:
                break


class RestReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.kept = dict(options), []

    def pushFilters(self, filters: list) -> Iterator:
        """Comparisons of the date are dealt with by asking for those dates alone; the others are left to Spark."""
        tests = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda d, values: d in values}
        for f in filters:
            if type(f) in tests and f.attribute == ("date",) and "start" in self.options and f.value is not None:
                self.kept.append((tests[type(f)].__name__, f.value))
            else:
                yield f

    def _wanted(self, date: str) -> bool:
        tests = {"eq": operator.eq, "gt": operator.gt, "ge": operator.ge, "lt": operator.lt, "le": operator.le}
        return all(tests[name](date, value) if name in tests else date in value for name, value in self.kept)

    def partitions(self) -> list[InputPartition]:
        o = self.options
        if "start" not in o:
            return [InputPartition([("", o["url"])])]
        dated = [x for x in date_urls(o["url"], o["start"], int(o.get("days", 1))) if self._wanted(x[0])]
        n = int(o.get("dates_per_task", 1))
        return [InputPartition(dated[i : i + n]) for i in range(0, len(dated), n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records_of(self.options, partition.value)


class RestStream(DataSourceStreamReader):
    """Offsets count dates from the start: up to ``days`` of them, or without that up to today. A batch has the dates between
    two offsets; a batch that is asked for again asks for the same dates."""

    def __init__(self, options: dict):
        self.options = dict(options)

    def initialOffset(self) -> dict:
        return {"dates": 0}

    def latestOffset(self) -> dict:
        until_today = (dt.datetime.now(dt.timezone.utc).date() - dt.date.fromisoformat(self.options["start"])).days + 1
        return {"dates": int(self.options.get("days", max(0, until_today)))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        dated = date_urls(self.options["url"], self.options["start"], end["dates"])[start["dates"] :]
        n = int(self.options.get("dates_per_task", 1))
        return [InputPartition(dated[i : i + n]) for i in range(0, len(dated), n)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return records_of(self.options, partition.value)


class RestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "disclosure_rest"

    def schema(self) -> str:
        return "date string, record string"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return RestStream(self.options)
