"""Candles as pages of arrays, the way exchange services deliver them, as a Spark data source.

A page is a JSON array of rows, each an array of up to 12 fields: open time (ms), open, high, low, close, volume, close
time, quote volume, trades, taker buy base, taker buy quote, ignored. Files hold one page a line. The reader has a
partition per file; the stream reader takes up new files in name order. Fetching pages over a network is left to a
function that is passed in (see pages).
"""

from __future__ import annotations

import email.utils
import glob
import json
import os
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

SCHEMA = "symbol string, open_time long, open double, high double, low double, close double, volume double, close_time long, quote_volume double, trades long, taker_base double, taker_quote double"


def retry_after(text: str | None, now: float | None = None, default: float = 1.0) -> float:
    """Seconds to wait by a Retry-After header: a number of seconds or an HTTP date; `default` if unreadable."""
    if text is None:
        return default
    try:
        return max(0.0, float(text))
    except ValueError:
        pass
    try:
        return max(0.0, email.utils.parsedate_to_datetime(text).timestamp() - (time.time() if now is None else now))
    except (TypeError, ValueError):
        return default


def pages(fetch: Callable[[int, int], tuple[int, dict, list]], start: int, end: int, limit: int = 1000, tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> Iterator[list]:
    """All rows with start <= open time <= end (ms), page by page: fetch(start, limit) gives status, headers, rows.

    Status 429 waits as told and tries again, at most `tries` times; other errors double their wait. A short page is
    the last one; rows behind the end are left out; a row repeated at a page's start comes once."""
    last = None
    while start <= end:
        for attempt in range(tries):
            status, headers, rows = fetch(start, limit)
            if status == 200:
                break
            sleep(retry_after(headers.get("Retry-After")) if status == 429 else 2.0**attempt)
        else:
            raise OSError(f"no page after {tries} tries")
        fresh = [r for r in rows if r[0] <= end and (last is None or r[0] > last)]
        yield from fresh
        if len(rows) < limit or not fresh:
            return
        last = fresh[-1][0]
        start = last + 1


def rows_of(line: str, symbol: str) -> Iterator[tuple]:
    page = json.loads(line)
    if isinstance(page, dict):
        symbol, page = page.get("symbol", symbol), page.get("rows") or []
    for r in page:
        r = [*r, *[None] * (12 - len(r))]
        num = [None if x is None else float(x) for x in r[1:6]]
        yield (symbol, int(r[0]), *num, None if r[6] is None else int(r[6]), None if r[7] is None else float(r[7]), None if r[8] is None else int(r[8]), *[None if x is None else float(x) for x in r[9:11]])


def _files(path: str) -> list[str]:
    path = path[5:] if path.startswith("file:") else path
    return sorted(p for p in glob.glob(os.path.join(path, "**", "*"), recursive=True) if os.path.isfile(p) and not os.path.basename(p).startswith((".", "_")))


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _read(path: str) -> Iterator[tuple]:
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip():
                yield from rows_of(line, os.path.basename(path).split(".")[0])


class KlineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def partitions(self) -> list[FilePartition]:
        return [FilePartition(p) for p in _files(self.path)]

    def read(self, partition: FilePartition) -> Iterator[tuple]:
        return _read(partition.path)


class KlineStream(SimpleDataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def initialOffset(self) -> dict:
        return {"files": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        files = _files(self.path)
        return iter([r for p in files[start["files"] :] for r in _read(p)]), {"files": len(files)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for p in _files(self.path)[start["files"] : end["files"]] for r in _read(p)])


class KlineSource(DataSource):
    """spark.dataSource.register(KlineSource); spark.read.format("kline_pages").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "kline_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> KlineReader:
        return KlineReader(self.options)

    def simpleStreamReader(self, schema) -> KlineStream:
        return KlineStream(self.options)
