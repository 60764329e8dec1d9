"""Sources of live bars, prices and metadata: the interface, a paced reader, an HTTP client, a Spark reader over any of them."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A bar: symbol, t (epoch seconds of its open), o, h, l, c, v.
Bar = tuple[str, int, float, float, float, float, float]
BARS = "symbol string, t long, o double, h double, l double, c double, v double"


class BarSource(Protocol):
    """What the engine asks of a market."""

    def bars(self, symbol: str, interval: str, start: int, end: int) -> list[Bar]: ...
    def mids(self) -> dict[str, float]: ...
    def markets(self) -> tuple[list[dict], list[dict]]: ...


class SourceError(RuntimeError):
    pass


class LoadShed(SourceError):
    """A source kept answering with nothing. Nothing isn't absence: a market that trades has bars."""


def parsed_bar(symbol: str, row: dict) -> Bar:
    """A bar with short or long names; times are milliseconds, and volume may be missing."""
    pick = lambda short, long: row[short] if short in row else row[long]
    numbers = [float(pick(s, n)) for s, n in (("o", "open"), ("h", "high"), ("l", "low"), ("c", "close"))]
    volume = float(row.get("v", row.get("volume", 0.0)))
    o, h, low, c = numbers
    if not all(map(math.isfinite, [*numbers, volume])) or low <= 0 or h < max(o, c, low) or low > min(o, c, h) or volume < 0:
        raise SourceError(f"unsound bar of {symbol}: {row}")
    return (symbol, int(pick("t", "timestamp")) // 1000, o, h, low, c, volume)


@dataclass
class HttpSource:
    """A public market over HTTP: JSON requests to one address, tried again with growing waits; answers must name what was asked."""

    url: str
    tries: int = 3
    wait: float = 0.4
    timeout: float = 15.0
    sleep: Callable[[float], None] = time.sleep
    post: Callable[[dict], object] | None = None

    def ask(self, payload: dict) -> object:
        for attempt in range(self.tries):
            try:
                return (self.post or self._post)(payload)
            except (OSError, urllib.error.URLError, ValueError) as error:
                if attempt + 1 == self.tries:
                    raise SourceError(f"{self.url}: {error}") from error
                self.sleep(self.wait * 2**attempt)
        raise SourceError(f"{self.url}: no try is allowed")

    def _post(self, payload: dict) -> object:
        request = urllib.request.Request(self.url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
            return json.loads(answer.read())

    def bars(self, symbol: str, interval: str, start: int, end: int) -> list[Bar]:
        answer = self.ask({"type": "candleSnapshot", "req": {"coin": symbol, "interval": interval, "startTime": start * 1000, "endTime": end * 1000}})
        if not isinstance(answer, list):
            raise SourceError(f"bars of {symbol} aren't a list")
        for row in answer:
            if row.get("s", symbol) != symbol or row.get("i", interval) != interval:
                raise SourceError(f"asked for {symbol} {interval}, got {row.get('s')} {row.get('i')}")
        return sorted((parsed_bar(symbol, r) for r in answer), key=lambda b: b[1])

    def mids(self) -> dict[str, float]:
        answer = self.ask({"type": "allMids"})
        prices = {s: float(p) for s, p in answer.items()} if isinstance(answer, dict) else {}
        if bad := [s for s, p in prices.items() if not math.isfinite(p) or p <= 0]:
            raise SourceError(f"unsound prices of {', '.join(sorted(bad))}")
        return prices

    def markets(self) -> tuple[list[dict], list[dict]]:
        answer = self.ask({"type": "metaAndAssetCtxs"})
        if not isinstance(answer, list) or len(answer) != 2 or not isinstance(answer[0], dict) or not isinstance(answer[0].get("universe"), list) or not isinstance(answer[1], list):
            raise SourceError("metadata and contexts don't come as a pair")
        return answer[0]["universe"], answer[1]


@dataclass
class Paced:
    """A source's bars with a least gap between requests; an empty answer is asked again, and at last an error."""

    source: BarSource
    gap: float = 0.12
    tries: int = 4
    wait: float = 0.4
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _next: float = field(default=-math.inf, repr=False)

    def bars(self, symbol: str, interval: str, start: int, end: int) -> list[Bar]:
        for attempt in range(self.tries):
            if attempt:
                self.sleep(self.wait * 2 ** (attempt - 1))
            if (early := self._next - self.clock()) > 0:
                self.sleep(early)
            self._next = self.clock() + self.gap
            if found := self.source.bars(symbol, interval, start, end):
                return found
        raise LoadShed(f"{symbol} {interval}: empty {self.tries} times")


class BarsDataSource(DataSource):
    """``spark.read.format("lodestar_bars")``: a partition a symbol, read on the executors by a source that ``factory`` makes.

    Options: symbols (comma-separated), interval, start, end (epoch seconds), factory
    (``module:function``, called without arguments).
    """

    @classmethod
    def name(cls) -> str:
        return "lodestar_bars"

    def schema(self) -> str:
        return BARS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(s.strip()) for s in self.options["symbols"].split(",") if s.strip()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import importlib

        module, _, function = self.options["factory"].partition(":")
        source = Paced(getattr(importlib.import_module(module), function)(), gap=float(self.options.get("gap", 0.12)))
        yield from source.bars(partition.value, self.options["interval"], int(self.options["start"]), int(self.options["end"]))
