"""A streaming source that scrapes expositions: one micro-batch is one round over all targets."""

from __future__ import annotations

import time
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .sinks import fetch, scrape


class Target(InputPartition):
    def __init__(self, url: str, round_ms: int):
        self.url, self.round_ms = url, round_ms


class ScrapeReader(DataSourceStreamReader):
    """Offsets are rounds of `interval` seconds; each target is a partition, so targets are read in parallel."""

    def __init__(self, options: dict):
        self.targets = [t for t in options.get("targets", "").split(",") if t]
        self.interval = int(float(options.get("interval", "15")) * 1000)
        self.labels = dict(p.split("=", 1) for p in options.get("labels", "").split(",") if "=" in p)
        self.access = {k: options[k] for k in ("token", "user", "password", "ca_file", "insecure") if options.get(k)}

    def _round(self) -> int:
        return int(time.time() * 1000) // self.interval

    def initialOffset(self) -> dict:
        return {"round": self._round() - 1}

    def latestOffset(self) -> dict:
        return {"round": self._round()}

    def partitions(self, start: dict, end: dict) -> list[Target]:
        return [Target(t, end["round"] * self.interval) for t in self.targets] if end["round"] > start["round"] else []

    def read(self, partition: Target) -> Iterator[tuple]:
        host = urllib.parse.urlparse(partition.url).netloc or partition.url
        own = ",".join(f'{k}="{v}"' for k, v in sorted(self.labels.items()))
        for line in scrape(partition.url, lambda url: fetch(url, self.access)):
            yield (line, host, own, partition.round_ms)


class ScrapeSource(DataSource):
    """Options: targets (comma-separated URLs), interval (seconds), labels (k=v, comma-separated); for access token or user and password,
    ca_file, insecure (true: certificates aren't checked). functions.parsers.parse_scrape turns its rows into metrics with the labels of their target."""

    @classmethod
    def name(cls) -> str:
        return "scrape"

    def schema(self) -> str:
        return "value string, instance string, labels string, scraped_ms bigint"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ScrapeReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ScrapeSource)
