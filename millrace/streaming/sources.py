"""Streaming sources that Python provides: an HTTP poller as a data source, and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class HttpSource(DataSource):
    """``spark.read.format("millrace_http").option("url", ...)``: each URL (options ``url``, or ``urls`` separated by blanks) is a partition and a row."""

    @classmethod
    def name(cls) -> str:
        return "millrace_http"

    def schema(self) -> str:
        return "url string, status int, body string"

    def reader(self, schema) -> DataSourceReader:
        return HttpReader(self.options)


class HttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.urls = (options.get("urls") or options["url"]).split()
        self.timeout = float(options.get("timeout", 5))

    def partitions(self):
        return [InputPartition(u) for u in self.urls]

    def read(self, partition):
        import urllib.error
        import urllib.request

        try:
            with urllib.request.urlopen(partition.value, timeout=self.timeout) as r:
                yield (partition.value, r.status, r.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            yield (partition.value, e.code, e.read().decode("utf-8", "replace"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HttpSource)


def rate(spark: SparkSession, rows_per_second: int) -> DataFrame:
    """An endless stream of ``timestamp, value``; the counterpart of a generator with an interval, and of a rate limit."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()


def lines(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines of a TCP socket."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
