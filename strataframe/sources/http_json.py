"""JSON records over HTTP as a Spark data source: one task a page, a record a row, with status and error beside it."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Seconds until a request that gets no answer fails.
TIMEOUT = 30
ROWS = "url string, status int, ord long, key string, value string, error string"


class Page(InputPartition):
    def __init__(self, url: str):
        super().__init__(url)
        self.url = url


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options["urls"].split("\n")
        self.records = options.get("records", "")
        self.headers = json.loads(options.get("headers", "{}"))
        self.timeout = float(options.get("timeout", TIMEOUT))

    def partitions(self) -> list[Page]:
        return [Page(u) for u in self.urls if u]

    def read(self, partition: Page) -> Iterator[tuple]:
        url = partition.url
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as answer:
                status, body = answer.status, json.load(answer)
        except urllib.error.HTTPError as e:
            yield url, e.code, None, None, None, f"HTTP {e.code}"
            return
        except (OSError, ValueError) as e:
            yield url, None, None, None, None, type(e).__name__
            return
        for name in filter(None, self.records.split(".")):
            body = body.get(name) if isinstance(body, dict) else None
        rows = body.items() if isinstance(body, dict) else enumerate(body if isinstance(body, list) else [body])
        for ord_, (key, value) in enumerate(rows):
            yield url, status, ord_, str(key), json.dumps(value), None


class JsonPages(DataSource):
    """Options: ``urls`` (a line each), ``records`` (dotted path to a list or an object of records; the whole body without
    it), ``headers`` (a JSON object), ``timeout``."""

    @classmethod
    def name(cls) -> str:
        return "json_pages"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def http_records(spark: SparkSession, urls: list[str], schema: str, records: str = "", headers: dict[str, str] | None = None) -> DataFrame:
    """``url``, ``status``, ``ord``, ``key`` and ``error`` of each record of the pages, and its fields by the declared schema. A page
    that can't be read is a row with an error."""
    spark.dataSource.register(JsonPages)
    rows = spark.read.format("json_pages").option("urls", "\n".join(urls)).option("records", records).option("headers", json.dumps(headers or {})).load()
    return rows.withColumn("r", F.from_json("value", schema)).select("url", "status", "ord", "key", "error", "r.*")


def authorised(token: str) -> dict[str, str]:
    return {"Authorization": f"Token {token}"}


def found(status: Column, records: Column) -> Column:
    """The line that heads a page of search results: its size counts null records too."""
    return F.when(status == 200, F.concat(F.lit("Found "), F.size(records).cast("string"), F.lit(" models")))
