"""A paged object API as a Spark data source, with its filter on the change stamp pushed down.

`ObjectSource` reads objects from a service (client credentials once, then pages until the service says done) or from a
folder of JSON lines, so the same reader serves a live service and an offline copy. `query_text` builds the query such
a service takes, `run_query` answers it over a DataFrame: filter, sort by stamp and id, limit, pages.
"""

from __future__ import annotations

import json
import pathlib
import re
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, InputPartition

STAMP = "SystemModstamp"
PAGE = 200
_QUERY = re.compile(r"^\s*SELECT\s+FIELDS\(ALL\)\s+FROM\s+(\w+)(?:\s+WHERE\s+(\w+)\s*>\s*(\S+))?(?:\s+ORDER\s+BY\s+(\w+))?(?:\s+LIMIT\s+(\d+))?\s*$", re.I)


def query_text(kind: str, after: str | None = None, limit: int | None = None) -> str:
    where = f" WHERE {STAMP} > {after}" if after else ""
    return f"SELECT Fields(ALL) FROM {kind}{where} ORDER BY {STAMP}" + (f" LIMIT {limit}" if limit else "")


def parse_query(text: str) -> tuple[str, str | None, int | None]:
    m = _QUERY.match(text)
    if not m or (m[2] and m[2].lower() != STAMP.lower()):
        raise ValueError(f"not a query of this service: {text}")
    return m[1], m[3], int(m[5]) if m[5] else None


def run_query(objects: DataFrame, text: str, stamp: str, key: str, page: int, page_size: int = PAGE) -> DataFrame:
    """Rows of one page (from 0): stamps are compared as text, the limit holds before paging.

    A page needs the first (page + 1) * page_size rows only, which a top-k gives; its rows are numbered among these.
    """
    _, after, limit = parse_query(text)
    rows = objects.filter(F.col(stamp) > F.lit(after)) if after else objects
    most = (page + 1) * page_size if limit is None else min(limit, (page + 1) * page_size)
    top = rows.orderBy(stamp, key).limit(most)
    n = F.row_number().over(Window.orderBy(stamp, key))
    return top.withColumn("_n", n).filter((F.col("_n") > page * page_size) & (F.col("_n") <= (page + 1) * page_size)).drop("_n")


class ServiceClient:
    """Token by client credentials, then pages: each answer has records, done and the address of the next page."""

    def __init__(self, url: str, client: str, secret: str, timeout: float = 30.0) -> None:
        self.url, self.timeout = url.rstrip("/"), timeout
        body = urllib.parse.urlencode({"grant_type": "client_credentials", "client_id": client, "client_secret": secret}).encode()
        self.token = self._json(urllib.request.Request(f"{self.url}/services/oauth2/token", data=body))["access_token"]

    def _json(self, request: urllib.request.Request) -> dict:
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            return json.load(answer)

    def query_all(self, text: str) -> Iterator[dict]:
        at = "/services/data/v60.0/query?" + urllib.parse.urlencode({"q": text})
        while at:
            page = self._json(urllib.request.Request(self.url + at, headers={"Authorization": f"Bearer {self.token}"}))
            yield from page["records"]
            at = None if page["done"] else page["nextRecordsUrl"]


class _Part(InputPartition):
    def __init__(self, path: str | None) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.after = dict(options), None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, GreaterThan) and f.attribute == ("modified_at",):
                self.after = max(self.after or "", f.value)
            yield f  # Spark checks every row again, which costs nothing beside the read

    def partitions(self) -> list[InputPartition]:
        if "url" in self.options:
            return [_Part(None)]
        return [_Part(str(p)) for p in sorted(pathlib.Path(self.options["folder"], self.options["kind"]).glob("*.jsonl"))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        if partition.path is None:
            client = ServiceClient(self.options["url"], self.options.get("client", ""), self.options.get("secret", ""))
            for doc in client.query_all(query_text(self.options["kind"], self.after)):
                yield doc.get("Id"), doc.get(STAMP), json.dumps(doc)
            return
        with open(partition.path, encoding="utf-8") as f:
            for line in f:
                if line.strip():
                    doc = json.loads(line)
                    at = doc.get(STAMP)
                    if self.after is None or (at is not None and at > self.after):
                        yield doc.get("Id"), at, line.rstrip("\n")


class ObjectSource(DataSource):
    """format("objects"): options kind and folder, or kind, url, client and secret; columns id, modified_at and payload."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return "id string, modified_at string, payload string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark) -> None:
    """Makes format("objects") known to the session, with filters pushed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectSource)
