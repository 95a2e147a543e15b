"""A paginated HTTP source as a Python data source: pages are partitions, equality filters go to the server.

spark.dataSource.register(PagedSource); spark.read.format("paged").option("url", ...).schema(...).load().
Options: url, pages, page_param, size_param, page_size, records (path of the list in
the answer, dots between names), params (comma-separated columns that the server filters).
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition


class Page(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options, self.sent = schema, options, {}

    def pushFilters(self, filters):
        allowed = set(filter(None, self.options.get("params", "").split(",")))
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in allowed:
                self.sent[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        return [Page(n) for n in range(int(self.options.get("pages", 1)))]

    def fetch(self, url: str) -> dict | list:
        with urllib.request.urlopen(url, timeout=float(self.options.get("timeout", 30))) as answer:
            return json.load(answer)

    def read(self, page: Page):
        query = {self.options.get("page_param", "page"): page.number, self.options.get("size_param", "size"): self.options.get("page_size", 100), **self.sent}
        body = self.fetch(f"{self.options['url']}?{urllib.parse.urlencode(query)}")
        for name in filter(None, self.options.get("records", "").split(".")):
            body = body[name]
        for record in body:
            yield tuple(record.get(f.name) for f in self.schema.fields)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(schema, self.options)


class SegmentLog:
    """An append-only topic of numbered records in Parquet segments, read from any offset."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def end(self) -> int:
        from pyspark.errors import AnalysisException
        from pyspark.sql import functions as F

        try:
            return (self.spark.read.parquet(self.path).agg(F.max("offset")).first()[0] + 1) or 0
        except (AnalysisException, TypeError):
            return 0

    def append(self, df, order: str) -> int:
        """Offsets follow the order; the first one is returned."""
        from pyspark.sql import functions as F

        from quernstone.operators.windows import global_row_number

        first = self.end()
        global_row_number(df, [order], "offset").withColumn("offset", F.col("offset") - 1 + first).write.mode("append").parquet(self.path)
        return first

    def read(self, start: int = 0, stop: int | None = None):
        from pyspark.sql import functions as F

        df = self.spark.read.parquet(self.path).filter(F.col("offset") >= start)
        return df if stop is None else df.filter(F.col("offset") < stop)
