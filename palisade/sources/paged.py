"""Rows of a paginated HTTP service as a Spark data source.

`url` has the marks {offset} and {length}. A page is a JSON object with `rows`, a list of {"row": {...}}, and, where the
service knows it, `num_rows_total`. With a total, the pages are dealt to tasks, each of which fetches its own; without
one, a single task follows the pages until a short one. A row comes as its offset and its JSON text, so `read_paged`
can lay any schema over it.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE, PAGES_A_TASK, ATTEMPTS, PAUSE, LONGEST_PAUSE, TIMEOUT = 100, 20, 6, 2.0, 12.0, 90


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "offset bigint, row string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return PagedReader(dict(self.options))


class Pages(InputPartition):
    """Rows first..end - 1; end None: as far as there are rows."""

    def __init__(self, first: int, end: int | None):
        super().__init__((first, end))
        self.first, self.end = first, end


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        get = {k.lower(): v for k, v in options.items()}.get
        self.url = get("url")
        if not self.url or "{offset}" not in self.url:
            raise ValueError("option url has to hold the mark {offset}")
        self.page = int(get("page", PAGE))
        self.per_task = int(get("pagespertask", PAGES_A_TASK))
        self.attempts = int(get("attempts", ATTEMPTS))
        self.pause = float(get("pause", PAUSE))
        self.cap = int(get("maxrows", 0))

    def fetch(self, offset: int) -> dict:
        """A page; a request that fails is made again after a pause that grows by its first length each time."""
        url = self.url.replace("{offset}", str(offset)).replace("{length}", str(self.page))
        for attempt in range(1, self.attempts + 1):
            try:
                with urllib.request.urlopen(url, timeout=TIMEOUT) as answer:
                    return json.load(answer)
            except (OSError, ValueError):  # refused, cut off, an error status, or no JSON
                if attempt == self.attempts:
                    raise
                time.sleep(min(self.pause * attempt, LONGEST_PAUSE))
        raise ValueError("attempts has to be 1 or more")

    def partitions(self) -> list[InputPartition]:
        head = self.fetch(0)
        total = head.get("num_rows_total") or head.get("num_rows_total_visible")
        if not head.get("rows"):
            return [Pages(0, 0)]
        if not total:
            return [Pages(0, self.cap or None)]
        end = min(total, self.cap) if self.cap else total
        step = self.page * self.per_task
        return [Pages(at, min(at + step, end)) for at in range(0, end, step)]

    def read(self, partition: Pages) -> Iterator[tuple[int, str]]:
        at, end = partition.first, partition.end
        while end is None or at < end:
            rows = self.fetch(at).get("rows") or []
            for k, item in enumerate(rows):
                if end is not None and at + k >= end:
                    return
                yield at + k, json.dumps(item.get("row") or {}, ensure_ascii=False)
            if len(rows) < self.page:
                return
            at += self.page


def read_paged(spark: SparkSession, url: str, schema: str | None = None, **options: object) -> DataFrame:
    """offset and row (JSON text), or offset and the columns of schema (DDL)."""
    spark.dataSource.register(PagedSource)
    x = spark.read.format("paged").options(url=url, **{k: str(v) for k, v in options.items()}).load()
    return x if schema is None else x.select("offset", F.from_json("row", schema).alias("r")).select("offset", "r.*")


def labelled_rows(rows: DataFrame) -> DataFrame:
    """id, skill_name, content, label of fetched rows; a row without an id gets one from its offset."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    made = F.concat(F.lit("row-"), F.col("offset").cast("string"))
    return rows.select(F.coalesce(F.when(F.col("id") != "", F.col("id")), made).alias("id"), blank("skill_name").alias("skill_name"), blank("content").alias("content"), F.lower(F.trim(blank("label"))).alias("label"))
