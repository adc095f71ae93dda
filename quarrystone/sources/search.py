"""A search service as a data source: ``spark.read.format("paper_search")``.

Each query variant is a partition. A page of results is a JSON file ``<n>.json`` below ``path`` with
(status, data), as a service would return it; a remote service is plugged in by passing another
``fetch``. Projection, year and open-access predicates, order and limit are applied at the source.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FIELDS = "variant_ix int, hit_ix int, paper_id string, title string, abstract string, year int, citation_count bigint, influential_citation_count bigint, pdf_url string, venue string"
RETRY_STATUS = (429, 503)


class SearchFailed(Exception):
    """The service refused a request for good."""


def file_fetch(path: str, variant: int) -> tuple[int, list[dict], float]:
    """(status, data, seconds to wait before another try) of one variant; a missing file is an unknown status."""
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")
    try:
        with files.open_input_stream(f"{root}/{variant}.json") as f:
            page = json.loads(f.read())
    except FileNotFoundError:
        return 404, [], 0.0
    return int(page.get("status", 200)), page.get("data") or [], float(page.get("retry_after") or 0)


def search_page(fetch: Callable[[str, int], tuple[int, list[dict], float]], path: str, variant: int, attempts: int = 3, pause: float = 2.0) -> list[dict]:
    """One page: data for status 200, up to ``attempts`` tries for 429 and 503, nothing for other statuses.

    Between tries it waits as long as the service asks, if it does, and then the pause, which doubles.
    """
    for attempt in range(attempts):
        status, data, wait = fetch(path, variant)
        if status == 200:
            return data
        if status not in RETRY_STATUS:
            return []
        if attempt + 1 < attempts:
            time.sleep(max(wait, 0.0) + pause * 2**attempt)
    raise SearchFailed(f"variant {variant}: status {status}")


def hits_of(data: list[dict], variant: int, limit: int, min_year: int, open_access: bool) -> Iterator[tuple]:
    """Rows of FIELDS from a page; papers of unknown year pass only without a least year."""
    n = 0
    for paper in data:
        year, pdf = paper.get("year"), (paper.get("openAccessPdf") or {}).get("url")
        if (min_year and (year is None or year < min_year)) or (open_access and not pdf):
            continue
        if n == limit:
            return
        yield (variant, n, paper.get("paperId"), paper.get("title"), paper.get("abstract"), year, paper.get("citationCount") or 0, paper.get("influentialCitationCount") or 0, pdf, paper.get("venue"))
        n += 1


class SearchReader(DataSourceReader):
    """Reads one variant per partition; with mode DROP a failing one gives no rows, with FAILFAST it ends the job."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.variants = int(options.get("variants", "1"))
        self.limit, self.min_year = int(options.get("limit", "100")), int(options.get("minyear", "1990"))
        self.open_access = options.get("openaccess", "true").lower() == "true"
        self.drop, self.pause = options.get("mode", "DROP").upper() == "DROP", float(options.get("pause", "2"))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.variants)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        try:
            data = search_page(file_fetch, self.path, partition.value, pause=self.pause)
        except SearchFailed:
            if not self.drop:
                raise
            return
        yield from hits_of(data, partition.value, self.limit, self.min_year, self.open_access)


class SearchSource(DataSource):
    """The source ``paper_search``; options: path, variants, limit, minYear, openAccess, mode, pause."""

    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return FIELDS

    def reader(self, schema) -> SearchReader:
        return SearchReader(self.options)


def search(spark: SparkSession, path: str, variants: int, **options: object) -> DataFrame:
    """All variants' hits with variant_ix and hit_ix, the order of arrival."""
    spark.dataSource.register(SearchSource)
    reader = spark.read.format("paper_search").option("variants", str(variants))
    for key, value in options.items():
        reader = reader.option(key, str(value))
    return reader.load(path)
