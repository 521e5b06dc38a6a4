"""Python data sources for archives and paged services.  Each partition reads one unit; nothing runs on the driver."""

from __future__ import annotations

import csv
import io
import json
import random
import time
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)


class ZipCsv(DataSource):
    """CSV members of ZIP archives: ``spark.read.format("zip_csv").schema(...).option("path", folder or file)``.

    Cells are matched to the schema's columns by name, as text; options ``where_<column>`` keep rows of one value.
    """

    @classmethod
    def name(cls) -> str:
        return "zip_csv"

    def schema(self) -> str:
        raise ValueError("zip_csv needs a schema")

    def reader(self, schema) -> DataSourceReader:
        return _ZipReader(schema, dict(self.options))


class _ZipReader(DataSourceReader):
    def __init__(self, schema, options: dict) -> None:
        self.names = [f.name for f in schema.fields]
        self.options = options

    def partitions(self) -> list[_File]:
        p = Path(self.options["path"])
        return [_File(str(x)) for x in (sorted(p.rglob("*.zip")) if p.is_dir() else [p])]

    def read(self, partition: _File) -> Iterator[tuple]:
        keep = {k[6:]: v for k, v in self.options.items() if k.startswith("where_")}
        with zipfile.ZipFile(partition.value) as z:
            for member in sorted(z.namelist()):
                if member.lower().endswith(".csv"):
                    with io.TextIOWrapper(z.open(member), "utf-8", newline="") as f:
                        for row in csv.DictReader(f):
                            if all((row.get(next((c for c in row if c and c.lower() == k), k)) or "") == v for k, v in keep.items()):
                                yield tuple(row.get(n) for n in self.names)


class _Page(InputPartition):
    def __init__(self, start: int) -> None:
        super().__init__(start)


class PagedJson(DataSource):
    """A paged service recorded as files ``<path>/<offset>.json`` = ``{"total": n, "data": [...]}``; one page, one partition.

    ``page_size`` is the distance of the offsets.  Rows come as JSON text in the column ``value``.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(dict(self.options))


class _PageReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("page_size", 5000))

    def _load(self, start: int) -> dict:
        return json.loads((Path(self.path) / f"{start}.json").read_text())

    def partitions(self) -> list[_Page]:
        total = int(self._load(0).get("total", 0))
        return [_Page(s) for s in range(0, max(total, 1), self.size)]

    def read(self, partition: _Page) -> Iterator[tuple]:
        for row in self._load(partition.value).get("data", []):
            yield (json.dumps(row, sort_keys=True),)


@dataclass(frozen=True)
class Retry:
    """When to try again: after a wait that doubles (and is stretched at random), or as long as the service asks for."""

    attempts: int = 4
    base: float = 1.0
    jitter: float = 0.25
    again: frozenset[int] = frozenset({429, 500, 502, 503, 504})

    def wait(self, attempt: int, asked: float | None = None, rng: random.Random | None = None) -> float:
        if asked is not None:
            return float(asked)
        return self.base * 2 ** (attempt - 1) * (1 + self.jitter * (rng or random).random())

    def run(self, call: Callable[[], tuple[int, object, float | None]], sleep: Callable[[float], None] = time.sleep) -> object:
        """``call`` returns (status, value, seconds asked for); statuses outside ``again`` end the attempts."""
        for attempt in range(1, self.attempts + 1):
            status, value, asked = call()
            if status < 400:
                return value
            if status not in self.again or attempt == self.attempts:
                raise RuntimeError(f"gave up after {attempt} attempts with status {status}")
            sleep(self.wait(attempt, asked))
        raise AssertionError


def read_each(spark: SparkSession, sources: dict[str, Callable[[], DataFrame]], schema: str) -> DataFrame:
    """``(source, columns of schema, error)``: rows of every source; one that can't be opened gives a single row with its error."""
    empty = spark.createDataFrame([], schema)
    out = None
    for name, read in sources.items():
        try:
            one = read().select(*empty.columns).withColumn("error", F.lit(None).cast("string"))
        except Exception as e:  # whatever keeps one source from answering must not keep the others
            one = spark.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields], F.lit(type(e).__name__).alias("error"))
        one = one.select(F.lit(name).alias("source"), *empty.columns, "error")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else empty.select(F.lit("").alias("source"), *empty.columns, F.lit("").alias("error"))


def register(spark) -> None:
    """Make the sources known to a session."""
    spark.dataSource.register(ZipCsv)
    spark.dataSource.register(PagedJson)
