"""A data source over histories that come a page at a time, each page naming the next one's key.

``write_pages`` lays a table out as such a service would answer: for each code, pages of so many rows in order of time,
a JSON object {"next": key of the next page or null, "rows": [...]}; the last page may be short.  Reading,

    read_pages(spark, folder, ddl, code, time)

gives a partition for each chain of ``span`` pages of a code (pages are numbered, so chains start anywhere) and follows
the keys within it.  Filters on the code choose chains, and a bound on the time ends a chain at the first page beyond
it and skips rows before; both show as pushed.  (Spark keeps what a relation was last asked to filter, for a next
query without filters too; so ``read_pages`` gives every query one, on the page's number, and by itself the format takes none over.)  A page that can't be read is asked for again ``retries`` times, after
growing pauses; then the task fails, and Spark tries it elsewhere.

As a stream, an offset is the number of pages of every code; a batch reads the pages that came since, a page that is
still short again only when it has been replaced by the next number.  The folder may lie in any store that
Arrow opens by its address.

Defined cases: no pages, no rows; a null code or time is in no page (``write_pages`` refuses neither, they go under the
code "" and after all times)."""

from __future__ import annotations

import json
import sys
import time
from collections.abc import Iterator
from datetime import datetime

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType, TimestampNTZType, TimestampType

# The source is planned in Python processes of its own, which may not know this package: its classes travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAUSE = 0.05
#: What a folder's name holds as % and two digits.
_ESCAPED = frozenset("\"#%'*/:=?\\\x7f{[]^")


def write_pages(df: DataFrame, folder: str, code: str, ts: str, tie: str, size: int) -> None:
    """Pages of ``size`` rows: one small text file a page, below code=.../page=..."""
    w = Window.partitionBy(code).orderBy(F.col(ts).asc_nulls_last(), tie)
    rows = df.withColumn("_n", F.row_number().over(w) - 1).withColumn("page", F.floor(F.col("_n") / size).cast("int"))
    body = F.struct(*df.columns)
    last = Window.partitionBy(code)
    pages = rows.groupBy(F.coalesce(F.col(code).cast("string"), F.lit("")).alias("code"), "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", body.alias("row")))), lambda x: x["row"]).alias("rows"))
    pages = pages.withColumn("next", F.when(F.max("page").over(last.partitionBy("code")) > F.col("page"), F.col("page") + 1))
    made = pages.select("code", "page", F.to_json(F.struct("next", "rows"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("value"))
    made.repartition("code", "page").write.mode("append").partitionBy("code", "page").text(folder)


class Folder:
    """Where the pages are; stands for the service."""

    def __init__(self, path: str):
        self.path = path

    def open(self):
        from pyarrow import fs

        path = self.path.replace("file:///", "/").replace("file:/", "/") if self.path.startswith("file:") else self.path
        return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def pages(self) -> dict[str, int]:
        """Number of pages of every code, which are 0, 1, 2, ..."""
        from urllib.parse import unquote

        from pyarrow import fs

        store, root = self.open()
        found: dict[str, int] = {}
        for x in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
            parts = x.path.rsplit("/", 3)
            if len(parts) == 4 and parts[3].startswith("part-") and parts[2].startswith("page="):
                name = unquote(parts[1].removeprefix("code="))
                name = "" if name == "__HIVE_DEFAULT_PARTITION__" else name
                found[name] = max(found.get(name, 0), int(parts[2][5:]) + 1)
        return found

    def page(self, code: str, number: int) -> dict:
        from pyarrow import fs

        store, root = self.open()
        name = "".join(f"%{ord(c):02X}" if c in _ESCAPED or c < " " else c for c in code) or "__HIVE_DEFAULT_PARTITION__"
        files = [x for x in store.get_file_info(fs.FileSelector(f"{root}/code={name}/page={number}")) if x.base_name.startswith("part-")]
        with store.open_input_stream(files[0].path) as f:
            return json.loads(f.read())


class Chain(InputPartition):
    def __init__(self, code: str, first: int, end: int):
        self.code, self.first, self.end = code, first, end


class _Pages:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder = schema, Folder(options["path"])
        self.code, self.ts = options.get("code", "code"), options.get("time", "ts")
        self.span, self.retries = int(options.get("span", 8)), int(options.get("retries", 3))
        self.codes: set | None = None
        self.bounds: list[tuple[str, object]] = []
        self.push = options.get("push", "false") == "true"

    def chains(self, first: dict[str, int], end: dict[str, int]) -> list[Chain]:
        out = []
        for code, n in sorted(end.items()):
            if self.codes is None or code in self.codes:
                out += [Chain(code, a, min(a + self.span, n)) for a in range(first.get(code, 0), n, self.span)]
        return out

    def fetch(self, code: str, number: int) -> dict:
        for again in range(self.retries + 1):
            try:
                return self.folder.page(code, number)
            except (OSError, ValueError, IndexError):
                if again == self.retries:
                    raise
                time.sleep(PAUSE * 2**again)

    def value(self, field, v):
        if v is not None and isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            return datetime.fromisoformat(v.removesuffix("Z"))
        return v

    def rows(self, chain: Chain) -> Iterator[tuple]:
        number, place = chain.first, self.schema.fieldNames().index(self.ts) if self.ts in self.schema.fieldNames() else None
        while number is not None and number < chain.end:
            page = self.fetch(chain.code, number)
            late = False
            for r in page["rows"]:
                row = tuple(number if f.name == "_page" else self.value(f, r.get(f.name)) for f in self.schema.fields)
                if place is not None and row[place] is not None:
                    if any(op in (">", ">=") and not (row[place] > v if op == ">" else row[place] >= v) for op, v in self.bounds):
                        continue
                    if any(op in ("<", "<=") and not (row[place] < v if op == "<" else row[place] <= v) for op, v in self.bounds):
                        late = True
                        break
                elif self.bounds:
                    continue  # no comparison with null holds
                yield row
            if late:  # pages are in order of time
                break
            number = page.get("next")


class HistoryReader(_Pages, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        signs = {GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
        for f in filters:
            if not self.push:
                yield f
            elif f.attribute == ("_page",):
                pass  # every page has a number
            elif isinstance(f, (EqualTo, In)) and f.attribute == (self.code,):
                chosen = set(f.value if isinstance(f, In) else (f.value,))
                self.codes = chosen if self.codes is None else self.codes & chosen
            elif type(f) in signs and f.attribute == (self.ts,) and isinstance(f.value, datetime):
                self.bounds.append((signs[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Chain]:
        return self.chains({}, self.folder.pages()) or [Chain("", 0, 0)]

    def read(self, partition: Chain) -> Iterator[tuple]:
        yield from self.rows(partition)


class HistoryStream(_Pages, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self.folder.pages()

    def partitions(self, start: dict, end: dict) -> list[Chain]:
        return self.chains(start, end)

    def read(self, partition: Chain) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class PagedHistory(DataSource):
    """Options: path; schema (DDL of a row); code and time (the columns' names); span (pages of a partition); retries."""

    @classmethod
    def name(cls) -> str:
        return "paged_history"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> HistoryReader:
        return HistoryReader(schema, self.options)

    def streamReader(self, schema: StructType) -> HistoryStream:
        return HistoryStream(schema, self.options)


def read_pages(spark, folder: str, schema: str, code: str, ts: str, span: int = 8) -> DataFrame:
    """The rows behind the pages of ``folder``; filters on code and time reach the source."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedHistory)
    rows = spark.read.format("paged_history").options(path=folder, schema=f"{schema}, _page int", code=code, time=ts, span=span, push="true").load()
    return rows.where(F.col("_page") >= 0).drop("_page")
