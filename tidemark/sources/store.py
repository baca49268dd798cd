"""The tick store, an SQLite file, as a Spark source: ranges of the sequence are partitions, and filters go down into the store.

    spark.dataSource.register(TickStore)
    spark.read.format("tick_store").option("path", file).option("partitions", 16).load()

The file must be where every executor sees it. Pushing filters needs spark.sql.python.filterPushdown.enabled, which pushed_filters() sets.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterable, Iterator
from contextlib import closing

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

# The columns of the store's table of events.
COLUMNS = "sequence long, run_id string, event_type string, source string, occurred_at string, received_at string, stock_code string, source_sequence string, payload_json string, payload_sha256 string, schema_version string"
_ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith(" long") else pa.string()) for c in COLUMNS.split(", ")])
_NAMES = [c.split()[0] for c in COLUMNS.split(", ")]
#: What may be pushed: columns with an index or an order of their own, and comparisons that mean the same in the store.
PUSHED = frozenset(("sequence", "run_id", "event_type", "stock_code", "occurred_at", "received_at"))
_SIGNS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
BATCH = 10_000


class Range(InputPartition):
    """Numbers from low on and below high."""

    def __init__(self, low: int, high: int):
        super().__init__(None)
        self.low, self.high = low, high


class TickStore(DataSource):
    """Options: path, partitions (8 unless given)."""

    @classmethod
    def name(cls) -> str:
        return "tick_store"

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("partitions", "8")))


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path.removeprefix('file:')}?mode=ro", uri=True)


class _Reader(DataSourceReader):
    def __init__(self, path: str, partitions: int):
        self.path, self.n, self.clauses, self.values = path, max(1, partitions), [], []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in PUSHED and type(f) in _SIGNS and f.value is not None:
                self.clauses.append(f"{column} {_SIGNS[type(f)]} ?")
                self.values.append(f.value)
            elif column in PUSHED and isinstance(f, In) and f.value and None not in f.value:
                self.clauses.append(f"{column} IN ({', '.join('?' * len(f.value))})")
                self.values.extend(f.value)
            else:
                yield f

    def partitions(self) -> list[Range]:
        where = f" WHERE {' AND '.join(self.clauses)}" if self.clauses else ""
        with closing(_open(self.path)) as store:
            low, high = store.execute(f"SELECT min(sequence), max(sequence) FROM events{where}", self.values).fetchone()
        if low is None:
            return [Range(0, 0)]
        step = -(-(high + 1 - low) // self.n)
        return [Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        sql = f"SELECT {', '.join(_NAMES)} FROM events WHERE {' AND '.join(['sequence >= ?', 'sequence < ?', *self.clauses])} ORDER BY sequence"
        with closing(_open(self.path)) as store:
            rows = store.execute(sql, [part.low, part.high, *self.values])
            while got := rows.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pushed_filters(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def tick_store(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """Events of a store, with problem: HASH where a payload's digest differs, MALFORMED where it is no JSON."""
    pushed_filters(spark)
    spark.dataSource.register(TickStore)
    e = spark.read.format("tick_store").option("path", path).option("partitions", partitions).load()
    problem = F.when(F.sha2("payload_json", 256) != F.col("payload_sha256"), "HASH").when(F.try_parse_json("payload_json").isNull(), "MALFORMED")
    return e.withColumn("problem", problem)
