"""What the text operators share: table access, stage tables in the shared folder, word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as every operator here takes them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_folder: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: the executors of a cluster share no other folder")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return _own_folder[0]


def stage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends, and later readers do no work twice."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_sorting(df: DataFrame) -> DataFrame:
    """df as a side of a join that sorts both sides. For tables that grow with the input: Spark sizes them by their files, which are
    compressed, and takes an explode for one row each, so it may send a table whole through the driver that is many times what it took it for."""
    return df.hint("merge")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def least_hashes(df: DataFrame, n: int, *by: str, total: int | None = None) -> DataFrame:
    """The n different rows of least hash of the named columns (all, if none is named): a sample that no order of rows or tasks changes,
    and that a row of many copies doesn't fill.

    A threshold from the number of rows goes before the sort, so that tasks send some 4 n rows in all, not n each.
    """
    h = F.xxhash64(*(by or df.columns))
    total = df.count() if total is None else total
    some = df.where(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * 4.0 * n / total)) if total > 4 * n else df
    return some.distinct().orderBy(F.pmod(h, F.lit(1 << 31)), h, *df.columns).limit(n)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long, text as UTF-8 bytes (null stays null), and the named columns."""
    # a bare column where it can be: an alias would keep equal exchanges from being seen as one
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    return docs.select(doc_id, F.col("text").cast("binary").alias("text"), *more)


class _Hashes(dict):
    """64-bit hash of each word; a bounded memory of those met."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_hashes = _Hashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of x over all 64."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive entries (polynomial, by doubling); empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    have, span, out, done = words, 1, None, 0
    while True:
        if k & span:
            # out covers the first `done` words of each window, have the next `span`
            part = have[done : done + n]
            out = part if out is None else out[:n] * np.uint64(pow(_BASE, span, 1 << 64)) + part
            done += span
        if 2 * span > k:
            break
        have = have[: len(have) - span] * np.uint64(pow(_BASE, span, 1 << 64)) + have[span:]
        span *= 2
    return mixed(out[:n])


def columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


def rows_out(schema: pa.Schema, *cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


Batches = Iterator[pa.RecordBatch]
