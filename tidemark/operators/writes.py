"""Slowly changing rows and guarded loads: parquet has no update, so each gives the rows to write."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scd2(current: DataFrame, incoming: DataFrame, keys: list[str], content: list[str], at) -> DataFrame:
    """current: keys, content, valid_from, revision (open rows). incoming: keys, content. All rows after the load: an equal row is TOUCHED and stays
    open, a changed one is CLOSED and OPENED anew with the next revision, an absent one CLOSED, a new one OPENED with revision 1."""
    old = current.select(*keys, F.struct(*content).alias("was"), "valid_from", "revision")
    new = incoming.select(*keys, F.struct(*content).alias("now"))
    x = old.join(new, keys, "full_outer")
    at = F.lit(at).cast("date")
    row = lambda body, since, until, revision, action: F.struct(body.alias("body"), since.alias("valid_from"), until.alias("valid_to"), revision.alias("revision"), F.lit(action).alias("action"))
    open_ = F.lit(None).cast("date")
    one = F.lit(1).cast("long")
    rows = (
        F.when(F.col("was").isNull(), F.array(row(F.col("now"), at, open_, one, "OPENED")))
        .when(F.col("now").isNull(), F.array(row(F.col("was"), F.col("valid_from"), at, F.col("revision"), "CLOSED")))
        .when(F.col("was") == F.col("now"), F.array(row(F.col("was"), F.col("valid_from"), open_, F.col("revision"), "TOUCHED")))
        .otherwise(F.array(row(F.col("was"), F.col("valid_from"), at, F.col("revision"), "CLOSED"), row(F.col("now"), at, open_, F.col("revision") + 1, "OPENED")))
    )
    return x.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.body.*", "r.valid_from", "r.valid_to", "r.revision", "r.action")


def overlaps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose half-open range [start, end) begins before an earlier one of the same keys has ended."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("until", F.max(end).over(before)).where(F.col(start) < F.col("until")).drop("until")


def load_labels(held: DataFrame, incoming: DataFrame, key: str, output: str) -> DataFrame:
    """What a load does with each incoming label: INSERT, SKIP (held already, same output) or CONFLICT (held with another one)."""
    x = incoming.select(key, F.col(output).alias("now")).join(held.select(key, F.col(output).alias("was"), F.lit(True).alias("held")), key, "left")
    return x.select(key, F.when(F.col("held").isNull(), "INSERT").when(F.col("was").eqNullSafe(F.col("now")), "SKIP").otherwise("CONFLICT").alias("action"))


def write_days(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that rows hold, and no others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def import_bundle(rows: DataFrame, path: str, digest: str) -> bool:
    """Write rows under their input's digest, once: a bundle that was written whole before is left alone (False). Readers take all bundles of
    path; a bundle that broke off has no mark of success and is written anew."""
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bundle={digest}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(target, "_SUCCESS")):
        return False
    rows.write.mode("overwrite").parquet(f"{path}/bundle={digest}")
    return True


def with_key(rows: DataFrame, name: str, *columns: str) -> DataFrame:
    """A surrogate key from the natural one, the same on every run: nulls differ from empty strings, and no two lists of values read alike."""
    coded = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return rows.withColumn(name, F.sha2(F.concat_ws("|", *coded), 256))
