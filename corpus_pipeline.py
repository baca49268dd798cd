"""From raw documents to packed training sequences: five stages, each written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import mixing, packing, pii, quality, sketches
from tidemark.llm.common import by_sorting, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null and empty texts are scored as the empty text, repeated rows each by itself, whole
    texts whatever their length; an empty table stays empty; any other columns stay as they are."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: that of least doc_id. Rows without doc_id stay.

    Different texts under one doc_id are documents of their own: the text of least hash goes by the doc_id, the others by numbers
    of 62 bits, which come last in a group. Of rows with equal doc_id and text that of least other columns stays. Null and empty
    texts link with nothing; texts of any length are compared whole; an empty table stays empty; any other columns stay as they are.
    """
    # the row travels as one struct, so that no column of it meets a name of ours
    rows = docs.where("doc_id is not null").select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    h = F.xxhash64("text")
    shared = stage(rows.groupBy("doc_id").agg(F.min(h).alias("least"), F.max(h).alias("most")).where("least <> most").select("doc_id", "least"))
    if shared.isEmpty():
        keyed = rows
    else:
        other = F.shiftrightunsigned(F.xxhash64("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256), F.col("text").isNull()), 2) + F.lit(1 << 62)
        own = F.when(F.col("least").isNull() | (h == F.col("least")), F.col("doc_id")).otherwise(other)
        keyed = stage(rows.join(by_sorting(shared), "doc_id", "left").select("row", own.alias("doc_id"), "text"))
    kept = sketches.near_duplicates(keyed).where("kept").select("doc_id").distinct()
    sorted_by = [F.col(f"row.`{f.name}`") for f in docs.schema if f.name != "text" and f.dataType.typeName() not in ("map", "variant")]
    least = Window.partitionBy("doc_id").orderBy(*sorted_by, "text")
    one = keyed.join(by_sorting(kept), "doc_id", "left_semi").withColumn("place", F.row_number().over(least)).where("place = 1").select("row.*")
    return one.unionByName(docs.where("doc_id is null"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data give way to their kind in brackets, in whole texts of any length. Null and empty texts stay; repeated rows
    are read each by itself; an empty table stays empty; n_chars follows the text, any other columns stay as they are."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once for each pass over its source in which the mix takes it, in the order of the mix's slots: files
    and rows follow the schedule, so that every stretch of them holds the sources in their proportions.

    The one document at a source's end that is taken in part counts as taken if half of it or more is; empty and null texts have nothing
    to take and go. Rows equal in doc_id, source and size are taken alike: in a pass that takes half of them or more. Texts of any length
    count whole; an empty table stays empty; any other columns stay as they are.
    """
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0)).cast("long")
    met = mixing.passes(docs).where("size > 0").groupBy("doc_id", "source", "size", "pass")
    taken = met.agg(F.avg((F.col("used") * 2 >= F.col("size")).cast("int")).alias("part"), F.min("first_slot").alias("slot")).where("part >= 0.5")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").alias("of"), words.alias("n"))
    copies = rows.join(by_sorting(taken), F.expr("id <=> doc_id and of <=> source and n = size"))
    return copies.repartitionByRange("slot", "id").sortWithinPartitions("slot", "id").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row a piece of a packed sequence. Null and empty texts are one end mark; repeated rows are packed each by itself."""
    return packing.digest(packing.pack(docs))


STAGES = [
    ("quality classifier", quality_stage),
    ("near-duplicates", near_duplicate_stage),
    ("personal data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the tokenizer have no SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
