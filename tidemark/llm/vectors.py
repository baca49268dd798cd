"""What the two vector searches share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: str = "embedding") -> Column:
    """Not null, and no null or non-finite component."""
    return F.col(c).isNotNull() & F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id (long, not null), embedding (array<double>) of the vectors that take part."""
    return embeddings.where(F.col("vec_id").isNotNull() & finite()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
