"""Small column functions on numbers and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..lineage import cut, join_weighed


def nan_to_null(x: Column | str) -> Column:
    """NaN becomes null."""
    return F.when(~F.isnan(x), F.col(x) if isinstance(x, str) else x)


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x))."""
    return 1 / (1 + F.exp(-x))


def share_of_max(rows: DataFrame, x: str, by: str) -> DataFrame:
    """Adds ``share``, the value divided by its group's greatest; 0 where that is not positive.

    The maxima are combined before the shuffle and joined back, so a group of any size is no task's work.
    Rows with a null group are a group of their own.
    """
    name = F.coalesce(F.col(by).cast("string"), F.lit("\u0000"))
    tops = cut(rows.groupBy(name.alias("_by")).agg(F.max(x).alias("_top"), F.count("*").alias("_n")))
    joined = join_weighed(rows.withColumn("_by", name), tops, "_by", "_n")
    return joined.withColumn("share", F.when(F.col("_top") > 0, F.col(x) / F.col("_top")).otherwise(0.0)).drop("_by", "_top")


def new_id() -> Column:
    """A random identifier of a row (UUID version 4)."""
    return F.uuid()


def n_batches(n: Column, size: int) -> Column:
    """How many batches of ``size`` hold ``n`` items."""
    return F.ceil(n / size)


def preview(text: Column | str, n: int = 80) -> Column:
    """The first ``n`` characters."""
    return F.substring(text, 1, n)


def public_row(df: DataFrame, *hidden: str) -> DataFrame:
    """Each row as one JSON string, without the columns ``hidden``; nulls are left out."""
    return df.select(F.to_json(F.struct(*(c for c in df.columns if c not in hidden))).alias("json"))


def masked_mean(tokens: Column | str, mask: Column | str, dims: int) -> Column:
    """The mean of the token vectors (array of arrays) whose mask is not 0; zeros where all are masked."""
    both = F.zip_with(tokens, mask, lambda v, m: F.when(m != 0, v))
    vectors = F.filter(both, lambda v: v.isNotNull())
    total = lambda i: F.aggregate(vectors, F.lit(0.0), lambda s, v: s + v[i].cast("double"))
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: total(i) / F.greatest(F.size(vectors).cast("double"), F.lit(1e-9)))
