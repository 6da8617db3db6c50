"""Health of groups of vectors, from sums that merge over days."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_sums(rows: DataFrame, keys: list[str], vector: str = "v") -> DataFrame:
    """(keys, n, total, squares) in one pass: count, sum of the vectors, sum of their squared lengths. Rows without vector are left out."""
    rows = rows.where(F.col(vector).isNotNull()).withColumn("__v", F.col(vector).cast("array<double>"))
    length = F.aggregate("__v", F.lit(0.0), lambda a, x: a + x * x)
    out = rows.withColumn("__l", length).withColumn("__v", array_to_vector("__v")).groupBy(*keys)
    return out.agg(F.count("*").alias("n"), vector_to_array(Summarizer.sum(F.col("__v"))).alias("total"), F.sum("__l").alias("squares"))


def merged_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of fewer keys, as of all days together."""
    return sums.withColumn("__v", array_to_vector("total")).groupBy(*keys).agg(F.sum("n").alias("n"), vector_to_array(Summarizer.sum(F.col("__v"))).alias("total"), F.sum("squares").alias("squares"))


def _length(total):
    return F.aggregate(total, F.lit(0.0), lambda a, x: a + x * x)


def group_variance(sums: DataFrame, group: str) -> DataFrame:
    """(group, n, within): the mean squared distance of a group's vectors from their mean."""
    return sums.select(group, "n", F.greatest(F.col("squares") / F.col("n") - _length("total") / F.col("n") / F.col("n"), F.lit(0.0)).alias("within"))


def health(sums: DataFrame) -> DataFrame:
    """(n_groups, n, within, between, separation, entropy) of all groups.

    within and between are the parts of the mean squared distance from the mean of all; separation is the
    share of the latter in both (0 if both are 0); entropy is that of the group sizes over its largest value.
    """
    one = sums.withColumn("__q", _length("total") / F.col("n")).withColumn("__v", array_to_vector("total"))
    a = one.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n"), F.sum("squares").alias("s"), F.sum("__q").alias("q"), vector_to_array(Summarizer.sum(F.col("__v"))).alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlog"))
    a = a.where("n_groups > 0").withColumn("all", _length("total") / F.col("n"))
    a = a.withColumn("within", F.greatest((F.col("s") - F.col("q")) / F.col("n"), F.lit(0.0))).withColumn("between", F.greatest((F.col("q") - F.col("all")) / F.col("n"), F.lit(0.0)))
    share = F.when(F.col("within") + F.col("between") > 0, F.col("between") / (F.col("within") + F.col("between"))).otherwise(0.0)
    entropy = F.when(F.col("n_groups") > 1, (F.log("n") - F.col("nlog") / F.col("n")) / F.log("n_groups")).otherwise(0.0)
    return a.select("n_groups", "n", "within", "between", share.alias("separation"), entropy.alias("entropy"))
