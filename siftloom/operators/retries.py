"""Steps that may fail for single rows: attempts, waiting times and dead letters as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "id string, step string, attempts int, error_hash string, due timestamp, status string"


def due(rows: DataFrame, state: DataFrame, step: str, now: Column) -> DataFrame:
    """The ``rows`` (with id) that a run takes: those never tried, and failed ones whose waiting time is over. Done and dead ones are left out."""
    own = state.where(F.col("step") == step).select("id", F.col("due").alias("__due"), F.col("status").alias("__status"))
    j = rows.join(own, "id", "left")
    return j.where(F.col("__status").isNull() | ((F.col("__status") == "waits") & (F.col("__due") <= now))).drop("__due", "__status")


def recorded(state: DataFrame, results: DataFrame, step: str, now: Column, most: int = 3, wait: int = 60) -> DataFrame:
    """``state`` after a run with ``results`` (id, error; null if it went well).

    A row that went well is done. One that failed waits ``wait`` seconds, twice as long after each further
    failure, and is dead after ``most``; an error is kept as its hash. Of a row's several results in a run
    a failure counts, once. Rows of other steps and rows without result stay.
    """
    new = results.groupBy("id").agg(F.max("error").alias("error"))
    own, others = state.where(F.col("step") == step), state.where(F.col("step") != step)
    j = own.join(new.withColumn("__ran", F.lit(True)), "id", "full")
    ran, ok = F.coalesce("__ran", F.lit(False)), F.col("error").isNull()
    attempts = F.coalesce("attempts", F.lit(0)) + F.when(ran, 1).otherwise(0)
    status = F.when(~ran, F.col("status")).when(ok, "done").when(attempts >= most, "dead").otherwise("waits")
    later = F.timestamp_seconds(F.unix_timestamp(now) + wait * F.pow(F.lit(2), attempts - 1).cast("long"))
    return others.unionByName(
        j.select(
            "id", F.lit(step).alias("step"), attempts.cast("int").alias("attempts"), F.when(~ran, F.col("error_hash")).when(~ok, F.sha2("error", 256)).alias("error_hash"),
            F.when(~ran, F.col("due")).when(status == "waits", later).alias("due"), status.alias("status"),
        )
    )


def attempted(rows: DataFrame, value: Column, error: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with ``value`` that went well, results for ``recorded``): a step as a value and its error, so a bad row stops no other."""
    out = rows.withColumn("value", value).withColumn("__error", error)
    return out.where("__error is null").drop("__error"), out.select("id", F.col("__error").alias("error"))
