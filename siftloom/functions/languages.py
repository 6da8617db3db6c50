"""Languages by letter triples: ranked profiles fitted from given texts, and out-of-place distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import detect_language

#: Triples of a profile, and of a text, that are ranked.
TOP = 300


#: Three characters from every place on, found in one pass; no place is within a character of two code units.
OVERLAPPING = r"(?![\x{DC00}-\x{DFFF}])(?=(.{3}))"


def triples(c: Column) -> Column:
    """The letter triples of a text in lower case; all that is no letter is one space, also around the text."""
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))
    return F.regexp_extract_all(t, F.lit(OVERLAPPING), F.lit(1))


def _ranked(counts: DataFrame, key: str) -> DataFrame:
    """(key, gram, rank): the ``TOP`` most frequent triples, from 1, smaller ones first of equals."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= TOP).select(key, "gram", "rank")


def fit(texts: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, gram, rank): a profile for each language of ``texts``; rows without language are left out."""
    grams = texts.where(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.explode(triples(F.col(text))).alias("gram"))
    return _ranked(grams.groupBy("lang", "gram").agg(F.count("*").alias("n")), "lang")


def by_triples(texts: DataFrame, profiles: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, language): the profile whose ranks differ least from the text's, summed over the text's triples.

    A triple that a profile lacks counts ``TOP``. Texts that share no triple with any profile have no row. Ties go to the smaller name. Keys are unique. Texts are counted triple by triple in
    map-side sums; profiles have ``TOP`` rows a language and are sent to all executors.
    """
    grams = texts.select(F.col(key).alias("id"), F.explode(triples(F.col(text))).alias("gram"))
    own = _ranked(grams.groupBy("id", "gram").agg(F.count("*").alias("n")), "id")
    known = F.map_from_entries(F.collect_list(F.struct("lang", "rank"))).alias("ranks")
    langs = F.broadcast(profiles.agg(F.array_sort(F.collect_set("lang")).alias("langs")))
    table = F.broadcast(profiles.withColumnRenamed("rank", "r").select("lang", "gram", F.col("r").alias("rank")).groupBy("gram").agg(known))
    j = own.join(table, "gram", "left").join(langs)
    apart = F.transform("langs", lambda g: F.struct(g.alias("lang"), F.coalesce(F.abs(F.element_at("ranks", g) - F.col("rank")), F.lit(TOP)).alias("d")))
    each = j.select("id", F.explode(apart).alias("x")).groupBy("id", F.col("x.lang").alias("lang")).agg(F.sum("x.d").alias("d"), F.count("*").alias("n"))
    best = each.groupBy("id").agg(F.min_by("lang", F.struct("d", "lang")).alias("language"), F.min("d").alias("d"), F.first("n").alias("n"))
    return best.where(F.col("d") < TOP * F.col("n")).select("id", "language").withColumnRenamed("id", key)


def with_language(texts: DataFrame, profiles: DataFrame, key: str = "id", text: str = "text", into: str = "lang") -> DataFrame:
    """``texts`` with struct ``into`` (language, confidence): Hangul and short texts by rule, scripts of one language by their share, all else by triples at 0.8."""
    rule = texts.withColumn("__rule", detect_language(F.col(text)))
    ruled = F.col("__rule.language").isin("ko", "ja", "zh", "ru", "ar", "th") | (F.length(text) < 10)
    found = by_triples(texts.where(F.length(text) >= 10), profiles, key, text).withColumnRenamed("language", "__found")
    j = rule.join(found, key, "left")
    other = F.struct(F.coalesce("__found", F.lit("unknown")).alias("language"), F.when(F.col("__found").isNull(), 0.0).otherwise(0.8).alias("confidence"))
    return j.withColumn(into, F.when(ruled, F.col("__rule")).otherwise(other)).drop("__rule", "__found")
