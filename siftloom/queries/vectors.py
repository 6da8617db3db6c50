"""Queries of hashes, vectors and neighbour searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import rounded
from ..operators.similarity import first_come, hamming_codes, nearest
from ..plans.tables import saved, sent_if_small
from ..sources.tables import load


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def knn_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    v = _vectors(spark, sf_dir)
    return nearest(v.where("id % 50 = 0"), v, 5).select("query", "id", "rank", rounded(F.col("cosine"), 4).alias("cosine"))


KNN_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings),
p AS (SELECT q.id AS query, t.id, list_cosine_similarity(q.v, t.v) AS c FROM v q JOIN v t ON q.id % 50 = 0 AND q.id <> t.id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY c DESC, id) AS rank FROM p)
SELECT query, id, rank::int AS rank, floor(c * 10000 + 0.5) / 10000 AS cosine FROM r WHERE rank <= 5
"""


def cosine_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate, near or new by the nearest vector: from 0.985, from 0.90, below."""
    v = _vectors(spark, sf_dir)
    best = nearest(v.where("id % 50 = 0"), v, 1)
    band = F.when(F.col("cosine") >= 0.985, "duplicate").when(F.col("cosine") >= 0.9, "near").otherwise("new")
    return best.groupBy(band.alias("band")).agg(F.count("*").alias("n"))


BANDS_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings),
p AS (SELECT q.id, max(list_cosine_similarity(q.v, t.v)) AS c FROM v q JOIN v t ON q.id % 50 = 0 AND q.id <> t.id GROUP BY q.id)
SELECT CASE WHEN c >= 0.985 THEN 'duplicate' WHEN c >= 0.9 THEN 'near' ELSE 'new' END AS band, count(*) AS n FROM p GROUP BY 1
"""


def semantic_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose classification a query may reuse: its nearest eligible vector, if at 0.95 or nearer.

    Eligible are vectors whose document is labelled good; the threshold is tested on the nearest
    one only.
    """
    v = _vectors(spark, sf_dir)
    good = load(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    queries = v.where("id % 50 = 0")
    best = nearest(queries, v.join(good, "id", "left_semi"), 1)
    hit = best.where("cosine >= 0.95").select("query", F.col("id").alias("source"))
    return queries.select(F.col("id").alias("query")).join(hit, "query", "left").withColumn("status", F.when(F.col("source").isNull(), "miss").otherwise("cache_hit"))


CACHE_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::double[] AS v FROM embeddings), g AS (SELECT * FROM v WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)),
p AS (SELECT q.id AS query, t.id, list_cosine_similarity(q.v, t.v) AS c FROM v q JOIN g t ON q.id % 50 = 0 AND q.id <> t.id),
b AS (SELECT query, id, c FROM p QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id) = 1)
SELECT v.id AS query, b.id AS source, CASE WHEN b.id IS NULL THEN 'miss' ELSE 'cache_hit' END AS status FROM v LEFT JOIN b ON b.query = v.id AND b.c >= 0.95 WHERE v.id % 50 = 0
"""


def centroid_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and radius of each label's group around its first vector."""
    v = _vectors(spark, sf_dir)
    first = v.groupBy("label").agg(F.min_by("v", "id").alias("rep"))
    far = 1 - V.cosine(F.col("v"), F.col("rep"))
    return v.join(sent_if_small(saved(first, "first")), "label").groupBy("label").agg(F.count("*").alias("n"), rounded(F.max(far), 4).alias("radius"))


RADIUS_SQL = """
WITH v AS (SELECT vec_id AS id, embedding::double[] AS v, label FROM embeddings), f AS (SELECT label, arg_min(v, id) AS rep FROM v GROUP BY label)
SELECT label, count(*) AS n, floor(max(1 - list_cosine_similarity(v, rep)) * 10000 + 0.5) / 10000 AS radius FROM v JOIN f USING (label) GROUP BY label
"""


def simhash_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash of every benchmark item."""
    return load(spark, sf_dir, "benchmark").select("item_id", V.simhash64("text").alias("simhash"))


_BIT = " + ".join(f"(CASE WHEN b{k} * 2 > n THEN {1 << (63 - k)}::hugeint ELSE 0 END)" for k in range(64))


def _hashes(key: str, table: str) -> str:
    """CTEs up to sh (key, simhash) for the texts of ``table``."""
    return rf"""
t AS (SELECT {key} AS k, trim(regexp_replace(nfc_normalize(lower(coalesce(text, ''))), '\s+', ' ', 'g')) AS t FROM {table}),
g AS (SELECT k, substr(md5(substr(t, i, 3)), 1, 16) AS h FROM (SELECT k, t, unnest(range(1, greatest(length(t) - 1, 2))) AS i FROM t WHERE length(t) > 0)),
x AS (SELECT k, ('0x' || substr(h, 1, 8))::bigint AS hi, ('0x' || substr(h, 9, 8))::bigint AS lo FROM g),
v AS (SELECT k, count(*) AS n, {", ".join(f"sum(({'hi' if k < 32 else 'lo'} >> {31 - k % 32}) & 1) AS b{k}" for k in range(64))} FROM x GROUP BY k),
s AS (SELECT k, {_BIT} AS u FROM v),
sh AS (SELECT t.k, CASE WHEN u IS NULL THEN 0 WHEN u >= 9223372036854775808 THEN (u - 18446744073709551616)::bigint ELSE u::bigint END AS simhash FROM t LEFT JOIN s USING (k))"""


SIMHASH_SQL = f"WITH {_hashes('item_id', 'benchmark')} SELECT k AS item_id, simhash FROM sh"


def dedup_first_come(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns that repeat an earlier kept one, by SimHash; decided in order of arrival."""
    rows = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), V.simhash64("text").alias("simhash"))
    rows = rows.groupBy("id").agg(F.min("simhash").alias("simhash"))
    return first_come(rows, alike=hamming_codes(rows))


#: Rows are decided one after the other: each step adds a row to those gone if a row before it stayed.
FIRST_COME_SQL = f"""
WITH RECURSIVE {_hashes("rid", "(SELECT row_number() OVER () AS rid, * FROM cs)").replace("t AS (", "cs AS (SELECT conv_id * 1000 + turn AS id, text FROM conversations), own AS MATERIALIZED (SELECT row_number() OVER () AS rid, * FROM cs), t AS (", 1).replace("(SELECT row_number() OVER () AS rid, * FROM cs))", "own)", 1)},
h AS MATERIALIZED (SELECT id, min(simhash) AS h FROM sh JOIN own ON rid = k GROUP BY id),
p AS MATERIALIZED (SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h)) AS d FROM h a JOIN h b ON a.id < b.id AND a.h <> 0 AND b.h <> 0 AND bit_count(xor(a.h, b.h)) <= 3),
n AS MATERIALIZED (SELECT b, list(a) AS near, row_number() OVER (ORDER BY b) AS k FROM p GROUP BY b),
r AS (SELECT 0::bigint AS k, []::bigint[] AS gone UNION ALL SELECT r.k + 1, CASE WHEN len(list_filter(near, lambda y: NOT list_contains(gone, y))) > 0 THEN list_append(gone, b) ELSE gone END FROM r JOIN n ON n.k = r.k + 1),
z AS MATERIALIZED (SELECT unnest(gone) AS id FROM (SELECT gone FROM r ORDER BY k DESC LIMIT 1)),
f AS (SELECT b, arg_min(a, (d, a)) AS a FROM p WHERE b IN (FROM z) AND a NOT IN (FROM z) GROUP BY b)
SELECT h.id, f.a AS duplicate_of FROM h LEFT JOIN f ON f.b = h.id
"""


def dedup_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of every distinct text, and how many it stands for."""
    docs = load(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return docs.groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


QUERIES = {f.__name__: f for f in (knn_top5, cosine_bands, semantic_cache, centroid_radius, simhash_codes, dedup_first_come, dedup_exact)}
ORACLES = {
    "knn_top5": KNN_SQL, "cosine_bands": BANDS_SQL, "semantic_cache": CACHE_SQL, "centroid_radius": RADIUS_SQL, "simhash_codes": SIMHASH_SQL, "dedup_first_come": FIRST_COME_SQL,
    "dedup_exact": "SELECT min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY coalesce(text, '')",
}
