"""Item tables made from the driver's tables by fixed arithmetic, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import average_hash, word_hash
from ..functions.vectors import doubles


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three embeddings with the lowest ids."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(3).select("vec_id", doubles(F.col("embedding")).alias("vec"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    i = F.col("vec_id")
    return e.select(
        F.lit("all").alias("collection"), "vec_id",
        F.concat(F.lit("set"), (i % 7).cast("string"), F.lit("/item"), F.lpad(i.cast("string"), 6, "0"), F.lit(".png")).alias("path"),
        F.sha2(i.cast("string"), 256).alias("fingerprint"),
        F.when(i % 29 == 0, 0).when(i % 17 == 0, 2).otherwise(1).alias("subjects"), (i % 53 == 0).alias("invalid"),
        ((i * 37 % 101) / 100.0).alias("quality"), (i * 53 % 181 - 90).cast("double").alias("yaw"), (i * 31 % 121 - 60).cast("double").alias("pitch"),
        F.element_at(F.array(*map(F.lit, ("neutral", "smiling", "surprised"))), (i % 3 + 1).cast("int")).alias("expression"),
        doubles(F.col("embedding")).alias("vec"))


ITEMS_SQL = """
    items AS (
        SELECT 'all' AS collection, vec_id, 'set' || (vec_id % 7) || '/item' || lpad(vec_id::VARCHAR, 6, '0') || '.png' AS path,
               sha256(vec_id::VARCHAR) AS fingerprint,
               (CASE WHEN vec_id % 29 = 0 THEN 0 WHEN vec_id % 17 = 0 THEN 2 ELSE 1 END)::INT AS subjects, vec_id % 53 = 0 AS invalid,
               (vec_id * 37 % 101)::DOUBLE / 100.0::DOUBLE AS quality, (vec_id * 53 % 181 - 90)::DOUBLE AS yaw, (vec_id * 31 % 121 - 60)::DOUBLE AS pitch,
               (['neutral', 'smiling', 'surprised'])[(vec_id % 3 + 1)::INT] AS expression, embedding::DOUBLE[] AS vec
        FROM embeddings)"""
REFS_SQL = "refs AS (SELECT vec_id, embedding::DOUBLE[] AS vec FROM embeddings ORDER BY vec_id LIMIT 3)"
TARGET_SQL = """
    target AS (
        SELECT list(x ORDER BY i) AS c FROM (
            SELECT i, sum(v / n) AS x FROM (
                SELECT unnest(vec) AS v, generate_subscripts(vec, 1) AS i, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS n FROM refs) GROUP BY i))"""
MATCHED_SQL = f"""{ITEMS_SQL}, {REFS_SQL}, {TARGET_SQL},
    matched AS (SELECT items.*, round(least(greatest((list_cosine_similarity(vec, c) + 1) / 2, 0), 1), 6)::DOUBLE AS match FROM items, target)"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items, hashed by words."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    i = F.col("doc_id")
    bare = d.select("doc_id", F.concat("source", F.lit("/"), F.lpad(i.cast("string"), 8, "0")).alias("path"), F.sha2("text", 256).alias("fingerprint"), ((i * 37 % 101) / 100.0).alias("quality"), "text")
    hashed = word_hash(bare.groupBy("fingerprint").agg(F.first("text").alias("text")), "fingerprint", "text")
    best = bare.groupBy("fingerprint").agg(F.max("quality").alias("quality"))  # equal bytes have equal quality
    return bare.drop("text", "quality").join(best, "fingerprint").join(hashed, "fingerprint")


DOCS_SQL = """
    bare AS (SELECT doc_id, source || '/' || lpad(doc_id::VARCHAR, 8, '0') AS path, sha256(coalesce(text, '')) AS fingerprint, coalesce(text, '') AS text FROM documents),
    buckets AS (
        SELECT doc_id, ('0x' || substr(md5(w), 1, 2))::INT % 64 AS b, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM bare) GROUP BY ALL),
    hashes AS (
        SELECT doc_id, sum(CASE WHEN n * 64 >= total AND b < 32 THEN 1::BIGINT << (31 - b) ELSE 0 END)::BIGINT AS hi, sum(CASE WHEN n * 64 >= total AND b >= 32 THEN 1::BIGINT << (63 - b) ELSE 0 END)::BIGINT AS lo
        FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total FROM buckets) GROUP BY doc_id),
    docs AS MATERIALIZED (
        SELECT bare.doc_id, path, fingerprint, max((bare.doc_id * 37 % 101)::DOUBLE / 100.0::DOUBLE) OVER (PARTITION BY fingerprint) AS quality, hi, lo,
               lower(printf('%08x%08x', hi, lo)) AS hash
        FROM bare JOIN hashes USING (doc_id))"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 tiles and their average hash."""
    return table(spark, sf_dir, "embeddings").select("vec_id", average_hash(doubles(F.col("embedding"))).alias("hash"))
