"""Logical recommendation tables derived from the driver's parquet tables.

The driver ships TPC-H-like tables; these functions re-shape them into the
ratings / movies / links / vectors layout the operators work on. Every
mapping is a projection or an equi-join, so Catalyst prunes columns and
pushes filters into the parquet scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Total order of ratings: event time, then the source-row columns that make
# every rating unique (the same user may rate the same item twice a day).
TIE_BREAK = ["l_orderkey", "l_linenumber", "movieId", "l_suppkey", "l_quantity", "l_extendedprice"]
RATING_ORDER = ["timestamp"] + TIE_BREAK


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_seconds(ts: Column) -> Column:
    """Midnight timestamp -> epoch seconds as bigint."""
    return F.unix_date(F.to_date(ts)).cast("long") * F.lit(86400)


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId, movieId, rating 0.5..5.0, timestamp (epoch s) + tie-break columns."""
    li = _read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    od = _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        F.col("o_custkey").alias("userId"),
        F.col("l_partkey").alias("movieId"),
        (F.ceil(F.col("l_quantity") / F.lit(5.0)) * F.lit(0.5)).alias("rating"),
        epoch_seconds(F.col("o_orderdate")).alias("timestamp"),
        "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice",
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, title "Name (YYYY)" (bare name for some), genres "A|B|C"."""
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    words = F.split(F.col("p_name"), " ")
    three = F.array(F.col("p_type"), F.get(words, 0), F.get(words, 1))
    n_genres = (F.col("p_partkey") % 3 + 1).cast("int")
    title = F.when(F.col("p_partkey") % 97 == 0, F.col("p_name")).otherwise(
        F.concat(F.col("p_name"), F.lit(" ("), (F.lit(1950) + F.col("p_size")).cast("string"), F.lit(")")))
    return p.select(
        F.col("p_partkey").alias("movieId"),
        title.alias("title"),
        F.array_join(F.slice(three, F.lit(1), n_genres), "|").alias("genres"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, imdbId (7-digit text), tmdbId (text, null for some)."""
    p = _read(spark, sf_dir, "part").select("p_partkey")
    return p.select(
        F.col("p_partkey").alias("movieId"),
        F.lpad((F.col("p_partkey") + 100000).cast("string"), 7, "0").alias("imdbId"),
        F.when(F.col("p_partkey") % 89 == 0, F.lit(None).cast("string"))
        .otherwise((F.col("p_partkey") + 500).cast("string")).alias("tmdbId"),
    )


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """movieId, emb array<float>."""
    e = _read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("movieId"), F.col("embedding").alias("emb"))


def user_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """userId = max(vec_id) - vec_id, emb array<float>."""
    e = _read(spark, sf_dir, "embeddings")
    top = e.agg(F.max("vec_id").alias("m"))
    return e.select((F.lit(top.scalar()) - F.col("vec_id")).alias("userId"),
                    F.col("embedding").alias("emb"))
