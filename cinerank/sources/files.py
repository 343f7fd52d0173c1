"""File sources and sinks (IO1-IO6): header CSV with explicit schemas, the
`id:f f f` embedding text format, and sample folders.

All readers take an explicit StructType (no inference, no all-string
columns). A malformed row never fails the job: readers leave it out, whatever
columns are read, and `csv_rejects` / `embedding_rejects` return such lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinerank.functions.columns import parse_vector, vector_text

RATINGS_SCHEMA = T.StructType([
    T.StructField("userId", T.LongType()), T.StructField("movieId", T.LongType()),
    T.StructField("rating", T.DoubleType()), T.StructField("timestamp", T.LongType())])
MOVIES_SCHEMA = T.StructType([
    T.StructField("movieId", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("genres", T.StringType())])
LINKS_SCHEMA = T.StructType([
    T.StructField("movieId", T.LongType()), T.StructField("imdbId", T.StringType()),
    T.StructField("tmdbId", T.StringType())])


REJECT = "_corrupt_record"


def _parsed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    full = T.StructType(list(schema.fields) + [T.StructField(REJECT, T.StringType())])
    return (spark.read.schema(full).option("header", True).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", REJECT).csv(path))


def _read_columns(schema: T.StructType):
    """Always true, but reads all columns, so that a row is parsed whole and the
    same rows are well-formed whatever columns a query needs."""
    return F.length(F.concat_ws("", *[F.col(c).cast("string") for c in schema.fieldNames()])) >= 0


def _csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Well-formed rows; which they are does not depend on the columns read."""
    return _parsed(spark, path, schema).filter(F.col(REJECT).isNull() & _read_columns(schema)).drop(REJECT)


def csv_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The malformed lines of a CSV source, for a quarantine output."""
    return _parsed(spark, path, schema).filter(F.col(REJECT).isNotNull() & _read_columns(schema)).select(
        F.col(REJECT).alias("line"))


def read_ratings(spark: SparkSession, path: str, schema: T.StructType = RATINGS_SCHEMA) -> DataFrame:
    """IO1: ratings CSV with header."""
    return _csv(spark, path, schema)


def _strict(spark: SparkSession, path: str, n_fields: int) -> DataFrame:
    """Lines that split into exactly n fields on every comma, as a
    naive line splitter would read them: trailing empty fields are dropped
    before counting, and the header line is skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", ",+$", "").alias("v"))
    parts = F.split("v", ",")
    return lines.filter(F.size(parts) == n_fields).select(parts.alias("p"))


def read_movies(spark: SparkSession, path: str, strict_columns: bool = False) -> DataFrame:
    """IO2: movies CSV; quoted titles with commas are kept. strict_columns
    keeps only lines with exactly three comma-separated fields."""
    if not strict_columns:
        return _csv(spark, path, MOVIES_SCHEMA)
    p = _strict(spark, path, 3)
    return (p.select(F.get("p", 0).try_cast("long").alias("movieId"), F.get("p", 1).alias("title"),
                     F.get("p", 2).alias("genres")).filter(F.col("movieId").isNotNull()))


def read_links(spark: SparkSession, path: str, strict_columns: bool = False) -> DataFrame:
    """IO3: links CSV; an empty tmdbId reads as null. strict_columns drops
    such lines."""
    if not strict_columns:
        return _csv(spark, path, LINKS_SCHEMA)
    p = _strict(spark, path, 3)
    return (p.select(F.get("p", 0).try_cast("long").alias("movieId"), F.trim(F.get("p", 1)).alias("imdbId"),
                     F.trim(F.get("p", 2)).alias("tmdbId")).filter(F.col("movieId").isNotNull()))


def _embedding_fields(spark: SparkSession, path: str):
    """Lines of a vector file with their parsed id and vector, null where a
    line has not exactly one ':', no numeric id, or a field that is no number."""
    p = F.split("value", ":")
    two = F.size(p) == 2
    emb = F.when(two, parse_vector(F.get(p, 1)))
    return spark.read.text(path).select(
        "value", F.when(two, F.trim(F.get(p, 0)).try_cast("long")).alias("id"),
        F.when(~F.exists(emb, lambda x: x.isNull()), emb).alias("emb"))


def read_embeddings(spark: SparkSession, path: str, id_col: str = "movieId") -> DataFrame:
    """IO4: `id:f f f` lines -> (id, array<float>); other lines are left out."""
    return (_embedding_fields(spark, path).filter(F.col("id").isNotNull() & F.col("emb").isNotNull())
            .select(F.col("id").alias(id_col), "emb"))


def embedding_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that `read_embeddings` leaves out."""
    return (_embedding_fields(spark, path).filter(F.col("id").isNull() | F.col("emb").isNull())
            .select(F.col("value").alias("line")))


def embedding_lines(vectors: DataFrame, id_col: str = "movieId") -> DataFrame:
    """V2: (id, array<float>) -> `id:f f f` text."""
    return vectors.select(F.concat(F.col(id_col).cast("string"), F.lit(":"), vector_text("emb")).alias("value"))


def write_embeddings(vectors: DataFrame, path: str, id_col: str = "movieId") -> None:
    """IO5: write vectors as `id:f f f` text files."""
    embedding_lines(vectors, id_col).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.option("header", True).mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_samples(split: DataFrame, path: str) -> dict[str, int]:
    """IO6 / A16: train/test CSV folders with header (`part=train`, `part=test`),
    written in parallel; no single-task funnel. The rows of each part are
    counted by the job that writes them."""
    seen = Observation("samples")
    write_csv(split.observe(seen, *[F.count(F.when(F.col("part") == p, 1)).alias(p) for p in ("train", "test")]), path, ["part"])
    return seen.get
