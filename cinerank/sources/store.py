"""Keyed feature table (IO7-IO11): the batch stand-in for a key-value
serving store. Rows are (key string, fields map<string,string>,
expires_at timestamp), stored as parquet under one base folder in shared
storage, partitioned by a hash of the key. `put` rewrites only the parts its keys
lie in (dynamic partition overwrite): the merged rows are first written elsewhere,
then take the place of these parts, so nothing is read while it is replaced, and a
put that failed is put again. Puts to different parts do not see each other; one
writer at a time per part. A table read before a put is to be read anew after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.session import write_once

PARTS = 64
STORE_SCHEMA = "key string, fields map<string,string>, expires_at timestamp"


def feature_map(cols: list[str]) -> Column:
    """Row -> map of field name -> text value; null -> ""."""
    pairs = []
    for c in cols:
        pairs += [F.lit(c), F.coalesce(F.col(c).cast("string"), F.lit(""))]
    return F.create_map(*pairs)


def keyed(df: DataFrame, prefix: str, id_col: str, value_cols: list[str], expires_at: Column) -> DataFrame:
    """Rows to store records with key `<prefix><id>`."""
    return df.select(F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("key"),
                     feature_map(value_cols).alias("fields"), expires_at.cast("timestamp").alias("expires_at"))


class FeatureStore:
    def __init__(self, spark: SparkSession, base: str, parts: int = PARTS):
        self.spark, self.base, self.parts = spark, base, parts

    def _rows(self) -> DataFrame:
        """All records with the part they lie in."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{STORE_SCHEMA}, part int")
        return self.spark.read.schema(f"{STORE_SCHEMA}, part int").parquet(self.base)

    def current(self) -> DataFrame:
        """All records, expired ones too."""
        return self._rows().drop("part")

    def put(self, records: DataFrame) -> int:
        """Upsert records (key, fields, expires_at); returns how many parts were rewritten."""
        new = write_once(records.select("key", "fields", "expires_at",
                                        F.pmod(F.xxhash64("key"), F.lit(self.parts)).cast("int").alias("part")), "store-new")
        touched = [r.part for r in new.select("part").distinct().collect()]  # self.parts at most
        if touched:
            kept = self._rows().where(F.col("part").isin(touched)).join(new.select("key"), "key", "left_anti")
            merged = write_once(kept.unionByName(new), "store-merged")
            (merged.hint("rebalance", "part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("part").parquet(self.base))
        return len(touched)

    def get(self, prefix: str, now: Column | None = None) -> DataFrame:
        """IO10: records under a key prefix that have not expired, with the
        id after the ':' parsed out."""
        now = now if now is not None else F.current_timestamp()
        cur = self.current().filter(F.col("key").startswith(prefix) & (F.col("expires_at") > now))
        return cur.withColumn("id", F.get(F.split("key", ":"), 1))

    def lookup(self, ids: DataFrame, prefix: str, id_col: str, now: Column | None = None) -> DataFrame:
        """IO11: point gets for a table of ids (left join; misses and expired
        records -> null)."""
        now = now if now is not None else F.current_timestamp()
        keys = ids.select(F.col(id_col), F.concat(F.lit(prefix), F.col(id_col).cast("string")).alias("key"))
        return keys.join(self.current().filter(F.col("expires_at") > now), "key", "left")


def put_user_features(store: FeatureStore, latest_users: DataFrame, cols: list[str], expires_at: Column) -> int:
    """IO7: newest user rows -> `uf:<userId>` records."""
    return store.put(keyed(latest_users, "uf:", "userId", cols, expires_at))


def put_item_features(store: FeatureStore, latest_items: DataFrame, cols: list[str], expires_at: Column) -> int:
    """IO8: newest item rows -> `mf:<movieId>` records."""
    return store.put(keyed(latest_items, "mf:", "movieId", cols, expires_at))


def put_embeddings(store: FeatureStore, vectors: DataFrame, prefix: str, id_col: str, expires_at: Column) -> int:
    """IO9: vectors -> `<prefix>:<id>` records with field `emb` = "f f f"."""
    from cinerank.functions.columns import vector_text
    recs = vectors.select(F.concat(F.lit(prefix + ":"), F.col(id_col).cast("string")).alias("key"),
                          F.create_map(F.lit("emb"), vector_text("emb")).alias("fields"),
                          expires_at.cast("timestamp").alias("expires_at"))
    return store.put(recs)


def attach_features(items: DataFrame, store: FeatureStore, prefix: str, id_col: str = "movieId",
                    now: Column | None = None) -> DataFrame:
    """Items left-joined with their live feature record (`fields`, null
    when the store has none) on the id parsed from the key."""
    recs = store.get(prefix, now).select(F.col("id").cast("long").alias(id_col), "fields")
    return items.join(recs, id_col, "left")
