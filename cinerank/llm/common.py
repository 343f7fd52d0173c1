"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from cinerank.session import shared_path

# One white-space class for every operator that needs it: space, \t \n \v \f \r.
WHITE = r"[\x20\x09-\x0D]+"
SLICE = 1024  # rows per call of a batch function
SALTS = 64  # pieces in which the rows of one key are joined with what is known of the key


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def materialise(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write `df` once into the shared checkpoint folder and read it back.

    Cuts the lineage without losing anything when an executor goes: the table
    lies in shared storage. Afterwards the shuffle files of the finished job
    are garbage; a collection on the driver lets Spark's cleaner delete them.
    """
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    release(spark)
    return out


def release(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete materialised tables that no later plan reads, and let Spark drop
    shuffle files that nothing refers to any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def key_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys of a partition sorted by them, as one
    frame each, also across batch borders. Holds one batch and one group."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        cuts = np.zeros(len(pdf), bool)
        for k in keys:
            v = pdf[k].to_numpy()
            cuts[1:] |= v[1:] != v[:-1]
        starts = [0, *np.flatnonzero(cuts).tolist(), len(pdf)]
        if held and all(held[-1][k].iat[-1] == pdf[k].iat[0] for k in keys):
            held.append(pdf.iloc[:starts[1]])
            starts = starts[1:]
            if len(starts) == 1:
                continue
        for lo, hi in zip(starts[:-1], starts[1:]):
            if held:
                yield pd.concat(held) if len(held) > 1 else held[0]
            held = [pdf.iloc[lo:hi]]
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def local_forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) of a partition reduced to one edge per node to the least
    node it is connected with inside each batch; connectivity stays the same."""
    for pdf in batches:
        a, b = pdf["a"].to_numpy(np.int64), pdf["b"].to_numpy(np.int64)
        nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        x, y = inv[:len(a)], inv[len(a):]
        root = least_labels(len(nodes), x, y)
        own = np.arange(len(nodes))
        keep = root != own
        yield pd.DataFrame({"a": nodes[keep], "b": nodes[root[keep]]})


def least_labels(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n indexes over the edges (x, y)."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[x], lab[y])
        new = lab.copy()
        np.minimum.at(new, lab[x], low)
        np.minimum.at(new, lab[y], low)
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if np.array_equal(new, lab):
            return lab
        lab = new


def with_least(df: DataFrame, key: str, by: str, value: str, out: str) -> tuple[DataFrame, DataFrame]:
    """The rows of `df` with the least `value` of their key as `out`, and that
    least value per (key, piece). The rows of a key are cut into SALTS pieces by
    their column `by`; pieces are reduced before they meet, so a key that holds a
    third of all rows is many small tasks."""
    cut = df.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)))
    least = (cut.groupBy(key, "_salt").agg(F.min(value).alias(out))
             .withColumn(out, F.min(out).over(Window.partitionBy(key))))
    return cut.join(least, [key, "_salt"]).drop("_salt"), least


def spare_name(df: DataFrame, name: str) -> str:
    """`name`, longer by underscores until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per value of `keys`: the first by its other columns (as JSON), then by `text`."""
    other = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in df.columns if c not in (*keys, text)]))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    first = F.min_by(row, F.struct(other.alias("o"), F.col(f"`{text}`").alias("t")))
    return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(first.alias("_first")).select("_first.*")


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, comp): the least node id reachable over undirected edges (a, b).

    Alternating large-star / small-star rounds (every round hangs each node
    under the least neighbour seen), each round joins of salted keys written to
    shared storage, as a hub with very many edges would be one hot key. Only
    nodes with an edge are returned.
    """
    spark = edges.sparkSession
    cur = materialise(edges.select(F.col("a").cast("long"), F.col("b").cast("long"))
                      .where("a <> b").mapInPandas(local_forest, "a long, b long"), f"{name}-e")
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        met, _low = with_least(both, "a", "b", "b", "m")
        large = met.where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        met, low = with_least(large, "a", "b", "b", "m")
        small = met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        nxt = materialise(small.distinct(), f"{name}-r")
        now = nxt.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
        release(spark, cur)
        cur = nxt
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not settle")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        cur.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), vectorised."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Cache(dict):
    """A bounded memo of a pure function of one key; cleared when full."""

    def __init__(self, fn: Callable, limit: int = 400_000):
        super().__init__()
        self.fn, self.limit = fn, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        v = self[key] = self.fn(key)
        return v


def add_columns(df: DataFrame, make: Callable[[], Callable], inputs: list[str], added: dict[str, str],
                drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns of `df` (but `drop`) plus `added` (name -> Spark type), computed
    per Arrow batch: make() builds, once per partition, a function from the input
    columns as Python lists to one list per added column. Other columns pass
    through as Arrow data, so nullable integers stay exact. An added column
    replaces one of the same name (any case)."""
    clash = {c.lower() for c in added}
    src = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in clash or c in inputs])
    keep = [c for c in src.columns if c not in drop and c.lower() not in clash]
    new = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in added.items()))
    schema = StructType([src.schema[c] for c in keep] + list(new.fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        types = [to_arrow_type(f.dataType) for f in new.fields]
        for b in batches:
            for at in range(0, max(b.num_rows, 1), SLICE):  # bounds the Python objects alive at once
                part = b.slice(at, SLICE)
                col = lambda c: part.column(part.schema.get_field_index(c))
                out = fn(*[col(c).to_pylist() for c in inputs])
                yield pa.RecordBatch.from_arrays([col(c) for c in keep] + [pa.array(v, t) for v, t in zip(out, types)],
                                                 names=schema.names)

    return src.mapInArrow(run, schema)
