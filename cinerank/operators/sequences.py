"""Ordered-sequence building blocks that stay exact when one key holds a
large share of all rows.

* `positions` numbers the rows of each key 0..n-1 in a total order. The rows are
  written once to shared storage, so that their sources are read once; bounds, counts
  and rows come from there. They are dealt into buckets of the first order column's
  range, so a hot key is spread over many buckets; a small table of counts per (key,
  bucket) gives each bucket its offset, and rows are numbered inside their bucket (where
  all keys are small, inside their key). The rows are shuffled once. A bucket with very many rows (of one key, at about one time)
  is split again by the next order column.
* `with_preceding_halo` / `with_following_halo` cut each key's sequence into
  chunks of bounded length and copy the `k` rows a frame needs from the
  neighbouring chunk, so a `rowsBetween(-k, -1)` (or lead) window runs per
  (key, chunk) with bounded groups and the same result as over the whole key.
* `running_agg` is the same idea for sums, minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.session import write_once

DEFAULT_CHUNK_ROWS = 1 << 16


N_BUCKETS = 1024
MAX_BUCKET_ROWS = 1 << 18


def _bucket(df: DataFrame, col: str, n: int) -> Column:
    """Which of n equal slices of the column's range a value lies in (nulls in the
    last one)."""
    v = F.col(col).cast("double")
    lo, hi = df.agg(F.min(v), F.max(v)).first()
    if lo is None or not hi > lo:
        return F.when(v.isNull(), -1).otherwise(0).cast("int")
    place = F.floor((v - F.lit(lo)) / F.lit(hi - lo) * n)
    return F.coalesce(F.least(place, F.lit(n - 1)), F.lit(-1)).cast("int")


def slice_order(df: DataFrame, order: list[str], n: int = N_BUCKETS) -> list[Column]:
    """What `positions` sorts by before `order`: the slice of the first column,
    which says where its nulls come (in the last slice, before its other rows)."""
    numeric = dict(df.dtypes)[order[0]] not in ("string", "binary", "boolean")
    return [_bucket(df, order[0], n)] if numeric else []


def _bucketed(df: DataFrame, keys: list[str], order: list[str], n: int, max_rows: int) -> tuple[DataFrame, list[str]]:
    """Rows with `_at`, the struct of their keys and levels (as a struct, null
    keys are equal to each other), and the names of the levels. Ordering by the
    levels and then by `order` is ordering by `order`. The first level is a slice
    of the first order column. Only where a slice of a key holds more than max_rows
    rows (at most rows / max_rows slices do), two more levels tell its rows apart:
    the column's value, and a slice of the next column; and so on."""
    numeric = {c for c, t in df.dtypes if t not in ("string", "binary", "boolean")}
    levels: list[str] = []
    out = df.withColumn("_at", F.struct(*keys, F.lit(0).alias("_one")))
    for depth, col in enumerate(order):
        if col not in numeric:
            break
        if not depth:
            out = out.withColumn("_b0", _bucket(df, col, n))
            levels.append("_b0")
        else:
            crowded = out.groupBy("_at").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > max_rows)
            if crowded.isEmpty():
                break
            marked = out.join(crowded.select("_at", F.lit(True).alias("_hot")), "_at", "left")
            hot = F.coalesce("_hot", F.lit(False))
            out = marked.withColumns({f"_v{depth}": F.when(hot, F.col(order[depth - 1])),
                                      f"_b{depth}": F.when(hot, _bucket(marked.where("_hot"), col, n))}).drop("_hot")
            levels += [f"_v{depth}", f"_b{depth}"]
        out = out.withColumn("_at", F.struct(*keys, *levels))
    return out, levels


def _earlier(rows: DataFrame, keys: list[str], levels: list[str], total: Column, combine) -> DataFrame:
    """(_at, _off): the combined totals of a key's earlier buckets."""
    per = rows.groupBy("_at").agg(total.alias("_n"))
    before = Window.partitionBy(*[F.col(f"_at.{k}") for k in keys] or [F.lit(0)]).orderBy(
        *[F.col(f"_at.{c}") for c in levels] or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, -1)
    return per.select("_at", combine("_n").over(before).alias("_off"))


def positions(df: DataFrame, keys: list[str], order: list[str], pos_col: str = "pos", n_buckets: int = N_BUCKETS,
              max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Add `pos` = 0-based rank of each row within its key under `order`
    (which must make rows unique within a key). Where no key holds more than
    max_bucket_rows rows, they are numbered key by key."""
    df = write_once(df, "positions")
    if df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_bucket_rows).isEmpty():
        return df.withColumn(pos_col, (F.row_number().over(Window.partitionBy(*keys or [F.lit(0)]).orderBy(
            *slice_order(df, order, n_buckets), *order)) - 1).cast("long"))
    rows, levels = _bucketed(df, keys, order, n_buckets, max_bucket_rows)
    offsets = _earlier(rows, keys, levels, F.count(F.lit(1)), F.sum)
    inside = Window.partitionBy("_at").orderBy(*order)
    pos = F.coalesce("_off", F.lit(0)) + F.row_number().over(inside) - 1
    return rows.join(offsets, "_at").withColumn(pos_col, pos.cast("long")).drop("_at", "_off", *levels)


def _with_halo(df: DataFrame, pos_col: str, chunk_rows: int, copy_to_next: Column, step: int) -> DataFrame:
    chunk = F.floor(F.col(pos_col) / F.lit(chunk_rows)).cast("long")
    targets = F.when(copy_to_next, F.array(chunk, chunk + step)).otherwise(F.array(chunk))
    out = df.withColumn("_own", chunk).withColumn("_chunk", F.explode(targets))
    return out.withColumn("_halo", F.col("_chunk") != F.col("_own")).drop("_own")


def with_preceding_halo(df: DataFrame, pos_col: str, preceding: int,
                        chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Add `_chunk` and `_halo`; rows in the last `preceding` slots of a chunk
    are also emitted into the next chunk as halo rows (one pass, no union).
    Window per (key, _chunk), then drop halo rows."""
    if chunk_rows < preceding:
        raise ValueError("chunk_rows must be >= preceding")
    return _with_halo(df, pos_col, chunk_rows, F.col(pos_col) % chunk_rows >= chunk_rows - preceding, 1)


def with_following_halo(df: DataFrame, pos_col: str, following: int,
                        chunk_rows: int = DEFAULT_CHUNK_ROWS) -> DataFrame:
    """Mirror of `with_preceding_halo` for lead()-style frames."""
    if chunk_rows < following:
        raise ValueError("chunk_rows must be >= following")
    first_rows = (F.col(pos_col) % chunk_rows < following) & (F.col(pos_col) >= chunk_rows)
    return _with_halo(df, pos_col, chunk_rows, first_rows, -1)


_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def running_agg(df: DataFrame, keys: list[str], order: list[str], value: str, out_col: str, op: str = "sum",
                inclusive: bool = False, n_buckets: int = N_BUCKETS, max_bucket_rows: int = MAX_BUCKET_ROWS) -> DataFrame:
    """Running sum / min / max of `value` within each key under `order`
    (exclusive by default; sum starts at 0, min/max at null), exact and
    skew-safe: aggregated inside each bucket of a key (see `positions`) and
    combined with the key's earlier buckets. With no keys it runs over the
    whole table; then only the table of buckets is in one task."""
    agg = _AGG[op]
    rows, levels = _bucketed(write_once(df, "running"), keys, order, n_buckets, max_bucket_rows)
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = rows.join(_earlier(rows, keys, levels, agg(value), agg), "_at").withColumn("_loc", agg(value).over(inside))
    if op == "sum":
        combined = (F.coalesce("_off", F.lit(0)) + F.coalesce("_loc", F.lit(0))).cast("long")
    else:
        combined = F.least("_off", "_loc") if op == "min" else F.greatest("_off", "_loc")
    return out.withColumn(out_col, combined).drop("_at", "_loc", "_off", *levels)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: str, out_col: str,
                inclusive: bool = False, **kw) -> DataFrame:
    """Running sum of `value` within each key under `order` (see running_agg)."""
    return running_agg(df, keys, order, value, out_col, "sum", inclusive, **kw)
