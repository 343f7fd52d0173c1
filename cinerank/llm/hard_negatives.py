"""Hard-negative mining by a vertical scan with branch and bound (BOND).

For each anchor (a row whose id is divisible by `anchor_every`) the positives are
the first rows of its label by inner product; for each positive the negatives are the
first rows of other labels whose product lies in a window below the positive's.
Products are of integers, floor(scale * x) per component; equal products go by the
smaller id.

Rows are dealt into blocks by hash and anchors into blocks of their own, every pair
of blocks meets in one task, and each task holds one block of each. A task keeps
its rows by columns, one array per dimension, and splits them by label, so that a
label's least and greatest component per dimension bound what a row can still gain.
For an anchor the dimensions are read in descending magnitude of the anchor's
component. After a few of them, a row's product is known to lie between its partial
product plus the least and plus the greatest remaining contribution; the bitmap of
candidates loses the rows that can no longer be among the first, or whose interval
meets no window, and what remains when few are left (or all dimensions are read)
is resolved exactly. Every block returns its own first rows; a ranking over blocks
picks the result. Two such passes follow each other: windows need positive scores.

Cases: rows with a null label, vector or id, or a null or non-finite component, take
no part (so does one whose scaled component is not finite); a vector only meets vectors of its own length, an empty vector none; repeated
ids and equal rows are rows of their own (an anchor does not meet itself, but a copy
of it); an anchor without other rows of its label has no result, fewer rows give
shorter lists; an empty table gives an empty result; a positive score below 0 has an
empty window; other columns are not read. Where products could pass 2**53, a block
computes with Python's integers; a score beyond 64 bits counts as the nearest 64-bit
number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import materialise

SCALE = 256
ANCHOR_EVERY = 50
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # a negative has LOW to HIGH percent of the positive's score
ROWS = 8192  # of a block of candidates
ANCHORS = 4096  # of a block of anchors
STEP = 16  # dimensions read between two prunings
FEW = 64  # candidates left that are resolved at once
EXACT = 1 << 53

Start = tuple["Columns", np.ndarray]  # a part and the places in it that are candidates


class Columns:
    """Candidates of one block and length, one array per dimension."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray):
        self.rows, self.dims = rows, np.ascontiguousarray(vectors[rows].T)
        self.least, self.most = self.dims.min(1), self.dims.max(1)

    def all(self) -> Start:
        return self, np.arange(len(self.rows))

    def remaining(self, query: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest contribution of the dimensions order[i:], for each i."""
        x, y = query[order] * self.least[order], query[order] * self.most[order]
        low, high = np.zeros(len(order) + 1, x.dtype), np.zeros(len(order) + 1, x.dtype)
        low[:-1] = np.minimum(x, y)[::-1].cumsum()[::-1]
        high[:-1] = np.maximum(x, y)[::-1].cumsum()[::-1]
        return low, high


class ByLabel:
    """A block's candidates by label: labels with few rows share one part."""

    def __init__(self, label: np.ndarray, vectors: np.ndarray, rows: np.ndarray):
        rows = rows[np.argsort(label[rows], kind="stable")]
        labels, starts = np.unique(label[rows], return_index=True)
        runs = np.split(rows, starts[1:]) if len(rows) else []
        self.parts = {int(x): Columns(vectors, r) for x, r in zip(labels, runs) if len(r) >= FEW}
        shared = [r for r in runs if len(r) < FEW]
        self.shared = Columns(vectors, np.concatenate(shared)) if shared else None
        self.shared_label = label[self.shared.rows] if shared else None

    def of(self, label: int) -> list[Start]:
        if label in self.parts:
            return [self.parts[label].all()]
        return self._shared(label, True)

    def others(self, label: int) -> list[Start]:
        return [p.all() for x, p in self.parts.items() if x != label] + self._shared(label, False)

    def _shared(self, label: int, same: bool) -> list[Start]:
        if self.shared is None:
            return []
        places = np.flatnonzero((self.shared_label == label) == same)
        return [(self.shared, places)] if len(places) else []


def scan(starts: list[Start], query: np.ndarray, windows: list[tuple[float, float]], first: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that may be among the `first` of a window [low, high], with their exact
    scores: for every window all of its first rows are there, ties too."""
    order = np.argsort(-np.abs(query.astype(np.float64)), kind="stable")
    parts = [p for p, _ in starts]
    bounds = [p.remaining(query, order) for p in parts]
    part = np.repeat(np.arange(len(parts)), [len(x) for _, x in starts])
    place = np.concatenate([x for _, x in starts])
    partial = np.zeros(len(part), query.dtype)
    done = 0
    while done < len(order):
        step = order[done:] if len(part) <= FEW else order[done:done + STEP]
        edges = np.searchsorted(part, np.arange(len(parts) + 1))
        for p, lo, hi in zip(parts, edges[:-1], edges[1:]):
            if lo < hi:
                whole = hi - lo == len(p.rows)
                partial[lo:hi] += query[step] @ (p.dims[step] if whole else p.dims[np.ix_(step, place[lo:hi])])
        done += len(step)
        low = np.array([b[0][done] for b in bounds], query.dtype)[part] + partial
        high = np.array([b[1][done] for b in bounds], query.dtype)[part] + partial
        alive = np.zeros(len(part), bool)
        for lo, hi in windows:
            near = (high >= lo) & (low <= hi)
            sure = low[near & (low >= lo) & (high <= hi)]
            if len(sure) >= first:  # so many rows of the window reach this score
                near &= high >= (np.sort(sure) if sure.dtype == object else np.partition(sure, len(sure) - first))[len(sure) - first]
            alive |= near
        part, place, partial = part[alive], place[alive], partial[alive]
    return np.concatenate([p.rows[place[part == k]] for k, p in enumerate(parts)]), partial


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """The scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _vectors(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows: doubles where every product is exact, else objects."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    if flat.size and np.abs(flat).max() ** 2 * flat.shape[1] >= EXACT:
        flat = np.array([[int(x) for x in row] for row in flat.tolist()], object)
    return flat


def _blocks(square: pa.Table) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """(columns, vectors, anchors, candidates) for the rows of one length."""
    length = square["dims"].to_numpy()
    for n in np.unique(length):
        t = square.filter(pa.array(length == n)).combine_chunks()
        v = t["vector"]
        vectors = _vectors(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)
        cols = {c: t[c].to_numpy() if c != "positives" else t[c].to_pylist() for c in t.column_names if c not in ("vector", "dims")}
        side = cols["side"]
        yield cols, vectors, np.flatnonzero(side == 1), np.flatnonzero(side == 0)


POSITIVE = pa.schema([("uid", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64())])
NEGATIVE = pa.schema([("uid", pa.int64()), ("row", pa.int64()), ("id", pa.int64()), ("score", pa.int64()),
                      ("negative_uid", pa.int64()), ("negative", pa.int64()), ("negative_score", pa.int64())])


def positives(square: pa.Table, first: int) -> pa.Table:
    """Each anchor's `first` rows of its label in one block of candidates."""
    out: list[list] = [[], [], [], []]
    for cols, vectors, anchors, rows in _blocks(square):
        labels = ByLabel(cols["label"], vectors, rows)
        for a in anchors:
            own = labels.of(int(cols["label"][a]))
            if not own:
                continue
            left, score = scan(own, vectors[a], [(-np.inf, np.inf)], first + 1)  # one more: itself
            for i in _best(left, score, cols, int(cols["uid"][a]), first):
                _put(out, cols["uid"][a], cols["uid"][left[i]], cols["id"][left[i]], score[i])
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=POSITIVE)


def negatives(square: pa.Table, first: int, low: int, high: int) -> pa.Table:
    """For each anchor and positive the `first` rows of other labels in the
    window, in one block of candidates."""
    out: list[list] = [[] for _ in NEGATIVE]
    for cols, vectors, anchors, rows in _blocks(square):
        labels = ByLabel(cols["label"], vectors, rows)
        for a in anchors:
            others = labels.others(int(cols["label"][a]))
            pairs = [(p, window_of(p["score"], low, high)) for p in cols["positives"][a]]
            open_ = [w for _, w in pairs if w[0] <= w[1]]
            if not others or not open_:
                continue
            left, score = scan(others, vectors[a], sorted(set(open_)), first)
            for p, (lo, hi) in pairs:
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                for i in inside[_best(left[inside], score[inside], cols, None, first)]:
                    _put(out, cols["uid"][a], p["row"], p["id"], p["score"], cols["uid"][left[i]], cols["id"][left[i]], score[i])
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in out], schema=NEGATIVE)


def _put(out: list[list], *values) -> None:
    for column, v in zip(out, values):
        column.append(max(-1 << 63, min((1 << 63) - 1, int(v))))


def _best(rows: np.ndarray, score: np.ndarray, cols: dict, itself: int | None, first: int) -> np.ndarray:
    """Places of the first rows by (score descending, id, uid), without the row `itself`."""
    other = np.flatnonzero(cols["uid"][rows] != itself) if itself is not None else np.arange(len(rows))
    return np.array(sorted(other, key=lambda i: (-score[i], cols["id"][rows[i]], cols["uid"][rows[i]]))[:first], np.int64)


def usable(df: DataFrame, id_col: str, vector: str, label: str, scale: int) -> DataFrame:
    """(uid, id, label, dims, vector) of the rows that take part."""
    v = F.col(f"`{vector}`")
    times = lambda x: F.lit(float(scale)) * x.cast("double")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(times(x)) != float("inf")))
    near = lambda x: F.rint(times(x))
    scaled = F.transform(v, lambda x: F.when(near(x) > times(x), near(x) - 1).otherwise(near(x)))  # floor, still a double
    return (df.where(F.col(f"`{label}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & (F.size(v) > 0) & finite)
            .select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label}`").cast("long").alias("label"),
                    F.size(v).alias("dims"), scaled.alias("vector")))


def mine(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE,
         anchor: Column | None = None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         block_rows: int = ROWS, block_anchors: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).
    `anchor` is a condition on (id, label); by default the id is divisible by 50."""
    rows = materialise(usable(df, id_col, vector, label, scale).withColumn("uid", F.monotonically_increasing_id()), "negatives-rows")
    anchors = rows.where(anchor if anchor is not None else F.col("id") % ANCHOR_EVERY == 0)
    n, m = rows.count(), anchors.count()
    row_blocks, anchor_blocks = max(1, -(-n // block_rows)), max(1, -(-m // block_anchors))

    def block(count: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(count))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    none = F.lit(None).cast("array<struct<row:long,id:long,score:long>>")

    def squares(asked: DataFrame) -> DataFrame:
        """Every block of anchors with every block of rows, as one group each."""
        left = rows.select("*", F.lit(0).alias("side"), none.alias("positives"), block(row_blocks).alias("b"), every(anchor_blocks).alias("a"))
        right = asked.select(*rows.columns, F.lit(1).alias("side"), "positives", every(row_blocks).alias("b"), block(anchor_blocks).alias("a"))
        return left.union(right).groupBy("a", "b")

    found = squares(anchors.withColumn("positives", none)).applyInArrow(
        lambda t: positives(t, n_positives), "uid long, row long, id long, score long")
    ranked = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "id", "row"))
    first = (found.withColumn("at", ranked).where(F.col("at") <= n_positives).groupBy("uid")
             .agg(F.collect_list(F.struct("row", "id", "score")).alias("positives")))  # n_positives at most
    asked = materialise(anchors.join(first, "uid"), "negatives-anchors")
    mined = squares(asked).applyInArrow(
        lambda t: negatives(t, n_negatives, low, high),
        "uid long, row long, id long, score long, negative_uid long, negative long, negative_score long")
    order = Window.partitionBy("uid", "row").orderBy(F.desc("negative_score"), "negative", "negative_uid")
    best = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    return best.join(asked.select("uid", F.col("id").alias("anchor_id")), "uid").select(
        "anchor_id", F.col("id").alias("positive_id"), "rank", F.col("negative").alias("negative_id"),
        F.col("score").alias("positive_score"), "negative_score")
