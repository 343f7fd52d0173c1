"""Embedding near-duplicates by sorted projection passes.

Each pass concatenates the signs of random projections to one code; sorted
lexicographically by (pass, label and length, code), near vectors come to stand
near each other. The projections start from the mean of the label's unit
vectors, so a direction that all of them share does not spend the signs. The
more vectors a label has, and the more of their length is that shared
direction, the more passes a pair needs to stand within one window, so each
label gets as many as its rows and its mean ask for under the accepted chance
of missing a pair at exactly the threshold (`passes_for`).

What travels through the passes is not the vector but its unit vector in bytes,
one a component, with the length of what rounding took away. Two such vectors
give the cosine up to a bound known for the pair: most neighbours in a window
are links or none beyond doubt, and the rest (a narrow band around the
threshold, without those that sure links connect anyway) is settled in double
precision on the vectors themselves. Links of all passes are united to
components. A dense group is larger than any window, so in the end the links of
a component are counted whole: its vectors are dealt into tiles of bounded size
and each pair of tiles is one matrix product.

The order is laid out by one range exchange over all passes (the row's number
breaks ties, so a crowded label or code is split); rows at the end of one
partition meet those at the start of the next in a second, small exchange.

Cases: a vector that is null, empty, zero or holds a null or non-finite
component, and a vector without label, links with nothing; vectors of different
lengths never link; equal rows are linked like any others; a null vec_id counts
in links but never names a component; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from cinerank.llm.common import SLICE, add_columns, connected_components, key_groups, least_labels, materialise, release

BITS, WINDOW, TILE, SEED = 32, 24, 512, 20240
LEAST_PASSES = 8
MISS = 1e-4  # chance that no pass brings two vectors at exactly the threshold together
COMMON = 0.5  # squared length of a label's mean up to which passes are added for it
HEAD = 8  # bytes of a packed vector before its components: scale, rounding error


def passes_for(rows: int, least: float, window: int = WINDOW, miss: float = MISS) -> int:
    """Number of passes after which a pair at cosine `least`, in a label of `rows`
    vectors, has stood within `window` places of each other but for the chance
    `miss`: a sign agrees with chance 1 - angle / pi, and a pass needs about
    log2(rows / window) leading signs to agree."""
    agree = 1 - math.acos(max(-1.0, min(1.0, least))) / math.pi
    once = agree ** math.log2(max(rows / window, 1.0))
    if once >= 1:
        return LEAST_PASSES
    return max(LEAST_PASSES, math.ceil(math.log(miss) / math.log1p(-once)))


def projections(dim: int, passes: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, passes * bits))


def codes(x: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """(n, passes) integers: the signs of `bits` random projections, first bit highest."""
    signs = (x @ projections(x.shape[1], passes, bits, seed) > 0).reshape(len(x), passes, bits)
    return signs @ (1 << np.arange(bits - 1, -1, -1, dtype=np.int64))


def centred_cosine(least: float, mean: np.ndarray) -> float:
    """What a cosine of `least` between unit vectors is after their mean is taken off both."""
    shared = min(float(mean @ mean), COMMON)
    return (least - shared) / (1 - shared)


def _stack(vectors, kind: str) -> np.ndarray:
    return np.stack([np.frombuffer(v, kind) for v in vectors]).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def packed(u: np.ndarray) -> np.ndarray:
    """Unit vectors as rows of bytes: float32 scale, float32 length of the rounding
    error (rounded up), then one signed byte a component."""
    scale = (np.abs(u).max(1) / 127).astype(np.float32)
    q = np.rint(u / scale[:, None].astype(np.float64)).clip(-127, 127)
    off = u - q * scale[:, None].astype(np.float64)
    error = np.nextafter(np.sqrt((off * off).sum(1)).astype(np.float32), np.float32(np.inf))
    head = np.stack([scale, error], 1).astype("<f4").view(np.uint8)
    return np.concatenate([head, q.astype(np.int8).view(np.uint8)], 1)


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of all rows of x with all rows of y, in double precision."""
    nx, ny = np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1))
    return (x @ y.T) / nx[:, None] / ny[None, :]


def _usable(kind: str):
    """Vectors as their number of components and bytes of `kind`, scaled by a power
    of two so that no square over- or underflows; null if not usable."""
    def run(vectors: list) -> tuple[list, list]:
        dims, out = [], []
        for v in vectors:
            x = np.array([np.nan if c is None else c for c in v or ()], np.float64)
            big = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            dims.append(len(x) if big > 0 else None)
            out.append(np.ldexp(x, -int(np.frexp(big)[1])).astype(kind).tobytes() if big > 0 else None)
        return dims, out
    return lambda: run


def _sums(kind: str):
    """Per batch, label and length: number and sum of the unit vectors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(label, dim, len(g), unit(_stack(g["vec"], kind)).sum(0)) for (label, dim), g in pdf.groupby(["label", "dim"])]
            yield pd.DataFrame(rows, columns=["label", "dim", "n", "total"])
    return run


def label_means(good: DataFrame, kind: str) -> DataFrame:
    """One row per label and length: its number `grp`, its rows, the mean of its unit vectors."""
    parts = good.select("label", "dim", "vec").mapInPandas(_sums(kind), "label string, dim long, n long, total array<double>")
    sums = (parts.select("label", "dim", "n", F.posexplode("total").alias("at", "x"))
            .groupBy("label", "dim", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    return (sums.groupBy("label", "dim")
            .agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("at", (F.col("x") / F.col("n")).alias("x")))).alias("m"))
            .select("label", "dim", "n", F.col("m.x").alias("mean")).withColumn("grp", F.monotonically_increasing_id()))


def _coded(passes: int | None, bits: int, seed: int, least: float, window: int, miss: float, kind: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, rows in pdf.groupby("grp"):
                mean = np.asarray(rows["mean"].iat[0])
                k = passes or passes_for(int(rows["n"].iat[0]), centred_cosine(least, mean), window, miss)
                for g in (rows.iloc[at:at + SLICE] for at in range(0, len(rows), SLICE)):
                    u = unit(_stack(g["vec"], kind))
                    c = codes(u - mean, k, bits, seed)
                    small = np.array([v.tobytes() for v in packed(u)] + [None], object)[:-1]
                    yield pd.DataFrame({"step": np.repeat(np.arange(k), len(g)), "grp": grp, "code": c.T.ravel(),
                                        "node": np.tile(g["node"].to_numpy(), k), "vec": np.tile(small, k)})
    return run


def _windowed(rows: pd.DataFrame, window: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs (i, j), i < j <= i + window, of rows (step, grp, vec) of one step
    and group whose cosine may reach `least`, and whether it does beyond doubt."""
    step, grp = rows["step"].to_numpy(), rows["grp"].to_numpy()
    long = rows["vec"].str.len().to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(long)) + 1).tolist(), len(rows)]
    found: list[tuple] = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):  # other lengths are other groups
        raw = np.frombuffer(b"".join(rows["vec"].iloc[lo:hi]), np.uint8).reshape(hi - lo, -1)
        scale, error = np.ascontiguousarray(raw[:, :HEAD]).view("<f4").T
        x = np.ascontiguousarray(raw[:, HEAD:]).view(np.int8) * scale[:, None]
        error = error.astype(np.float64)
        rounding = 1e-6 + x.shape[1] * 1.2e-7  # of the products in single precision
        for d in range(1, min(window, len(x) - 1) + 1):
            dot = np.einsum("ij,ij->i", x[:-d], x[d:])
            doubt = error[:-d] + error[d:] * (1 + error[:-d]) + rounding
            same = (step[lo:hi - d] == step[lo + d:hi]) & (grp[lo:hi - d] == grp[lo + d:hi])
            i = np.flatnonzero(same & (dot >= least - doubt))
            found.append((i + lo, i + lo + d, dot[i] >= least + doubt[i]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found))


def _links(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, sure: np.ndarray) -> pd.DataFrame:
    """A spanning forest of the sure pairs, which says as much as all of them, and
    the doubtful pairs that it does not connect."""
    label = least_labels(len(nodes), i[sure], j[sure])
    child = np.flatnonzero(label != np.arange(len(nodes)))
    i, j = i[~sure], j[~sure]
    apart = label[i] != label[j]
    i, j = i[apart], j[apart]
    a, b = np.concatenate([nodes[child], nodes[i]]), np.concatenate([nodes[label[child]], nodes[j]])
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sure": np.arange(len(a)) < len(child)})


_FOUND = ["a", "b", "sure", "border", "side", "seq", "step", "grp", "vec"]


def _pass_links(window: int, least: float):
    """Links (a, b) within a sorted partition, and its first and last `window` rows
    marked with the border they stand at."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()

        def edge(rows: pd.DataFrame, border: int, side: int, seq: int) -> pd.DataFrame:
            return rows.assign(a=rows["node"], b=-1, sure=False, border=border, side=side, seq=np.arange(seq, seq + len(rows)))[_FOUND]

        tail, seen = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            if seen < window:
                yield edge(pdf.iloc[:window - seen], part, 1, seen)
            seen += len(pdf)
            both = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
            i, j, sure = _windowed(both, window, least)
            new = j >= len(both) - len(pdf)
            yield _links(both["node"].to_numpy(), i[new], j[new], sure[new]).assign(border=-1, side=0, seq=0, step=0, grp=0, vec=b"")[_FOUND]
            tail = both.iloc[-window:]
        if tail is not None:
            yield edge(tail, part + 1, 0, 0)
    return run


def _border_links(window: int, least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, ["border"]):
            g = g.reset_index(drop=True)
            side = g["side"].to_numpy()
            i, j, sure = _windowed(g, window, least)
            across = side[i] != side[j]
            yield _links(g["a"].to_numpy(), i[across], j[across], sure[across])
    return run


def _settled(least: float, kind: str):
    """The pairs (a, b, x, y) whose vectors reach `least` in double precision."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, g in pdf.groupby(pdf["x"].str.len()):
                x, y = _stack(g["x"], kind), _stack(g["y"], kind)
                dot = np.einsum("ij,ij->i", unit(x), unit(y))
                hit = dot >= least
                for i in np.flatnonzero(np.abs(dot - least) < 1e-9):  # the same formula as in the link count
                    hit[i] = cosine(x[i:i + 1], y[i:i + 1])[0, 0] >= least
                yield g.loc[hit, ["a", "b"]]
    return run


def _tile_counts(least: float, kind: str):
    """Links of every vector of a tile with the vectors of the other tile."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, ["comp", "ti", "tj"]):
            tile, nodes = g["tile"].to_numpy(), g["node"].to_numpy()
            x = _stack(g["vec"], kind)
            l, r = tile == g["ti"].iat[0], tile == g["tj"].iat[0]
            hit = cosine(x[l], x[r]) >= least
            if g["ti"].iat[0] == g["tj"].iat[0]:
                np.fill_diagonal(hit, False)
                yield pd.DataFrame({"node": nodes[l], "n": hit.sum(1)})
            else:
                yield pd.DataFrame({"node": np.concatenate([nodes[l], nodes[r]]),
                                    "n": np.concatenate([hit.sum(1), hit.sum(0)])})
    return run


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label",
                 least: float = 0.93, passes: int | None = None, bits: int = BITS, window: int = WINDOW,
                 tile: int = TILE, seed: int = SEED, miss: float = MISS) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept. `passes`, if not
    given, are those that `passes_for` asks for each label."""
    spark = df.sparkSession
    held = df.schema[vector].dataType
    kind = "<f4" if isinstance(held, ArrayType) and isinstance(held.elementType, FloatType) else "<f8"
    rows = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label}`").cast("string").alias("label"),
                     F.col(f"`{vector}`").alias("raw"), F.monotonically_increasing_id().alias("node"))
    rows = materialise(add_columns(rows, _usable(kind), ["raw"], {"dim": "long", "vec": "binary"}, drop=("raw",)), "proj-rows")
    good = rows.where("label is not null and vec is not null").select("node", "label", "dim", "vec")
    means = materialise(label_means(good, kind), "proj-means")
    coded = good.join(means, ["label", "dim"]).select("grp", "n", "mean", "node", "vec").mapInPandas(
        _coded(passes, bits, seed, least, window, miss, kind), "step int, grp long, code long, node long, vec binary")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["step", "grp", "code", "node"]
    found = materialise(coded.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(
        _pass_links(window, least),
        "a long, b long, sure boolean, border int, side int, seq int, step int, grp long, vec binary"), "proj-links")
    across = (found.where("border > 0").repartition(parts, "border").sortWithinPartitions("border", "side", "seq")
              .mapInPandas(_border_links(window, least), "a long, b long, sure boolean"))
    links = materialise(found.where("border < 0").select("a", "b", "sure").union(across)
                        .groupBy("a", "b").agg(F.bool_or("sure").alias("sure")), "proj-pairs")
    doubtful = (links.where("not sure").select("a", "b")
                .join(good.select(F.col("node").alias("a"), F.col("vec").alias("x")), "a")
                .join(good.select(F.col("node").alias("b"), F.col("vec").alias("y")), "b"))
    edges = links.where("sure").select("a", "b").union(
        doubtful.select("a", "b", "x", "y").mapInPandas(_settled(least, kind), "a long, b long"))
    comp = materialise(connected_components(edges, "proj-cc"), "proj-comp")
    release(spark, found, links)

    size = comp.groupBy("comp").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    dealt = (comp.join(size, "comp").join(good.select("node", "vec"), "node")
             .withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("comp", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"),
                     "tile", "node", "vec"))
    counts = (dealt.repartition(parts, "comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj", "node")
              .mapInPandas(_tile_counts(least, kind), "node long, n long").groupBy("node").agg(F.sum("n").alias("n_links")))
    named = comp.join(rows.select("node", "_id"), "node")
    least_id = named.groupBy("comp").agg(F.min("_id").alias("component_id"))
    links = comp.join(least_id, "comp").select("node", "component_id").join(counts, "node", "left")
    return (rows.select("node", "_id").join(links, "node", "left")
            .select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "_id").alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))
