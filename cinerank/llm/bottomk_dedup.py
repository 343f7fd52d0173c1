"""Near-duplicate groups from bottom-k sketches of word-shingle sets.

One hash function orders all shingles. A document's sketch is its `k` least
shingle hashes; documents with the same set are one class from the start, and
only class representatives are compared.

* Inverted lists: three neighbouring retained values (in hash order) make one
  list key, for the first `lead` values of the sketch; sets of at most eight
  shingles are also listed under two neighbours. Two sets of similarity 0.8 or
  more share such a key: small sets by the pigeonhole principle (of the values
  of the union, those that are not shared leave a gap of three, up to eight
  values a gap of two), larger ones but for a chance of 1e-8 at the threshold
  and far less above it, which sets `lead`. A frequent passage alone seldom
  makes three neighbours, so its lists stay short. Lists with the
  same members are kept once. Lists are split into cells of bounded size, every
  pair of cells is looked at, so no candidate is dropped.
* Union-sketch estimate: inside a cell all pairs are estimated on the least
  values of the union, by one matrix product. Sets that the sketch holds whole
  are decided exactly there.
* Exact Jaccard: members of pairs that the estimate (less five standard
  deviations) does not exclude meet again, in the cell of the pair's least common
  key, with their full sets, and all of them are decided exactly. A cell emits a
  spanning forest of its links, never its pairs, so a group of many near copies
  costs rows in proportion to its members.
* Components: star contraction over the links.

The joins are merge joins at every size, so a small run shows what a large one
does, and adaptive execution splits their hot keys.

Cases: null and empty texts have no shingles, link with nothing and are their
own component; texts shorter than `shingle` words are one shingle of all words;
equal rows and rows with one doc_id are linked if their sets are equal; a row
without doc_id counts for its group but never names it; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import (add_columns, connected_components, key_groups, least_labels, materialise,
                                 mix64, one_of_each, release, spare_name, with_least)

SHINGLE, K, CELL = 3, 128, 512
MISS = 1e-8  # chance of sharing no list key at exactly the threshold
FILTER_BITS = 26  # 8 MB; selective up to some ten million wanted documents
SURE = 5.0  # standard deviations below the threshold at which the estimate excludes a pair


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of `text` (A-Z lower-
    cased, words between ASCII white space); fewer words make one shingle."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    size_ = min(size, n)
    acc = mix64(h[:n - size_ + 1] + np.uint64(size_))
    for i in range(1, size_):
        acc = mix64(acc + h[i:n - size_ + 1 + i])
    return np.unique(acc)


def set_name(values: np.ndarray) -> bytes:
    """128-bit name of a set of shingle hashes."""
    return xxhash.xxh3_128_digest(values.tobytes())


def _sketches(size: int, k: int):
    def make():
        def run(texts):
            sets = [shingle_hashes(t, size) for t in texts]
            return [len(s) for s in sets], [set_name(s) for s in sets], [s[:k].tobytes() for s in sets]
        return run
    return make


def lead_for(percent: int, miss: float = MISS) -> int:
    """Number of values after which independent draws that are shared with
    chance percent / 100 have shown no three shared ones in a row with chance
    below `miss`."""
    p = percent / 100
    state, n = [1.0, 0.0, 0.0], 0  # by the number of shared values at the end
    while sum(state) > miss:
        state, n = [sum(state) * (1 - p), state[0] * p, state[1] * p], n + 1
    return n


def run_keys(sketch: np.ndarray, size: int, lead: int) -> np.ndarray:
    """List keys of a sketch: one per run of three neighbouring values, for sets
    of at most eight also of two."""
    v = sketch[:lead]
    if len(v) < 4:  # a different set of at most three shingles is never similar enough
        return np.empty(0, np.int64)
    two = mix64(v[:-1] + np.uint64(1)) ^ mix64(v[1:] + np.uint64(2))
    three = mix64(two[:-1] ^ mix64(v[2:] + np.uint64(3)))
    return np.unique(np.concatenate([mix64(two), three]) if size <= 8 else three).view(np.int64)


def _emit_runs(lead: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = [run_keys(np.frombuffer(s, np.uint64), n, lead) for s, n in zip(pdf["sketch"], pdf["n"])]
            yield pd.DataFrame({"key": np.concatenate(keys) if keys else np.empty(0, np.int64),
                                "node": np.repeat(pdf["node"].to_numpy(np.int64), [len(x) for x in keys])})
    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all left with all right sets (sorted
    distinct numbers), by matrix products over the values that both sides have."""
    if len(left) == len(right) == 1:
        return np.array([[float(len(np.intersect1d(left[0], right[0], assume_unique=True)))]])
    lv, rv = np.concatenate(left), np.concatenate(right)
    if left is right:  # a set with itself is of no interest
        both, n = np.unique(lv, return_counts=True)
        both = both[n > 1]
    else:
        both = np.intersect1d(lv, rv)
    out = np.zeros((len(left), len(right)))

    def placed(values: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        col = np.searchsorted(both, values)
        hit = col < len(both)
        hit[hit] = both[col[hit]] == values[hit]
        return np.repeat(np.arange(len(sets)), [len(x) for x in sets])[hit], col[hit]

    (lr, lc), (rr, rc) = placed(lv, left), placed(rv, right)
    for lo in range(0, len(both), width):
        n = min(width, len(both) - lo)
        x, y = np.zeros((len(left), n), np.float32), np.zeros((len(right), n), np.float32)
        sel = (lc >= lo) & (lc < lo + n)
        x[lr[sel], lc[sel] - lo] = 1
        sel = (rc >= lo) & (rc < lo + n)
        y[rr[sel], rc[sel] - lo] = 1
        out += x @ y.T
    return out


def estimates(left: list[np.ndarray], right: list[np.ndarray], n_left: np.ndarray, n_right: np.ndarray,
              k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union-sketch estimate of all pairs of sketches: values of the union's
    sketch, shared ones among them, and whether both sets are there whole."""
    shared = overlaps(left, right)
    whole_l, whole_r = n_left <= k, n_right <= k
    most = np.uint64(2**64 - 1)
    end_l = np.array([most if w else s[-1] for s, w in zip(left, whole_l)], np.uint64)
    end_r = np.array([most if w else s[-1] for s, w in zip(right, whole_r)], np.uint64)
    upto = np.minimum(end_l[:, None], end_r[None, :])
    union = -shared
    union += np.stack([np.searchsorted(s, upto[i], side="right") for i, s in enumerate(left)])
    union += np.stack([np.searchsorted(s, upto[:, j], side="right") for j, s in enumerate(right)], axis=1)
    return union, shared, whole_l[:, None] & whole_r[None, :]


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Component labels of n members under the links (x, y), and a tree edge
    (member, label) for each member that is not its component's label."""
    label = least_labels(n, x, y) if len(x) else np.arange(n)
    child = np.flatnonzero(label != np.arange(n))
    return label, child, label[child]


def _cells(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of one cell: rows, nodes, and places of its left and right members."""
    for g in key_groups(batches, ["key", "ci", "cj"]):
        cell = g["cell"].to_numpy()
        left, right = np.flatnonzero(cell == g["ci"].iat[0]), np.flatnonzero(cell == g["cj"].iat[0])
        if len(left) and len(right) and len(g) > 1:
            yield g, g["node"].to_numpy(np.int64), left, right


def _picked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[list, list]:
    """The sets of both sides; one list if the sides are the same."""
    ls = [sets[i] for i in left]
    return ls, ls if np.array_equal(left, right) else [sets[i] for i in right]


def _compare_cells(k: int, percent: int, lead: int):
    """Rows (kind, a, b, key, ci, cj, cell): kind 0 is a certain link (a, b), kind
    1 a member `a` of a cell whose full set is needed there."""
    p = percent / 100
    cols = ["kind", "a", "b", "key", "ci", "cj", "cell"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, nodes, left, right in _cells(batches):
            sizes = g["n"].to_numpy(np.int64)
            sk = [np.frombuffer(s, np.uint64) for s in g["sketch"]]
            ls, rs = _picked(sk, left, right)
            union, shared, sure = estimates(ls, rs, sizes[left], sizes[right], k)
            near = np.minimum(sizes[left][:, None], sizes[right][None, :]) * 100 >= percent * np.maximum(
                sizes[left][:, None], sizes[right][None, :])
            near &= left[:, None] != right[None, :]
            x, y = np.nonzero(near & sure & (100 * shared >= percent * union))
            label, child, parent = forest(len(nodes), left[x], right[y])
            maybe = near & ~sure & (shared >= union * p - SURE * np.sqrt(union * p * (1 - p)))
            maybe &= label[left][:, None] != label[right][None, :]
            x, y = np.nonzero(maybe)
            if len(x):  # only in the cell of the pair's least common key
                key = int(g["key"].iat[0])
                lower = [run_keys(s, n, lead) for s, n in zip(sk, sizes)]
                lower = [v[v < key] for v in lower]
                first = overlaps(*_picked(lower, left, right)) == 0
                x, y = np.nonzero(maybe & first)
            asked = np.unique(np.concatenate([left[x], right[y]]))
            if len(child) or len(asked):
                yield pd.DataFrame({
                    "kind": np.repeat([0, 1], [len(child), len(asked)]), "a": np.concatenate([nodes[child], nodes[asked]]),
                    "b": np.concatenate([nodes[parent], nodes[asked]]), "key": g["key"].iat[0], "ci": g["ci"].iat[0],
                    "cj": g["cj"].iat[0], "cell": np.concatenate([np.zeros(len(child), np.int64), g["cell"].to_numpy()[asked]])})[cols]
    return run


def _decide_cells(percent: int):
    """A spanning forest of the exact links of each cell."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, nodes, left, right in _cells(batches):
            full = [np.frombuffer(s, np.uint64) for s in g["full"]]
            sizes = np.array([len(f) for f in full])
            shared = overlaps(*_picked(full, left, right)).astype(np.int64)
            union = sizes[left][:, None] + sizes[right][None, :] - shared
            x, y = np.nonzero((100 * shared >= percent * union) & (left[:, None] != right[None, :]))
            _, child, parent = forest(len(nodes), left[x], right[y])
            yield pd.DataFrame({"a": nodes[child], "b": nodes[parent]})
    return run


def _by_cell(df: DataFrame) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "key", "ci", "cj").sortWithinPartitions("key", "ci", "cj", "node")


def _compared(reps: DataFrame, k: int, percent: int, cell: int) -> DataFrame:
    lead = lead_for(percent)
    runs = reps.select("node", "n", "sketch").mapInPandas(_emit_runs(lead), "key long, node long")
    lists = runs.groupBy("key").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("node")).alias("x"),
        F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("members > 1")
    lists = materialise(lists.groupBy("members", "x", "y").agg(F.min("key").alias("key"))
                        .select("key", F.ceil(F.col("members") / cell).cast("int").alias("cells")), "bk-lists")
    member = materialise(runs.join(lists.hint("merge"), "key"), "bk-members")
    release(reps.sparkSession, lists)
    full = (member.join(reps.select("node", "n", "sketch").hint("merge"), "node")
            .withColumn("cell", F.pmod(F.xxhash64("node"), F.col("cells")).cast("int"))
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
            .select("key", F.least("cell", "other").alias("ci"), F.greatest("cell", "other").alias("cj"),
                    "cell", "node", "n", "sketch"))
    out = materialise(_by_cell(full).mapInPandas(
        _compare_cells(k, percent, lead), "kind int, a long, b long, key long, ci int, cj int, cell int"), "bk-cells")
    release(reps.sparkSession, member)
    return out


def id_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of 2**bits bits over xxhash64 of an id column (three
    places per id). However many ids there are, at most 2**bits / 64 words reach
    the driver."""
    col = F.col(ids.columns[0])
    places = ids.select(F.explode(F.array(*[F.pmod(F.xxhash64(col, F.lit(s)), F.lit(1 << bits)) for s in range(3)])).alias("p"))
    words = places.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).collect()
    out = np.zeros((1 << bits) // 64, np.uint64)
    for w in words:
        out[w["w"]] = np.uint64(w["bits"] & (2**64 - 1))
    return out


def _full_sets(docs: DataFrame, wanted: DataFrame, size: int, bits: int) -> DataFrame:
    """(node, full) for wanted rows (rep, sid, node). Texts are not moved: a
    filter over the wanted ids, of fixed size, is sent to the texts, and the sets
    of the rows that pass it are then matched by the name of the set."""
    word = id_filter(wanted.select("rep"), bits)
    shared = docs.sparkSession.sparkContext.broadcast(word)

    def make():
        def run(texts, *places):
            words = shared.value
            out_sid, out_set = [], []
            ok = np.ones(len(texts), bool)
            for p in places:
                p = np.array(p, np.uint64)
                ok &= (words[p >> np.uint64(6)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
            for t, keep in zip(texts, ok):
                s = shingle_hashes(t, size) if keep else None
                out_sid.append(set_name(s) if keep else None)
                out_set.append(s.tobytes() if keep else None)
            return out_sid, out_set
        return run

    placed = docs.select("_text", *[F.pmod(F.xxhash64("_id", F.lit(s)), F.lit(1 << bits)).alias(f"_p{s}") for s in range(3)])
    names = ["_p0", "_p1", "_p2"]
    full = add_columns(placed, make, ["_text", *names], {"sid": "binary", "full": "binary"}, drop=("_text", *names))
    return full.where("sid is not null").join(wanted.select("sid", "node").hint("merge"), "sid").groupBy("node").agg(F.min("full").alias("full"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (least id reachable
    over links of 100 * intersection >= percent * union), kept, and the (small)
    columns named in `carry`. percent is at least 80, k at least lead_for(percent)."""
    return _grouped(df, id_col, text, **options).drop("_comp")


def _grouped(df: DataFrame, id_col: str, text: str, percent: int = 85, size: int = SHINGLE, k: int = K, cell: int = CELL,
             carry: tuple[str, ...] = (), filter_bits: int = FILTER_BITS) -> DataFrame:
    """near_groups plus _comp, which is the same in the rows of one component and
    in no others, whatever their ids; null where the text has no shingles."""
    if percent < 80 or k < lead_for(percent):
        raise ValueError("the list keys are complete from 80 percent on, and need a longer sketch below")
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_text"), *carry)
    signed = materialise(add_columns(docs, _sketches(size, k), ["_text"],
                                     {"n": "long", "sid": "binary", "sketch": "binary"}, drop=("_text",)), "bk-docs")
    reps = materialise(signed.where("n > 0").groupBy("sid").agg(
        F.min("_id").alias("rep"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
        .withColumn("node", F.monotonically_increasing_id()), "bk-reps")
    cells = _compared(reps, k, percent, cell)
    asked = cells.where("kind = 1").select("key", "ci", "cj", "cell", F.col("a").alias("node"))
    wanted = materialise(asked.select("node").distinct().hint("merge").join(reps.select("node", "rep", "sid"), "node"), "bk-wanted")
    sets = materialise(_full_sets(docs, wanted, size, filter_bits), "bk-sets")
    links = cells.where("kind = 0").select("a", "b").union(
        _by_cell(asked.join(sets.hint("merge"), "node")).mapInPandas(_decide_cells(percent), "a long, b long"))
    comp = materialise(connected_components(links, "bk-cc"), "bk-comp")
    release(spark, cells, wanted, sets)

    label = reps.select("node", "sid", "rep").join(comp.hint("merge"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled, _ = with_least(label, "comp", "sid", "rep", "component_id")
    of_set = labelled.select("sid", "component_id", F.col("comp").alias("_comp"))
    return (signed.select("_id", "n", *carry, F.when(F.col("n") > 0, F.col("sid")).alias("sid")).join(of_set.hint("merge"), "sid", "left")
            .select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), *carry, "_comp",
                    F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("_id")).alias("component_id"))
            .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id"))))


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, whole, that stay: one per component, that of the least
    id (rows without id come last; of different rows with this id, the one with
    the least text hash). Rows that only share an id, or have none, are not linked
    by that; a text without shingles stays, once per id and text. Of rows with one
    id and text, the first by its other columns stays."""
    own, stay_id, stay_own = (spare_name(df, c) for c in ("_h", "_stay_id", "_stay_h"))
    hashed = df.withColumn(own, F.xxhash64(F.col(f"`{text}`")))
    rows = _grouped(hashed.select(F.col(f"`{id_col}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.col(own).alias("_h")),
                    "_key", "_text", carry=("_h",), **options)
    first = F.min(F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("id"), F.col("_h").alias("h")))
    stay = (rows.where("_comp is not null").groupBy("_comp").agg(first.alias("s")).select("s.id", "s.h")
            .union(rows.where("_comp is null").select("_key", "_h")))
    stay = stay.toDF(stay_id, stay_own)
    kept = hashed.join(stay, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_own)), "left_semi")
    return one_of_each(kept, [id_col, own], text).drop(own)
