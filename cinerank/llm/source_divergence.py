"""Source divergence audit over a K-squared quadtree of the group-term matrix.

Groups are (lang, source); terms are runs of letters and non-ASCII characters,
lower-cased in A-Z only. A lang keeps the terms that at least `least_docs` of its
documents hold. With integer rates p = 1 + floor(10**9 (count + 2) / (N + 2 V)) the
audit prices, for all pairs of sources of a lang, the sum over kept terms of
floor((p - q)**2 / (p + q)), and for each source the terms it has more of than its
lang.

Spark counts terms (partial counts per task, then one aggregate), keeps the cells
of kept terms, and deals the matrix of each lang out as squares: BAND sources by
up to WIDTH terms, a term's column set following from its hash. Each pair of bands meets
for each column set in one task, which holds 2 * BAND by WIDTH cells at most. There
the square becomes a quadtree with K * K children per node, one bit per quadrant
(does it hold a count?), level by level. Pairs of rows descend together from the
root: where both quadrants are empty, all their terms have the same price, which
only depends on the two groups' totals and is multiplied by the number of terms;
other pairs of quadrants go on to their children, and pairs of leaves are priced
cell by cell. Columns are ordered by the number of groups that hold them, so that empty
quadrants are large. All arithmetic is in integers.

Cases: null text, lang or source count as ''; documents without terms make their
group occur; a lang without kept terms prices every pair 0; a lang with one source
has no pairs; equal rows each count; an empty table gives an empty result; a very
long text is counted whole; columns are read by name, others are ignored; ids only
spread the rows; ties rank
by the item's UTF-8 bytes. Rates are exact up to totals of 9 * 10**15 words a group.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import materialise

TERM = rb"[a-z\x80-\xff]+"  # of lower-cased UTF-8: letters and all non-ASCII characters
LEAST_DOCS = 10
TOP = 10
K = 4
LEVELS = 6  # K ** LEVELS columns at most at the root
WIDTH = K ** LEVELS
BAND = 128  # sources of one side of a square
SCALE = 10 ** 9
FLUSH = 200_000  # counted cells a task holds before it hands them on
TRIPLES = 1 << 16  # leaf pairs priced at once


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) summed over runs of rows; a row with a null
    term says that the group occurs."""
    find = re.compile(TERM).findall
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()),
                        ("docs", pa.int64())])
    total: dict[tuple, list[Counter]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in total.items():
            terms = list(n)
            yield pa.RecordBatch.from_arrays([
                pa.array([lang] * (len(terms) + 1), pa.string()), pa.array([source] * (len(terms) + 1), pa.string()),
                pa.array([t.decode() for t in terms] + [None], pa.string()), pa.array([*n.values(), 0], pa.int64()),
                pa.array([*(docs[t] for t in terms), 0], pa.int64())], schema=schema)
        total.clear()

    for b in batches:
        for i in range(b.num_rows):
            n, docs = total.setdefault((b.column(0)[i].as_py(), b.column(1)[i].as_py()), [Counter(), Counter()])
            words = find(b.column(2)[i].as_buffer().to_pybytes().lower())
            held -= len(n)
            n.update(words)
            docs.update(set(words))
            held += len(n)
            if held > FLUSH:
                yield from flush()
                held = 0
    yield from flush()


def rates(count: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), three decimal digits at a time."""
    below = total + 2 * kept
    out = (count + 2) // below
    left = (count + 2) % below
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // below
        left = left % below
    return out + 1


def price(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


class Quadtree:
    """Occupancy bits of a count matrix: level 0 has one bit per cell, a quadrant
    of level l covers K**l rows and columns. Empty quadrants have no descendants
    that anyone visits."""

    def __init__(self, occupied: np.ndarray, levels: int):
        self.shape, self.bits = occupied.shape, [occupied]
        for _ in range(levels):
            low = self.bits[-1]
            rows, cols = (-(-n // K) for n in low.shape)
            wide = np.zeros((rows * K, cols * K), bool)
            wide[:low.shape[0], :low.shape[1]] = low
            self.bits.append(wide.reshape(rows, K, cols, K).any(axis=(1, 3)))

    def width(self, level: int, col: np.ndarray) -> np.ndarray:
        """How many columns quadrants cover; the last of a level may stick out."""
        return np.minimum((col + 1) * K ** level, self.shape[1]) - col * K ** level


def traverse(tree: Quadtree, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, Iterator[tuple]]:
    """Joint descent of all pairs of `first` rows with `second` rows (row ranges
    [lo, hi)). Returns (empty, leaves): for each pair of rows the number of columns
    that lie in empty quadrants of both, and a list of (a, b, c), the pairs of level-1
    quadrants with a count in at least one."""
    rows = tree.shape[0]
    empty = np.zeros((rows, rows), np.int64)
    level = len(tree.bits) - 1
    step = K ** level
    a, b, c = (x.ravel() for x in np.meshgrid(np.arange(first[0] // step, -(-first[1] // step)),
                                              np.arange(second[0] // step, -(-second[1] // step)),
                                              np.arange(tree.bits[level].shape[1]), indexing="ij"))
    while True:
        some = tree.bits[level][a, c] | tree.bits[level][b, c]
        found = np.zeros((tree.bits[level].shape[0],) * 2, np.int64)
        np.add.at(found, (a[~some], b[~some]), tree.width(level, c[~some]))
        step = K ** level
        at = np.arange(rows) // step
        empty += found[at[:, None], at]
        a, b, c = a[some], b[some], c[some]
        if level == 1:
            return empty, (a, b, c)
        level -= 1
        child = np.arange(K)
        shape = (len(a), K, K, K)
        a = np.broadcast_to((a[:, None] * K + child)[:, :, None, None], shape).ravel()
        b = np.broadcast_to((b[:, None] * K + child)[:, None, :, None], shape).ravel()
        c = np.broadcast_to((c[:, None] * K + child)[:, None, None, :], shape).ravel()
        step = K ** level
        real = ((c < tree.bits[level].shape[1]) & (a * step < first[1]) & ((a + 1) * step > first[0])
                & (b * step < second[1]) & ((b + 1) * step > second[0]) & (a <= b))
        a, b, c = a[real], b[real], c[real]


def pair_prices(rate: np.ndarray, none: np.ndarray, tree: Quadtree, cut: int) -> np.ndarray:
    """Summed prices of the row pairs (g, h), g < h; of rows cut by `cut` only
    pairs across it. `none` has each row's rate of a count of 0."""
    rows, cols = rate.shape
    first, second = ((0, rows), (0, rows)) if cut == rows else ((0, cut), (cut, rows))
    empty, (a, b, c) = traverse(tree, first, second)
    total = empty * price(none[:, None], none[None, :])
    high, wide = (-(-n // K) * K for n in rate.shape)
    padded = np.zeros((high, wide), np.int64)  # equal rates price 0, so rows beyond the last price nothing wanted
    padded[:rows, :cols] = rate
    padded[:, cols:] = 1
    padded[rows:, :] = 1
    tiles = padded.reshape(high // K, K, wide // K, K).transpose(0, 2, 1, 3)
    out = np.zeros((high // K, high // K, K, K), np.int64)
    for at in range(0, len(a), TRIPLES // K):
        x, y, z = (v[at:at + TRIPLES // K] for v in (a, b, c))
        f = price(tiles[x, z][:, :, None, :], tiles[y, z][:, None, :, :]).sum(-1)
        np.add.at(out, (x, y), f)
    return total + out.transpose(0, 2, 1, 3).reshape(high, high)[:rows, :rows]


PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()),
                    ("value", pa.int64())])


def price_square(square: pa.Table, top: int) -> pa.Table:
    """One pair of bands by one column set: partial prices of pairs, and the `top`
    terms of each source where a band meets itself."""
    rows = square.to_pandas()
    heads = rows[rows["term"].isna()].sort_values(["side", "source"], kind="stable")
    cells = rows[rows["term"].notna()]
    lang, same = rows["lang"].iat[0], bool((rows["b1"] == rows["b2"]).iat[0])
    names = heads["source"].to_numpy(object)
    cut = len(names) if same else int((heads["side"] == 0).sum())
    kept, lang_total = int(heads["kept"].iat[0]), int(heads["lang_total"].iat[0])
    out = {"lang": [], "source": [], "part": [], "item": [], "value": []}

    def emit(part: str, sources, items, values) -> None:
        out["lang"] += [lang] * len(values)
        out["part"] += [part] * len(values)
        out["source"] += list(sources)
        out["item"] += list(items)
        out["value"] += [int(v) for v in values]

    g, h = np.triu_indices(len(names), 1)
    if not same:
        g, h = (x.ravel() for x in np.meshgrid(np.arange(cut), np.arange(cut, len(names)), indexing="ij"))
    totals = heads["total"].to_numpy(np.int64)
    none = np.array([rates(np.zeros(1, np.int64), int(t), kept)[0] if kept else 1 for t in totals])
    absent = int(heads["set_kept"].iat[0]) - cells["term"].nunique()  # kept terms that no source of these bands has
    if not len(cells):
        emit("pair", names[g], names[h], absent * price(none[g], none[h]))
        return pa.Table.from_pydict(out, schema=PRICED)
    column = cells.groupby("term", sort=True).agg(holders=("source", "nunique"), lang_n=("lang_n", "first"))
    column = column.sort_values("holders", ascending=False, kind="stable")
    where = {t: i for i, t in enumerate(column.index)}
    row = {s: i for i, s in enumerate(names)}
    i, j = cells["source"].map(row).to_numpy(np.int64), cells["term"].map(where).to_numpy(np.int64)
    count = np.zeros((len(names), len(column)), np.int64)
    count[i, j] = cells["n"].to_numpy(np.int64)
    rate = np.stack([rates(c, int(t), kept) for c, t in zip(count, totals)])
    levels = 1
    while K ** levels < max(count.shape):
        levels += 1
    summed = pair_prices(rate, none, Quadtree(count > 0, levels), cut)
    emit("pair", names[g], names[h], summed[g, h] + absent * price(none[g], none[h]))
    if same:
        q = rates(column["lang_n"].to_numpy(np.int64), lang_total, kept)
        terms = column.index.to_numpy(object)
        keys = np.array([t.encode() for t in terms], object)
        for s, name in enumerate(names):
            more = np.flatnonzero((count[s] > 0) & (rate[s] > q))
            value = price(rate[s][more], q[more])
            if len(more) > top:
                more = more[value >= np.partition(value, -top)[-top]]
                value = price(rate[s][more], q[more])
            best = sorted(range(len(more)), key=lambda m: (-value[m], keys[more[m]]))[:top]
            emit("term", [name] * len(best), terms[more[best]], value[best])
    return pa.Table.from_pydict(out, schema=PRICED)


def kept_cells(df: DataFrame, least_docs: int, id_col: str, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(cells, groups): (lang, source, term, n, lang_n) of kept terms, and all (lang, source).

    Texts are first dealt by ranges of (lang, source, id hash): a task then counts
    the terms of few groups and adds up what would else be partial counts of every
    group in every task; a hot group takes several ranges."""
    read = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a)
                       for c, a in ((lang, "lang"), (source, "source"), (text, "text"))], F.xxhash64(F.col(f"`{id_col}`")).alias("spread"))
    read = read.repartitionByRange("lang", "source", "spread").drop("spread")
    counted = read.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long")
    counted = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")),
                          "divergence-counts")
    of_term = Window.partitionBy("lang", "term")
    cells = (counted.where("term is not null")
             .select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("lang_n"))
             .where(F.col("docs") >= least_docs).drop("docs"))
    return materialise(cells, "divergence-cells"), counted.where("term is null").select("lang", "source")


def audit(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS,
          top: int = TOP, band: int = BAND, width: int = WIDTH) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for every other source
    of the lang, `term` rows for the `top` terms a source has more of than its lang."""
    cells, groups = kept_cells(df, least_docs, id_col, text, lang, source)
    langs = (cells.dropDuplicates(["lang", "term"]).groupBy("lang")
             .agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")))
    heads = (groups.join(cells.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
             .join(langs, "lang", "left").fillna(0, ["total", "kept", "lang_total"]))
    heads = materialise(heads, "divergence-groups")
    size = heads.agg(F.max("kept")).first()[0] or 0
    most = heads.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    sets, bands = max(1, -(-size // width)), max(1, -(-most // band))

    def dealt(d: DataFrame) -> DataFrame:
        """A row goes to the squares of its band with every band, as first or second."""
        own = F.pmod(F.xxhash64("source"), F.lit(bands))
        d = d.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
        return (d.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other"))
                .withColumn("side", (F.col("own") > F.col("other")).cast("int")).drop("own", "other"))

    of_cell = cells.withColumn("set", F.pmod(F.xxhash64("term"), F.lit(sets)))
    per_set = of_cell.dropDuplicates(["lang", "term"]).groupBy("lang", "set").agg(F.count("*").alias("set_kept"))
    of_head = (heads.withColumn("set", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sets - 1).cast("long"))))
               .join(per_set, ["lang", "set"], "left").fillna(0, ["set_kept"]))
    nothing = F.lit(None).cast("long")
    rows = dealt(of_cell.select("lang", "source", "set", "term", "n", "lang_n", nothing.alias("total"), nothing.alias("kept"),
                                nothing.alias("lang_total"), nothing.alias("set_kept"))
                 .union(of_head.select("lang", "source", "set", F.lit(None).cast("string"), nothing, nothing, "total", "kept",
                                       "lang_total", "set_kept")))
    priced = rows.groupBy("lang", "set", "b1", "b2").applyInArrow(
        lambda g: price_square(g, top), "lang string, source string, part string, item string, value long")
    # a band meets itself in one square, others in one, so a pair comes once per column set
    priced = materialise(priced, "divergence-priced")
    pairs = priced.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = pairs.union(pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = (priced.where("part = 'term'").withColumn("rank", rank).where(F.col("rank") <= top)
             .select("lang", "source", "part", "item", "value", "rank"))
    return ranked.union(terms)
