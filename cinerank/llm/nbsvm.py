"""Quality classifier: naive Bayes support vectors.

Features are hashed n-gram indicators of the whole text: words, word pairs and
byte triples. Each indicator is scaled by its class log-count ratio, the scaled
vector is brought to unit length, and a linear hinge-loss model is fitted by
dual coordinate descent. The weights are one vector of 2**`bits` numbers, so
every text is scored where it lies, without a shuffle.

The model is fitted on a bounded sample of labelled rows: the `max_rows` rows
with the least hash of their id, and of these, in that order, as many as hold
`max_features` indicators together. Everything else covers all rows.

Cases: null and empty texts get the score of the bias; a null, repeated or
contradictory label is left out, merged or decided by majority; rows without id
are scored and never learned from; with labels of one class only, or none, all
scores are that class's (or 0.5); extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import add_columns, mix64

BITS, MAX_ROWS, MAX_FEATURES = 18, 10_000, 25_000_000


def indicators(text: str | None, bits: int, mark: np.ndarray) -> np.ndarray:
    """Sorted distinct feature numbers of a text; `mark` is a zeroed scratch
    array of 2**bits booleans, zeroed again on return."""
    data = (text or "").encode()
    words = data.split()
    shift = np.uint64(64 - bits)
    if words:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        mark[mix64(h) >> shift] = True
        mark[mix64(mix64(h[:-1]) + h[1:]) >> shift] = True
    if len(data) > 2:
        b = np.frombuffer(data, np.uint8).astype(np.uint64)
        mark[mix64((b[:-2] << np.uint64(16)) + (b[1:-1] << np.uint64(8)) + b[2:]) >> shift] = True
    out = np.flatnonzero(mark)
    mark[out] = False
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, bits: int, smooth: float = 1.0, cost: float = 1.0,
        passes: int = 12, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """(log-count ratios, hinge weights of the scaled unit vectors, bias)."""
    n = 1 << bits
    pos, neg = np.full(n, smooth), np.full(n, smooth)
    for f, y in zip(rows, labels):
        (pos if y else neg)[f] += 1
    ratio = np.log(pos / pos.sum()) - np.log(neg / neg.sum())
    scale = np.array([1 / max(math.sqrt(float(ratio[f] @ ratio[f])), 1e-12) for f in rows])
    y = np.where(labels, 1.0, -1.0)
    w, bias, alpha = np.zeros(n), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            f = rows[i]
            v = ratio[f] * scale[i]
            q = float(v @ v) + 1.0  # the bias is one more feature of value 1
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / q, 0.0), cost)
            d = (new - alpha[i]) * y[i]
            if d:
                alpha[i] = new
                w[f] += d * v
                bias += d
            worst = max(worst, abs(d))
        if worst < 1e-3 * cost:
            break
    return ratio, w, bias


def _fit_partition(bits: int, max_features: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mark, rows, labels, held = np.zeros(1 << bits, bool), [], [], 0
        store = np.empty(max_features + (1 << bits), np.int32)  # one block, given back whole
        for pdf in batches:
            for text, label in zip(pdf["text"], pdf["label"]):
                if held < max_features:
                    f = indicators(text, bits, mark)
                    store[held:held + len(f)] = f
                    rows.append(store[held:held + len(f)])
                    labels.append(label)
                    held += len(f)
        y = np.array(labels, bool)
        if not len(y) or y.all() or not y.any():
            flat = np.zeros(1 << bits, np.float32).tobytes()
            yield pd.DataFrame({"ratio": [flat], "weight": [flat], "bias": [float(y.mean() * 2 - 1) if len(y) else 0.0]})
        else:
            ratio, w, bias = fit(rows, y, bits)
            yield pd.DataFrame({"ratio": [ratio.astype(np.float32).tobytes()],
                                "weight": [w.astype(np.float32).tobytes()], "bias": [bias]})
    return run


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text: str = "text",
          label: str = "quality", bits: int = BITS, max_rows: int = MAX_ROWS,
          max_features: int = MAX_FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on a bounded sample of the labelled rows for which `usable` (over the
    id column) holds. The sample is picked from the label table alone; at most
    max_rows ids are broadcast, so no text is shuffled but the sample's."""
    picked = (labels.where(usable & F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
              .groupBy(id_col).agg(F.avg(label).alias("_m")).where("_m <> 0.5")
              .select(F.col(id_col).alias("_id"), (F.col("_m") > 0.5).alias("label"), F.xxhash64(id_col).alias("_h"))
              .orderBy("_h", "_id").limit(max_rows))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(picked), "_id")
    model = (rows.repartition(1).sortWithinPartitions("_h", "_id", "text").select("text", "label")
             .mapInPandas(_fit_partition(bits, max_features), "ratio binary, weight binary, bias double")).first()
    if model is None:  # no usable label at all
        return np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32), 0.0
    return np.frombuffer(model["ratio"], np.float32), np.frombuffer(model["weight"], np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text", column: str = "score") -> DataFrame:
    """All rows and columns plus the score (0 to 1, 0.5 at the margin)."""
    ratio, weight, bias = model
    bits = int(math.log2(len(ratio)))
    shared = docs.sparkSession.sparkContext.broadcast((ratio, ratio * weight))  # 2**bits numbers each

    def make():
        r, rw = (x.astype(np.float64) for x in shared.value)
        mark = np.zeros(1 << bits, bool)

        def one(t: str | None) -> float:
            f = indicators(t, bits, mark)
            norm = math.sqrt(float((r[f] ** 2).sum())) or 1.0
            return 1 / (1 + math.exp(-2 * min(max(float(rw[f].sum()) / norm + bias, -300), 300)))
        return lambda texts: ([one(t) for t in texts],)

    return add_columns(docs, make, [text], {column: "double"})


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """id, held_out, score, predicted for every row; labels are learned only
    from rows whose crc32(id as text) mod 3 is not 1."""
    fold = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))
    model = train(docs, labels, ~fold, id_col, text, **options)
    out = score(docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias(text)), model, text)
    return out.select(id_col, fold.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
