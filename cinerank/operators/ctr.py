"""Click / rating models on Spark ML.

The single-machine neural scripts are re-aimed at Spark ML estimators with
the same inputs, roles and metrics; they are not numerically equal to the
neural networks and do not claim to be. Spark ML has no embedding layer, so the
learned user and item ids of the scripts are the factors of a distributed
factorisation (ALS, rank 10) of the training labels: two tables, one row per
user and item, that stay DataFrames. Perceptrons, logistic regressions and dot
products take them as inputs like any other column.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import MinMaxScaler, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.functions.columns import cosine, genre_array, uniform_u32
from cinerank.operators.sequences import positions
from cinerank.session import settled, write_once

# Input columns of the reference models.
GENRE_COLS = ["userGenre1", "userGenre2", "userGenre3", "userGenre4", "userGenre5",
              "movieGenre1", "movieGenre2", "movieGenre3"]
NUMERIC_COLS = ["releaseYear", "movieRatingCount", "movieAvgRating", "movieRatingStddev",
                "userRatingCount", "userAvgRating", "userRatingStddev"]
HISTORY_COLS = ["userRatedMovie1", "userRatedMovie2", "userRatedMovie3", "userRatedMovie4", "userRatedMovie5"]


def text_number(c) -> Column:
    """Two-digit text ("1,234.50") -> double; missing -> 0."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.regexp_replace(col.cast("string"), ",", "").try_cast("double"), F.lit(0.0))


def model_inputs(samples: DataFrame) -> DataFrame:
    """C11: model columns with numeric text parsed, missing numbers -> 0."""
    keep = ["userId", "movieId", "label"] + GENRE_COLS + HISTORY_COLS
    extra = [c for c in samples.columns if c not in keep + NUMERIC_COLS]
    return samples.select(*keep, *[text_number(c).alias(c) for c in NUMERIC_COLS], *extra)


def genre_vocabulary(movies: DataFrame) -> Column:
    """The catalogue's genres in order, as one array from a scalar subquery (one
    entry per distinct genre)."""
    genres = movies.select(F.explode(genre_array("genres")).alias("g")).distinct()
    return F.lit(genres.agg(F.sort_array(F.collect_list("g")).alias("v")).scalar())


def encode_vocab(df: DataFrame, cols: list[str], vocab: list[str] | Column, suffix: str = "Idx") -> DataFrame:
    """Text -> 0-based position in a vocabulary; unknown or missing -> -1."""
    arr = vocab if isinstance(vocab, Column) else F.array(*[F.lit(v) for v in vocab])
    return df.select("*", *[(F.coalesce(F.array_position(arr, F.col(c)), F.lit(0)) - 1).cast("int")
                            .alias(c + suffix) for c in cols])


def id_range(df: DataFrame, col: str) -> Column:
    """One more than the largest id of a column."""
    return F.lit(df.agg((F.max(col) + 1).alias("n")).scalar())


def encode_identity(df: DataFrame, col: str, n: int | Column, out_col: str | None = None) -> DataFrame:
    """Id kept when 0 <= id < n, else null; take n from the data
    (`id_range`) or from where it is fixed."""
    c = F.col(col)
    return df.withColumn(out_col or col + "Idx", F.when((c >= 0) & (c < n), c.cast("int")))


def cross_hash(a, b, n: int = 10000) -> Column:
    """Hashed cross of two ids into n buckets (md5-based, reproducible)."""
    return F.pmod(uniform_u32(F.coalesce(F.col(a).cast("string"), F.lit("")),
                              F.coalesce(F.col(b).cast("string"), F.lit(""))), F.lit(n)).cast("int")


def indicator(df: DataFrame, cols: list[str], largest: DataFrame | None = None) -> DataFrame:
    """C4: one-hot vectors for integer-coded columns (<col>Vec). Their sizes come
    from `largest` (a row with the largest code of each column) if given, else
    from the data; larger codes, met later, share one more slot. A column's metadata
    has the size alone: names of all slots, as `OneHotEncoder` gives them, would be as
    many objects on the driver as there are ids."""
    top = (df if largest is None else largest).agg(*[F.max(c).cast("long").alias(c) for c in cols]).first()
    if None in top:
        raise ValueError(f"no codes in {[c for c in cols if top[c] is None]}")
    size = {c: top[c] + 2 for c in cols}
    return df.select("*", *[_hot(size[c])(F.col(c).cast("int")).alias(c + "Vec", metadata={"ml_attr": {"num_attrs": size[c]}}) for c in cols])


def _hot(size: int):
    """A code's sparse vector with a 1 in its place, or in the last if it is larger."""
    @F.arrow_udf(VectorUDT())
    def vector(codes: pa.Array) -> pa.Array:
        at = codes.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
        if len(at) and at.min() < 0:
            raise ValueError("negative code")
        n = len(at)
        every = pa.array(np.arange(n + 1, dtype=np.int32))
        parts = [pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, size, np.int32)),
                 pa.ListArray.from_arrays(every, pa.array(np.minimum(at, size - 1).astype(np.int32))),
                 pa.ListArray.from_arrays(every, pa.array(np.ones(n)))]
        return pa.StructArray.from_arrays(parts, ["type", "size", "indices", "values"], mask=codes.is_null())
    return vector


def genre_codes(df: DataFrame, cols: list[str], vocab: list[str] | Column) -> DataFrame:
    """Genre columns as codes (<col>Idx): 0 for an unknown or missing genre, the
    place in the vocabulary plus one for the others."""
    d = encode_vocab(df, cols, vocab)
    return d.withColumns({c + "Idx": F.col(c + "Idx") + 1 for c in cols})


def _vector_width(df: DataFrame, col: str) -> int:
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    return int(df.select(F.size(vector_to_array(col))).first()[0])


def _indicators(cols: list[str]) -> OneHotEncoder:
    return OneHotEncoder(inputCols=[c + "Idx" for c in cols], outputCols=[c + "Vec" for c in cols], dropLast=False,
                         handleInvalid="keep")


def without_summary(model):
    """A fitted model without its training summary. That holds the plan of the training
    rows and the session, which a scoring task would be sent and, where a query of the
    session has been observed, cannot be."""
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def _fit_mlp(d: DataFrame, feature_stages: list, hidden, max_iter: int, seed: int) -> PipelineModel:
    """Fit feature stages, size the input layer from the assembled vector,
    then fit the perceptron; one PipelineModel with all stages."""
    feats = Pipeline(stages=feature_stages).fit(d)
    td = feats.transform(d).select("label", "features")  # not persisted: the trainer keeps a copy in blocks of its own
    mlp = MultilayerPerceptronClassifier(layers=[_vector_width(td, "features"), *hidden, 2], maxIter=max_iter,
                                         solver="l-bfgs", seed=seed, labelCol="label", featuresCol="features").fit(td)
    return PipelineModel(stages=[*feats.stages, without_summary(mlp)])


def probability(col: str = "probability") -> Column:
    return F.get(vector_to_array(col), 1)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Apply a fitted pipeline; adds `score` = probability of label 1."""
    return model.transform(df).withColumn("score", probability())


# ------------------------------------------------------------------ id factors
@dataclass
class Factors:
    """Learned ids: one row per user and item of the training rows."""
    users: DataFrame  # userId, uf array<float>
    items: DataFrame  # movieId, vf array<float>
    rank: int


def id_factors(train: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.1, seed: int = 42) -> Factors:
    """Distributed factorisation of the labels (mean label per pair) by
    alternating least squares. Ids of any size are numbered densely for it."""
    pairs = train.groupBy("userId", "movieId").agg(F.avg("label").alias("y"))
    u = positions(train.select("userId").distinct(), [], ["userId"], "u")
    v = positions(train.select("movieId").distinct(), [], ["movieId"], "v")
    rows = write_once(pairs.join(u, "userId").join(v, "movieId").select(F.col("u").cast("int"), F.col("v").cast("int"),
                                                                        F.col("y").cast("float")), "pairs")
    m = ALS(rank=rank, maxIter=max_iter, regParam=reg, userCol="u", itemCol="v", ratingCol="y", seed=seed,
            checkpointInterval=1).fit(rows)  # a checkpoint lets go of the shuffles before it
    users = m.userFactors.join(u, F.col("id") == F.col("u")).select("userId", F.col("features").alias("uf"))
    items = m.itemFactors.join(v, F.col("id") == F.col("v")).select("movieId", F.col("features").alias("vf"))
    return Factors(write_once(users, "factors"), write_once(items, "factors"), rank)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def join_factors(df: DataFrame, f: Factors) -> DataFrame:
    """Rows with the factors of their user and item (`uf`, `vf`; zeros for ids
    that were not trained)."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), f.rank)
    d = df.join(f.users, "userId", "left").join(f.items, "movieId", "left")
    return d.withColumns({"uf": F.coalesce("uf", zeros), "vf": F.coalesce("vf", zeros)})


def factor_columns(df: DataFrame) -> DataFrame:
    """What follows from the factors: their dot product `pairDot`, and both as vectors."""
    return df.withColumns({"pairDot": dot(F.col("uf"), F.col("vf")), "ufVec": array_to_vector("uf"), "vfVec": array_to_vector("vf")})


def with_factors(df: DataFrame, f: Factors) -> DataFrame:
    return factor_columns(join_factors(df, f))


def _logistic(d: DataFrame, cols: list[str], stages: list | None = None, max_iter: int = 50, reg: float = 0.0,
              standardize: bool = True) -> PipelineModel:
    feats = VectorAssembler(inputCols=cols, outputCol="features")
    lr = LogisticRegression(featuresCol="features", labelCol="label", maxIter=max_iter, regParam=reg, standardization=standardize)
    model = Pipeline(stages=[*(stages or []), feats, lr]).fit(d)
    without_summary(model.stages[-1])
    return model


def pair_model(train: DataFrame, head: str = "dot", hidden=(10, 10), max_iter: int = 20, seed: int = 42) -> tuple[PipelineModel, Factors]:
    """User x item model on learned ids (two towers of width 10). head="dot":
    a logistic function of the dot product; head="mlp": a perceptron over both
    factors. `train` is factorised first; rows to score need `with_factors`."""
    f = id_factors(train, seed=seed)
    d = with_factors(train, f)
    if head == "dot":
        return _logistic(d, ["pairDot"]), f
    return pair_perceptron(d, hidden, max_iter, seed), f


def pair_perceptron(d: DataFrame, hidden=(10, 10), max_iter: int = 20, seed: int = 42) -> PipelineModel:
    """The perceptron over both factors of rows from `with_factors`."""
    feats = VectorAssembler(inputCols=["ufVec", "vfVec"], outputCol="features")
    return _fit_mlp(d, [feats], hidden, max_iter, seed)


def _scaled_numbers() -> list:
    return [VectorAssembler(inputCols=NUMERIC_COLS, outputCol="numRaw", handleInvalid="keep"),
            MinMaxScaler(inputCol="numRaw", outputCol="numScaled")]


def mlp_model(train: DataFrame, hidden=(128, 128), max_iter: int = 20, seed: int = 42) -> PipelineModel:
    """Numeric columns + genre indicators + learned user and item ids ->
    perceptron. Rows come from `genre_codes` and `with_factors`."""
    feats = VectorAssembler(inputCols=["numScaled", "ufVec", "vfVec"] + [c + "Vec" for c in GENRE_COLS], outputCol="features")
    return _fit_mlp(train, [_indicators(GENRE_COLS), *_scaled_numbers(), feats], hidden, max_iter, seed)


def with_deep_score(deep: PipelineModel, df: DataFrame) -> DataFrame:
    """Rows with the deep model's probability, written once without the deep part's
    vectors."""
    keep = [c for c, t in df.dtypes if t != "vector"]
    return write_once(deep.transform(df).select(*keep, probability().alias("deepScore")), "deep")


def wide_deep_model(scored: DataFrame, n_cross: int = 10000, max_iter: int = 20) -> PipelineModel:
    """The deep model's probability (`with_deep_score`) plus the hashed item
    x first-history cross (one-hot, `n_cross` buckets) -> logistic regression."""
    d = scored.withColumn("crossIdx", cross_hash("movieId", "userRatedMovie1", n_cross))
    enc = OneHotEncoder(inputCols=["crossIdx"], outputCols=["crossVec"], dropLast=False, handleInvalid="keep")
    # unscaled, the penalty holds a bucket with few rows near 0
    return _logistic(d, ["deepScore", "crossVec"], [enc], max_iter, reg=0.02, standardize=False)


def predict_wide_deep(wd: PipelineModel, scored: DataFrame, n_cross: int = 10000) -> DataFrame:
    return predict(wd, scored.withColumn("crossIdx", cross_hash("movieId", "userRatedMovie1", n_cross)))


FM_GENRES = ["userGenre1", "movieGenre1"]


def with_candidate(samples: DataFrame, item_vectors: DataFrame) -> DataFrame:
    """The samples whose item has a vector."""
    return samples.join(item_vectors.where("emb is not null").select("movieId"), "movieId", "left_semi")


def interest_vector(samples: DataFrame | Callable[[], DataFrame], item_vectors: DataFrame, key: list[str], n: int = 5,
                    weighted: bool = False, weights: DataFrame | None = None) -> DataFrame:
    """For each sample, sum over its history slots (userRatedMovie1..n,
    empty or vector-less slots skipped) of concat(h - c, h, c, h * c), where
    h is the slot item's vector and c the candidate item's; `weighted`
    scales each slot by cosine(h, c), `weights` (key, slot from 0, weight) by a
    given weight (`click_models.slot_weights`). Adds `interest` array<double>, `nSlots`
    and `candidate` (c); samples whose candidate has no vector get null. `key`
    makes samples unique. Empty slots are left out before the vectors are joined,
    so no null key gathers rows, and a sample's at most n vectors meet again by
    its key; samples whose candidate has no vector need none and meet nothing. Samples
    are written once, as all these read them; given as a function that makes them,
    the tables it wrote on the way are let go."""
    v = item_vectors.select("movieId", "emb")
    has = v.where("emb is not null").select("movieId").distinct().withColumn("_has", F.lit(True))
    marked = settled(lambda: (samples() if callable(samples) else samples).join(has, "movieId", "left"), "interest")
    whole = marked.where("_has").drop("_has")
    slots = whole.select(*key, F.posexplode(F.array(*[F.col(f"userRatedMovie{i}") for i in range(1, n + 1)])).alias("_i", "_m"))
    found = (slots.filter(F.col("_m").isNotNull()).join(v.select(F.col("movieId").alias("_m"), F.col("emb").alias("_h")), "_m")
             .filter(F.col("_h").isNotNull()))
    given = F.lit(1.0)
    if weights is not None:
        found = found.join(weights.withColumnRenamed("slot", "_i"), [*key, "_i"], "left")
        given = F.coalesce("weight", F.lit(0.0))
    hist = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_i", "_h", given.alias("_w")))).alias("_l"))
    d = whole.join(hist, key, "left").join(v.withColumnRenamed("emb", "_c"), "movieId", "left")
    d = d.withColumn("_hs", F.coalesce(
        F.filter(F.transform("_l", lambda e: F.struct(e["_h"].alias("h"), e["_w"].alias("w"))), lambda e: F.size(e["h"]) == F.size(F.col("_c"))),
        F.array().cast("array<struct<h:array<float>,w:double>>")))

    def block(h):
        c = F.col("_c")
        parts = F.concat(F.zip_with(h, c, lambda x, y: x - y), h, c, F.zip_with(h, c, lambda x, y: x * y))
        return F.transform(parts, lambda x: x.cast("double"))

    zero = F.transform(F.sequence(F.lit(1), F.size("_c") * 4), lambda i: F.lit(0.0))
    if weighted:
        d = d.withColumn("_hs", F.transform("_hs", lambda e: F.struct(e["h"].alias("h"), cosine(e["h"], F.col("_c")).alias("w"))))
    if weighted or weights is not None:
        acc = F.aggregate("_hs", zero, lambda a, e: F.zip_with(a, block(e["h"]), lambda x, y: x + y * e["w"]))
    else:
        acc = F.aggregate("_hs", zero, lambda a, e: F.zip_with(a, block(e["h"]), lambda x, y: x + y))
    known = F.col("_c").isNotNull()
    d = d.withColumns({"interest": F.when(known, acc), "nSlots": F.when(known, F.size("_hs")), "candidate": F.col("_c")}).drop("_c", "_hs", "_l")
    none = marked.where("_has is null").drop("_has").join(v.where("emb is null").select("movieId"), "movieId", "left")
    return d.unionByName(none.select("*", *[F.lit(None).cast(d.schema[c].dataType).alias(c) for c in ("interest", "nSlots", "candidate")]))


def interest_inputs(df: DataFrame) -> DataFrame:
    """Rows with a candidate vector, their vectors ready for the model."""
    return df.filter(F.col("interest").isNotNull()).withColumns(
        {"interestVec": array_to_vector("interest"), "candidateVec": array_to_vector(F.col("candidate").cast("array<double>"))})


def interest_model(train: DataFrame, hidden=(128, 64), max_iter: int = 10, seed: int = 42) -> PipelineModel:
    """Interest vector + user profile (learned id, first genre, rating
    statistics) + candidate vector and genre + context -> perceptron. Rows come
    from `genre_codes` and `interest_inputs`, with factors."""
    raw = VectorAssembler(inputCols=["interestVec", "candidateVec", "ufVec", *NUMERIC_COLS], outputCol="raw")  # never null here
    scale = MinMaxScaler(inputCol="raw", outputCol="scaled")
    feats = VectorAssembler(inputCols=["scaled"] + [c + "Vec" for c in FM_GENRES], outputCol="features")
    return _fit_mlp(train, [_indicators(FM_GENRES), raw, scale, feats], hidden, max_iter, seed)


def binary_metrics(df: DataFrame, label: str = "label", score: str = "score", eps: float = 1e-7) -> DataFrame:
    """Log loss (scores clipped to [eps, 1-eps]), accuracy at 0.5 and
    the exact ROC and PR areas (no binning) in one row."""
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label).cast("double")
    base = df.agg(
        F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("logLoss"),
        F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label).cast("int")).cast("double")).alias("accuracy"))
    ev = df.select(F.col(score).cast("double").alias("s"), y.alias("y"))
    roc = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", metricName="areaUnderROC", numBins=0)
    pr = BinaryClassificationEvaluator(rawPredictionCol="s", labelCol="y", metricName="areaUnderPR", numBins=0)
    return base.select("logLoss", "accuracy", F.lit(roc.evaluate(ev)).alias("rocAuc"),
                       F.lit(pr.evaluate(ev)).alias("prAuc"))


def prediction_report(preds: DataFrame, order_cols: list[str], k: int = 12) -> DataFrame:
    """The first k predictions as percent text with a good/bad label."""
    top = preds.orderBy(*order_cols).limit(k)
    return top.select(*order_cols,
                      F.format_string("%.2f%%", F.col("score") * 100).alias("predicted"),
                      F.when(F.col("label") == 1, F.lit("Good Rating")).otherwise(F.lit("Bad Rating")).alias("actual"))


def save_model(model: PipelineModel, factors: Factors, path: str) -> None:
    """C14: persist a fitted pipeline and its learned ids."""
    model.write().overwrite().save(f"{path}/model")
    factors.users.write.mode("overwrite").parquet(f"{path}/users")
    factors.items.write.mode("overwrite").parquet(f"{path}/items")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, Factors]:
    users, items = spark.read.parquet(f"{path}/users"), spark.read.parquet(f"{path}/items")
    rank = users.select(F.size("uf")).first()[0]
    return PipelineModel.load(f"{path}/model"), Factors(users, items, rank)
