"""Click-model queries: encodings, interest vectors, metrics, Spark ML models
trained on the 10% sample's train part and scored on its test part.

A trained score cannot be computed in SQL, so a model's query returns, for every
test row, its key, its label, whether the score is a probability, and whether the
log loss over all test rows is below that of the base rate; metrics and saved models
are checked by properties computed from the scores."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cinerank.operators import click_models as C
from cinerank.operators import ctr as M
from cinerank.operators import samples as S
from cinerank.operators.candidates import recommend_by_model, recommend_for_users
from cinerank.operators.encoders import hot_index
from cinerank.operators.ranking import top_items
from cinerank.operators.vectors import pool_top_k
from cinerank.plans.q_profiles import ITEMS_SQL, items
from cinerank.plans.q_samples import samples, samples_sql
from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import sum_list_sql, uniform_u32_sql
from cinerank.session import settled, shared_path, write_once
from cinerank.sources import tables as T

KEY = ["userId", "movieId", "timestamp", "l_orderkey", "l_linenumber"]
SPLIT_KEY = ["userId", "movieId", "timestamp"] + T.TIE_BREAK
ROW_KEY = list(dict.fromkeys(SPLIT_KEY))


def _split(spark, d):
    return S.split_samples(samples(spark, d, S.in_sample(SPLIT_KEY, 0.1, 42)), SPLIT_KEY, 0.1, (0.8, 0.2), seed=42)


def _vocab(spark, d):
    return M.genre_vocabulary(T.movies(spark, d))


VOCAB_SQL = ["vocab AS (SELECT list(g ORDER BY g) AS v FROM (SELECT DISTINCT unnest(string_split(genres, '|')) AS g FROM movies))"]


@register("encode_genres", samples_sql(
    "SELECT " + ", ".join(KEY) + ", " + ", ".join(
        f"CAST(coalesce(list_position(vocab.v, {c}), 0) - 1 AS INTEGER) AS {c}Idx" for c in M.GENRE_COLS)
    + " FROM samples, vocab", extra=VOCAB_SQL))
def q_encode_genres(spark, d):
    """Genre slots -> index in the genre vocabulary (-1 unknown/missing)."""
    e = M.encode_vocab(samples(spark, d), M.GENRE_COLS, _vocab(spark, d))
    return e.select(*KEY, *[c + "Idx" for c in M.GENRE_COLS])


@register("encode_ids", samples_sql(f"""
SELECT {', '.join(KEY)}, CAST(userId AS INTEGER) AS userIdIdx, CAST(movieId AS INTEGER) AS movieIdIdx
FROM samples"""))
def q_encode_ids(spark, d):
    """Identity encoding of user and item ids into the ranges of the data
    (users of the ratings, items of the catalogue): no id is out of range."""
    n_users = M.id_range(T.ratings(spark, d), "userId")
    n_items = M.id_range(T.movies(spark, d), "movieId")
    e = M.encode_identity(M.encode_identity(samples(spark, d), "userId", n_users), "movieId", n_items)
    return e.select(*KEY, "userIdIdx", "movieIdIdx")


@register("cross_hash", samples_sql(f"""
SELECT {', '.join(KEY)}, CAST({uniform_u32_sql("coalesce(CAST(movieId AS VARCHAR), '')",
                                              "coalesce(CAST(userRatedMovie1 AS VARCHAR), '')")} % 10000 AS INTEGER) AS crossIdx
FROM samples"""))
def q_cross_hash(spark, d):
    """Hashed item x first-history-item cross, 10000 buckets."""
    s = samples(spark, d)
    return s.select(*KEY, M.cross_hash("movieId", "userRatedMovie1", 10000).alias("crossIdx"))


@register("model_inputs", samples_sql(
    "SELECT " + ", ".join(KEY) + ", label, " + ", ".join(
        f"coalesce(TRY_CAST(replace(CAST({c} AS VARCHAR), ',', '') AS DOUBLE), 0.0) AS {c}" for c in M.NUMERIC_COLS)
    + " FROM samples"))
def q_model_inputs(spark, d):
    """C11: model columns with two-digit texts parsed to numbers."""
    return M.model_inputs(samples(spark, d)).select(*KEY, "label", *M.NUMERIC_COLS)


def _interest_sql() -> str:
    hs = ("list_filter([" + ", ".join(f"h{i}.emb" for i in range(1, 6)) + "], lambda h: h IS NOT NULL AND len(h) = len(c.emb))")
    blocks = ["CAST(h[d] - c.emb[d] AS DOUBLE)", "CAST(h[d] AS DOUBLE)", "CAST(c.emb[d] AS DOUBLE)", "CAST(h[d] * c.emb[d] AS DOUBLE)"]
    parts = [f"list_transform(range(1, len(c.emb) + 1), lambda d: {sum_list_sql(f'list_transform(hs, lambda h: {e})')})" for e in blocks]
    whole = " || ".join(f"({p})" for p in parts)
    joins = " ".join(f"LEFT JOIN item_vectors h{i} ON h{i}.movieId = s.userRatedMovie{i}" for i in range(1, 6))
    total = sum_list_sql("iv")
    placed = sum_list_sql("list_transform(range(1, len(iv) + 1), lambda d: iv[d] * d)")
    return f"""
SELECT {', '.join(KEY)}, nSlots, CASE WHEN iv IS NOT NULL THEN {total} END AS total,
       CASE WHEN iv IS NOT NULL THEN {placed} END AS placed, CAST(len(iv) AS INTEGER) AS size
FROM (SELECT s.*, CASE WHEN c.emb IS NOT NULL THEN CAST(len(hs) AS INTEGER) END AS nSlots,
             CASE WHEN c.emb IS NOT NULL THEN {whole} END AS iv
      FROM (SELECT s.*, {hs} AS hs FROM samples s LEFT JOIN item_vectors c ON c.movieId = s.movieId {joins}) s
      LEFT JOIN item_vectors c ON c.movieId = s.movieId)"""


@register("interest_vector", samples_sql(_interest_sql(), extra=[
    "item_vectors AS (SELECT vec_id AS movieId, embedding AS emb FROM embeddings)"]))
def q_interest_vector(spark, d):
    """Per sample, sum over history slots of concat(h-c, h, c, h*c) with
    the given item vectors (null where the sample's item has none); reported as
    the vector's sum and its sum weighted by place, in which every dimension
    counts differently."""
    s = lambda: samples(spark, d).select(*dict.fromkeys(KEY + ROW_KEY + M.HISTORY_COLS))
    iv = M.interest_vector(s, T.item_vectors(spark, d), ROW_KEY)
    weighted = F.transform("interest", lambda x, i: x * (i + 1))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return iv.select(*KEY, "nSlots", add("interest").alias("total"), add(weighted).alias("placed"),
                     F.when(F.col("interest").isNotNull(), F.size("interest")).alias("size"))


def _baseline(df):
    """Rows scored by a rating baseline: item mean rating / 5."""
    return M.model_inputs(df).withColumn("score", F.col("movieAvgRating") / 5.0)


_SPLIT_U = uniform_u32_sql(*["userId", "movieId", '"timestamp"'] + T.TIE_BREAK, "42")
_SCORED = """scored AS (
  SELECT {cols}, label,
         coalesce(TRY_CAST(replace(movieAvgRating, ',', '') AS DOUBLE), 0.0) / 5.0 AS score
  FROM {rows})"""
TEST_SQL = [_SCORED.format(cols=", ".join(KEY), rows=f"(SELECT *, {_SPLIT_U} / 4294967296.0 AS u FROM samples) WHERE u < 0.1 AND u >= 0.1 * 0.8"),
            """pts AS (
  SELECT score, sum(label) AS tp, sum(1 - label) AS fp FROM scored GROUP BY score)""",
            """cum AS (
  SELECT score, sum(tp) OVER (ORDER BY score DESC) AS ctp, sum(fp) OVER (ORDER BY score DESC) AS cfp,
         (SELECT sum(label) FROM scored) AS p, (SELECT sum(1 - label) FROM scored) AS n FROM pts)""",
            """roc AS (
  SELECT list_prepend({'x': 0.0::DOUBLE, 'y': 0.0::DOUBLE},
         list({'x': cfp / n, 'y': ctp / p} ORDER BY score DESC)) AS c FROM cum)""",
            """pr AS (
  SELECT list_prepend({'x': 0.0::DOUBLE, 'y': first(ctp / (ctp + cfp) ORDER BY score DESC)},
         list({'x': ctp / p, 'y': ctp / (ctp + cfp)} ORDER BY score DESC)) AS c FROM cum)"""]


def _area(lst: str) -> str:
    return sum_list_sql(f"list_transform(range(2, len({lst}) + 1), lambda i: "
                        f"({lst}[i].x - {lst}[i - 1].x) * ({lst}[i].y + {lst}[i - 1].y) / 2.0)")


@register("baseline_metrics", samples_sql(f"""
SELECT round(avg(-(label * ln(least(greatest(score, 1e-7), 1 - 1e-7))
                  + (1 - label) * ln(1 - least(greatest(score, 1e-7), 1 - 1e-7)))), 6) AS logLoss,
       round(avg(CASE WHEN (score >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
       round((SELECT {_area('c')} FROM roc), 6) AS rocAuc,
       round((SELECT {_area('c')} FROM pr), 6) AS prAuc
FROM scored""", extra=[_SCORED.format(cols=", ".join(KEY), rows="samples")] + TEST_SQL[1:]))
def q_baseline_metrics(spark, d):
    """Log loss, accuracy, exact ROC and PR areas of the rating
    baseline on all samples (it is not fitted, so none are held out)."""
    # written once: the metrics read it several times
    m = M.binary_metrics(_baseline(samples(spark, d)).select("label", "score").checkpoint(eager=True))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@register("prediction_report", samples_sql(f"""
SELECT {', '.join(KEY)}, format('{{:.2f}}%', score * 100) AS predicted,
       CASE WHEN label = 1 THEN 'Good Rating' ELSE 'Bad Rating' END AS actual
FROM scored ORDER BY {', '.join(KEY)} LIMIT 12""", extra=TEST_SQL[:1]))
def q_prediction_report(spark, d):
    """First 12 held-out predictions as percent text + label."""
    return M.prediction_report(_baseline(_split(spark, d).filter(F.col("part") == "test")), KEY, 12)


def _parts(spark, d):
    """Train and test rows of the 10% sample as model inputs, written once:
    every estimator stage passes over the training rows."""
    sp = settled(lambda: M.model_inputs(_split(spark, d)), "parts")
    return sp.filter(F.col("part") == "train"), sp.filter(F.col("part") == "test")


def _coded_parts(spark, d):
    """Parts with genre codes and the factors learned on the train part. They are
    written without what follows from the factors, the widest columns."""
    tr, te = _parts(spark, d)
    f, v = M.id_factors(tr), _vocab(spark, d)
    prepare = lambda df: M.factor_columns(write_once(M.join_factors(M.genre_codes(df, M.GENRE_COLS, v), f), "coded"))
    return prepare(tr), prepare(te), f


FEW_ROWS = 200


def _loss_over_base(df):
    """The log loss of all rows less that of their base rate (one row)."""
    p = F.least(F.greatest("score", F.lit(1e-7)), F.lit(1 - 1e-7))
    y, rate = F.col("label").cast("double"), F.avg("label").cast("double")
    loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    return df.agg((loss + rate * F.log(rate) + (1 - rate) * F.log(1 - rate)).alias("over"), F.count("*").alias("rows"))


def _scored(df, margin=0.0):
    """Key, label, whether the score is a probability, and whether the held-out
    log loss is below the base rate's plus `margin` (below FEW_ROWS rows, where
    chance decides that, it always counts as such)."""
    df = write_once(df.select(*KEY, "label", "score"), "scored")
    below = (_loss_over_base(df).select((F.col("over") < margin) | (F.col("rows") < FEW_ROWS))).scalar()
    return df.select(*KEY, "label", F.col("score").between(0.0, 1.0).alias("in_unit"), below.alias("loss_ok"))


TEST_ROWS = samples_sql(f"SELECT {', '.join(KEY)}, label, true AS in_unit, true AS loss_ok FROM scored", extra=TEST_SQL[:1])


@register("pair_model", TEST_ROWS)
def q_pair_model(spark, d):
    """User x item model, ids learned jointly with the click loss, dot-product
    head. In the stand-in data ratings do not depend on who rates what, so the ids
    alone cannot beat the base rate; the loss must stay within 0.01 of it."""
    tr, te = _parts(spark, d)
    return _scored(C.score_pair(C.fit_pair(tr), te), margin=0.01)


@register("pair_mlp_model", TEST_ROWS)
def q_pair_mlp_model(spark, d):
    """User x item model, perceptron over factorised ids with a head on unseen
    rows; the loss must stay within 0.01 of the base rate, as for `pair_model`."""
    tr, te = _parts(spark, d)
    f = M.id_factors(C.head_rows(tr)[0])
    rows = lambda df: M.with_factors(df, f)
    return _scored(C.score_deep(C.fit_deep(rows(tr), M.pair_perceptron), rows(te)), margin=0.01)


TRAIN_SQL = f"tr AS (SELECT * FROM (SELECT *, {_SPLIT_U} / 4294967296.0 AS u FROM samples) WHERE u < 0.1 * 0.8)"


@register("pair_factors", samples_sql("""
SELECT 'user' AS kind, userId AS id, 10 AS rank FROM tr GROUP BY userId
UNION ALL SELECT 'item', movieId, 10 FROM tr GROUP BY movieId""", extra=[TRAIN_SQL]))
def q_pair_factors(spark, d):
    """Every user and item of the train part has a factor of length 10."""
    f = M.id_factors(_parts(spark, d)[0])
    return (f.users.select(F.lit("user").alias("kind"), F.col("userId").alias("id"), F.size("uf").alias("rank"))
            .union(f.items.select(F.lit("item"), "movieId", F.size("vf"))))


@register("mlp_model", TEST_ROWS)
def q_mlp_model(spark, d):
    """Numbers + genres + learned ids, perceptron (128, 128)."""
    tr, te, _ = _coded_parts(spark, d)
    return _scored(C.score_deep(C.fit_deep(tr, M.mlp_model, numbers=True), te))


@register("wide_deep_model", TEST_ROWS)
def q_wide_deep_model(spark, d):
    """Perceptron score + hashed cross -> logistic regression, which is
    fitted on rows that the perceptron has not seen."""
    tr, te, _ = _coded_parts(spark, d)
    fit, held = C.head_rows(tr)
    deep = M.mlp_model(fit)
    wd = M.wide_deep_model(M.with_deep_score(deep, held))
    return _scored(M.predict_wide_deep(wd, M.with_deep_score(deep, te)), margin=0.01)


@register("fm_model", TEST_ROWS)
def q_fm_model(spark, d):
    """A factorisation machine over user, item, first user genre and first item
    genre (first order and all products, learned jointly) beside a deep part (64, 64)
    over numbers and genres, joined by a logistic head."""
    v = _vocab(spark, d)
    tr, te = (M.genre_codes(df, M.GENRE_COLS, v) for df in _parts(spark, d))
    return _scored(C.score_deep(C.fit_deep(tr, C.genre_part, C.PAIR_AND_GENRE_IDS, numbers=True), te))


@register("interest_model", samples_sql(f"""
SELECT {', '.join(KEY)}, label, true AS in_unit, true AS loss_ok, true AS attends FROM scored
WHERE movieId IN (SELECT vec_id FROM embeddings)""", extra=TEST_SQL[:1]))
def q_interest_model(spark, d):
    """Interest vector + profile + candidate + context, perceptron (128, 64),
    for samples whose item has a vector. A learned activation unit (32) weighs each
    history slot by its item and the candidate; `attends`: its weights differ."""
    tr, te, _ = _coded_parts(spark, d)
    iv = T.item_vectors(spark, d)
    unit = C.attention_unit(C.head_rows(tr)[0], iv, ROW_KEY)
    weights = write_once(C.slot_weights(unit, te, iv, ROW_KEY), "weights")
    prepare = lambda df, w: settled(lambda: M.interest_inputs(M.interest_vector(df, iv, ROW_KEY, weights=w)), "interest_rows")
    train = prepare(tr, C.slot_weights(unit, tr, iv, ROW_KEY))
    out = _scored(C.score_deep(C.fit_deep(train, M.interest_model, numbers=True), prepare(te, weights)), margin=0.01)
    return out.withColumn("attends", weights.agg((F.stddev("weight") > 0.001) & F.min("weight").between(0, 1)).scalar())


@register("model_metrics", samples_sql(f"""
SELECT CASE WHEN u < 0.1 * 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives,
       true AS in_range, CASE WHEN part = 'train' THEN true END AS beats_base_rate
FROM (SELECT *, {_SPLIT_U} / 4294967296.0 AS u FROM samples) WHERE u < 0.1 GROUP BY 1"""))
def q_model_metrics(spark, d):
    """C12 on the pair model: all metrics lie in their ranges, and on the rows
    it was fitted on its log loss is below that of the base rate."""
    tr, te = _parts(spark, d)
    m, f = M.pair_model(tr)
    out = None
    for part, df in (("train", tr), ("test", te)):
        scored = M.predict(m, M.with_factors(df, f)).select("label", "score").checkpoint(eager=True)
        rate = F.avg("label").cast("double")
        counts = scored.agg(F.count("*").alias("rows"), F.sum("label").cast("long").alias("positives"),
                            (-(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))).alias("base"))
        row = M.binary_metrics(scored).join(counts).select(
            F.lit(part).alias("part"), "rows", "positives",
            ((F.col("logLoss") >= 0) & F.col("accuracy").between(0, 1) & F.col("rocAuc").between(0, 1) & F.col("prAuc").between(0, 1)).alias("in_range"),
            F.when(F.lit(part) == "train", F.col("logLoss") < F.col("base")).alias("beats_base_rate"))
        out = row if out is None else out.unionByName(row)
    return out


@register("indicator_vectors", samples_sql(f"""
SELECT {', '.join(KEY)}, CAST((SELECT max(movieId) + 2 FROM movies) AS INTEGER) AS movieIdIdxSize,
       CAST((SELECT max(userId) + 2 FROM ratings) AS INTEGER) AS userIdIdxSize,
       CAST(coalesce(list_position(vocab.v, movieGenre1), 0) AS INTEGER) AS movieGenre1Hot,
       CAST(coalesce(list_position(vocab.v, movieGenre3), 0) AS INTEGER) AS movieGenre3Hot
FROM samples, vocab""", extra=VOCAB_SQL))
def q_indicator_vectors(spark, d):
    """C4: one-hot indicators of item, user and genre slots; a missing genre has
    a slot of its own (0). Checked by the sizes of the id vectors and the place
    of the 1 in each row's genre vectors."""
    genres = ["movieGenre1", "movieGenre3"]
    s = M.genre_codes(samples(spark, d), genres, _vocab(spark, d))
    s = M.encode_identity(M.encode_identity(s, "userId", M.id_range(T.ratings(spark, d), "userId")), "movieId",
                          M.id_range(T.movies(spark, d), "movieId"))
    # fitted on the whole id ranges, which the samples need not reach
    top = s.agg(F.lit(1).alias("one")).select(
        (M.id_range(T.ratings(spark, d), "userId") - 1).cast("int").alias("userIdIdx"),
        (M.id_range(T.movies(spark, d), "movieId") - 1).cast("int").alias("movieIdIdx"),
        *[F.size(_vocab(spark, d)).alias(g + "Idx") for g in genres])
    out = M.indicator(s, ["movieIdIdx", "userIdIdx"] + [g + "Idx" for g in genres], top)
    size = lambda c: F.lit(out.schema[c].metadata["ml_attr"]["num_attrs"]).cast("int")
    return out.select(*KEY, *[size(c + "Vec").alias(c + "Size") for c in ("movieIdIdx", "userIdIdx")],
                      *[hot_index(g + "IdxVec").alias(g + "Hot") for g in genres])


@register("model_roundtrip", samples_sql(f"SELECT {', '.join(KEY)}, true AS same FROM scored", extra=TEST_SQL[:1]))
def q_model_roundtrip(spark, d):
    """C14: save the pair model to shared storage, load it, score again: the
    scores of every test row before and after are equal."""
    tr, te = _parts(spark, d)
    m, f = M.pair_model(tr)
    path = shared_path(spark, f"model-{uuid.uuid4().hex[:12]}")
    M.save_model(m, f, path)
    m2, f2 = M.load_model(spark, path)
    before = M.predict(m, M.with_factors(te, f)).select(*ROW_KEY, F.col("score").alias("before"))
    after = M.predict(m2, M.with_factors(te, f2)).select(*ROW_KEY, F.col("score").alias("after"))
    return before.join(after, ROW_KEY).select(*KEY, (F.col("before") == F.col("after")).alias("same"))


@register("recommend_model", samples_sql(f"""
SELECT w.userId, r.i AS rank, true AS in_pool, true AS in_unit
FROM (SELECT u.userId, least(32, CASE WHEN u.userId IN (SELECT userId FROM tr)
                                      THEN (SELECT count(*) FROM pool WHERE movieId IN (SELECT movieId FROM tr))
                                      ELSE (SELECT count(*) FROM pool) END) AS n
      FROM (SELECT DISTINCT userId FROM ratings) u) w, range(1, 33) AS r(i)
WHERE r.i <= w.n""", extra=[ITEMS_SQL, TRAIN_SQL, """pool AS (
  SELECT movieId FROM items ORDER BY averageRating DESC, movieId LIMIT 800)"""]))
def q_recommend_model(spark, d):
    """Every user's 32 best items of the 800-item pool by the pair model's
    score, scored from its factor tables; users without a factor get the pool in
    its own order. Checked: each user's ranks, that the items are in the pool
    and that the scores are probabilities."""
    r, it = T.ratings(spark, d), items(spark, d)
    tr, _ = _parts(spark, d)
    m, f = M.pair_model(tr)
    pool = top_items(it, 800, "rating").select("movieId")
    top = pool_top_k(f.users, "userId", "uf", pool.join(f.items, "movieId"), "movieId", "vf", 32, "dot")
    line = m.stages[-1]
    logit = F.lit(float(line.coefficients[0])) * F.col("score") + F.lit(float(line.intercept))
    warm = top.select(F.col("qid").alias("userId"), F.col("cid").alias("movieId"), (1 / (1 + F.exp(-logit))).alias("score"), "rank")
    cold_users = r.select("userId").distinct().join(f.users, "userId", "left_anti")
    cold = recommend_for_users(cold_users, it, size=32, pool=800).withColumn("score", F.lit(tr.agg(F.avg("label")).scalar()))
    both = warm.unionByName(cold).join(pool.withColumn("in_pool", F.lit(True)), "movieId", "left")
    return both.select("userId", "rank", F.coalesce("in_pool", F.lit(False)).alias("in_pool"),
                       F.col("score").between(0.0, 1.0).alias("in_unit"))


@register("recommend_clicks", samples_sql("""
SELECT u.userId, r.i AS rank, true AS in_pool, true AS in_unit, true AS falling
FROM (SELECT DISTINCT userId FROM ratings) u, range(1, 33) AS r(i)
WHERE r.i <= least(32, (SELECT count(*) FROM pool))""", extra=[ITEMS_SQL, """pool AS (
  SELECT movieId FROM items ORDER BY averageRating DESC, movieId LIMIT 800)"""]))
def q_recommend_clicks(spark, d):
    """R5 with a click model: the pool ranked for every user by the jointly learned
    machine over user and item. Checked: each user's ranks, that the items are in the
    pool, that scores are probabilities and fall with the rank."""
    it = items(spark, d)
    model = C.fit_pair(_parts(spark, d)[0])
    top = recommend_by_model(T.ratings(spark, d), it, C.PairScorer(model))
    before = F.lag("score").over(Window.partitionBy("userId").orderBy("rank"))
    pool = top_items(it, 800, "rating").select("movieId", F.lit(True).alias("in_pool"))
    return top.withColumn("before", before).join(pool, "movieId", "left").select(
        "userId", "rank", F.coalesce("in_pool", F.lit(False)).alias("in_pool"), F.col("score").between(0.0, 1.0).alias("in_unit"),
        (F.col("score") <= F.coalesce("before", F.lit(1.0))).alias("falling"))


@register("recommend_scores", samples_sql("""
SELECT userId, movieId, score, rank FROM (
  SELECT sc.*, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) AS rank
  FROM (SELECT userId, movieId, avg(rating) AS score FROM ratings GROUP BY userId, movieId) sc
  WHERE movieId IN (SELECT movieId FROM items ORDER BY averageRating DESC, movieId LIMIT 800))
WHERE rank <= 32""", extra=[ITEMS_SQL]))
def q_recommend_scores(spark, d):
    """R5 with a given score table: rank the pool by each user's own mean rating
    of an item, over all rated pairs."""
    r = T.ratings(spark, d)
    scores = r.groupBy("userId", "movieId").agg(F.avg("rating").alias("score"))
    return recommend_for_users(r, items(spark, d), size=32, model="scores", pool=800, scores=scores)
