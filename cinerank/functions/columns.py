"""Column-expression helpers. All are built-in Spark expressions (codegen,
no Python in the hot path); each returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_POW_32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---------------------------------------------------------------- titles
def release_year(title, fallback_year: int = 1990) -> Column:
    """Year from a "Name (YYYY)" title: the four characters before the last
    one of the trimmed title. Short, missing or non-numeric -> fallback."""
    t = F.trim(_c(title))
    n = F.length(t)
    y = t.substr(n - F.lit(4), F.lit(4))
    ok = t.isNotNull() & (n >= 6) & y.rlike("^[0-9]{4}$")
    return F.when(ok, y.try_cast("int")).otherwise(F.lit(fallback_year)).cast("int")


def clean_title(title, keep_title_on_fail: bool = True) -> Column:
    """Title without the " (YYYY)" suffix; the trimmed title when no year."""
    t = F.trim(_c(title))
    n = F.length(t)
    y = t.substr(n - F.lit(4), F.lit(4))
    ok = t.isNotNull() & (n >= 6) & y.rlike("^[0-9]{4}$")
    stripped = F.trim(t.substr(F.lit(1), n - F.lit(6)))
    return F.when(ok, stripped).otherwise(t if keep_title_on_fail else F.lit(None).cast("string"))


def genre_array(genres) -> Column:
    """"A|B|C" -> [A, B, C]; null or blank -> [], blank parts are left out."""
    g = _c(genres)
    return F.when(g.isNull(), F.array().cast("array<string>")).otherwise(
        F.filter(F.split(g, "\\|"), lambda x: F.trim(x) != ""))


def slot(arr, i: int) -> Column:
    """Element i (0-based) or null past the end (never raises under ANSI)."""
    return F.get(_c(arr), F.lit(i))


def round_text(x, digits: int = 2) -> Column:
    """Two-digit text with grouping commas, as format_number."""
    return F.format_number(_c(x), digits)


def display_rating(x) -> Column:
    """Two significant digits for a rating shelf (values in 0..5)."""
    v = _c(x)
    return F.when(v >= 1.0, F.format_string("%.1f", v)).otherwise(F.format_string("%.2f", v))


# ---------------------------------------------------------------- moments
def var_from_sums(n, s, ss) -> Column:
    """Sample variance (n * sum(x^2) - sum(x)^2) / (n * (n - 1)); null for
    n < 2. For discrete inputs (ratings in 0.5 steps, integer years) the
    sums are exact in double, so this is the correctly rounded variance,
    independent of summation order or engine."""
    n = _c(n).cast("double")
    s, ss = _c(s).cast("double"), _c(ss).cast("double")
    return F.when(n > 1, (n * ss - s * s) / (n * (n - F.lit(1.0))))


def sample_var(x) -> Column:
    """Aggregate form of `var_from_sums` (exact for discrete inputs)."""
    v = _c(x).cast("double")
    return var_from_sums(F.count(v), F.sum(v), F.sum(v * v))


def sample_stddev(x) -> Column:
    return F.sqrt(sample_var(x))


# ---------------------------------------------------------------- draws
def uniform_u32(*parts) -> Column:
    """Reproducible 32-bit integer draw from md5 of the '|'-joined key."""
    key = F.concat_ws("|", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def uniform01(*parts) -> Column:
    """Reproducible uniform in [0, 1) from md5 of the '|'-joined key."""
    return uniform_u32(*parts) / F.lit(TWO_POW_32)


# ---------------------------------------------------------------- vectors
def parse_vector(text) -> Column:
    """"f f f" -> array<float> (whitespace separated); null for a field that is
    no number."""
    t = F.trim(_c(text))
    return F.transform(F.split(t, "\\s+"), lambda s: s.try_cast("float"))


def vector_text(arr) -> Column:
    """array<float> -> "f f f"."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), " ")


def _sum_double(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    """Sum of float products, accumulated in double, left to right."""
    return _sum_double(F.zip_with(_c(a), _c(b), lambda x, y: (x * y).cast("double")))


def sq_norm(a) -> Column:
    return _sum_double(F.transform(_c(a), lambda x: (x * x).cast("double")))


def cosine(a, b, na: Column | None = None, nb: Column | None = None) -> Column:
    """Cosine similarity; -1 when a vector is missing, lengths differ or a
    norm is zero. `na`, `nb`: squared norms that are already there."""
    a, b = _c(a), _c(b)
    na, nb = sq_norm(a) if na is None else na, sq_norm(b) if nb is None else nb
    valid = a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (na > 0) & (nb > 0)
    return F.when(valid, dot(a, b) / (F.sqrt(na) * F.sqrt(nb))).otherwise(F.lit(-1.0))


# ---------------------------------------------------------------- genres
def genre_similarity(a, b) -> Column:
    """same / (|a| + |b|) / 2 where same counts a's genres found in b;
    0 when both lists are empty."""
    a, b = _c(a), _c(b)
    # native intersection when a has no repeated genre; the counting form
    # (repeats counted) otherwise
    same = F.when(F.size(F.array_distinct(a)) == F.size(a), F.size(F.array_intersect(a, b))) \
        .otherwise(F.size(F.filter(a, lambda x: F.array_contains(b, x)))).cast("double")
    denom = (F.size(a) + F.size(b)).cast("double")
    return F.coalesce(F.try_divide(same, denom) / F.lit(2.0), F.lit(0.0))


def blend_score(genre_sim, avg_rating, sim_weight: float = 0.7, rating_weight: float = 0.3) -> Column:
    return _c(genre_sim) * F.lit(sim_weight) + F.lit(rating_weight) * (_c(avg_rating) / F.lit(5.0))


def add_ranked_genres(df, list_col: str, out_col: str, n: int | None = None):
    """List of "A|B" texts in `list_col` -> `out_col`: distinct genres by
    count desc, genre asc (first `n`).

    Steps are separate projections so that no lambda re-evaluates a list
    expression: one split of the joined texts, a native sort, one pass for
    the starts of equal runs; a genre's count is the gap to the next start."""
    lst = F.col(list_col)
    empty_s = F.array().cast("array<string>")
    flat = F.when(F.size(lst) == 0, empty_s).otherwise(F.split(F.concat_ws("|", lst), "\\|"))
    df = df.withColumn("_gsrt", F.sort_array(flat))
    srt = F.col("_gsrt")
    total = F.size(srt)
    idx = F.when(total > 0, F.sequence(F.lit(0), total - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_gst", F.filter(idx, lambda i: (i == 0) | (F.get(srt, i) != F.get(srt, i - 1))))
    st = F.col("_gst")
    nxt = F.concat(F.slice(st, 2, F.greatest(F.size(st) - 1, F.lit(0))), F.array(total))
    entries = F.zip_with(st, nxt, lambda a, b: F.struct((a - b).alias("neg"), F.get(srt, a).alias("genre")))
    ranked = F.transform(F.sort_array(entries), lambda e: e["genre"])
    ranked = F.when(total == 0, empty_s).otherwise(F.slice(ranked, 1, n) if n else ranked)
    return df.withColumn(out_col, ranked).drop("_gsrt", "_gst")
