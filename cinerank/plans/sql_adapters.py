"""The driver-table adapters as SQL common table expressions, for the DuckDB
oracle queries. They mirror cinerank.sources.tables one to one."""

from __future__ import annotations

CTES = {
    "ratings": """ratings AS (
  SELECT o.o_custkey AS userId, l.l_partkey AS movieId,
         ceil(l.l_quantity / 5.0) * 0.5 AS rating,
         CAST(epoch(o.o_orderdate) AS BIGINT) AS "timestamp",
         l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, l.l_extendedprice
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)""",
    "movies": """movies AS (
  SELECT p_partkey AS movieId,
         CASE WHEN p_partkey % 97 = 0 THEN p_name
              ELSE p_name || ' (' || CAST(1950 + p_size AS VARCHAR) || ')' END AS title,
         CASE p_partkey % 3
              WHEN 0 THEN p_type
              WHEN 1 THEN p_type || '|' || split_part(p_name, ' ', 1)
              ELSE p_type || '|' || split_part(p_name, ' ', 1) || '|' || split_part(p_name, ' ', 2) END AS genres
  FROM part)""",
    "links": """links AS (
  SELECT p_partkey AS movieId, lpad(CAST(p_partkey + 100000 AS VARCHAR), 7, '0') AS imdbId,
         CASE WHEN p_partkey % 89 = 0 THEN NULL ELSE CAST(p_partkey + 500 AS VARCHAR) END AS tmdbId
  FROM part)""",
    "item_vectors": """item_vectors AS (
  SELECT vec_id AS movieId, embedding AS emb FROM embeddings)""",
    "user_vectors": """user_vectors AS (
  SELECT (SELECT max(vec_id) FROM embeddings) - vec_id AS userId, embedding AS emb FROM embeddings)""",
}

RATING_ORDER_SQL = '"timestamp", l_orderkey, l_linenumber, movieId, l_suppkey, l_quantity, l_extendedprice'


def year_sql(title: str, fallback: int) -> str:
    t = f"trim({title})"
    y = f"substr({t}, length({t}) - 4, 4)"
    return (f"(CASE WHEN {title} IS NOT NULL AND length({t}) >= 6 AND regexp_full_match({y}, '[0-9]{{4}}') "
            f"THEN CAST({y} AS INTEGER) ELSE {fallback} END)")


def clean_title_sql(title: str) -> str:
    t = f"trim({title})"
    y = f"substr({t}, length({t}) - 4, 4)"
    return (f"(CASE WHEN {title} IS NOT NULL AND length({t}) >= 6 AND regexp_full_match({y}, '[0-9]{{4}}') "
            f"THEN trim(substr({t}, 1, length({t}) - 6)) ELSE {t} END)")


def sum_list_sql(expr: str) -> str:
    """Left-to-right double sum of a list (matches Spark's aggregate())."""
    return f"list_reduce(list_prepend(0.0::DOUBLE, {expr}), lambda acc, x: acc + x)"


def dot_sql(a: str, b: str) -> str:
    return sum_list_sql(f"list_transform(range(1, len({a}) + 1), lambda i: CAST({a}[i] * {b}[i] AS DOUBLE))")


def sqnorm_sql(a: str) -> str:
    return sum_list_sql(f"list_transform({a}, lambda x: CAST(x * x AS DOUBLE))")


def cosine_sql(a: str, b: str) -> str:
    na, nb = sqnorm_sql(a), sqnorm_sql(b)
    return (f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND len({a}) = len({b}) AND {na} > 0 AND {nb} > 0 "
            f"THEN {dot_sql(a, b)} / (sqrt({na}) * sqrt({nb})) ELSE -1.0 END)")


def uniform_u32_sql(*parts: str) -> str:
    key = " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 8)) AS BIGINT)"


def with_ctes(body: str, *names: str, extra: list[str] | None = None, recursive: bool = False) -> str:
    """Prefix a query with the adapter CTEs it names (plus extra CTEs)."""
    parts = [CTES[n] for n in names] + list(extra or [])
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(parts) + "\n" + body) if parts else body


def var_sql(x: str, over: str = "") -> str:
    """Sample variance from exact sums, as functions.columns.var_from_sums
    (`over` = " OVER w" for window frames)."""
    n = f"count({x}){over}::DOUBLE"
    sm = f"sum({x}::DOUBLE){over}"
    ss = f"sum({x}::DOUBLE * {x}::DOUBLE){over}"
    return f"(CASE WHEN {n} > 1 THEN ({n} * {ss} - {sm} * {sm}) / ({n} * ({n} - 1.0)) END)"
