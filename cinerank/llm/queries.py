"""The registered queries of the training-data operators: thin calls with
production parameters on whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.llm import (block_naming, bottomk_dedup, hard_negatives, host_reputation, nbsvm, piece_lattice, projection_dedup, pseudonyms,
                          retrieval_packing, source_divergence, source_mix, template_removal, token_count)
from cinerank.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable, name: str, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_naming.exact_groups(documents(spark, sf_dir))


register(op3_block_naming, "op3_block_naming", r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
     g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t""")


def op7_heap_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir).select("doc_id", "text"),
                                    public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


register(op7_heap_token_count, "op7_heap_token_count")


def op1_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return template_removal.main_text(pages.select("page_id", "url", "html"))


register(op1_template_removal, "op1_template_removal")


def public_vocabulary() -> retrieval_packing.Vocabulary:
    return retrieval_packing.Vocabulary(public_tokenizers.path("byte_bpe_50k.json"),
                                        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def packed_digests(docs: DataFrame) -> DataFrame:
    pieces = retrieval_packing.pack(docs, public_vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_digests(documents(spark, sf_dir))


register(op2_retrieval_packing, "op2_retrieval_packing")

URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"),
             ("block", "net/fr/")]


def op4_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label row of its number says low quality or toxic."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"),
                             ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return host_reputation.judge(pages, outcomes, URL_RULES)


def _op4_sql() -> str:
    fits = "(p.host = split_part(r.rule, '/', 1) OR ends_with(p.host, '.' || split_part(r.rule, '/', 1)))"
    rules = ", ".join(f"('{v}', '{r}')" for v, r in URL_RULES)

    def shrink(level: str, units: str, prior: str) -> str:
        return f"""
{level}0 AS (SELECT *, {prior} AS mu FROM {units}),
{level}m AS (SELECT 1 / greatest({host_reputation.LEAST_RHO}, least({host_reputation.MOST_RHO}, coalesce(
       CASE WHEN sum(n * (n - 1) * mu * (1 - mu)) > 0
            THEN sum((k - n * mu) * (k - n * mu) - n * mu * (1 - mu)) / sum(n * (n - 1) * mu * (1 - mu)) END,
       {host_reputation.LEAST_RHO}))) - 1 AS m FROM {level}0),
{level} AS (SELECT {level}0.*, m, (k + m * mu) / (n + m) AS mean FROM {level}0, {level}m)"""
    return rf"""
WITH raw AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM raw),
o AS (SELECT doc_id AS page_id, CAST(avg(b) >= 0.5 AS INT) AS bad
      FROM (SELECT doc_id, CAST(quality = 0 OR toxic = 1 AS INT) AS b FROM labels) WHERE doc_id IS NOT NULL AND b IS NOT NULL GROUP BY 1),
counted AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS k FROM p LEFT JOIN o USING (page_id) GROUP BY host),
names AS (SELECT host, n, k, name, string_split(name, '.') AS labels,
                 regexp_matches(name, '^([0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}|\[.*)$') AS address
          FROM (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS name FROM counted)),
suffix_rules AS (SELECT unnest(string_split('{" ".join(host_reputation.SUFFIX_RULES)}', ' ')) AS rule),
ends AS (SELECT host, len(labels) - i + 1 AS size, array_to_string(labels[i:], '.') AS tail,
                '*.' || array_to_string(labels[i + 1:], '.') AS any_tail
         FROM (SELECT host, labels, unnest(range(1, len(labels) + 1)) AS i FROM names)),
-- an exception beats all other rules
met AS (SELECT host, coalesce(max(CASE WHEN rule = '!' || tail THEN size - 1 END), max(size)) AS size
        FROM ends JOIN suffix_rules ON rule IN (tail, any_tail, '!' || tail) GROUP BY host),
hosts AS (SELECT host, n, k, CASE WHEN address THEN name ELSE array_to_string(labels[-(coalesce(size, 1) + 1):], '.') END AS domain,
                 CASE WHEN address THEN '' ELSE array_to_string(labels[-coalesce(size, 1):], '.') END AS suffix
          FROM names LEFT JOIN met USING (host)),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY 1, 2),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY 1),
{shrink("s", "suffixes", f"(SELECT (coalesce(sum(k), 0) + {host_reputation.FIRST_RATE}) / (coalesce(sum(n), 0) + 1) FROM suffixes)")},
{shrink("d", "domains", "(SELECT s.mean FROM s WHERE s.suffix = domains.suffix)")},
{shrink("h", "hosts", "(SELECT d.mean FROM d WHERE d.domain = hosts.domain)")},
r(v, rule) AS (VALUES {rules}),
fit AS (SELECT p.host, p.path, r.rule, r.v, row_number() OVER (PARTITION BY p.host, p.path ORDER BY length(r.rule) DESC) AS i
        FROM (SELECT DISTINCT host, path FROM p) p, r
        WHERE {fits} AND starts_with(p.path, '/' || substr(r.rule, instr(r.rule, '/') + 1)))
SELECT p.page_id, p.host, p.path, fit.rule,
       coalesce(fit.v, CASE WHEN h.mean - {host_reputation.Z} * sqrt(h.mean * (1 - h.mean) / (h.n + h.m + 1)) > {host_reputation.WORST}
                            THEN 'block' ELSE 'allow' END) AS verdict, h.n AS host_labelled, h.k AS host_bad
FROM p JOIN h ON p.host = h.host LEFT JOIN fit ON fit.i = 1 AND fit.host = p.host AND fit.path = p.path"""


register(op4_host_reputation, "op4_host_reputation", _op4_sql())


SAMPLE_KEY = "development key, replace it"  # for the sample tables only: whoever reads this can undo it


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get(pseudonyms.KEY_SETTING, SAMPLE_KEY)


def op5_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(documents(spark, sf_dir), key=pii_key(spark))


register(op5_feistel_pseudonyms, "op5_feistel_pseudonyms")


def op6_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbsvm.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


register(op6_nbsvm_quality, "op6_nbsvm_quality")


def op8_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


register(op8_projection_dedup, "op8_projection_dedup")


def op9_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_lattice.coded_digests(documents(spark, sf_dir).select("doc_id", "text"),
                                       public_tokenizers.path("piece_bpe_32k.model"))


register(op9_suffix_array_pieces, "op9_suffix_array_pieces")


def op10_bottomk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk_dedup.near_groups(documents(spark, sf_dir))


register(op10_bottomk_dedup, "op10_bottomk_dedup")


def op12_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.taken_words(*source_mix.mix(documents(spark, sf_dir)))


register(op12_source_schedule, "op12_source_schedule", r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                  ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(doc_id::VARCHAR, ''), coalesce(text, ''))), 1, 15))::BIGINT AS key
           FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS words FROM d GROUP BY source),
w AS (SELECT source, words, ([5, 2, 1])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM g),
-- by words per weight: if the earlier ones are at their limit, the others share the rest
f AS (SELECT *, (150 * (SELECT sum(words) FROM g)::BIGINT - 200 * coalesce(sum(words) OVER before, 0)::BIGINT)::DOUBLE
                / (100 * sum(weight) OVER rest) AS share
      FROM w WINDOW before AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    rest AS (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max(share) AS share FROM f),  -- the share grows up to the right number of them, then falls
t AS (SELECT source, words, CASE WHEN 2 * words < weight * l.share THEN (2 * words)::DOUBLE ELSE weight * l.share END AS target FROM w, l),
s AS (SELECT *, CASE WHEN words > 0 THEN floor(target)::BIGINT // words ELSE 0 END AS passes,
             CASE WHEN words > 0 THEN floor(target)::BIGINT % words ELSE 0 END AS rest FROM t),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS pos FROM d)
SELECT doc_id, size::BIGINT AS size, words AS source_size, target,
       (passes * size + greatest(0, least(pos + size, rest) - pos))::BIGINT AS taken
FROM p JOIN s ON p.source IS NOT DISTINCT FROM s.source""")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(documents(spark, sf_dir))


register(op11_source_divergence, "op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
o AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
l AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS total FROM k GROUP BY lang),
g AS (SELECT d.lang, d.source, coalesce(any_value(l.v), 0) AS v,
             coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0)::BIGINT AS total
      FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN l USING (lang) GROUP BY d.lang, d.source),
m AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n,
             1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value
         FROM m a JOIN m b USING (lang, term) WHERE a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
q AS (SELECT m.*, 1 + 1000000000 * (lang_n + 2) // (l.total + 2 * l.v) AS q FROM m JOIN l USING (lang) WHERE n > 0),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM q WHERE p > q)
SELECT lang, source, part, item, value, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 10""")


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", label))


register(op13_bond_negatives, "op13_bond_negatives", """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
      FROM r a JOIN r b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS i FROM s WHERE same QUALIFY i <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id)::INT AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3""")
