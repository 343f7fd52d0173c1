"""Exact deduplication by deterministic block naming (DataFrame operations only).

The normalised text (each run of white space becomes one space) is cut into
blocks of a fixed number of UTF-8 bytes. The distinct blocks are sorted and get
integer names; then, round by round, the distinct adjacent pairs of names are
sorted and named in turn, until each document is left with one integer. Of
documents with equally many blocks, two get the same integer if and only if
their texts are equal: names belong to contents, not to digests, so no hash
collision can merge two texts.

A 64-bit digest only carries a block to its name. The table of distinct blocks
is grouped by digest and content, so it shows whether any digest has several
contents; if one has, blocks look their names up by content instead.

Cases: null text counts as empty, and empty texts are equal; equal rows (also
with one doc_id) are one group, of which exactly one row stays; of equal texts
rows without doc_id come last; an empty table gives an empty result; only the
id and text columns are read, so other columns cannot clash; a very long text
is many blocks, handled by one more round per doubling.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import WHITE, materialise, one_of_each, release, spare_name

BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _blocks(data: Column, size: int) -> Column:
    """Consecutive slices of a binary column; an empty text has one empty block."""
    last = F.greatest(F.floor((F.length(data) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def _name(distinct: DataFrame, order: list[str]) -> DataFrame:
    """Integer names of distinct rows: sorted within their hash partition and
    numbered partition by partition."""
    return distinct.sortWithinPartitions(*order).withColumn("name", F.monotonically_increasing_id())


def name_texts(df: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES,
               digest: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """All columns of `df` but the text, plus _sha (SHA-256 of the normalised
    text, lowercase hex), and (_blocks, _name): equal if and only if the
    normalised texts are. `digest` only speeds up the block look-up."""
    data = F.encode(normalised(F.col(f"`{text}`")), "UTF-8")
    src = df.withColumn("_data", data).withColumn("_b", _blocks(F.col("_data"), block_bytes))

    # names of the distinct blocks; the contents themselves are not written
    flat = src.select(F.explode("_b").alias("block")).select(digest(F.col("block")).alias("digest"), "block")
    distinct = flat.groupBy("digest", "block").agg(F.count("*").alias("n"))
    names = materialise(_name(distinct, ["block"]).select("digest", "name"), "naming-blocks")
    carry = ["digest"]
    if not names.groupBy("digest").count().where("count > 1").isEmpty():
        release(df.sparkSession, names)
        names = materialise(_name(distinct, ["block"]).select("digest", "block", "name"), "naming-blocks")
        carry = ["digest", "block"]

    kept = [c for c in df.columns if c != text]

    def part(b: Column) -> Column:
        return F.struct(digest(b).alias("digest"), *([b.alias("block")] if "block" in carry else []))

    docs = materialise(src.select(
        F.monotonically_increasing_id().alias("_rid"), *[F.col(f"`{c}`") for c in kept],
        F.sha2(F.col("_data"), 256).alias("_sha"), F.size("_b").alias("_blocks"),
        F.transform("_b", part).alias("_parts")), "naming-docs")

    parts = docs.select("_rid", "_blocks", F.posexplode("_parts").alias("pos", "part")).select("_rid", "_blocks", "pos", "part.*")
    state = materialise(parts.join(names, carry).select("_rid", "_blocks", "pos", "name"), "naming-state")
    most = state.agg(F.max("_blocks")).first()[0] or 1
    done, left, width = [], state, 1
    while width < most:
        done.append(left.where(f"_blocks <= {width}"))
        pairs = (left.where(f"_blocks > {width}")
                 .groupBy("_rid", "_blocks", F.shiftright("pos", 1).alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("l"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r")))
        pairs = materialise(pairs, "naming-pairs")
        named = materialise(_name(pairs.groupBy("l", "r").agg(F.count("*").alias("n")), ["l", "r"])
                            .select("l", "r", "name"), "naming-names")
        left = materialise(pairs.join(named, ["l", "r"]).select("_rid", "_blocks", "pos", "name"), "naming-state")
        release(df.sparkSession, pairs, named)
        width *= 2
    done.append(left)
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return docs.drop("_parts", "_blocks").join(result.select("_rid", "_blocks", F.col("name").alias("_name")), "_rid")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. Of
    equal texts the row with the least id stays (of those with one id, one)."""
    named = name_texts(df.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text}`").alias(text)), text, **options)
    order = F.struct(F.col(id_col).isNull().alias("a"), F.col(id_col).alias("b"), F.col("_rid").alias("c"))
    groups = named.groupBy("_blocks", "_name").agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
    return (named.join(groups, ["_blocks", "_name"])
            .select(id_col, F.col("_first.b").alias("keep_id"), "group_size",
                    (F.col("_rid") == F.col("_first.c")).alias("kept"), F.col("_sha").alias("text_sha256")))


def keep_first(df: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df`, whole, that stay: one per group of equal normalised
    texts, the one with the least id (of several with this id, the first by its
    other columns)."""
    own, stay_id, stay_own = (spare_name(df, c) for c in ("_sha", "_stay_id", "_stay_sha"))
    stay = exact_groups(df, id_col, text, **options).where("kept").select(
        F.col(id_col).alias(stay_id), F.col("text_sha256").alias(stay_own))
    sha = F.sha2(F.encode(normalised(F.col(f"`{text}`")), "UTF-8"), 256)
    rows = df.withColumn(own, sha).join(
        stay, F.col(f"`{id_col}`").eqNullSafe(F.col(stay_id)) & (F.col(own) == F.col(stay_own)), "left_semi")
    return one_of_each(rows, [id_col, own], text).drop(own)
