"""Mixing sources to target weights with a low-discrepancy source schedule
(DataFrame operations only).

Targets. Sources in code-point order (a null source last) take the weights of a
cycle in turn and share `percent` of all words; a target stops at `repeats` times
the words of its source, and the excess is shared again by weight until no target
is above. Every round is one aggregate over the table of sources.

Blocks. The documents of a source are shuffled by a keyed digest and laid end to
end; this stream is cut into blocks of equally many words (the last is shorter).
A source needs n slots: one per block of each whole pass over its stream, then
blocks up to its target; the last one is cut so that the target, rounded down, is
met to the word.

Schedule. The slots of all sources are laid out as n consecutive cells per source,
the cumulative weights, in a grid of 2**bits cells. The van der Corput sequence (bit
reversal) visits every cell once, so a source gets exactly its slots and any prefix
of the schedule holds each source's share to within about `bits` slots. The rank of
a slot among its source's is counted in closed form: the k-th point has been
preceded, per set bit of k, by one arithmetic progression of cells. So no source's
slots are ever sorted, whatever share of all slots it has. Slot of rank r reads
block r mod blocks; the first pass over a source ends before the second begins.

Hot sources are split throughout: documents are grouped by (source, hash range),
slots are dealt by chunk, and the join key is (source, block).

Cases: null text and a text without words have size 0 and take 0; a null or repeated
doc_id is a row like any other; equal rows of one source are interchangeable; a
source without words has target 0; an empty table gives an empty result; a very
long text spans many blocks; other columns are not read. The result depends on the
rows only, not on their order or partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.llm.common import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
PERCENT = 150  # words of the mix, of all words
REPEATS = 2  # a target is at most so many times its source
BLOCK = 1024  # words of a block
ROWS_PER_RANGE = 8192  # documents whose positions one sorted group counts
CHUNK = 4096  # slots made from one row


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(WORD))).cast("long")


def shuffle_key(seed: str, id_col: Column, text: Column) -> Column:
    """60 bits of an MD5 of seed, id and text; SQL gives the same number."""
    key = F.concat_ws("|", F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("")), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.encode(key, "UTF-8")), 1, 15), 16, 10).cast("long")


def document_sizes(df: DataFrame, seed: str, id_col: str, text: str, source: str) -> DataFrame:
    t, s = F.col(f"`{text}`"), F.col(f"`{source}`")
    return df.select(F.col(f"`{id_col}`").alias("doc"), s.isNull().alias("no_source"), F.coalesce(s, F.lit("")).alias("source"),
                     word_count(t).alias("size"), shuffle_key(seed, F.col(f"`{id_col}`"), t).alias("key"))


def running(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of all earlier sources. `part` numbers
    sorted ranges of sources; only the sums per range meet in one task."""
    before = df.groupBy("part").agg(F.sum(value).alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy("no_source", "source").rowsBetween(Window.unboundedPreceding, -1)
    total = F.col("before") + F.coalesce(F.sum(value).over(inside), F.lit(0))
    return df.join(before, "part").withColumn(name, total.cast("long")).drop("before")


def with_targets(sources: DataFrame, percent: int, repeats: int) -> DataFrame:
    """Adds `target` (double). Shares grow from round to round, so a source once
    at its limit stays there, and the rounds end."""
    total = sources.agg(F.sum("words")).first()[0] or 0
    limit, over, held, share = F.col("words") * repeats, F.lit(False), -1, 0.0
    while True:
        row = sources.agg(F.count(F.when(over, 1)), F.sum(F.when(over, F.col("words"))),
                          F.sum(F.when(~over, F.col("weight")))).first()
        if row[0] == held or not row[2]:
            return sources.withColumn("target", F.when(over, limit.cast("double")).otherwise(F.col("weight") * F.lit(share)))
        held, share = row[0], (percent * total - 100 * repeats * (row[1] or 0)) / (100 * row[2])
        over = limit < F.col("weight") * F.lit(share)


def reversed_bits(number: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(number), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def slot_rank(cell: Column, first: Column, end: Column, bits: int) -> Column:
    """How many cells of [first, end) the van der Corput sequence of 2**bits points
    visits before `cell`. For each set bit b of the cell, one run of earlier points
    visits exactly the cells that equal the cell's lower b bits modulo 2**(b + 1)."""
    rank = F.lit(0).cast("long")
    for b in range(bits):
        low, step = cell.bitwiseAND(F.lit((1 << b) - 1)), 1 << (b + 1)
        visited = F.shiftright(end - low + (step - 1), b + 1) - F.shiftright(first - low + (step - 1), b + 1)
        rank = rank + F.when(cell.bitwiseAND(F.lit(1 << b)) != 0, visited).otherwise(0)
    return rank


def schedule(sources: DataFrame, bits: int, chunk: int = CHUNK) -> DataFrame:
    """All slots: (slot, no, pass, block, upto): the place in the schedule, the
    source's number, which block of its stream is read in which pass, and the word
    of the stream where this pass ends."""
    chunks = sources.where("slots > 0").select(
        "no", "words", "blocks", "passes", "rest", "slots", "first",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / chunk))).alias("chunk")).repartition("no", "chunk")
    start = F.col("first") + F.col("chunk") * chunk
    end = F.least(start + chunk, F.col("first") + F.col("slots"))
    cells = chunks.withColumn("cell", F.explode(F.sequence(start, end - 1)))
    rank = slot_rank(F.col("cell"), F.col("first"), F.col("first") + F.col("slots"), bits)
    ranked = cells.withColumn("rank", rank).withColumn("pass", F.floor(F.col("rank") / F.col("blocks")))
    return ranked.select(reversed_bits(F.col("cell"), bits).alias("slot"), "no", "pass",
                         (F.col("rank") - F.col("pass") * F.col("blocks")).alias("block"),
                         F.when(F.col("pass") == F.col("passes"), F.col("rest")).otherwise(F.col("words")).alias("upto"))


def mix(df: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, repeats: int = REPEATS, block: int = BLOCK,
        seed: str = "mix", rows_per_range: int = ROWS_PER_RANGE) -> tuple[DataFrame, DataFrame]:
    """(documents, mix). Documents: one row per row of `df` with (no, range, nth),
    its key, doc, source, size, source_size, target. Mix: the pieces in schedule
    order, (slot, pass, no, range, nth, doc, source, begin, length): `length` words of
    the document from word `begin`; sorting by (slot, at) gives the mixed stream."""
    sized = materialise(document_sizes(df, seed, id_col, text, source), "mix-sizes")
    split = max(0, (sized.count() // rows_per_range).bit_length())
    sized = sized.withColumn("range", F.shiftright("key", 60 - split))
    by = ["no_source", "source"]
    ranges = sized.groupBy(*by, "range").agg(F.sum("size").alias("words"))
    parts = max(1, df.sparkSession.sparkContext.defaultParallelism)
    listed = materialise(ranges.groupBy(*by).agg(F.sum("words").alias("words")).repartitionByRange(parts, *by)
                         .withColumn("part", F.spark_partition_id()), "mix-sources")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("no") % len(weights) + 1).cast("int"))
    targets = with_targets(running(listed, F.lit(1), "no").withColumn("weight", weight), percent, repeats)

    take = F.floor("target")
    passes = F.when(F.col("words") > 0, F.floor(take / F.greatest("words", F.lit(1)))).otherwise(0)
    sources = (targets.withColumn("blocks", F.ceil(F.col("words") / block)).withColumn("passes", passes.cast("long"))
               .withColumn("rest", take - F.col("passes") * F.col("words"))
               .withColumn("slots", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)))
    sources = materialise(running(sources, F.col("slots"), "first").drop("part"), "mix-targets")
    bits = max(0, (sources.agg(F.sum("slots")).first()[0] or 0) - 1).bit_length()

    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (ranges.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0))).drop("words")
              .join(sources.select(*by, "no", "words", "target"), by))
    order = Window.partitionBy(*by, "range").orderBy("key", "doc", "size")
    until = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    docs = materialise(sized.join(ranges, [*by, "range"]).select(
        "no", "range", F.row_number().over(order).alias("nth"), "doc", F.when(~F.col("no_source"), F.col("source")).alias("source"),
        "size", F.col("words").alias("source_size"), "target", (F.col("base") + until - F.col("size")).alias("pos")), "mix-docs")

    end = F.col("pos") + F.col("size")
    pieces = docs.where("size > 0").select(
        "no", "range", "nth", "doc", "source", "pos", end.alias("end"),
        F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor((end - 1) / block))).alias("block"))
    begin = F.greatest(F.col("pos"), F.col("block") * block)
    length = F.least(F.col("end"), (F.col("block") + 1) * block, F.col("upto")) - begin
    # merge: the planner takes the slots for as small as the sources they are made from
    mixed = (pieces.join(schedule(sources, bits).hint("merge"), ["no", "block"]).where(length > 0)
             .select("slot", begin.alias("at"), "pass", "no", "range", "nth", "doc", "source",
                     (begin - F.col("pos")).alias("begin"), length.alias("length")))
    return docs, mixed


def taken_words(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (its words in the mix)."""
    key = ["no", "range", "nth"]
    taken = mixed.groupBy(*key).agg(F.sum("length").alias("taken"))
    return docs.join(taken, key, "left").select(F.col("doc").alias(id_col), "size", "source_size", "target",
                                                F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
