"""Lexical retrieval packing: windows filled by BM25 neighbours.

Documents are turned to token ids and an end id. Whole windows of a long
document are sequences of their own; what is left (shorter than a window) is
packed. The remainders are laid out by a lexical key (their two heaviest terms;
a token's place in the vocabulary, where frequent merges come first, stands for
its rarity), so that similar ones lie in one shard; a hash of the document
breaks ties, so a crowded key is split over shards. Each shard, of bounded size, holds a BM25
inverted index over token ids with corpus-wide document frequencies and lengths.
The next unused remainder is a window's seed; its unused neighbours, best first,
fill the window, the last one is cut and its rest stays in the index. What does
not fill a window at the end of a shard goes on to the next; at the end of a
task it is cut into sequences whose lengths are powers of two, so nothing is
padded.

The corpus statistics are one number per vocabulary entry, so they have a fixed
bound. Token ids are made once and written to shared storage.

Cases: null and empty texts are just the end id; a document longer than a window
is cut; repeated rows are packed each on its own; rows without doc_id too; extra
columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from tokenizers import Tokenizer

from cinerank.llm.common import SLICE, materialise

WINDOW, SHARD_PARTS, SHARD_TOKENS = 2048, 768, 1 << 19
K1, B = 1.2, 0.75


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE vocabulary in both public forms (the same ids)."""
    json_path: str
    ranks_path: str
    pattern: str
    end_id: int = 1


_ENCODERS: dict[Vocabulary, Callable[[str], bytes]] = {}  # per worker


def encoder(v: Vocabulary, kind: str) -> Callable[[str], bytes]:
    """text -> its ids as little-endian 16-bit numbers (32-bit for vocabularies
    over 65536), without the end id.

    The merge ranks give the ids; texts with special strings, or with very long
    stretches without a space (where merging by ranks is quadratic), go through
    the tokenizers library. Where no two white-space characters follow each
    other, the split pattern needs no look-ahead, which makes it much faster.
    """
    if v not in _ENCODERS:
        slow: list[Tokenizer] = []  # loaded by the first text that needs it
        with open(v.json_path, encoding="utf-8") as f:
            special = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(v.ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        split = lambda name, pattern: tiktoken.Encoding(
            name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        whole, plain = split("whole", v.pattern), split("plain", v.pattern.replace(r"|\s+(?!\S)", ""))

        def library(text: str) -> list[int]:
            if not slow:
                slow.append(Tokenizer.from_file(v.json_path))
            return slow[0].encode(text, add_special_tokens=False).ids

        def run(text: str) -> bytes:
            odd = any(s in text for s in special) or any(
                " " not in text[i:i + _STRETCH] or text[i:i + _STRETCH].isspace()
                for i in range(0, len(text) - _STRETCH + 1, _STRETCH))
            if odd:
                ids = library(text)
            else:
                runs = any(p in text for p in _PAIRS) or any(c in text for c in _OTHER)
                ids = whole(text) if runs else plain(text)
            return np.array(ids, kind).tobytes()

        _ENCODERS[v] = run
    return _ENCODERS[v]


_PAIRS = ("  ", "\n\n", " \n", "\n ")
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_STRETCH = 1000  # a stretch of twice this length has one of the aligned slices inside


def _tokenised(v: Vocabulary, size: int, kind: str, window: int):
    """Windows and remainders of documents (these with their lexical key), and
    one row of document frequencies per task."""
    names = ["kind", "doc_id", "start", "doc_tokens", "ids", "t1", "t2", "terms", "counts"]
    types = [pa.int32(), None, pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int32()),
             pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(v, kind)
        wide = np.dtype(kind).itemsize
        end = np.array([v.end_id], kind).tobytes()
        freq, n_docs, n_tokens, id_kind = np.zeros(size, np.int64), 0, 0, pa.int64()
        rarity = np.log(np.arange(size) + 2.0)

        def table(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t or id_kind) for c, t in zip(cols, types)], names=names)

        for b in batches:
            id_kind = b.column(0).type
            rows, held = [], 0
            slices = (b.slice(k, SLICE) for k in range(0, b.num_rows, SLICE))
            for doc, text in ((d, t) for x in slices for d, t in zip(x.column(0).to_pylist(), x.column(1).to_pylist())):
                data = encode(text or "") + end
                ids = np.frombuffer(data, kind)
                n = len(ids)
                n_docs += 1
                n_tokens += n
                tail = n - n % window
                t, tf = np.unique(ids[tail:], return_counts=True)
                freq[t if not tail else np.unique(ids)] += 1
                for s in range(0, tail, window):
                    rows.append((1, doc, s, n, data[s * wide:(s + window) * wide], None, None, None, None))
                if tail < n:
                    top = np.argsort(-tf * rarity[t], kind="stable")
                    rows.append((0, doc, tail, n, data[tail * wide:], int(t[top[0]]), int(t[top[:2][-1]]), None, None))
                held += len(data)
                if held > 8_000_000:
                    yield table(rows)
                    rows, held = [], 0
            yield table(rows)
        if n_docs:
            t = np.flatnonzero(freq)
            yield table([(2, None, n_docs, n_tokens, None, None, None, t.tolist(), freq[t].tolist())])
    return run


class Shard:
    """BM25 inverted index over the token ids of remainders, used up by packing."""

    def __init__(self, parts: list[np.ndarray], idf: np.ndarray, mean: float):
        n = np.array([len(p) for p in parts])
        ids = np.concatenate(parts)
        kind = np.int32 if (int(ids.max()) + 1) * len(parts) < 2**31 else np.int64  # small numbers sort faster
        pair = np.sort(ids.astype(kind) * kind(len(parts)) + np.repeat(np.arange(len(parts), dtype=kind), n))
        at = np.flatnonzero(np.diff(pair, prepend=-1))
        tf = np.diff(np.append(at, len(pair)))
        pair = pair[at].astype(np.int64)
        term, self.doc = np.divmod(pair, len(parts))
        self.terms, self.first = np.unique(term, return_index=True)  # postings of a term: first[t] .. first[t + 1]
        self.first = np.append(self.first, len(term))
        scale = tf + K1 * (1 - B + B * n[self.doc] / mean)
        self.impact = idf[term] * tf * (K1 + 1) / scale
        self.of_doc = np.argsort(self.doc, kind="stable")  # postings in document order, to read a document's terms
        self.at = np.searchsorted(self.doc[self.of_doc], np.arange(len(parts) + 1))
        self.row = np.searchsorted(self.terms, term)
        self.n = len(parts)

    def neighbours(self, seed: int) -> np.ndarray:
        """All parts by falling BM25 score for the terms of `seed`, ties by place."""
        rows = self.row[self.of_doc[self.at[seed]:self.at[seed + 1]]]
        lo, count = self.first[rows], self.first[rows + 1] - self.first[rows]
        where = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count - lo, count)
        score = np.bincount(self.doc[where], self.impact[where], self.n)
        return np.argsort(-score, kind="stable")


def pack_shard(parts: list[tuple], idf: np.ndarray, mean: float, window: int) -> tuple[list[list[tuple]], list[tuple]]:
    """(full windows, rest) of parts (doc, start, doc_tokens, ids): every window
    is a list of such parts with `window` ids together; the rest is shorter."""
    if sum(len(p[3]) for p in parts) < window:
        return [], parts
    index = Shard([p[3] for p in parts], idf, mean)
    left = list(parts)
    open_ = np.ones(len(parts), bool)
    windows: list[list[tuple]] = []
    seed = 0
    while seed < len(parts):
        if not open_[seed]:
            seed += 1
            continue
        now, room = [], window
        order = index.neighbours(seed)
        order = np.concatenate([[seed], order[order != seed]])
        for i in order[open_[order]].tolist():
            doc, start, n, ids = left[i]
            now.append((doc, start, n, ids[:room]))
            if len(ids) > room:
                left[i] = (doc, start + room, n, ids[room:])
                room = 0
            else:
                open_[i] = False
                room -= len(ids)
            if not room:
                break
        if room:
            return windows, now
        windows.append(now)
    return windows, []


def _packed(idf: np.ndarray, mean: float, window: int, kind: str, id_kind, shard_parts: int, shard_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        made = 0
        held: list[tuple] = []
        tokens = 0

        def rows(sequences: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for seq in sequences:
                offset = 0
                for doc, start, n, ids in seq:
                    for c, x in zip(cols, (doc, start, len(ids), n, ids.astype("<u4").tobytes(), ((task << 31) + made) * 2, offset)):
                        c.append(x)
                    offset += len(ids)
                made += 1
            types = [id_kind, pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=_PIECE)

        for b in batches:
            for doc, start, n, data in zip(*(b.column(j).to_pylist() for j in range(4))):
                ids = np.frombuffer(data, kind)
                held.append((doc, start, n, ids))
                tokens += len(ids)
                if len(held) >= shard_parts or tokens >= shard_tokens:
                    done, held = pack_shard(held, idf, mean, window)
                    tokens = sum(len(p[3]) for p in held)
                    yield rows(done)
        if held:
            done, held = pack_shard(held, idf, mean, window)
            yield rows(done)
        yield rows(_powers(held))
    return run


_PIECE = ["doc_id", "start", "length", "doc_tokens", "ids", "sequence_id", "offset"]


def _powers(parts: list[tuple]) -> list[list[tuple]]:
    """The parts cut into sequences whose lengths are powers of two, longest first."""
    left = sum(len(p[3]) for p in parts)
    out, parts = [], list(parts)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        now = []
        while room:
            doc, start, n, ids = parts.pop(0)
            now.append((doc, start, n, ids[:room]))
            if len(ids) > room:
                parts.insert(0, (doc, start + room, n, ids[room:]))
            room -= len(now[-1][3])
        out.append(now)
    return out


def pack(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text: str = "text", window: int = WINDOW,
         shard_parts: int = SHARD_PARTS, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian
    unsigned 32-bit numbers), sequence_id, offset."""
    spark = df.sparkSession
    size = Tokenizer.from_file(vocabulary.json_path).get_vocab_size()
    kind = "<u2" if size <= 65536 else "<u4"
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    id_sql = src.schema["doc_id"].dataType.simpleString()
    made = materialise(src.mapInArrow(
        _tokenised(vocabulary, size, kind, window),
        f"kind int, doc_id {id_sql}, start long, doc_tokens long, ids binary, t1 int, t2 int, "
        "terms array<int>, counts array<long>"), "pack-ids", codec="zstd")

    # corpus statistics: at most one row per vocabulary entry reaches the driver
    stats = made.where("kind = 2")
    total = stats.agg(F.sum("start").alias("docs"), F.sum("doc_tokens").alias("tokens")).first()
    freq = np.zeros(size)
    for r in (stats.select(F.explode(F.arrays_zip("terms", "counts")).alias("z")).groupBy("z.terms")
              .agg(F.sum("z.counts").alias("n")).collect()):
        freq[r["terms"]] = r["n"]
    docs, mean = total["docs"] or 0, (total["tokens"] or 1) / max(total["docs"] or 1, 1)
    idf = np.log(1 + (docs - freq + 0.5) / (freq + 0.5))

    full = (made.where("kind = 1").withColumn("sequence_id", F.monotonically_increasing_id() * 2 + 1)
            .select("doc_id", "start", F.lit(window).cast("long").alias("length"), "doc_tokens", "ids", "sequence_id",
                    F.lit(0).cast("long").alias("offset")))
    if kind != "<u4":
        full = full.mapInArrow(_widened(kind), full.schema)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["t1", "t2", F.xxhash64("ids"), "doc_id", "start"]
    laid = made.where("kind = 0").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    packed = laid.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(
        _packed(idf, mean, window, kind, to_arrow_type(src.schema["doc_id"].dataType), shard_parts, shard_tokens), full.schema)
    return full.union(packed)


def _widened(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index("ids")
            wide = [np.frombuffer(x, kind).astype("<u4").tobytes() for x in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.field(at), pa.array(wide, pa.binary()))
    return run
