"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut by the vocabulary's split pattern; inside each part the adjacent
pair with the lowest merge rank is popped from a heap, again and again, and
joined in a doubly linked list. A part's count is its bytes minus its merges;
no identifier is ever made. Counts of parts are memoised per worker (bounded),
as words repeat.

Cases: null text counts as empty (0 bytes, 0 tokens); a special token's string
inside a text is one token, as the library's default has it; a very long part
costs n log n; repeated rows each keep their row; extra columns are kept.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.llm.common import Cache, add_columns


def _byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary:
    printable Latin-1 stands for itself, the rest is numbered from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(c): b for b, c in [*zip(plain, plain), *((b, 256 + i) for i, b in enumerate(rest))]}


def load_merges(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Pair -> merge rank, and the special strings, of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    raw = lambda s: bytes(letters[c] for c in s)
    merges = spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    return ({(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)},
            [t["content"] for t in spec["added_tokens"]])


def merged_count(part: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left of `part` when the lowest-rank adjacent pair (the leftmost
    of equals) is merged until none can be."""
    n = len(part)
    if n < 2:
        return n
    sym: list[bytes | None] = [part[i:i + 1] for i in range(n)]
    if n == 2:
        return 1 if (sym[0], sym[1]) in ranks else 2
    prev, nxt = list(range(-1, n - 1)), list(range(1, n + 1))
    rank = ranks.get
    heap = []
    for i in range(n - 1):
        r = rank((sym[i], sym[i + 1]))
        if r is not None:
            heap.append((r, i, 2))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    left = n
    while heap:
        r, i, size = pop(heap)
        a = sym[i]
        j = nxt[i]
        if a is None or j >= n or len(a) + len(sym[j]) != size or rank((a, sym[j])) != r:
            continue  # one of the two has been merged since
        a = sym[i] = a + sym[j]
        sym[j] = None
        left -= 1
        k = nxt[i] = nxt[j]
        if k < n:
            prev[k] = i
            r = rank((a, sym[k]))
            if r is not None:
                push(heap, (r, i, len(a) + len(sym[k])))
        k = prev[i]
        if k >= 0:
            r = rank((sym[k], a))
            if r is not None:
                push(heap, (r, k, len(sym[k]) + len(a)))
    return left


_COUNTERS: dict[str, Callable[[str], int]] = {}


def counter(path: str, pattern: str) -> Callable[[str], int]:
    """text -> number of tokens, one per worker and vocabulary."""
    if path not in _COUNTERS:
        ranks, special = load_merges(path)
        memo = Cache(lambda w: merged_count(w.encode(), ranks), 600_000)
        parts = regex.compile(pattern).findall
        cut = regex.compile("|".join(map(regex.escape, special))) if special else None
        look = memo.__getitem__

        def part_count(w: str) -> int:
            return look(w) if len(w) < 64 else merged_count(w.encode(), ranks)

        def count(text: str) -> int:
            if cut and any(s in text for s in special):
                pieces = cut.split(text)
                return len(pieces) - 1 + sum(map(count, pieces))
            words = parts(text)
            if max(map(len, words), default=0) < 64:
                return sum(map(look, words))
            return sum(map(part_count, words))

        _COUNTERS[path] = count
    return _COUNTERS[path]


def count_tokens(df: DataFrame, path: str, pattern: str, text: str = "text", limit: int = 512) -> DataFrame:
    """All rows and columns of `df` but the text, plus n_bytes, n_tokens and
    over_limit (n_tokens > limit), which replace columns of the same name."""
    def make():
        count = counter(path, pattern)

        def run(texts: list[str | None]):
            texts = [t or "" for t in texts]
            return [len(t.encode()) for t in texts], [count(t) for t in texts]
        return run

    out = add_columns(df.drop("over_limit"), make, [text], {"n_bytes": "long", "n_tokens": "long"}, drop=(text,))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
