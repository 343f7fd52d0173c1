"""SentencePiece encoding and decoding by suffix-array matching.

A batch of texts is escaped as the model wants it (spaces become U+2581, one is
put in front) and cut wherever no piece holds the two neighbouring characters;
the distinct new segments are joined to one text, which is indexed by a suffix
array. Every piece of the vocabulary is binary-searched for its range of
occurrences, the ranges give the edges of the lattice, and the edges are sorted
by position in their segment and relaxed, equal positions of all segments at once.

The model is a byte-pair model, so a path is not chosen by its sum of scores:
an edge (start, piece) is relaxed if the piece can follow the piece that ends at
its start, that is if merging the two pieces' characters by score gives these
two pieces again. A position has exactly one such edge, and the path back from
the end of a segment is what merging the whole segment gives. Characters without
piece are spelt in byte pieces.

Cases: null and empty texts have no ids; runs of spaces, control characters and
unknown characters are kept; U+2581 itself decodes to a space, as in the model's
library; long texts are many segments; a segment without any space is one
lattice, linear in its length; repeated rows each keep their row; extra columns
pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame

from cinerank.llm.common import Cache, add_columns

SPACE = "▁"
_END = 0x110000  # sorts after every character and matches none
_PAIR_LIMIT = 1_500_000


class Pieces:
    """The vocabulary of a byte-pair SentencePiece model."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.text = [sp.id_to_piece(i) for i in ids]
        self.id = {self.text[i]: i for i in plain}
        self.score = {self.text[i]: sp.get_score(i) for i in plain}
        self.byte = {int(self.text[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.of_byte = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        self.hidden = {i for i in ids if sp.is_control(i)}
        self.longest = max(map(len, self.id))
        order = sorted(self.id, key=lambda p: (len(p), p))
        self.order = np.array([self.id[p] for p in order])
        self.length = np.array([len(p) for p in order])
        self.chars = np.full((len(order), self.longest), -1, np.int64)
        for row, p in zip(self.chars, order):
            row[:len(p)] = [ord(c) for c in p]
        # which characters stand side by side in any piece
        alphabet = sorted({ord(c) for p in order for c in p})
        self.number = np.zeros(_END + 1, np.int32)
        self.number[alphabet] = np.arange(1, len(alphabet) + 1)
        self.side = np.zeros((len(alphabet) + 1, len(alphabet) + 1), bool)
        for p in order:
            c = self.number[[ord(x) for x in p]]
            self.side[c[:-1], c[1:]] = True
        self.stands = np.zeros(len(self.text), bool)  # pieces that merging their own characters gives
        for i in self.order.tolist():
            self.stands[i] = len(self.merged(self.text[i])) == 1
        self.follows = Cache(self._follows, _PAIR_LIMIT)

    def _follows(self, key: int) -> bool:
        """Whether merging the characters of a pair of pieces gives the pair."""
        a, b = divmod(key, len(self.text))
        a, b = self.text[a], self.text[b]
        return self.merged(a + b) == [a, b]

    def pairs_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, inv = np.unique(left * len(self.text) + right, return_inverse=True)
        return np.fromiter(map(self.follows.__getitem__, keys.tolist()), bool, len(keys))[inv]

    def merged(self, s: str) -> list[str]:
        """Merge neighbours of a short string by best score, the leftmost of equals."""
        score, low = self.score.get, -np.inf
        sym = list(s)
        val = [score(a + b, low) for a, b in zip(sym, sym[1:])]
        while val:
            best = max(val)
            if best == low:
                break
            i = val.index(best)
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
            del val[i]
            if i:
                val[i - 1] = score(sym[i - 1] + sym[i], low)
            if i < len(val):
                val[i] = score(sym[i] + sym[i + 1], low)
        return sym


def suffix_array(chars: np.ndarray, depth: int) -> np.ndarray:
    """Positions of `chars` in the order of their next `depth` characters at
    least (prefix doubling from packed triples of characters)."""
    n = len(chars)
    pad = np.concatenate([chars, np.full(3, _END)]).astype(np.int64)
    key = (pad[:n] << 42) | (pad[1:n + 1] << 21) | pad[2:n + 2]
    known = 3
    while True:
        order = np.argsort(key, kind="stable")
        if known >= depth:
            return order
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
        after = np.full(n, rank.max() + 1 if n else 0)
        after[:max(n - known, 0)] = rank[known:]
        key = rank * (int(n) + 2) + after
        known *= 2


def occurrences(chars: np.ndarray, order: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """For every piece the range of suffixes that start with it."""
    n = len(chars)
    pad = np.concatenate([chars, np.full(pieces.longest + 1, _END)]).astype(np.int64)

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(pieces.order), np.int64), np.full(len(pieces.order), n)
        while True:
            act = np.flatnonzero(lo < hi)
            if not len(act):
                return lo
            mid = (lo[act] + hi[act]) // 2
            start = order[mid]
            sign = np.zeros(len(act), np.int8)  # of suffix against piece
            todo = np.arange(len(act))
            for j in range(pieces.longest):
                want = pieces.chars[act[todo], j]
                todo, want = todo[want >= 0], want[want >= 0]
                if not len(todo):
                    break
                d = np.sign(pad[start[todo] + j] - want)
                sign[todo] = d
                todo = todo[d == 0]
            right = sign <= 0 if upper else sign < 0
            lo[act[right]] = mid[right] + 1
            hi[act[~right]] = mid[~right]

    return bound(False), bound(True)


def relax(segments: list[str], pieces: Pieces) -> list[np.ndarray]:
    """Ids of each segment: edges by suffix array, sorted by position, relaxed."""
    sizes = np.array([len(s) for s in segments])
    starts = np.cumsum(sizes + 1) - sizes - 1
    codes = np.frombuffer("\n".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes[starts + sizes] = _END
    order = suffix_array(codes, pieces.longest)
    lo, hi = occurrences(codes, order, pieces)
    count = np.where(pieces.stands[pieces.order], hi - lo, 0)
    which = np.repeat(np.arange(len(count)), count)
    at = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
    single = np.zeros(len(codes), bool)
    single[at[pieces.length[which] == 1]] = True
    lone = np.flatnonzero(~single & (codes != _END))  # characters without piece
    ends = np.concatenate([at + pieces.length[which], lone + 1])
    at = np.concatenate([at, lone])
    ids = np.concatenate([pieces.order[which], np.full(len(lone), -1)])
    step = ends - starts[np.searchsorted(starts, at, side="right") - 1]
    line = np.argsort(step, kind="stable")
    at, ends, ids, step = at[line], ends[line], ids[line], step[line]
    last = np.full(len(codes) + 1, -2)  # id of the edge that reaches a position, -1 a start or lone character
    back = np.zeros(len(codes) + 1, np.int64)
    last[starts] = -1
    cuts = np.flatnonzero(np.diff(step, prepend=-1, append=-1))
    for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        p = last[at[x:y]]
        keep = x + np.flatnonzero(p > -2)
        p, i = p[keep - x], ids[keep]
        ok = (p < 0) | (i < 0)
        ask = np.flatnonzero(~ok)
        ok[ask] = pieces.pairs_follow(p[ask], i[ask])
        keep = keep[ok]
        last[ends[keep]], back[ends[keep]] = ids[keep], at[keep]

    where, segs, tokens = starts + sizes, np.arange(len(segments)), []
    while len(segs):  # back from the ends, all segments at once
        tokens.append((segs, last[where], where))
        where = back[where]
        on = where > starts[segs]
        where, segs = where[on], segs[on]
    if not tokens:
        return []
    seg, ids, where = (np.concatenate([t[j] for t in tokens][::-1]) for j in range(3))
    line = np.argsort(seg, kind="stable")
    seg, ids, where = seg[line], ids[line], where[line]
    bounds = np.searchsorted(seg, np.arange(len(segments) + 1))
    flat = ids.astype(np.uint32)
    out = [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    for k in np.unique(seg[ids < 0]).tolist():
        path: list[int] = []
        for i, e in zip(ids[bounds[k]:bounds[k + 1]].tolist(), where[bounds[k]:bounds[k + 1]].tolist()):
            raw = chr(codes[e - 1]).encode("utf-8", "replace") if i < 0 else b""
            path += [pieces.byte.get(b, pieces.unknown) for b in raw] if pieces.byte and i < 0 else [pieces.unknown if i < 0 else i]
        out[k] = np.array(path, np.uint32)
    return out


class Codec:
    """Encoder and decoder of a worker; segments are memoised (bounded)."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.memo: dict[str, bytes] = {}
        self.limit = 600_000
        p = self.pieces
        self.plain = [t.replace(SPACE, " ") for t in p.text]

    def _segments(self, texts: list[str | None]) -> tuple[list[str], list[int]]:
        """Segments of all texts, and for each text the number of those before it."""
        escaped = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(escaped)
        begin = np.cumsum([0] + [len(t) for t in escaped])
        number = self.pieces.number[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        cut = np.ones(len(joined) + 1, bool)
        if joined:
            cut[1:-1] = ~self.pieces.side[number[:-1], number[1:]]
        cut[begin] = True
        bounds = np.flatnonzero(cut)
        at = bounds.tolist() if joined else [0]
        return [joined[a:b] for a, b in zip(at, at[1:])], np.searchsorted(bounds, begin).tolist()

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids per text, as unsigned 32-bit numbers."""
        out: list[np.ndarray] = []
        todo: list[str | None] = []
        size = 0
        for k, t in enumerate(texts):  # a few million characters at a time
            todo.append(t)
            size += len(t or "")
            if size > 4_000_000 or k == len(texts) - 1:
                out += self._encode(todo)
                todo, size = [], 0
        return out

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        segs, at = self._segments(texts)
        memo = self.memo
        if len(memo) > self.limit:
            memo.clear()
        new = list(set(segs) - memo.keys())
        while new:  # index about a million characters at a time
            size, k = 0, 0
            while k < len(new) and (not k or size + len(new[k]) < 1_000_000):
                size += len(new[k]) + 1
                k += 1
            part, new = new[:k], new[k:]
            memo.update(zip(part, map(np.ndarray.tobytes, relax(part, self.pieces))))
        look = memo.__getitem__
        return [np.frombuffer(b"".join(map(look, segs[a:b])), np.uint32) for a, b in zip(at, at[1:])]

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids; broken UTF-8 in byte pieces gives
        U+FFFD per byte, control ids give nothing."""
        p = self.pieces
        ids = [i for i in ids.tolist() if i not in p.hidden] if p.hidden & set(ids[:1].tolist() + ids[-1:].tolist()) else ids.tolist()
        out: list[str] = []
        if p.of_byte and ids and not p.of_byte.keys().isdisjoint(ids):
            raw = bytearray()
            for i in ids:
                if i in p.of_byte:
                    raw.append(p.of_byte[i])
                else:
                    if raw:
                        out.append(_utf8(bytes(raw)))
                        raw.clear()
                    out.append(self.plain[i])
            if raw:
                out.append(_utf8(bytes(raw)))
        else:
            out = list(map(self.plain.__getitem__, ids))
        text = "".join(out)
        return text[1:] if ids and self.plain[ids[0]].startswith(" ") else text


def _utf8(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[:e.start].decode() + "�")
            raw = raw[e.start + 1:]
    return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def _batched(path: str, fn: Callable):
    def make():
        c = codec(path)
        return lambda values: fn(c, values)
    return make


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All rows and columns plus the array of ids."""
    return add_columns(df, _batched(path, lambda c, t: ([x.astype(np.int32) for x in c.encode(t)],)), [text], {ids: "array<int>"})


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """All rows and columns plus the text of the ids (null ids: empty)."""
    return add_columns(df, _batched(path, lambda c, v: ([c.decode(np.array(x or [], np.int64)) for x in v],)), [ids], {text: "string"})


def coded_digests(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """All rows and columns but the text, plus n_ids, ids_crc32 (unsigned, over
    little-endian unsigned 32-bit ids), n_chars_decoded, decoded_crc32 (UTF-8)
    and round_trip (the decoded text is the text)."""
    def run(c: Codec, texts: list[str | None]):
        n, crc, chars, dec, same = [], [], [], [], []
        for t, x in zip(texts, c.encode(texts)):
            back = c.decode(x)
            n.append(len(x))
            crc.append(zlib.crc32(x.tobytes()))
            chars.append(len(back))
            dec.append(zlib.crc32(back.encode("utf-8", "replace")))
            same.append(back == (t or ""))
        return n, crc, chars, dec, same

    return add_columns(df, _batched(path, run), [text], {
        "n_ids": "long", "ids_crc32": "long", "n_chars_decoded": "long", "decoded_crc32": "long", "round_trip": "boolean"}, drop=(text,))
