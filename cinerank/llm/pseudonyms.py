"""Format-preserving pseudonyms for personal data by keyed Feistel networks.

Values are found by pattern and validated (Luhn digit, calendar, octets), turned
into a number of their format's domain, permuted there by a keyed Feistel network
with cycle walking, and written back in the same format: a card
number stays a valid card number with its separators, a date a valid date in
its field order, an address an address. Each permutation is a bijection, so
equal values stay linked across all documents and different ones stay apart;
whoever has the key can undo it.

Kinds: email, card (13-19 digits, Luhn), phone (ten separated digits, with or
without 1; numbers of the North American plan stay in it, those with an area code
or exchange on 0 or 1 stay such), ssn, ipv4, date (1900-2099; Y-M-D, M/D/Y or
D/M/Y, D.M.Y; a time may follow), access key (AKIA...), secret (the value of any
length assigned to a password, token or key name, up to white space, a quote, a
bracket or one of , ; : & = | or a character that is not ASCII).

Cases: null text stays null; text without such values is returned unchanged,
character by character; a number that does not validate is left alone; a value
may by chance be its own pseudonym (a permutation has fixed points), so those
are walked on once more; equal rows get equal results; a very long text, also
one without any space, takes time in proportion to its length; an empty table
gives an empty result; other columns pass through, an added column replaces one
of the same name; without a key there is an error, as a known key undoes the work.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

from cinerank.llm.common import Cache, add_columns

KEY_SETTING = "spark.cinerank.pii.key"
KINDS = ("email", "card", "phone", "ssn", "ipv4", "date", "access_key", "secret")
ROUNDS = 8
_A, _Z = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_D = "0123456789"


def feistel(value: int, size: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """A keyed permutation of range(size): an unbalanced Feistel network over
    the least power of two that holds it, walked until it lands inside."""
    width = max((size - 1).bit_length(), 2)
    lo = width // 2
    hi = width - lo

    def prf(rnd: int, x: int, bits: int) -> int:
        need = (bits + 7) // 8
        out = b""
        while len(out) < need:
            out += hashlib.blake2b(f"{tweak}|{size}|{rnd}|{x}|{len(out)}".encode(), key=key, digest_size=64).digest()
        return int.from_bytes(out[:need], "big") & ((1 << bits) - 1)

    def once(x: int) -> int:
        left, right = x >> lo, x & ((1 << lo) - 1)
        for r in (reversed(range(ROUNDS)) if inverse else range(ROUNDS)):
            if r % 2 == 0:
                left ^= prf(r, right, hi)
            else:
                right ^= prf(r, left, lo)
        return left << lo | right

    value = once(value)
    while value >= size:
        value = once(value)
    return value


def walk(value: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool] = lambda _: True,
         inverse: bool = False) -> int:
    """`feistel` restricted to the valid numbers of its range (cycle walking)."""
    value = feistel(value, size, key, tweak, inverse)
    while not valid(value):
        value = feistel(value, size, key, tweak, inverse)
    return value


def _spread(digits: str, shape: str) -> str:
    """`digits` written over the digit places of `shape`."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _only(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


_FIFTH = re.compile(r"(\d{4}([ -])\d{4}\2\d{4}\2\d{4})(\2\d{1,3})\Z", re.A)


def _card(s: str, key: bytes, inv: bool) -> str | None:
    d = _only(s)
    if not 13 <= len(d) <= 19 or not luhn(d) or len(set(d)) == 1:
        four = _FIFTH.match(s)  # a number may follow a card in four groups
        out = _card(four[1], key, inv) if four else None
        while out and luhn(_only(out + four[3])):
            out = _card(out, key, inv)
        return out and out + four[3]
    n = len(d) - 1
    lead = d[0]  # the first digit says what kind of card it is
    body = walk(int(d[1:-1]), 10 ** (n - 1), key, f"card{lead}{n}", inverse=inv)
    head = lead + str(body).zfill(n - 1)
    return _spread(head + next(c for c in _D if luhn(head + c)), s)


def _in_plan(v: int) -> bool:
    """Whether neither area code nor exchange starts with 0 or 1."""
    return v >= 2 * 10**9 and v // 10**6 % 10 >= 2


def _phone(s: str, key: bytes, inv: bool) -> str | None:
    d = _only(s)
    lead, d = d[:-10], d[-10:]
    if len(d) < 10 or lead not in ("", "1"):
        return None
    kind = _in_plan(int(d))  # numbers of the plan stay in it, others stay what they are
    out = walk(int(d), 10**10, key, "phone", lambda v: _in_plan(v) == kind, inv)
    return _spread(lead + str(out).zfill(10), s)


def _ssn_ok(v: int) -> bool:
    return 0 < v // 10**6 < 900 and v // 10**6 != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0


def _ssn(s: str, key: bytes, inv: bool) -> str | None:
    v = int(_only(s))
    return _spread(str(walk(v, 10**9, key, "ssn", _ssn_ok, inv)).zfill(9), s) if _ssn_ok(v) else None


def _public(v: int) -> bool:
    a, b = v >> 24, v >> 16 & 255
    return 0 < a < 224 and a not in (10, 127) and (a, b) not in ((192, 168), (169, 254)) and not (a == 172 and 16 <= b < 32)


def _ipv4(s: str, key: bytes, inv: bool) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in s.split(".")):
        return None
    v = int.from_bytes(bytes(parts), "big")
    kind = _public(v)  # public addresses stay public, others stay what they are
    return ".".join(map(str, walk(v, 1 << 32, key, "ip", lambda x: _public(x) == kind, inv).to_bytes(4, "big")))


_FIRST = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST


def _calendar(y: int, m: int, d: int) -> int | None:
    """Day number from 1900 on, None where there is no such day until 2099."""
    try:
        v = datetime.date(y, m, d).toordinal() - _FIRST
    except ValueError:
        return None
    return v if 0 <= v < _DAYS else None


def _date(s: str, key: bytes, inv: bool) -> str | None:
    sep = re.search(r"[-/.]", s)[0]
    f = [int(x) for x in s.split(sep)]
    of = lambda v: datetime.date.fromordinal(v + _FIRST)
    valid: Callable[[int], bool] = lambda _: True
    if f[0] > 31:
        order, v = "ymd", _calendar(*f)
    elif sep == ".":
        order, v = "dmy", _calendar(f[2], f[1], f[0])
    else:
        order, v = "mdy", _calendar(f[2], f[0], f[1])
        if v is None:  # a day above twelve tells the other order
            order, v = "dmy", _calendar(f[2], f[1], f[0])
            valid = lambda x: of(x).day > 12
    if v is None:
        return None
    out = of(walk(v, _DAYS, key, "date", valid, inv))
    got = {"y": str(out.year), "m": str(out.month), "d": str(out.day)}
    pad = min(len(x) for x in s.split(sep)) == 2
    return sep.join(got[c].zfill(2) if pad else got[c] for c in order)


def _string(s: str, key: bytes, inv: bool, tweak: str, alphabets: tuple[str, ...] = (_A, _D)) -> str:
    """Every letter and digit permuted as one number of mixed radix; letters
    keep their case, other characters their place."""
    low = [c.lower() if c in _Z else c for c in s]
    base = [next((a for a in alphabets if c in a), None) for c in low]
    size, value = 1, 0
    for c, a in zip(low, base):
        if a:
            size, value = size * len(a), value * len(a) + a.index(c)
    shape = "".join("-" if not a else a[0] if len(alphabets) > 1 else "x" for a in base)
    if size < 2:
        return s
    value = walk(value, size, key, f"{tweak}{shape}", inverse=inv)
    out = []
    for c, a in zip(reversed(s), reversed(base)):
        if a:
            value, i = divmod(value, len(a))
            c = a[i].upper() if c in _Z else a[i]
        out.append(c)
    return "".join(reversed(out))


def _email(s: str, key: bytes, inv: bool) -> str | None:
    local, _, domain = s.rpartition("@")
    labels = domain.split(".")
    return _string(local, key, inv, "local") + "@" + ".".join(
        [_string(x, key, inv, "label") for x in labels[:-1]] + labels[-1:])


def _access_key(s: str, key: bytes, inv: bool) -> str | None:
    return s[:4] + _string(s[4:].lower(), key, inv, "access", (_A + _D,)).upper()


_NAME = r"""(?:(?i:password|passwd|pwd|secret|token|api[_-]?key)["']?[ ]{0,2}[=:][ ]{0,2}["']?)"""
_NAMED = re.compile(_NAME)
_BLOCK = 256  # letters and digits permuted as one number


def _secret(s: str, key: bytes, inv: bool) -> str | None:
    """The value assigned to a password, token or key name: hexadecimal digits
    stay hexadecimal, other letters and digits stay letters and digits. A long
    value goes block by block, each under a key that depends on those before."""
    at = _NAMED.match(s).end()
    name, value = s[:at], s[at:]
    if not any(c in _D for c in value):
        return None  # a word, as in "password: required"
    how = ("hex", (_D + "abcdef",)) if set(value) <= set(_D + "abcdef") else ("secret",)
    out, chain = [], key
    for lo in range(0, len(value), _BLOCK):
        part = value[lo:lo + _BLOCK]
        out.append(_string(part, chain, inv, *how))
        chain = hashlib.blake2b((out[-1] if inv else part).encode(), key=chain, digest_size=32).digest()
    return name + "".join(out)


# in the value of a secret; it ends on another one, or on . ! ? at the end of a sentence
_CHAR = r"[A-Za-z0-9+/_.~!@\#$%^*?-]"
_LOCAL = _A + _A.upper() + _D + "._%+-"  # what stands before the @ of an address
_DOMAIN = r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}"
_OTHERS = rf"""
    (?P<access_key>(?<![A-Za-z0-9])AKIA[A-Z0-9]{{16}}(?![A-Za-z0-9]))
  | (?P<secret>(?<![A-Za-z]){_NAME}
        (?![A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]|\d{{1,3}}(?:\.\d{{1,3}}){{3}}(?![\w.]))(?={_CHAR}*\d)
        {_CHAR}{{8,}}(?<![.!?]))
  | (?P<ipv4>(?<![\w.])\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}(?!\w|\.\d))
  | (?P<date>(?<![\w./-])(?:\d{{4}}(?P<s1>[-/.])\d{{1,2}}(?P=s1)\d{{1,2}}
        |\d{{1,2}}(?P<s2>[-/.])\d{{1,2}}(?P=s2)\d{{4}})(?!(?![Tt]\d\d)\w|[./-]\d))
  | (?P<ssn>(?<![\w-])\d{{3}}-\d{{2}}-\d{{4}}(?!\w|-\d))
  | (?P<phone>(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\w|-\d))
  | (?P<card>(?<![\w-])(?<!\d\.)(?:\d{{13,19}}|\d{{4}}(?P<s3>[ -])\d{{4}}(?P=s3)\d{{4}}(?P=s3)(?:\d{{4}}(?P=s3)\d{{1,3}}|\d{{1,7}})
        |\d{{4}}(?P<s4>[ -])\d{{6}}(?P=s4)\d{{5}})(?!\w|[.-]\d))
"""
_FIND = re.compile(rf"(?P<email>[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_%+-])?@{_DOMAIN}) | {_OTHERS}", re.X | re.A)
_AFTER_AT, _REST = re.compile(_DOMAIN, re.A), re.compile(_OTHERS, re.X | re.A)
_MAYBE = re.compile(r"[0-9@]|AKIA")
_MAKE = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ipv4": _ipv4, "date": _date,
         "access_key": _access_key, "secret": _secret}


def pseudonym(kind: str, value: str, key: bytes, inverse: bool = False) -> str | None:
    """The pseudonym of one value in its format, None if it does not validate."""
    out = _MAKE[kind](value, key, inverse)
    return _MAKE[kind](out, key, inverse) if out == value else out


def _emails(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, @, end) of what may be e-mail addresses, read outwards from each @.
    Stretches before and after two @ do not overlap, so this is linear."""
    before, at = -1, text.find("@")
    while at >= 0:
        head = text[before + 1:at]
        local = head[len(head.rstrip(_LOCAL)):].lstrip("._%+-")
        domain = _AFTER_AT.match(text, at + 1)
        if local and local[-1] != "." and domain:
            yield at - len(local), at, domain.end()
        before, at = at, text.find("@", at + 1)


def find_values(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the matches of `_FIND` in order, in time linear in
    the text however long its unbroken stretches are."""
    pos = 0
    emails = _emails(text)
    mail, other = next(emails, None), _REST.search(text)
    while mail or other:
        if mail and mail[0] < pos:  # begins inside the value before
            left = text[pos:mail[1]].lstrip("._%+-")
            mail = (mail[1] - len(left), *mail[1:]) if pos < mail[1] and left else next(emails, None)
        elif other and other.start() < pos:
            other = _REST.search(text, pos)
        elif mail and (not other or mail[0] <= other.start()):
            yield "email", mail[0], mail[2]
            pos, mail = mail[2], next(emails, None)
        else:
            yield other.lastgroup, other.start(), other.end()
            pos = other.end()


def replacer(key: bytes) -> Callable[[str | None], tuple[str | None, list[int]]]:
    """text -> (text with pseudonyms, number of values by kind)."""
    memo = Cache(lambda kv: pseudonym(*kv, key), 100_000)

    def run(text: str | None):
        found = [0] * len(KINDS)
        if text is None or not _MAYBE.search(text):
            return text, found

        out, done = [], 0
        for kind, start, end in find_values(text):
            new = memo[(kind, text[start:end])]
            if new is not None:
                found[KINDS.index(kind)] += 1
                out += [text[done:start], new]
                done = end
        return "".join(out) + text[done:] if out else text, found
    return run


def pseudonymise(df: DataFrame, key: str | None = None, text: str = "text") -> DataFrame:
    """All rows and columns with the text replaced, plus n_values and, per kind,
    n_<kind>. The key is the argument, else the session setting
    spark.cinerank.pii.key; without either this refuses to run."""
    key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pass a key, or set {KEY_SETTING}")
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()
    order = df.columns

    def make():
        one = replacer(secret)

        def run(texts):
            out = [one(t) for t in texts]
            counts = list(zip(*[f for _, f in out])) or [()] * len(KINDS)
            return [t for t, _ in out], [sum(f) for _, f in out], *counts
        return run

    added = {text: "string", "n_values": "long"} | {f"n_{k}": "long" for k in KINDS}
    out = add_columns(df, make, [text], added)
    clash = {c.lower() for c in added} - {text.lower()}
    return out.select(*[c for c in order if c.lower() not in clash], *[c for c in added if c != text])
