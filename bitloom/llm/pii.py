"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

Found and validated: e-mail addresses, payment cards (Luhn), IBANs (mod 97), US social security
numbers (valid areas), telephone numbers (North American plan, or + and 8 to 15 digits), IPv4
addresses (octets), and calendar dates in six notations. Each value is an element of a finite
domain (card payloads of n digits, days from 1900 to 2099, ...). A balanced Feistel network of ten
rounds, keyed by BLAKE2b, permutes the smallest even power of two that holds the domain, and cycle
walking stays inside it, so the pseudonym is valid, has the same format, and equal values get equal
pseudonyms in all documents:

* a date becomes one day in all notations. Days up to the 12th become such days and later ones later
  ones, so that numbers with slashes are read as day and month in the order they were;
* addresses are equal whatever their letters' case, which the pseudonym keeps place by place.

No address, date, IP address or foreign phone number stays as it is (:meth:`Permutation.move`); other kinds
have domains of 10^9 and more, where one value in that many may. A value that other numbers or words
follow is found by trying shorter readings (:func:`readings`). With the key, :func:`restore` inverts it
(days and months written without a leading zero may come back with one, and a month whose pseudonym
is May may come back shortened).

Scale: one narrow Arrow pass per row, no shuffle and no table of pseudonyms: linkage comes from the
permutation. The key is a parameter and must be kept secret in production.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pieces, tidy

KINDS = ("email", "iban", "card", "ssn", "phone", "ip", "date")
ROUNDS = 10


class Permutation:
    """A keyed permutation of range(n) for any n, by Feistel rounds and cycle walking."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, r: int, half: int, tweak: bytes, width: int) -> int:
        size = (width + 7) // 8
        h = hashlib.blake2b(bytes([r]) + half.to_bytes(size, "little") + tweak, key=self.key, digest_size=max(8, min(64, size)))
        return int.from_bytes(h.digest(), "little") & ((1 << width) - 1)

    def apply(self, x: int, n: int, tweak: str, inverse: bool = False) -> int:
        if n < 2:
            return x
        width = (max(2, (n - 1).bit_length()) + 1) // 2
        mask, t = (1 << width) - 1, f"{tweak}/{n}".encode()
        while True:
            left, right = x >> width, x & mask
            if inverse:
                for r in reversed(range(ROUNDS)):
                    left, right = right ^ self._round(r, left, t, width), left
            else:
                for r in range(ROUNDS):
                    left, right = right, left ^ self._round(r, right, t, width)
            x = left << width | right
            if x < n:
                return x

    def move(self, x: int, n: int, tweak: str, inverse: bool = False) -> int:
        """A permutation of range(n) that leaves no value in place (n > 1): a keyed step along the cycle that :meth:`apply` lays."""
        if n < 2:
            return x
        step = 1 + self._round(ROUNDS, 0, f"{tweak}/{n}/step".encode(), 64) % (n - 1)
        at = self.apply(x, n, tweak, inverse=True)
        return self.apply((at - step if inverse else at + step) % n, n, tweak)


# --- formats ------------------------------------------------------------------------------


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """``shape`` with its ASCII digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if "0" <= c <= "9" else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _walk(p: Permutation, x: int, n: int, tweak: str, inverse: bool, valid: Callable[[int], bool]) -> int:
    """Cycle walking within the valid elements of range(n)."""
    while True:
        x = p.apply(x, n, tweak, inverse)
        if valid(x):
            return x


def _card(p: Permutation, text: str, inverse: bool) -> str | None:
    d = _digits(text)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or d[0] == "0" or luhn_digit(d[:-1]) != int(d[-1]):
        return None
    n = 10 ** (len(d) - 1)
    first = n // 10
    full = lambda x: f"{x:0{len(d) - 1}d}{luhn_digit(str(x))}"
    # the next check digit stays, too: so a number that digits follow passes or fails the check with them as its pseudonym does
    fits = lambda x: x >= first and len(set(s := full(x))) > 1 and luhn_digit(s) == luhn_digit(d)
    return _refill(text, full(_walk(p, int(d[:-1]), n, "card", inverse, fits)))


#: Lengths of the IBANs of each country.
IBAN_LENGTHS = {c: int(n) for n, codes in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL "
    "24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in codes.split(",")}


def _iban(p: Permutation, text: str, inverse: bool) -> str | None:
    s = text.replace(" ", "")
    value = lambda t: int("".join(str(int(c, 36)) for c in t)) % 97
    sound = lambda t: value(t[4:] + t[:4]) == 1
    if not 15 <= len(s) <= 34 or not sound(s):
        return None
    d = _digits(s[4:])
    if not d:
        return None

    def full(x: int) -> str:
        body = _refill(s[4:], str(x).zfill(len(d)))
        return f"{s[:2]}{98 - value(body + s[:2] + '00'):02d}{body}"

    # where the country's length is less, its reading comes first and mustn't become valid
    n = IBAN_LENGTHS.get(s[:2], 34)
    out = iter(full(_walk(p, int(d), 10 ** len(d), f"iban{s[:2]}", inverse, lambda x: len(s) <= n or not sound(full(x)[:n]))))
    return "".join(c if c == " " else next(out) for c in text)


def _ssn_valid(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(p: Permutation, text: str, inverse: bool) -> str | None:
    x = int(_digits(text))
    if not _ssn_valid(x):
        return None
    return _refill(text, f"{_walk(p, x, 10**9, 'ssn', inverse, _ssn_valid):09d}")


def _nanp_valid(x: int) -> bool:
    return x >= 2 * 10**9 and x // 10**6 % 10 >= 2


def _phone(p: Permutation, text: str, inverse: bool) -> str | None:
    d = _digits(text)
    plus = text.lstrip("(").startswith("+")
    national = d[1:] if len(d) == 11 and d[0] == "1" else d
    if len(national) == 10 and (not plus or len(d) == 11) and _nanp_valid(int(national)):
        return _refill(text, d[: len(d) - 10] + str(_walk(p, int(national), 10**10, "nanp", inverse, _nanp_valid)))
    if plus and len(d) == 11 and d[0] == "1":  # not a number of the plan, and its pseudonym isn't, either
        return _refill(text, "1" + str(_walk(p, int(national), 10**10, "other", inverse, lambda x: not _nanp_valid(x))).zfill(10))
    m = re.match(r"\(?\+([0-9]{1,3})(?![0-9])", text)
    code = m[1] if m else d[:2]
    if not plus or not 8 <= len(d) <= 15 or d[0] == "0":
        return None
    rest = d[len(code) :]
    return _refill(text, code + str(p.move(int(rest), 10 ** len(rest), f"phone{code}", inverse)).zfill(len(rest)))


def _ip(p: Permutation, text: str, inverse: bool) -> str | None:
    octets = text.split(".")
    if any(int(o) > 255 or o != str(int(o)) for o in octets):
        return None
    x = p.move(int.from_bytes(bytes(map(int, octets)), "big"), 2**32, "ip", inverse)
    return ".".join(map(str, x.to_bytes(4, "big")))


FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
#: Days up to the 12th of a month, and later ones.
_DAYS = tuple([x for x in range(FIRST_DAY, LAST_DAY + 1) if (datetime.date.fromordinal(x).day > 12) == late] for late in (False, True))
#: English month names.
MONTHS = "January February March April May June July August September October November December".split()


def _date(p: Permutation, text: str, inverse: bool) -> str | None:
    parts = re.findall(r"[0-9]+|[A-Za-z]+", text)
    seps = re.split(r"[0-9]+|[A-Za-z]+", text)
    names = [i for i, x in enumerate(parts) if x[0].isalpha()]
    month = lambda x: next((i + 1 for i, n in enumerate(MONTHS) if x.lower() in (n.lower(), n[:3].lower())), 0)
    if names:
        order = "mdy" if names == [0] else "dmy"
        y, m, d = int(parts[2]), month(parts[names[0]]), int(parts[1 if order == "mdy" else 0])
    elif len(parts[0]) == 4:
        order, (y, m, d) = "ymd", map(int, parts)
    elif "/" in text and int(parts[0]) <= 12:
        order, (m, d, y) = "mdy", map(int, parts)
    else:
        order, (d, m, y) = "dmy", map(int, parts)
    try:
        x = datetime.date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= x <= LAST_DAY:
        return None
    days = _DAYS[d > 12]
    v = datetime.date.fromordinal(days[p.move(bisect.bisect_left(days, x), len(days), f"date{len(days)}", inverse)])
    name = MONTHS[v.month - 1]
    if names:
        old = parts[names[0]]
        name = name if len(old) > 3 or old.lower() == "may" and len(name) == 3 else name[:3]
        name = name.upper() if old.isupper() else name.lower() if old.islower() else name
    new = {"y": f"{v.year:04d}", "m": name if names else v.month, "d": v.day}
    out = []
    for slot, old in zip(order, parts, strict=True):
        value = new[slot]
        out.append(value if isinstance(value, str) else f"{value:02d}" if len(old) == 2 else str(value))
    return seps[0] + "".join(x + s for x, s in zip(out, seps[1:], strict=True))


def _email(p: Permutation, text: str, inverse: bool) -> str | None:
    local, _, domain = text.rpartition("@")
    x, n = 0, 1
    alphabet = {"d": "0123456789", "l": "abcdefghijklmnopqrstuvwxyz"}
    kind = ["d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "" for c in local.lower()]
    for c, k in zip(local.lower(), kind, strict=True):
        if k:
            x, n = x * len(alphabet[k]) + alphabet[k].index(c), n * len(alphabet[k])
    if n == 1:
        return None
    x = p.move(x, n, f"email@{domain.lower()}", inverse)
    out = []
    for c, k in zip(reversed(local), reversed(kind), strict=True):
        if k:
            x, r = divmod(x, len(alphabet[k]))
            c = alphabet[k][r].upper() if "A" <= c <= "Z" else alphabet[k][r]
        out.append(c)
    return "".join(reversed(out)) + "@" + domain


_MONTH = "(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")
_NUMBER = re.compile(
    r"(?<![A-Za-z0-9])(?:"
    r"(?P<iban>[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30})"
    r"|(?P<ip>(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9]))"
    r"|(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![-/.]?[0-9])"
    r"|(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?!-?[0-9])"
    r"|(?P<card>[0-9](?:[ -]?[0-9]){12,18})"
    r"|(?P<phone>\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}|(?:1[ .-])?\([2-9][0-9]{2}\)[ ]?[2-9][0-9]{2}[ .-][0-9]{4}|(?:1[ .-])?[2-9][0-9]{2}[-. ][2-9][0-9]{2}[-. ][0-9]{4})"
    r")(?![A-Za-z0-9])"
)
_WORDED = re.compile(rf"(?<![A-Za-z0-9])(?:{_MONTH}\.? [0-9]{{1,2}}, [0-9]{{4}}|[0-9]{{1,2}} {_MONTH} [0-9]{{4}})(?![A-Za-z0-9])", re.IGNORECASE | re.ASCII)
_DIGIT = re.compile("[0-9]")
_ISSUE = {"email": _email, "iban": _iban, "card": _card, "ssn": _ssn, "phone": _phone, "ip": _ip, "date": _date}


_LOCAL = re.compile(r"(?:1[ .-])?[2-9][0-9]{2}[-. ][2-9][0-9]{2}[-. ][0-9]{4}(?![0-9A-Za-z])")


def readings(kind: str, text: str) -> Iterator[str]:
    """What a candidate may be, the likeliest first: patterns take in numbers and words that follow a value.

    An IBAN has its country's length; a number after +1 has ten digits and others 15 at most; a card is the longest
    one that ends where a group ends (the groups before its last one have four digits or more).
    Layout and check digits decide, both of which pseudonyms keep, so they are read as the value was.
    """
    if kind == "iban":
        ends = [i + 1 for i, c in enumerate(text) if c != " "]
        n = IBAN_LENGTHS.get(text[:2])
        if n and n < len(ends) and text[ends[n - 1]] == " ":
            yield text[: ends[n - 1]]
    elif kind == "phone" and text[0] == "+":
        cuts = {len(_digits(text[:i])): i for i in range(1, len(text)) if text[i] in " .-" and text[i - 1] not in " .-"}
        if text[1] == "1" and 11 in cuts:
            yield text[: cuts[11]]
        elif len(_digits(text)) > 15:
            yield from (text[: cuts[n]] for n in sorted(cuts, reverse=True) if 8 <= n <= 15)
    yield text
    if kind == "card":
        for i in range(len(text) - 1, 12, -1):
            if text[i] in " -" and all(len(g) >= 4 for g in re.split("[ -]", text[:i])[:-1]):
                yield text[:i]


def find(text: str, p: Permutation, inverse: bool = False) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) of validated values, left to right, not overlapping; kinds in order of KINDS at one start."""
    got: list[tuple[int, int, str, str]] = []
    if "@" in text:
        for m in _AT.finditer(text):
            new = _email(p, m[0], inverse)
            if new is not None:
                got.append((m.start(), m.end(), "email", new))
    if _DIGIT.search(text):
        at = 0
        while m := _NUMBER.search(text, at):
            at = m.end()
            kind = m.lastgroup
            if kind == "card" and (q := _LOCAL.match(text, m.start())):
                # no card is written in these groups
                new = _phone(p, q[0], inverse)
                if new is not None:
                    got.append((q.start(), q.end(), "phone", new))
                    at = q.end()
                    continue
            for value in readings(kind, m[0]):
                new = _ISSUE[kind](p, value, inverse)
                if new is not None:
                    at = m.start() + len(value)
                    got.append((m.start(), at, kind, new))
                    break
            else:
                # not what it looked like; another value may start in it
                if kind in ("card", "iban", "phone"):
                    at = m.start() + 1
        for m in _WORDED.finditer(text):
            new = _date(p, m[0], inverse)
            if new is not None:
                got.append((m.start(), m.end(), "date", new))
    out, reach = [], 0
    for a, b, kind, new in sorted(got, key=lambda g: (g[0], KINDS.index(g[2]), -g[1])):
        if a >= reach:
            out.append((kind, a, b, new))
            reach = b
    return out


def replace(text: str, found: list[tuple[str, int, int, str]]) -> str:
    parts, at = [], 0
    for _, a, b, new in found:
        parts += (text[at:a], new)
        at = b
    return "".join([*parts, text[at:]])


def restore(text: str, key: bytes) -> str:
    """The original of a pseudonymised text."""
    p = Permutation(key)
    return replace(text, find(text, p, inverse=True))


COUNTS = [f"n_{k}" for k in KINDS]


def _run(text_col: str, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Permutation(key)
        for whole in batches:
            for batch in pieces(whole, text_col, 8 << 20):
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at).to_pylist()
                found = [find(t, p) if t else [] for t in texts]
                columns = list(batch.columns)
                columns[at] = pa.array([replace(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string())
                kinds = [Counter(k for k, *_ in f) for f in found]
                columns += [pa.array([c[k] for c in kinds], pa.int64()) for k in KINDS]
                columns.append(pa.array([",".join(f"{k}:{a}:{b}" for k, a, b, _ in f) for f in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *COUNTS, "spans"])

    return tidy(run)


def pseudonymise(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in ``text_col`` replaced, and a count of each kind and spans (in the old text) added.

    Existing columns with these names are replaced; others pass through. Null and empty texts stay as
    they are; very long texts are read whole; repeated rows get the same pseudonyms. Of values that
    start at one place (ties) the first in the order of KINDS counts. An empty table gives no rows.
    """
    docs = docs.drop(*COUNTS, "spans").withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("spans", T.StringType())])
    return docs.mapInArrow(_run(text_col, key), schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, b"key of the registered query").withColumn("n_found", sum((F.col(c) for c in COUNTS[1:]), F.col(COUNTS[0])))
