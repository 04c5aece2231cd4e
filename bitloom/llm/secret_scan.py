"""Secret scanning with assignment-aware lexing.

Two layers run over every whole text:

* base patterns, leftmost and non-overlapping per kind: ``assign`` (a sensitive name, = or :, a
  value of 8 characters or more), ``access`` (AKIA keys) and ``hex`` (runs of 32 or more);
* a lexer for source and configuration syntax. It cuts the text into names, string literals
  (also triple-quoted ones), bare values and operators, pairs names with literals (``name = "x"``,
  ``"name": "x"``, ``name: type = "x"``, ``call(name="x")``, ``NAME=x``, ``<name>x</name>``,
  ``Authorization: Bearer x``), joins ``"a" + "b"``, propagates constants (``A = "x"``, later
  ``password = A``) within the braces or the ``def`` that they are set in, and scores each literal
  by how sensitive its target name is and how random the literal looks. Literals that reach the
  threshold become ``lexed`` spans at the place where they are written. Apostrophes and other
  stray quotes open no string, and strings that hold assignments are lexed inside, too.

Values are judged whole, whatever their length.

Scale: one narrow Arrow pass per row, no shuffle. Work and memory are linear in the text, whatever
it holds: a quote that doesn't close is tried once per line, joined values share their parts, and values of
more than ``SHORT`` characters are judged by shares of characters, which are counted once and added up where values
are joined or end in the same run. Texts without a sensitive stem or an assignment sign skip the lexer.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import pieces, tidy

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
_NAMED = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Sensitivity of words, and of neighbouring word pairs, in a target name.
NAME_WORDS = {"password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "passcode": 3.0, "secret": 3.0, "apikey": 3.0, "token": 2.5, "credential": 2.0, "credentials": 2.0, "auth": 1.5, "authorization": 2.5, "bearer": 2.0}
NAME_PAIRS = {("api", "key"), ("access", "key"), ("private", "key"), ("secret", "key"), ("signing", "key"), ("encryption", "key"), ("account", "key"), ("client", "secret")}
#: Words that say a name holds something about a secret, not the secret.
NAME_AGAINST = {"url", "uri", "path", "file", "field", "label", "hint", "policy", "type", "length", "count", "limit", "name", "public", "prompt", "regex", "pattern", "header"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\{\{.*\}\}|%.*%|your.*|change_?me.*|example.*|placeholder.*|none|null|true|false|undefined|todo.*|dummy.*|redacted.*)$")
THRESHOLD = 4.0

_STEM = re.compile(r"(?ai:passw|pwd|passphrase|passcode|secret|token|key|credential|auth|bearer)")
_TOKEN = re.compile(
    r"(?P<quote>[\"'`])"
    r"|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*(?:[.-][A-Za-z_$][A-Za-z0-9_$]*)*)"
    r"|(?P<op>:=|=>|===?|!=|[=:+])"
    r"|(?P<line>\n)"
    r"|(?P<other>[^\s\x01])"
)
_CLOSED = {'"': re.compile(r'"(?:[^"\\\n]|\\.)*+"'), "'": re.compile(r"'(?:[^'\\\n]|\\.)*+'"), "`": re.compile(r"`[^`]*+`")}
#: A single quote opens a string unless a letter or digit comes before it that is no prefix of a literal.
_OPENS = re.compile(r"(?:(?<![^\W_])|(?<=\b[bBfFrRuU])|(?<=\b[bBfFrR]{2}))'")
_SCHEME = re.compile(r"(?i)(?:bearer|basic|token)[ \t]+(?=[^\s])")
_DEF = re.compile(r"[ \t]*+(?:async[ \t]+)?def[ \t]")
_INDENT = re.compile(r"[ \t]*+(?=[^\s])")
#: Values up to this length are kept as text; longer ones by their start and the shares of their characters.
SHORT = 512
#: Characters beyond ASCII share 64 classes when shares are taken.
CLASSES = 192
STEP = 256
#: Lengths of values that are joined with themselves over and over stay at this.
HUGE = 1 << 500
#: Stands for the backslash of an escaped quote where a string is lexed inside.
_ESCAPE = "\x01"
_PREFIX = re.compile(r"(?i)(?:[bfru]|[bf]r|r[bf])(?=[\"'])")
_BARE = re.compile(r"[^\s\"'`,;{}()\[\]<>]+")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.-]*)>([^<\s]{6,})</")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    words = [w.lower() for w in _WORD.findall(name)]
    score = max([NAME_WORDS.get(w, 0.0) for w in words] + [3.0 for p in zip(words, words[1:]) if p in NAME_PAIRS], default=0.0)
    return score - 2.0 if words and words[-1] in NAME_AGAINST else score


def value_score(value: str, quoted: bool) -> float:
    n = len(value)
    if n < 6 or PLACEHOLDER.match(value):
        return -9.0
    score = float(n >= 8) + float(n >= 16)
    letters, digits = any(c.isalpha() for c in value), any(c.isdigit() for c in value)
    score += 1.0 if letters and digits else 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    score += float(entropy >= 3.0)
    if any(c.isspace() for c in value):
        score -= 2.0
    if not digits and value.isalpha():
        score -= 1.0 if quoted else 3.0
    return score


def _stray(text: str, a: int, b: int) -> bool:
    """Whether the string at a:b starts with a stray quote, so that its last quote really opens the next one."""
    after = text[b : b + 1]
    if after.isalnum() or after and after in "_$@":
        return True
    return bool(after) and not after.isspace() and after not in ",;)]}>+&.%|" and text[a + 1 : b - 1].rstrip()[-1:] in (":", "=")


def lex(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of names, strings, operators, line ends and other characters, in order."""
    tokens: list[tuple[str, int, int]] = []
    #: Up to where a quote of its kind is known to open no string: it doesn't close in this line, or closes as a stray one.
    closed_till = {'"': -1, "'": -1, "`": -1, '"""': -1, "'''": -1}
    at = 0
    while m := _TOKEN.search(text, at):
        kind, a, at = m.lastgroup, m.start(), m.end()
        if kind == "quote":
            kind, q = "other", text[a]
            if q != "`" and text.startswith(3 * q, a) and closed_till[3 * q] <= a:
                end = text.find(3 * q, a + 3)
                if end >= 0:
                    kind, at = "string", end + 3
                else:
                    closed_till[3 * q] = len(text)
            if kind == "other" and closed_till[q] <= a and (q != "'" or _OPENS.match(text, a)):
                got = _CLOSED[q].match(text, a)
                if got is None:
                    end = text.find("\n", a) if q != "`" else -1
                    closed_till[q] = end if end >= 0 else len(text)
                elif q != "`" and _stray(text, a, got.end()):
                    closed_till[q] = got.end() - 1
                else:
                    kind, at = "string", got.end()
        tokens.append((kind, a, at))
    return tokens


def _inside(text: str, a: int, b: int) -> tuple[int, int]:
    """Where the content of the string at a:b is."""
    k = 3 if b - a >= 6 and text[a] != "`" and text.startswith(3 * text[a], a) and text.endswith(3 * text[a], a, b) else 1
    a, b = a + k, b - k
    return a, b - (b > a and text[b - 1] == _ESCAPE)


def _class(char: str) -> int:
    point = ord(char)
    return point if point < 128 else 128 + point % 64


class Seen:
    """What a long value holds: its length, the shares of its characters, and kinds of characters in it."""

    __slots__ = ("n", "shares", "letter", "digit", "space", "other", "line", "tail")

    def __init__(self, n: int, shares: dict[int, float], letter: bool, digit: bool, space: bool, other: bool, line: bool, tail: str):
        self.n, self.shares, self.letter, self.digit, self.space, self.other, self.line, self.tail = n, shares, letter, digit, space, other, line, tail

    @classmethod
    def of(cls, text: str) -> Seen:
        chars = set(text)
        kinds = (any(map(str.isalpha, chars)), any(map(str.isdigit, chars)), any(map(str.isspace, chars)), not all(map(str.isalpha, chars)))
        shares: dict[int, float] = {}
        for c, k in Counter(text).items():
            shares[_class(c)] = shares.get(_class(c), 0.0) + k / len(text)
        return cls(len(text), shares, *kinds, "\n" in chars, text[-1:])

    def then(self, more: Seen) -> Seen:
        n = self.n + more.n
        if not self.n or not more.n:
            return self if self.n else more
        one, two = self.n / n, more.n / n
        shares = {c: p * one for c, p in self.shares.items()}
        for c, p in more.shares.items():
            shares[c] = shares.get(c, 0.0) + p * two
        return Seen(min(n, HUGE), shares, self.letter or more.letter, self.digit or more.digit, self.space or more.space, self.other or more.other, self.line or more.line, more.tail)


class Run:
    """A run of value characters, in which several bare values may start and all end together."""

    def __init__(self, text: str, start: int, end: int):
        self.source, self.start, self.end, self.codes = text, start, end, None

    def _count(self) -> None:
        text = self.source[self.start : self.end]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self.codes = np.where(points < 128, points, 128 + points % 64).astype(np.int64)
        full = np.stack([np.bincount(self.codes[i : i + STEP], minlength=CLASSES) for i in range(0, len(text), STEP)])
        self.after = np.concatenate([np.cumsum(full[::-1], axis=0)[::-1][1:], np.zeros((1, CLASSES), np.int64)])  # counts beyond each step
        places_ = {c: i for i, c in enumerate(text)}  # the last of each character
        last = lambda test: max((i for c, i in places_.items() if test(c)), default=-1)
        self.last = last(str.isalpha), last(str.isdigit), last(lambda c: not c.isalpha())

    def seen(self, at: int) -> Seen:
        if self.codes is None:
            self._count()
        k = at - self.start
        step = k // STEP
        counts = self.after[step] + np.bincount(self.codes[k : (step + 1) * STEP], minlength=CLASSES)
        letter, digit, other = (i >= k for i in self.last)
        held = np.flatnonzero(counts)
        shares = dict(zip(held.tolist(), (counts[held] / (self.end - at)).tolist(), strict=True))
        return Seen(self.end - at, shares, letter, digit, False, other, False, self.source[self.end - 1])


_STARTS = re.compile(r"(?i)(?:your|change_?me|example|placeholder|todo|dummy|redacted)")


def long_score(head: str, quoted: bool, seen: Seen) -> float:
    """As :func:`value_score`, of a value of more than ``SHORT`` characters, of which ``head`` is the start."""
    share = lambda chars: sum(seen.shares.get(ord(c), 0.0) for c in chars)
    ends = head[:1] == "<" and seen.tail == ">" or head[:1] == "%" and seen.tail == "%" or head[:2] in ("${", "{{") and seen.tail == "}"
    if any(share(c) > 1 - 1e-9 for c in ("xX", "*", ".")) or not seen.line and (ends or _STARTS.match(head)):
        return -9.0
    entropy = -sum(p * math.log2(p) for p in seen.shares.values() if p > 0)
    score = 2.0 + float(seen.letter and seen.digit) + float(entropy >= 3.0 - 1e-9) - 2.0 * seen.space
    return score if seen.digit or seen.other else score - (1.0 if quoted else 3.0)


class Value:
    """A literal or a joined value. ``parts``: places in the text and other values; shared, never copied."""

    __slots__ = ("text", "n", "quoted", "parts", "origin", "score")

    def __init__(self, text: str, n: int, quoted: bool, parts: tuple, origin: tuple | None = None):
        self.text, self.n, self.quoted, self.parts, self.origin = text[:SHORT], n, quoted, parts, origin
        self.score: float | None = None

    def joined(self, more: Value) -> Value:
        text = self.text + more.text if self.n < SHORT else self.text
        return Value(text, min(self.n + more.n, HUGE), self.quoted and more.quoted, (self, more))

    def judged(self) -> float:
        if self.score is None:
            self.score = value_score(self.text, self.quoted) if self.n <= SHORT else long_score(self.text, self.quoted, _seen(self))
        return self.score


_RECENT: OrderedDict[int, tuple[Value, Seen]] = OrderedDict()


def _keep(value: Value, seen: Seen) -> None:
    _RECENT[id(value)] = value, seen
    if len(_RECENT) > 2048:
        _RECENT.popitem(last=False)


def _seen(value: Value) -> Seen:
    """What a value holds; of a chain of joined values some are remembered, so that later ones don't start over."""
    done: dict[int, Seen] = {}
    todo = [value]
    while todo:
        v = todo[-1]
        if id(v) in done:
            todo.pop()
        elif (known := _RECENT.get(id(v))) and known[0] is v:
            done[id(v)] = known[1]
            todo.pop()
        elif v.n <= SHORT:
            done[id(v)] = Seen.of(v.text)
            todo.pop()
        elif v.origin:
            source, a, b = v.origin
            done[id(v)] = source.seen(a) if isinstance(source, Run) else Seen.of(source[a:b])
            todo.pop()
        elif missing := [p for p in v.parts if id(p) not in done]:
            todo += missing
        else:
            done[id(v)] = done[id(v.parts[0])].then(done[id(v.parts[1])])
            todo.pop()
            if len(done) % 32 == 0:
                _keep(v, done[id(v)])
    _keep(value, done[id(value)])
    return done[id(value)]


def places(value: Value, seen: set[int]) -> list[tuple[int, int]]:
    """The literals that ``value`` is made of, without those of values in ``seen``, which grows."""
    out, todo = [], [value]
    while todo:
        v = todo.pop()
        if id(v) not in seen:
            seen.add(id(v))
            for p in v.parts:
                if isinstance(p, Value):
                    todo.append(p)
                else:
                    out.append(p)
    return out


class _Known:
    """Constants by name, in scopes that end with a brace or with the indentation of a ``def``."""

    def __init__(self):
        self.values: dict[str, list[Value]] = {}
        self.scopes: list[tuple[int, list[str]]] = []  # indentation of a def, or -1 for a brace; the names set in it
        self.braces = 0

    def open(self, indent: int) -> None:
        self.scopes.append((indent, []))
        self.braces += indent < 0

    def _end(self) -> int:
        indent, names = self.scopes.pop()
        self.braces -= indent < 0
        for name in names:
            self.values[name].pop()
        return indent

    def close_brace(self) -> None:
        while self.braces and self._end() >= 0:
            pass

    def dedent(self, indent: int) -> None:
        while self.scopes and self.scopes[-1][0] >= indent:
            self._end()

    def set(self, name: str, value: Value) -> None:
        self.values.setdefault(name, []).append(value)
        if self.scopes:
            self.scopes[-1][1].append(name)

    def get(self, name: str) -> Value | None:
        found = self.values.get(name)
        return found[-1] if found else None


def _closing(text: str, tokens: list[tuple[str, int, int]]) -> dict[int, int]:
    """The token that closes each opened parenthesis."""
    opened, out = [], {}
    for i, (kind, a, _) in enumerate(tokens):
        if kind == "other" and text[a] == "(":
            opened.append(i)
        elif kind == "other" and text[a] == ")" and opened:
            out[opened.pop()] = i
    return out


def lex_pairs(text: str, shift: int = 0) -> list[tuple[str, Value]]:
    """(name, value) in the order of assignment, constants propagated; places are moved by ``shift``."""
    found: list[tuple[str, Value]] = []
    known = _Known()
    tokens = lex(text)
    starts = [t[1] for t in tokens]
    n = len(tokens)
    bare = Run(text, 0, 0)  # the run of value characters last looked at

    closing = _closing(text, tokens)

    def term(i: int) -> tuple[Value, int] | None:
        """The literal, constant or bare value at token i, and the next token; of ``call(...) or "x"`` the literal."""
        nonlocal bare
        if i + 1 < n and tokens[i][0] == "other" and text[tokens[i][1]] == "\\" and tokens[i + 1][0] == "line":
            i += 1
        if i + 1 < n and tokens[i][0] == "line" and (tokens[i + 1][0] == "string" or _PREFIX.match(text, tokens[i + 1][1])):
            i += 1
        if i < n and tokens[i][0] == "name" and (end := closing.get(i + 1)) is not None and tokens[i + 1][1] == tokens[i][2]:
            k = end + 1
            if k < n and text[tokens[k][1] : tokens[k][2]] == "or":
                k += 1
            elif k + 1 < n and text[tokens[k][1] : tokens[k + 1][2]] in ("||", "??"):
                k += 2
            else:
                return None
            return term(k) if k < n and tokens[k][0] == "string" else None
        if i + 1 < n and tokens[i][0] == "name" and tokens[i + 1][0] == "string" and tokens[i][2] == tokens[i + 1][1] and _PREFIX.match(text, tokens[i][1]):
            i += 1
        if i >= n:
            return None
        kind, a, b = tokens[i]
        if kind == "string":
            x, y = _inside(text, a, b)
            if m := _SCHEME.match(text, x, y):
                x = m.end()
            return Value(text[x : min(y, x + SHORT)], y - x, True, ((x + shift, y + shift),), (text, x, y)), i + 1
        if kind == "name" and (value := known.get(text[a:b])) is not None:
            return value, i + 1
        if kind == "other" and text[a] == "$" or kind in ("line", "op"):
            return None
        scheme = _SCHEME.match(text, a) if kind == "name" else None
        if scheme:
            a = scheme.end()
        if not bare.start <= a < bare.end:
            m = _BARE.match(text, a)
            if not m:
                return None
            bare = Run(text, *m.span())
        end = bare.end
        value = Value(text[a : min(end, a + SHORT)], end - a, scheme is not None, ((a + shift, end + shift),), (bare, a, end))
        return value, max(i + 1, bisect.bisect_left(starts, end))

    def after_line(a: int) -> None:
        if m := _INDENT.match(text, a):
            known.dedent(m.end() - a)
            if _DEF.match(text, a):
                known.open(m.end() - a)

    after_line(0)
    i = 0
    passed = 0  # tokens whose scopes have been followed
    while i < n:
        while passed <= i:
            kind, a, b = tokens[passed]
            if kind == "line":
                after_line(b)
            elif kind == "other" and text[a] == "{":
                known.open(-1)
            elif kind == "other" and text[a] == "}":
                known.close_brace()
            passed += 1
        kind, a, b = tokens[i]
        # an index in brackets names what it is assigned to
        at = i + 1 + (kind == "string" and i + 3 < n and text[tokens[i + 1][1]] == "]" and text[tokens[i + 2][1] : tokens[i + 2][2]] == "=")
        if kind not in ("name", "string") or at + 1 >= n or tokens[at][0] != "op":
            i += 1
            continue
        x, y = (a, b) if kind == "name" else _inside(text, a, b)
        op = text[tokens[at][1] : tokens[at][2]]
        if op == "+" or kind == "string" and op not in (":", "=>", "="):
            i += 1
            continue
        j, names = at + 1, [text[x:y]]
        if op == ":" and kind == "name" and j + 1 < n and tokens[j][0] == "name" and text[tokens[j + 1][1] : tokens[j + 1][2]] == "=":
            names.append(text[tokens[j][1] : tokens[j][2]])
            j += 2  # name: type = value, or prose: name = value
        got = term(j)
        if got is None:
            i += 1
            continue
        value, j = got
        while j + 1 < n and tokens[j][0] == "op" and text[tokens[j][1] : tokens[j][2]] == "+":
            more = term(j + 1)
            if more is None:
                break
            value, j = value.joined(more[0]), more[1]
        found += [(x, value) for x in names]
        if kind == "name" and op in ("=", ":=", ":") and (value.quoted or value.n >= 6):
            for x in names:
                known.set(x, value)
        # a bare "a: b = 'c'" may hold a later pair, so only strings and names taken as values are passed over
        i = j if value.quoted else at + 1
    for kind, a, b in tokens:
        if kind == "string":
            x, y = _inside(text, a, b)
            if (text.find("=", x, y) >= 0 or text.find(":", x, y) >= 0) and _STEM.search(text, x, y):
                inner = text[x:y]
                found += lex_pairs(re.sub(r"\\(?=[\"'])", _ESCAPE, inner) if "\\" in inner else inner, shift + x)
    if not shift:
        found += [(m[1], Value(m[2], len(m[2]), False, (m.span(2),), (text, *m.span(2)))) for m in _ELEMENT.finditer(text)]
    return found


def lexed_spans(text: str) -> list[tuple[int, int]]:
    if not ("=" in text or ":" in text or "</" in text) or not _STEM.search(text):
        return []
    spans: set[tuple[int, int]] = set()
    seen: set[int] = set()
    _RECENT.clear()
    for name, value in lex_pairs(text):
        score = name_score(name)
        if score >= 1.5 and score + value.judged() >= THRESHOLD:
            spans.update(p for p in places(value, seen) if p[1] > p[0])
    return sorted(spans)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    low = text.lower()
    if any(w in low for w in _NAMED):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def _listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def redact(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """Overlapping spans become one mask."""
    out, at, reach = [], 0, -1
    for a, b in sorted((a, b) for _, a, b in spans):
        if a >= reach:
            out += (text[at:a], mask)
        reach = at = max(reach, b)
    return "".join([*out, text[at:]]) if out else text


RESULT = [("n_assign", T.LongType()), ("n_access", T.LongType()), ("n_hex", T.LongType()), ("base_sha256", T.StringType()), ("spans", T.StringType())]


def _scan(text_col: str, redacting: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, text_col, 8 << 20):
                at = batch.schema.get_field_index(text_col)
                texts = batch.column(at).to_pylist()
                base = [base_spans(t) if t else [] for t in texts]
                every = [b + [("lexed", *s) for s in lexed_spans(t)] if t else [] for b, t in zip(base, texts, strict=True)]
                columns = list(batch.columns)
                if redacting:
                    columns[at] = pa.array([t if t is None else redact(t, s) for t, s in zip(texts, every, strict=True)], pa.string())
                counts = [Counter(k for k, _, _ in b) for b in base]
                columns += [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS[:3]]
                columns += [pa.array([hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]), pa.array([_listed(e) for e in every])]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *(n for n, _ in RESULT)])

    return tidy(run)


def scan_secrets(docs: DataFrame, *, text_col: str = "text", redact_text: bool = False) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256 and spans added; the text redacted on request.

    Existing columns with these names are replaced; others pass through. Null and empty texts have
    no spans (and stay null or empty); very long texts are read whole, in linear time; repeated rows each
    get their own result. Spans that start at one place (ties) are listed in the order of KINDS. An
    empty table gives no rows.
    """
    docs = docs.drop(*(n for n, _ in RESULT)).withColumn(text_col, F.col(text_col).cast("string"))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in RESULT)])
    return docs.mapInArrow(_scan(text_col, redact_text), schema)


def op10_secret_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan_secrets(docs).drop("text")
