"""Number fidelity: source numbers, English number phrases, and whether the ones render the others.

A target line is cut into maximal number phrases and each is read as a value with its kind
(cardinal, ordinal, month, year in two halves); a source number claims the first phrase that means
it. Phrases that can't be read as one number mean nothing, so a part of a larger phrase never
stands for the whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal

# English number words and their values, months, and the marks of source numbers.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SCALES = {"hundred": 100, "thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12, "quadrillion": 10**15, "dozen": 12, "score": 20}
ORDINALS = "zeroth first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
ORDINAL_TENS = {"twentieth": 20, "thirtieth": 30}
MONTHS = "january february march april may june july august september october november december".split()
FACTOR = {"": 1, "万": 10**4, "亿": 10**8}
ORDINAL_MARK, APPROXIMATE_MARK = "第", "多"
DATE_MARKS = ("世纪", "年", "月", "日", "号")

_DIGIT = re.compile(r"\d")
_WORDS = {w: i for i, w in enumerate(ONES)} | TENS
_ORDINAL = {w: i for i, w in enumerate(ORDINALS)} | ORDINAL_TENS
_TOKEN = re.compile(r"(?P<digits>(?<![a-z0-9.])\d+(?:\.\d+)?(?![\d]|\.\d))(?P<suffix>st|nd|rd|th)?(?![a-z0-9])|(?P<word>[a-z]+)|(?P<gap>[\s-]+)|(?P<plus>\+)|(?P<other>.)", re.S)


@dataclass(frozen=True)
class Mention:
    number: Decimal
    unit: str
    over: bool
    date: str
    nth: bool

    def label(self) -> str:
        return f"{'第' if self.nth else ''}{plain(self.number)}{'多' if self.over else ''}{self.unit}{self.date}"


@dataclass
class Phrase:
    start: int
    end: int
    kind: str  # cardinal, ordinal, month, year, or "" if it means nothing
    value: Decimal | None
    over: bool
    digits: tuple[str, ...]  # digit tokens in it that aren't ordinals
    scaled: bool  # digits with a scale word over hundred


def plain(n: Decimal) -> str:
    """Without zeros after the decimal part, and never with an exponent."""
    return f"{n.normalize():f}"


# What may hold numbers that aren't content.
_ANCHOR, _DESTINATION, _CONTENTS = re.compile(r"\{#[^{}\n]*\}"), re.compile(r"(?<=\])\([^()\n]*\)"), re.compile(r"\[\d+\]\(\s*#")


def strip_structure(text: str) -> str:
    """Without page marks of contents lists, anchors and link destinations."""
    return _DESTINATION.sub("", _ANCHOR.sub("", _CONTENTS.sub("", text)))


class _Scanner:
    """Reads a source line from left to right."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def digits(self, at: int) -> int:
        """Where the run of digits from ``at`` ends."""
        while at < len(self.text) and self.text[at].isdecimal():
            at += 1
        return at

    def blanks(self, at: int) -> int:
        while at < len(self.text) and self.text[at].isspace():
            at += 1
        return at

    def number(self) -> Decimal:
        """The number at the present place: digits, groups of three after a comma, and a decimal part."""
        start, end = self.at, self.digits(self.at)
        if end - start <= 3:
            while self.text[end : end + 1] == "," and self.digits(end + 1) >= end + 4:
                end += 4
        if self.text[end : end + 1] == "." and (tail := self.digits(end + 1)) > end + 1:
            end = tail
        self.at = end
        return Decimal(self.text[start:end].replace(",", ""))

    def magnitude(self) -> tuple[str, bool]:
        """A unit that multiplies the number, and whether it is approximate; nothing is read without a unit."""
        at = self.blanks(self.at)
        over = self.text[at : at + 1] == APPROXIMATE_MARK
        if over:
            at = self.blanks(at + 1)
        unit = self.text[at : at + 1]
        if not unit or unit not in FACTOR:
            return "", False
        self.at = at + 1
        return unit, over

    def date(self) -> str:
        mark = next((m for m in DATE_MARKS if self.text.startswith(m, self.at)), "")
        self.at += len(mark)
        return mark


def mentions(source: str) -> list[Mention]:
    """Numbers of a source line: digits, then magnitude, then date mark."""
    scan, out = _Scanner(strip_structure(source)), []
    while scan.at < len(scan.text):
        if not scan.text[scan.at].isdecimal():
            scan.at += 1
            continue
        nth = scan.text[scan.at - 1 : scan.at] == ORDINAL_MARK if scan.at else False
        number = scan.number()
        unit, over = scan.magnitude()
        out.append(Mention(number, unit, over, scan.date(), nth))
        if scan.text[scan.at - 1].isdecimal():
            scan.at = scan.digits(scan.at)  # digits that go on after a group belong to no number
    return out


#: Dashes of all lengths become hyphens.
_DASHES = str.maketrans(dict.fromkeys(range(0x2010, 0x2016), "-"))


def normalise(target: str) -> str:
    """Lower case, one kind of hyphen, digits without commas between them."""
    pieces = target.lower().translate(_DASHES).split(",")
    out = pieces[0]
    for piece in pieces[1:]:
        grouped = out[-1:].isdecimal() and piece[:1].isdecimal()
        out += piece if grouped else f",{piece}"
    return out


def _read(tokens: list[str]) -> tuple[str, Decimal] | None:
    """Kind and value of the tokens of one phrase (digits, words), or None."""
    if any(t.endswith(("st", "nd", "rd", "th")) and t[0].isdigit() for t in tokens):
        return ("ordinal", Decimal(tokens[0][:-2])) if len(tokens) == 1 else None
    if "point" in tokens:
        k = tokens.index("point")
        tail = list(tokens[k + 1 :])
        scale = Decimal(1)
        while tail and tail[-1] in SCALES:
            scale *= SCALES[tail.pop()]
        head = _read(tokens[:k])
        if head is None or head[0] != "cardinal" or not tail or any(t not in ONES[:10] for t in tail):
            return None
        return "cardinal", (head[1] + Decimal("0." + "".join(str(ONES.index(t)) for t in tail))) * scale
    total, group, last, kind = Decimal(0), None, 10**18, "cardinal"
    below: Decimal | None = None  # what stands right before, to check the order of parts
    for i, t in enumerate(tokens):
        if kind == "ordinal":
            return None  # an ordinal word ends a number
        if t == "and":
            continue
        if t == "a":
            if group is not None or i + 1 >= len(tokens) or tokens[i + 1] not in SCALES or total:
                return None
            group, below = Decimal(1), Decimal(1)
        elif t in SCALES:
            size = SCALES[t]
            if group is None:
                return None
            if size == 100 or size in (12, 20):
                if group >= 100:
                    return None
                group, below = group * size, Decimal(size)
            else:
                if size >= last:
                    return None
                total, group, below, last = total + group * size, None, None, size
        else:
            if t[0].isdigit():
                value, small = Decimal(t), None
                if group is not None:
                    return None
            elif t in _WORDS:
                value, small = Decimal(_WORDS[t]), True
            else:
                value, small, kind = Decimal(_ORDINAL[t]), True, "ordinal"
            if group is None:
                group = value
            elif below is not None and below == 100 and value < 100:
                group += value
            elif small and below is not None and below >= 20 and below < 100 and below % 10 == 0 and 0 < value < 10:
                group += value
            else:
                return None
            below = value
    return kind, total + (group or 0)


def _year(tokens: list[str]) -> Decimal | None:
    """``nineteen ninety-five``: two numbers under a hundred."""
    if len(tokens) < 2 or any(t not in _WORDS for t in tokens):
        return None
    for k in range(1, len(tokens)):
        a, b = _read(tokens[:k]), _read(tokens[k:])
        if a and b and 10 <= a[1] < 100 and 0 < b[1] < 100:
            return a[1] * 100 + b[1]
    return None


def phrases(target: str) -> list[Phrase]:
    """Number phrases of a normalised line, from left to right."""
    found = [(m.lastgroup if m.lastgroup != "suffix" else "digits", m[0], m.start(), m.end()) for m in _TOKEN.finditer(target)]
    out: list[Phrase] = []
    i, n = 0, len(found)

    def counts(j: int, first: bool = False) -> bool:
        kind, text = found[j][:2]
        if kind == "digits":
            return True
        return kind == "word" and (text in _WORDS or text in _ORDINAL or text in SCALES or text == "point" or first and text == "a" and j + 2 < n and found[j + 1][0] == "gap" and found[j + 2][1] in SCALES)

    while i < n:
        if found[i][0] == "word" and found[i][1] in MONTHS:
            out.append(Phrase(found[i][2], found[i][3], "month", Decimal(MONTHS.index(found[i][1]) + 1), False, (), False))
            i += 1
            continue
        if not counts(i, True):
            i += 1
            continue
        tokens, over, j = [found[i][1]], False, i + 1
        while j < n:
            if found[j][0] == "plus" and tokens[-1][0].isdigit():
                over, j = True, j + 1
                continue
            if found[j][0] != "gap" or j + 1 >= n:
                break
            k = j + 1
            if found[k][1] == "and" and tokens[-1] in SCALES and k + 2 < n and found[k + 1][0] == "gap" and counts(k + 2):
                tokens += ["and", found[k + 2][1]]
                j = k + 3
                continue
            if not counts(k) or "-" in found[j][1] and tokens[-1][0].isdigit() and found[k][0] == "digits":
                break
            tokens.append(found[k][1])
            j = k + 1
        start, end = found[i][2], found[j - 1][3]
        over = over or bool(re.search(r"(?:over|more than)\s+$", target[:start]))
        read = _read(tokens)
        digits = tuple(t for t in tokens if t[0].isdigit() and not t.endswith(("st", "nd", "rd", "th")))
        scaled = bool(digits) and any(t in SCALES and SCALES[t] > 100 for t in tokens)
        if read is not None:
            out.append(Phrase(start, end, *read, over, digits, scaled))
        else:
            year = _year(tokens)
            out.append(Phrase(start, end, "year" if year is not None else "", year, over, digits, scaled))
        i = j
    return out


def renders(m: Mention, p: Phrase) -> bool:
    if p.value is None or p.value != m.number * FACTOR[m.unit]:
        return False
    if m.unit:
        return p.kind == "cardinal" and (p.over or not m.over)
    if p.kind == "cardinal":
        return not p.scaled
    if p.kind == "ordinal":
        return m.nth or m.date in ("日", "号", "世纪") and m.number <= 31
    return p.kind == "month" and m.date == "月" or p.kind == "year" and m.date == "年"


def check_line(source: str, target: str) -> tuple[list[str], list[str]]:
    """Labels of source numbers that the target lacks, and the target's digits that none accounts for."""
    wanted = mentions(source) if _DIGIT.search(source) else []
    if not wanted and not _DIGIT.search(target):
        return [], []
    found = phrases(normalise(target))
    free = [True] * len(found)
    missing = []
    for m in wanted:
        k = next((i for i, p in enumerate(found) if free[i] and renders(m, p)), None)
        if k is None:
            missing.append(m.label())
        else:
            free[k] = False
    return missing, [d for f, p in zip(free, found, strict=True) if f for d in p.digits]
