"""The reading of one document's boxes in plain Python, and by_document(), which has tasks do it that hold a document's boxes together.

What layout and invoices define over frames is done here a document at a time: one shuffle deals the boxes, and nothing is
written between steps. Amounts are whole pennies. Patterns keep Java's idea of blanks, digits and ends of a text.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from calendar import monthrange
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cached_property, lru_cache
from itertools import pairwise, zip_longest
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: See invoices, whose DataFrame steps have the same ones.
REACH, WRAP_GAP, BLOCK_GAP, TOTAL_ROWS, HOLDS = 8.0, 1.6, 2.2, 6, 0.8
#: Texts whose reading a worker remembers.
KNOWN_TEXTS = 1 << 16

_END = r"(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)"  # Java's $
_S = r"[ \t\n\x0b\f\r]"  # Java's \s
_NOT_S = r"[^ \t\n\x0b\f\r]"
_WHOLE_SHAPE = r"[-−–]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)"
_AMOUNT_SHAPE = r"[-−–]?£?(?:GBP)?" + _WHOLE_SHAPE + r"\.[0-9]{2}"
_WHOLE, _AMOUNT = (re.compile(rf"(?:\({s}\)|{s}){_END}") for s in (_WHOLE_SHAPE, _AMOUNT_SHAPE))
_NEGATIVE, _DIGIT, _NO_DIGIT = re.compile("[-−–(]"), re.compile("[0-9]"), re.compile("[^0-9]")
_CURRENCY, _EDGES, _SPACES = re.compile(r"\(gbp\)|£"), re.compile(rf"\A{_S}+|(?:{_S}|:)+{_END}"), re.compile(f"{_S}+")
_MARKS = re.compile(r"\(gbp\)|£|[:.]")
_WORD, _LETTERS = re.compile("[A-Za-z]{2}"), re.compile("[A-Za-z]{3}")
_FOOTER = re.compile(rf"page [0-9]+ of [0-9]+{_END}", re.IGNORECASE | re.ASCII)
_WORDS, _PARTS = re.compile(f"{_NOT_S}+"), re.compile(f"{_S}+|{_NOT_S}+")
_VALUE_EDGES = re.compile(rf"\A(?:[:#]|{_S})+|(?:[:#]|{_S})+{_END}")
_NUMBER, _CUSTOMER, _COUNTRY = re.compile(rf"(?:C[0-9]{{5,7}}|[0-9]{{6,7}}){_END}"), re.compile(rf"[0-9]{{3,6}}{_END}"), re.compile(rf"[A-Za-z][A-Za-z .'-]{{1,40}}{_END}")
_D, _Y, _TIME = r"([0-9]{1,19})", r"([0-9]{4}|-[0-9]{4,19}|\+[0-9]{5,19})", r"(?: ([0-9]{1,19}):([0-9]{1,19}))?"
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_MONTH = {m: i + 1 for i, m in enumerate(_MONTHS)}
_SHORT = {m[:3]: i + 1 for i, m in enumerate(_MONTHS)}
_DATES = [  # pattern, places of day, month and year, names of months
    (re.compile(f"{_D}/{_D}/{_Y}{_TIME}"), (1, 2, 3), None), (re.compile(f"{_Y}-{_D}-{_D}{_TIME}"), (3, 2, 1), None), (re.compile(f"{_D} ([A-Za-z]+) {_Y}{_TIME}"), (1, 2, 3), _MONTH), (re.compile(f"{_D} ([A-Za-z]+) {_Y}{_TIME}"), (1, 2, 3), _SHORT),
    (re.compile(rf"{_D}\.{_D}\.{_Y}{_TIME}"), (1, 2, 3), None), (re.compile(f"{_D}-([A-Za-z]+)-{_Y}{_TIME}"), (1, 2, 3), _SHORT),
]
_DATE_LIKE = re.compile(r"[-+]?[0-9]+[-/. ]")


def whole_number(text: str) -> int | None:
    """columns.whole_number() of one text."""
    bare = text.replace(" ", "")
    if not _WHOLE.match(bare):
        return None
    value = int(_NO_DIGIT.sub("", bare))
    return None if value >= 1 << 63 else -value if _NEGATIVE.search(bare) else value


def pennies(text: str) -> int | None:
    """columns.money() of one text, in pennies."""
    bare = text.replace(" ", "")
    if not _AMOUNT.match(bare):
        return None
    value = int(_NO_DIGIT.sub("", bare))
    return None if value >= 10**14 else -value if _NEGATIVE.search(bare) else value


def plain_label(text: str) -> str:
    """invoices.plain_label() of one text."""
    if text.isprintable():  # the only blank is a space
        return " ".join(text.lower().replace("(gbp)", "").replace("£", "").lstrip(" ").rstrip(" :").replace(".", " ").split())
    return _SPACES.sub(" ", _EDGES.sub("", _CURRENCY.sub("", text.lower())).replace(".", " ")).strip(" ")


def is_date(text: str) -> bool:
    """Whether columns.printed_date() of a text isn't null."""
    text = _SPACES.sub(" ", text.strip(" "))
    if not _DATE_LIKE.match(text):
        return False
    for pattern, (d, m, y), names in _DATES:
        found = pattern.fullmatch(text)
        if found:
            day, year, month = int(found[d]), int(found[y]), int(found[m]) if names is None else names.get(found[m].lower(), 0)
            hour, minute = (int(x or 0) for x in found.groups()[3:])
            if 1 <= month <= 12 and -290_307 <= year <= 294_246 and found[y] != "-0000" and 1 <= day <= monthrange(2000 + year % 400, month)[1] and hour < 24 and minute < 60:
                return True
    return False


@lru_cache(KNOWN_TEXTS)
def value_kind(text: str) -> str | None:
    """invoices.value_kind() of one text."""
    t = text.strip(" ")
    if is_date(t):
        return "date"
    if _NUMBER.match(t):
        return "number"
    if _CUSTOMER.match(t) or t in ("—", "-", "Guest"):
        return "customer"
    return "country" if _COUNTRY.match(t) else None


@lru_cache(KNOWN_TEXTS)
def reads(text: str) -> tuple[int | None, int | None, str, bool, bool]:
    """A text's pennies, whole number, label, whether it has a word, whether it is a footer."""
    numbered = _DIGIT.search(text) is not None
    return (
        pennies(text) if numbered else None, whole_number(text) if numbered else None, plain_label(text), _WORD.search(text) is not None,
        numbered and _FOOTER.match(text.strip(" ")) is not None,
    )


def _first_nulls(*values) -> tuple:
    """A key that sorts as Spark does: nulls first, a number that is none last."""
    return tuple((0, 0) if v is None else (2, 0) if v != v else (1, v) for v in values)


def _ordered(items: list, key) -> list:
    """Sorted by a tuple that may hold nulls and numbers that are none."""
    return sorted(items, key=lambda x: _first_nulls(*key(x)))


_BY_PLACE = itemgetter(1, 0)


class Line:
    """A row of a document: number, page, boxes (text, x0, x1, top, bottom) from left to right; what each reads as, and facts of them all, when asked for."""

    def __init__(self, line: int, page, boxes: list, odd: bool):
        self.line, self.page = line, page
        self.boxes = _ordered(boxes, _BY_PLACE) if odd else sorted(boxes, key=_BY_PLACE) if len(boxes) > 1 else boxes

    @cached_property
    def read(self) -> list[tuple]:
        return [reads(b[0]) for b in self.boxes]

    @cached_property
    def amounts(self) -> int:
        return sum([r[0] is not None for r in self.read])

    @cached_property
    def item_like(self) -> bool:
        return len(self.boxes) >= 3 and self.amounts > 0 and any([r[1] is not None for r in self.read]) and any([r[3] for r in self.read])

    @cached_property
    def footer(self) -> bool:
        return any([r[4] for r in self.read])

    @cached_property
    def label(self) -> str:
        bare = [b[0] for b, r in zip(self.boxes, self.read, strict=True) if r[0] is None and r[1] is None]
        return reads(bare[0])[2] if len(bare) == 1 else plain_label(" ".join(bare))

    @cached_property
    def top(self) -> float | None:
        return min([b[3] for b in self.boxes if b[3] is not None], default=None)

    @cached_property
    def bottom(self) -> float | None:
        return max([b[4] for b in self.boxes if b[4] is not None], default=None)

    @cached_property
    def height(self) -> float:
        return sorted(map(_height, self.boxes))[len(self.boxes) // 2]


def _height(box) -> float:
    return max(1.0, box[4] - box[3]) if box[3] is not None and box[4] is not None else 1.0


def page_rows(boxes: list) -> tuple[list[tuple], bool]:
    """(page, row, box) of boxes (page, text, x0, x1, top, bottom), as layout.rows_of_boxes() numbers rows; box without its page. And whether places are missing."""
    kept = [b for b in boxes if b[1] is not None and b[1].strip(" ")]
    try:
        keyed = [(b[0], (b[4] + b[5]) / 2, b[2], b[1], b) for b in kept]
        total = sum([k[1] + k[2] for k in keyed])
        odd = total != total
        keyed.sort(key=_FOUR)
    except TypeError:  # a null
        odd = True
    if odd:
        middle = lambda b: (b[4] + b[5]) / 2 if b[4] is not None and b[5] is not None else None
        keyed = _ordered([(b[0], middle(b), b[2], b[1], b) for b in kept], _FOUR)
    out, row, page, m, h = [], 0, None, None, None
    for k in keyed:
        b, last_m, last_h = k[4], m, h
        m = k[1]
        h = None if m is None else b[5] - b[4]
        if not out or k[0] != page:
            row, page = 1, k[0]
        elif m is None or last_m is None or m - last_m >= 0.45 * (h if h > last_h else last_h):
            row += 1
        out.append((page, row, b[1:]))
    return out, odd


_FOUR = itemgetter(0, 1, 2, 3)


def numbered_lines(boxes: list) -> list[Line]:
    """A document's rows, numbered from 1 over its pages."""
    out: list[Line] = []
    rows, odd = page_rows(boxes)
    held, at, on = [], 0, None
    for page, row, box in rows:
        if held and (row != at or page != on):
            out.append(Line(len(out) + 1, on, held, odd))
            held = []
        at, on = row, page
        held.append(box)
    if held:
        out.append(Line(len(out) + 1, on, held, odd))
    return out


def gutters(boxes: list, heads: list[tuple[float, float]]) -> list[float]:
    """layout.gutters() of boxes (text, x0, x1, ...) under header cells (x0, x1): an edge after each cell but the last."""
    spans = [(math.floor(min(b[1], b[2])), math.floor(max(b[1], b[2]))) for b in boxes if b[1] is not None and b[2] is not None]
    out = []
    for (_, x1), (after, _) in pairwise(heads):
        if x1 is None or after is None:
            continue
        lo, hi, mid = math.floor(x1), math.floor(after) + 1, (x1 + after) / 2
        if hi <= lo:
            out.append(mid)
            continue
        changes = {lo: 0}
        for a, b in spans:
            if b >= lo and a <= hi:
                start = a if a > lo else lo
                changes[start] = changes.get(start, 0) + 1
                if b + 1 <= hi:
                    changes[b + 1] = changes.get(b + 1, 0) - 1
        at, n, best, centre = sorted(changes), 0, None, math.ceil(mid - 0.5)
        for x, until in zip(at, [*[x - 1 for x in at[1:]], hi], strict=True):
            n += changes[x]
            x = max(x, min(until, centre))
            key = (n, abs(x - mid), x)
            if best is None or key < best:
                best = key
        out.append(float(best[2]))
    return out


def _tenths(x: float) -> float:
    return float(Decimal(repr(x)).quantize(Decimal("0.1"), ROUND_HALF_UP))


def split_box(box: tuple, edges: list[float]) -> list[tuple]:
    """invoices.split_boxes() of one box (text, x0, x1, top, bottom); edges in order."""
    text, x0, x1 = box[:3]
    if not edges or x0 is None or x1 is None or bisect_right(edges, x0 + 1) == bisect_right(edges, x1 - 1) or len(_WORDS.findall(text)) < 2:
        return [box]
    per, at, pieces = (x1 - x0) / max(len(text), 1), 0, []
    for part in _PARTS.findall(text):
        a, b = x0 + at * per, x0 + (at + len(part)) * per
        at += len(part)
        if part[0] in " \t\n\x0b\f\r":
            continue
        band = bisect_right(edges, (a + b) / 2)
        if pieces and pieces[-1][0] == band:
            pieces[-1] = (band, f"{pieces[-1][1]} {part}", pieces[-1][2], b)
        else:
            pieces.append((band, part, a, b))
    return [(t, _tenths(a), _tenths(b), *box[3:]) for _, t, a, b in pieces]


def row_cells(boxes: list, edges: list[float]) -> dict[int, str]:
    """layout.cells() of one row: column to text."""
    held: dict[int, list] = {}
    for b in boxes:
        column = bisect_right(edges, (b[1] + b[2]) / 2) if b[1] is not None and b[2] is not None else 0
        held.setdefault(column, []).append(b)
    return {c: own[0][0] if len(own) == 1 else _joined(own) for c, own in held.items()}


def _joined(boxes: list) -> str:
    """layout._joined(): boxes (text, x0, x1, top, bottom) of a cell in reading order."""
    whole = [b[3] is not None and b[4] is not None for b in boxes]
    parts = [((b[3] + b[4]) / 2 if w else None, b[1], b[0], b[4] - b[3] if w else None) for b, w in zip(boxes, whole, strict=True)]
    line, before, found = 0, None, []
    for c, x0, text, h in _ordered(parts, lambda p: p):
        if c is not None and before is not None and c - before >= 0.5 * h:
            line += 1
        before = c
        found.append((line, x0, text))
    return " ".join(t for _, _, t in _ordered(found, lambda f: f))


def column_kind(texts: list[str]) -> str:
    """layout.column_kinds() of one column's texts."""
    given = [t for t in texts if t]
    if not given:
        return "empty"
    n = len(given)
    if sum(reads(t)[1] is not None for t in given) / n > 0.8:
        return "int"
    if sum(reads(t)[0] is not None for t in given) / n > 0.8:
        return "money"
    return "text" if sum(" " in t and _LETTERS.search(t) is not None for t in given) / n > 0.5 else "code"


def multiplying(rows: list[dict[int, str]], whole: list[int], price: list[int], amount: list[int], least: float) -> tuple[int, int, int] | None:
    """The columns q, p, a of rows for which q * p = a on the largest share of those that have all three, at least `least`."""
    best = None
    for q in whole:
        for p in price:
            for a in amount:
                if p == a or q in (p, a):
                    continue
                n = fits = 0
                for row in rows:
                    if q in row and p in row and a in row:
                        x, y, z = reads(row[q])[1], reads(row[p])[0], reads(row[a])[0]
                        if x is not None and y is not None and z is not None:
                            n += 1
                            fits += x * y == z
                if n and fits / n >= least:
                    key = (fits / n, a > p, -q, -p, -a)
                    if best is None or key > best:
                        best = key
    return None if best is None else (-best[2], -best[3], -best[4])


def by_word(words: dict[str, tuple[str, ...]]) -> dict[str, str]:
    """The name of each word; of the first name that has it."""
    return {w: name for name, own in reversed(words.items()) for w in own}


class Terms(NamedTuple):
    """The words that a reading goes by: a label's field, a header cell's role, labels of totals, of a subtotal and of counts."""

    fields: dict[str, str]
    roles: dict[str, str]
    totals: tuple[str, ...]
    subtotal: str
    counts: tuple[str, ...]

    def ends(self, label: str) -> bool:
        return label in self.totals or label == self.subtotal or label in self.counts


def table_header(lines: list[Line], terms: Terms) -> Line | None:
    """invoices.table_header() of a document."""
    for line in lines:
        if len(line.boxes) < 3:
            continue
        roles = {terms.roles.get(r[2]) for r in line.read} - {None}
        if len(roles) >= 3 and roles & {"quantity", "unit_price", "amount"} and roles & {"code", "description"}:
            return line
    item = next((x for x in lines if x.item_like), None)
    if item is None or item.page is None or item.top is None:
        return None
    above = lines[max(0, item.line - 3) : item.line - 1]
    near = [x for x in above if x.page == item.page and len(x.boxes) >= 3 and x.amounts == 0 and x.bottom is not None and item.top - x.bottom < 4 * item.height]
    return near[-1] if near else None


def header_pairs(region: list[Line], terms: Terms) -> list[tuple]:
    """invoices.header_pairs() of a document's lines above the table: (line, place, label, value, field, found)."""
    out, rest = [], []
    for line, after in zip_longest(region, region[1:]):
        fields = [terms.fields.get(r[2]) for r in line.read]
        below = after.boxes if after is not None else ()
        nearest = []
        if len(line.boxes) >= 3:
            for place, (b, field) in enumerate(zip(line.boxes, fields, strict=True)):
                met = [(abs(o[1] - b[1]), o[1], k) for k, o in enumerate(below) if b[1] is not None and o[1] is not None and abs(o[1] - b[1]) < REACH]
                if met:
                    nearest.append((line.line, place, b[0], below[min(met)[2]][0], field, "stacked"))
        n = len(line.boxes)
        if n >= 3 and len(nearest) >= max(3, n - 1) and not any(value_kind(b[0]) in ("date", "number", "customer") for b in line.boxes):
            out += nearest
        else:
            rest.append((line, fields))
    seeds, pair = [], []
    for line, fields in rest:
        for place, (b, field) in enumerate(zip(line.boxes, fields, strict=True)):
            last = place + 1 == len(line.boxes)
            if field is not None:
                if not last and fields[place + 1] is None:
                    out.append((line.line, place, b[0], line.boxes[place + 1][0], field, "side"))
                    seeds.append((line.line, b[3], b[1], line.boxes[place + 1][1], _height(b)))
                continue
            if place == 0 and len(line.boxes) == 2:
                pair.append((line.line, b, line.boxes[1]))
            words = _WORDS.findall(b[0])
            for c in range(1, min(4, len(words) - 1) + 1):
                label = " ".join(words[:c])
                known = terms.fields.get(plain_label(label))
                if known is not None:
                    value = _VALUE_EDGES.sub("", " ".join(words[c:])).strip(" ")
                    if value:
                        out.append((line.line, place, label, value, known, "inline"))
                        break
    if not seeds or not pair:
        return out
    close = lambda a, b: a is not None and b is not None and abs(a - b) < REACH
    fits = [(n, b, v) for n, b, v in pair if any(n != s[0] and close(b[1], s[2]) for s in seeds) and any(n != s[0] and close(v[1], s[3]) for s in seeds)]
    step = BLOCK_GAP * max(s[4] for s in seeds)
    tops = _ordered([*[(s[1], s[0], True, None) for s in seeds], *[(b[3], n, False, (n, 0, b[0], v[0], None, "block")) for n, b, v in fits]], lambda t: t[:2])
    block: list[tuple] = []
    for t in [*tops, None]:
        if t is None or block and (t[0] is None or block[-1][0] is None or t[0] - block[-1][0] > step):
            if any(x[2] for x in block):
                out += [x[3] for x in block if not x[2]]
            block = []
        block.append(t)
    return out


def header_fields(pairs: list[tuple]) -> list[tuple]:
    """invoices.header_fields() of a document's pairs: (field, value, label, by)."""
    known: dict[str, tuple] = {}
    for line, place, label, value, field, _ in pairs:
        if field is not None and (field not in known or (line, place) < known[field][0]):
            known[field] = ((line, place), value, label)
    loose: dict[str, tuple] = {}
    for line, place, label, value, field, found in pairs:
        if field is None and _WORD.search(label):
            kind, order = value_kind(value), (found == "block", line, place)
            if kind is not None and kind not in known and (kind not in loose or order < loose[kind][0]):
                loose[kind] = (order, value, label)
    return [(f, v, label, by) for own, by in ((known, "label"), (loose, "elimination")) for f, (_, v, label) in own.items()]


def content_roles(sample: list[dict[int, str]], heads: list[str | None]) -> list[str | None]:
    """invoices.content_roles(): a role for each header cell, from its name or from what the columns of item rows hold."""
    texts: dict[int, list[str]] = {}
    for row in sample:
        for c, t in row.items():
            texts.setdefault(c, []).append(t)
    kinds = {c: column_kind(own) for c, own in texts.items()}
    has, out = {r for r in heads if r is not None}, list(heads)
    may = lambda role, kind: [c for c, r in enumerate(heads) if r == role or r is None and kinds.get(c) == kind and role not in has]
    best = multiplying(sample, may("quantity", "int"), may("unit_price", "money"), may("amount", "money"), HOLDS)
    for c, role in zip(best or (), ("quantity", "unit_price", "amount"), strict=False):
        if out[c] is None:
            out[c] = role
    free = lambda kind: [c for c, r in enumerate(out) if r is None and kinds.get(c) in kind]
    if "description" not in has and free(("text",)):
        out[max(free(("text",)), key=lambda c: (sum(map(len, texts[c])), -c))] = "description"
    if "code" not in has and free(("code", "int")):
        out[free(("code", "int"))[0]] = "code"
    return out


def active(rows: list[tuple]) -> list[bool]:
    """invoices.active_rows() of a document's rows (page, stops, resumes), in order."""
    out, start, at = [], True, 0
    while at < len(rows):
        page, stopped, seen, part = rows[at][0], False, False, False
        while at < len(rows) and rows[at][0] == page:
            _, stops, resumes = rows[at]
            if resumes and not seen:
                seen, part = True, False
            stopped, part = stopped or stops, part or stops
            out.append((not stopped if start else seen and not part) and not resumes)
            at += 1
        start = not stopped if start else seen and not part
    return out


def table_items(lines: list[Line], head: Line, terms: Terms) -> tuple[list[tuple], int, float | None]:
    """invoices._items() of a document: (code, description, quantity, unit price and amount in pennies) of each item, the
    number of the line after the table, and the right end of the amount's header cell."""
    names = [terms.roles.get(r[2]) for r in head.read]
    names = [r if r not in names[:i] else None for i, r in enumerate(names)]
    under = lines[head.line :]
    stop = next((i for i, x in enumerate(under) if x.page != head.page and x.page is not None and head.page is not None or terms.ends(x.label) or x.footer), len(under))
    edges = sorted(gutters([b for x in under[:stop] for b in x.boxes], [b[1:3] for b in head.boxes]))
    cells = [{c: t for c, t in row_cells([p for b in x.boxes for p in split_box(b, edges)], edges).items() if t and c < len(names)} for x in under]
    roles = content_roles([c for c, x in zip(cells, under[:stop], strict=False) if x.item_like], names)
    labels = {r[2] for r in head.read}
    again = max(2, len(labels) - 1)

    rows = []
    for x, own in zip(under, cells, strict=True):
        resumes = sum(r[2] in labels for r in x.read) >= again and x.page is not None and head.page is not None and x.page > head.page
        total = terms.ends(x.label)
        is_item = (len(own) >= 3 or len(own) >= 2 and x.item_like) and not x.footer and not resumes and not total
        rows.append((x, own, resumes, total, is_item))
    early = active([(x.page, x.footer, resumes) for x, _, resumes, _, _ in rows])
    first = next((i for i, (r, a) in enumerate(zip(rows, early, strict=True)) if a and r[4]), len(rows))
    end = next((i for i, (x, _, _, total, _) in enumerate(rows) if total or i > first and x.amounts == 1 and len(x.boxes) <= 3 and not x.item_like), None)
    kept, wraps, page, last = [], [], None, None
    for i, (x, own, resumes, _, is_item) in enumerate(rows[:end]):
        if i == 0 or x.page != page:
            page, began, last = x.page, False, None
        if is_item:
            began, last = True, None
        textual = all(roles[c] in (None, "description") for c in own)
        wrap = began and i > first and not is_item and bool(own) and textual and x.top is not None and last is not None and x.top - last < WRAP_GAP * x.height
        if x.bottom is not None and (last is None or x.bottom > last):
            last = x.bottom
        wraps.append(wrap)
        kept.append((x.page, x.footer or i > first and not is_item and not wrap and not resumes and bool(own), resumes))
    items: list[list[dict]] = []
    for (_, own, _, _, is_item), wrap, reading in zip(rows[:end], wraps, active(kept), strict=True):
        if reading and is_item:
            items.append([own])
        elif reading and wrap and items:
            items[-1].append(own)
    place = {r: c for c, r in enumerate(roles) if r is not None}
    out = []
    for own in items:
        text = {r: " ".join(row[c] for row in own if c in row) for r, c in place.items() if any(c in row for row in own)}
        number = lambda r, read: read(text[r]) if r in text else None  # noqa: B023, E731
        described = _SPACES.sub(" ", text["description"]).strip(" ") if "description" in text else None
        out.append((text.get("code"), described, number("quantity", whole_number), number("unit_price", pennies), number("amount", pennies)))
    after = under[end].line if end is not None else lines[-1].line + 1
    return out, after, head.boxes[place["amount"]][2] if "amount" in place else None


def printed_totals(lines: list[Line], after: int, edge: float | None, terms: Terms) -> tuple:
    """invoices.printed_totals() of a document: total and subtotal in pennies, item_count, total_by."""
    total = subtotal = last = count = None
    for x in lines[after - 1 : after - 1 + TOTAL_ROWS]:
        if x.footer:
            break
        if x.label in terms.counts:
            count = next((r[1] for r in reversed(x.read) if r[1] is not None), count)
            continue
        amounts = [((abs(b[2] - edge) if edge is not None and b[2] is not None else -k, k), r[0]) for k, (b, r) in enumerate(zip(x.boxes, x.read, strict=True)) if r[0] is not None]
        if amounts:
            last = min(amounts)[1]
            total = last if total is None and x.label in terms.totals else total
            subtotal = last if x.label == terms.subtotal else subtotal
    return (total, subtotal, count, "label") if total is not None else (last, subtotal, count, "fallback" if last is not None else None)


class Invoice(NamedTuple):
    """One document's fields, items, totals, and whether a credit note is named above the table."""

    fields: list[tuple]
    items: list[tuple]
    totals: tuple
    noted: bool


def invoice(boxes: list, terms: Terms, fields: bool = True, items: bool = True) -> Invoice | None:
    """A document's boxes (page, text, x0, x1, top, bottom) read; None where none holds a text. What isn't asked for isn't looked for."""
    lines = numbered_lines(boxes)
    if not lines:
        return None
    head = table_header(lines, terms)
    found, noted, rows, totals = [], False, [], (None, None, None, None)
    if fields:
        first = min((x.page for x in lines if x.page is not None), default=None)
        region = [x for x in lines if x.page == first is not None and (head is None or x.line < head.line)]
        found = header_fields(header_pairs(region, terms))
        noted = "credit note" in " ".join(b[0] for x in region for b in x.boxes).lower()
    if items and head is not None:
        rows, after, edge = table_items(lines, head, terms)
        totals = printed_totals(lines, after, edge, terms)
    return Invoice(found, rows, totals, noted)


def read_table(boxes: list, roles: dict[str, str], totals: tuple[str, ...], counts: tuple[str, ...]) -> tuple | None:
    """A document's row of layout.extracted_invoices(): items, quantity, amount and total in pennies, consistent; None without items."""
    rows: dict[int, list] = {}
    for _, row, box in page_rows(boxes)[0]:
        rows.setdefault(row, []).append(box)
    named = item = None
    for n in sorted(rows):
        own = {roles.get(bare_label(b[0])) for b in rows[n]} - {None}
        if named is None and len(own) >= 3 and own & {"quantity", "unit_price", "amount"} and own & {"code", "description"}:
            named = n
        if item is None and sum(reads(b[0])[0] is not None for b in rows[n]) >= 2:
            item = n
    head = named if named is not None else item - 1 if item is not None else 0
    if head < 1:
        return None
    heads = _ordered(rows.get(head, []), lambda b: (b[1],))
    below = [(n, rows[n]) for n in sorted(rows) if n > head]
    edges = sorted(gutters([b for _, own in below for b in own], [b[1:3] for b in heads]))
    cells = [row_cells(own, edges) for _, own in below]
    end = next((i for i, own in enumerate(cells) if any(bare_label(t) in totals or bare_label(t) in counts for t in own.values())), len(cells))
    texts: dict[int, list[str]] = {}
    for own in cells[:end]:
        for c, t in own.items():
            texts.setdefault(c, []).append(t)
    kinds = {c: column_kind(own) for c, own in texts.items()}
    whole, sums = ([c for c, k in kinds.items() if k == kind] for kind in ("int", "money"))
    found = multiplying(cells[:end], whole, sums, sums, HOLDS)
    if found is None:
        return None
    q, p, a = found
    items = [own for own in cells[:end] if a in own and pennies(own[a]) is not None]
    if not items:
        return None
    number = lambda own, c, read: read(own[c]) if c in own else None
    values = [(number(own, q, whole_number), number(own, p, pennies), pennies(own[a])) for own in items]
    counted = [x for x, _, _ in values if x is not None]
    quantity, amount = sum(counted) if counted else None, sum(z for _, _, z in values)
    products = [x * y == z for x, y, z in values if x is not None and y is not None]
    edge = heads[a][2] if a < len(heads) else None
    # the last row with a total's label, else the last one with an amount; there the amount nearest to its column's end
    near = [(n in labelled, n, b, reads(b[0])[0]) for labelled in [{n for n, own in below if any(bare_label(b[0]) in totals for b in own)}] for n, own in below for b in own if reads(b[0])[0] is not None]
    far = lambda b: -1.0 if edge is None or b[2] is None else abs(b[2] - edge)
    total = min(near, key=lambda x: (not x[0], -x[1], far(x[2])), default=(None,) * 4)[3]
    return len(items), quantity, amount, total, bool(products) and all(products) and total == amount


@lru_cache(KNOWN_TEXTS)
def bare_label(text: str) -> str:
    """A printed label to compare: lower case, without currency, colons and full stops."""
    return _SPACES.sub(" ", _MARKS.sub(" ", text.lower())).strip(" ")


_BOX = {"page": None, "text": "string", "x0": "double", "x1": "double", "top": "double", "bottom": "double"}
Pages = Callable[[Iterator[pa.RecordBatch]], Iterator[list[tuple]]]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of documents (doc, boxes) from boxes that lie together."""
    doc, own, found = None, [], []
    for batch in batches:
        for d, *box in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if d != doc or not own:
                if own:
                    found.append((doc, own))
                doc, own = d, []
            own.append(tuple(box))
        if found:
            yield found
            found = []
    if own:
        yield [(doc, own)]


def by_document(source: DataFrame, read: Callable[[list, pa.DataType], pa.RecordBatch], schema: str, pages: Pages | None = None) -> DataFrame:
    """read() of lists of documents (doc, boxes), each with all its boxes (page, text, x0, x1, top, bottom), and the type of doc, as a table of that schema.

    source has boxes, which are dealt by document; or it has other rows, doc among them, of which pages() makes lists of documents.
    """
    held = source
    if pages is None:
        held = source.select("doc", *[F.col(n).cast(t) if t else F.col(n) for n, t in _BOX.items()]).repartition("doc").sortWithinPartitions("doc")
    listed = pages or _grouped

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("doc").type
                yield batch

        for found in listed(seen()):
            yield read(found, kind)

    return held.mapInArrow(documents, schema)


def decimals(values: list[int | None], digits: int = 14) -> pa.Array:
    """Pennies as decimals with two places."""
    given = np.array([v is not None for v in values], bool)
    low, high = np.array([(v or 0) & 0xFFFFFFFFFFFFFFFF for v in values], np.uint64), np.array([(v or 0) >> 64 for v in values], np.int64)
    return pa.Array.from_buffers(pa.decimal128(digits, 2), len(values), [pa.py_buffer(np.packbits(given, bitorder="little")), pa.py_buffer(np.stack((low, high.view(np.uint64)), 1).ravel())])
