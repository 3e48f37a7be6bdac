"""Forms and masks on pages: labels with values, redaction marks, layout JSON."""

from __future__ import annotations

import difflib
import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.session import with_package

# How like a template's label or print a line must be, and how far (in shares of the page) a value may stand from its label.
ACCEPT, ACCEPT_SHORT, SHORT, CORRECT, PRINT = 0.6, 0.8, 8, 0.75, 0.85
GAP, COLUMN, REACH, LEFT, RISE, FOOT, FOOT_RISE, OVERLAP = 0.035, 0.015, 0.08, 0.03, 0.10, 0.08, 0.01, 0.5
LEAST_LABELS, FOOT_NUMBERS, VALUE_LINES, VALUE_CHARS, REST_CHARS, FOOT_CHARS, VALUE_WORDS, LAST_NUMBER = 3, 3, 3, 200, 60, 60, 4, 30
_NUMBERED = re.compile(r"(\d{2})[.)]?(?:\s+(\S.*))?$", re.S)
_BOX = re.compile("[☐☒]")
_TURN = re.compile(r"(?:Fråga|Svar|[A-ZÅÄÖ](?:[A-ZÅÄÖ .-]{0,28}[A-ZÅÄÖ])?):\s")


@dataclass(frozen=True)
class Template:
    """A printed form: words that tell it, labels by number, other printed labels, fields of free text, and print that is never a value."""

    name: str
    labels: dict[int, str]
    match: tuple[str, ...] = ()
    free: frozenset[int] = frozenset()
    aliases: dict[int, tuple[str, ...]] = field(default_factory=dict)
    printed: tuple[str, ...] = ()

    def names(self, number: int) -> tuple[str, ...]:
        return (self.labels[number], *self.aliases.get(number, ())) if number in self.labels else ()


def template(data: object, where: str = "template") -> Template:
    """A template from its JSON object; whatever is wrong with it is named at once."""

    def wrong(key: str, why: str) -> ValueError:
        return ValueError(f"{where}: {key} {why}")

    def words(key: str) -> tuple[str, ...]:
        v = data.get(key, [])  # type: ignore[attr-defined]
        if not isinstance(v, list) or not all(isinstance(x, str) for x in v):
            raise wrong(key, "must be a list of strings")
        return tuple(v)

    def number(key: str, n: str) -> int:
        if not n.isdigit() or not 1 <= int(n) <= LAST_NUMBER:
            raise wrong(key, f"has {n!r}, which is no field number up to {LAST_NUMBER}")
        return int(n)

    if not isinstance(data, dict):
        raise wrong("it", "must be an object")
    unknown = set(data) - {"name", "match", "labels", "free_text", "aliases", "printed"}
    if unknown:
        raise wrong(min(unknown), "is unknown")
    if not isinstance(data.get("name"), str) or not data["name"].strip():
        raise wrong("name", "is missing")
    if not isinstance(data.get("labels"), dict) or not data["labels"] or not all(isinstance(v, str) and v.strip() for v in data["labels"].values()):
        raise wrong("labels", "must give a text for each number")
    labels = {number("labels", n): v for n, v in data["labels"].items()}
    free = frozenset(number("free_text", n) for n in words("free_text"))
    aliases = data.get("aliases", {})
    if not isinstance(aliases, dict) or not all(isinstance(v, list) and all(isinstance(x, str) for x in v) for v in aliases.values()):
        raise wrong("aliases", "must give a list for each number")
    aliases = {number("aliases", n): tuple(v) for n, v in aliases.items()}
    if (free | set(aliases)) - set(labels):
        raise wrong("free_text or aliases", "names a field that has no label")
    return Template(data["name"], labels, words("match"), free, aliases, words("printed"))


def templates(texts: list[tuple[str, str]]) -> list[Template]:
    """All templates of JSON files (name, content): a list each, or an object with ``templates``."""
    out = []
    for name, text in texts:
        try:
            data = json.loads(text)
        except ValueError as e:
            raise ValueError(f"{name}: no JSON ({e})") from e
        items = data.get("templates") if isinstance(data, dict) else data
        if not isinstance(items, list):
            raise ValueError(f"{name}: templates must be a list")
        out += [template(t, f"{name}, template {i}") for i, t in enumerate(items)]
    return out


def _flat(s: str) -> str:
    return " ".join(s.replace("*", "").replace("|", "I").lower().split())


def label_key(s: str) -> str:
    """A label as it is compared: without explanations in brackets, asterisks and case."""
    return _flat(re.sub(r"\s*\([^()]*\s[^()]*\)", "", re.sub(r"\s*\([^()]*\)\s*$", "", s.replace("*", ""))))


def similarity(a: str, b: str) -> float:
    """Likeness of whole labels; a line that only begins like one is not like it."""
    x, y = label_key(a), label_key(b)
    return difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0


def likeness(t: Template, number: int, raw: str) -> float:
    """How like a line is to the label or an alias of a number, 0 if it isn't accepted as one (short labels must be more alike)."""
    scores = [(similarity(raw, c), ACCEPT_SHORT if len(label_key(c)) < SHORT else ACCEPT) for c in t.names(number)]
    return max((s for s, least in scores if s >= least), default=0.0)


def is_printed(text: str, t: Template) -> bool:
    """Whether a line is print of the form, as a whole or in each part between upright rules."""

    def one(s: str) -> bool:
        return bool(_flat(s)) and any(difflib.SequenceMatcher(None, _flat(s), _flat(p)).ratio() >= PRINT for p in t.printed)

    parts = [x for x in text.split("|") if x.strip()]
    return one(text) or "|" in text and bool(parts) and all(map(one, parts))


def label_match(raw: str, label: str) -> tuple[float, str]:
    """Likeness of a line's best beginning to a label, and what follows it (also where it is written on, as in 'Avsnitt12'); of equal ones the shorter.

    The last word of the beginning must belong to the label by half its letters, so a
    value isn't taken for its end.
    """
    want, best = _flat(label), (0.0, raw)
    cuts = [i for i in range(1, len(raw)) if raw[i].isspace() or raw[i] in "(:;,." or raw[i - 1].isalpha() and raw[i].isdigit()] + [len(raw)]
    for cut in cuts:
        head = _flat(raw[:cut])
        if not head:
            continue
        m = difflib.SequenceMatcher(None, want, head, autojunk=False)
        last = head.rsplit(" ", 1)[-1]
        inside = sum(max(0, b.b + b.size - max(b.b, len(head) - len(last))) for b in m.get_matching_blocks())
        if m.ratio() > best[0] and inside * 2 >= len(last):
            best = (m.ratio(), raw[cut:].strip(" :;,."))
    return best


def value_like(text: str) -> bool:
    """Whether a line looks filled in: with a digit, or few words of which one has a capital and at most one has none; no sentence ends within."""
    words = text.split()
    if not words or re.search(r"[!?;]\s+\S|[.:]\s+[a-zåäöéü]", text):
        return False
    small = sum(w[0].isalpha() and w[0].islower() for w in words)
    return any(map(str.isdigit, text)) or len(words) <= VALUE_WORDS and any(w[0].isupper() for w in words) and small <= 1


@dataclass(eq=False)
class Line:
    """A line of a block with its place; a label once it has a number."""

    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    width: float  # of a character
    number: int | None = None
    label: str = ""
    below: Line | None = None  # the line that bears a lone number's label
    value: list[str] = field(default_factory=list)
    options: list[tuple[str, bool]] = field(default_factory=list)

    @property
    def right(self) -> float:
        return min(self.x1, self.x0 + len(self.text) * self.width) if self.width else self.x1


def lines_of(blocks: list[dict]) -> list[Line]:
    """The lines of the blocks that have a place, each as high as the others of its block."""
    out = []
    for b in blocks:
        lines = [x for x in (b.get("text") or "").split("\n")]
        if not b.get("bbox") or b.get("rows") is not None or b.get("kind") in ("PAGE_FOOTER", "CODE", "FORMULA", "FIGURE"):
            continue
        x0, y0, x1, y1 = map(float, b["bbox"])
        step, w = (y1 - y0) / len(lines), (x1 - x0) / max(1, *map(len, lines))
        out += [Line(s.strip(), x0, y0 + i * step, x1, y0 + (i + 1) * step, w) for i, s in enumerate(lines) if s.strip()]
    return out


def same_row(a: Line, b: Line) -> bool:
    """Whether two lines overlap upright by half the lower one."""
    low = min(a.y1 - a.y0, b.y1 - b.y0)
    return low > 0 and min(a.y1, b.y1) - max(a.y0, b.y0) >= OVERLAP * low


def _same_column(a: Line, b: Line, slack: float) -> bool:
    return a.x0 <= b.x1 + slack and b.x0 <= a.x1 + slack


def _two_labels(e: Line, n: int, rest: str, t: Template) -> list[Line]:
    """'05 datum 06 klockan' as two labels, parted where the second number stands."""
    for m in re.finditer(r"(?<=\s)(\d{2})\s+(?=\S)", rest):
        k, left, right = int(m[1]), rest[: m.start()].strip(), rest[m.end() :].strip()
        if k > n and likeness(t, n, left) and likeness(t, k, right):
            x = min(max(e.x0 + (len(e.text) - len(rest) + m.start()) * e.width, e.x0 + 1), e.x1 - 1)
            return [replace(e, x1=x, number=n, label=left, value=[], options=[]), replace(e, x0=x, number=k, label=right, value=[], options=[])]
    return []


def labels_of(lines: list[Line], t: Template, width: float) -> tuple[list[Line], list[Line]]:
    """Labels among the lines, and lines that begin with a field's number but aren't its label (no value goes past them)."""
    labels, barriers, slack = [], [], COLUMN * width
    for e in lines:
        m = _NUMBERED.match(e.text)
        if not m:
            continue
        n, rest = int(m[1]), m[2] or ""
        second = _NUMBERED.match(rest)
        if second and second[2] and n in t.labels and likeness(t, int(second[1]), second[2]):
            labels += [replace(e, number=n, label="", value=[], options=[]), replace(e, number=int(second[1]), label=second[2], value=[], options=[])]
        elif rest and (pair := _two_labels(e, n, rest, t)):
            labels += pair
        elif rest and (likeness(t, n, rest) or any(label_match(rest, c)[0] >= max(CORRECT, ACCEPT_SHORT if len(label_key(c)) < SHORT else 0) and len(label_match(rest, c)[1]) <= REST_CHARS for c in t.names(n))):
            labels.append(replace(e, number=n, label=rest, value=[], options=[]))
        elif not rest and (under := min((x for x in lines if x.y0 >= e.y1 - 1 and _same_column(e, x, slack)), key=lambda x: x.y0, default=None)) and likeness(t, n, _BOX.sub("", under.text)):
            labels.append(replace(e, number=n, label="", below=under, value=[], options=[]))
        elif n in t.labels:
            barriers.append(e)
    for e in lines:  # another printed label of a field beside its number
        if not _NUMBERED.match(e.text) and not any(x.below is e for x in labels):
            beside = next((x for x in labels if same_row(x, e) and e.x0 >= x.x0 + 1 and any(similarity(e.text, c) >= ACCEPT_SHORT for c in t.aliases.get(x.number or 0, ()))), None)
            if beside:
                labels.append(replace(e, number=beside.number, label=e.text, value=[], options=[]))
    return labels, barriers


def order_outliers(labels: list[tuple[int, float, float]], rise: float = 0.0, column: float = float("inf")) -> set[int]:
    """Places of the labels (number, x, y) that break the order of their numbers: a higher number more than ``rise`` above a lower one.

    The one with most violations goes first, until none is left; of equals the one
    furthest in number from its neighbours in its column, then from its neighbours in
    number by height, then the highest number.
    """
    left, out = dict(enumerate(labels)), set()

    def breaks(a: tuple, b: tuple) -> bool:
        return a[0] > b[0] and b[2] - a[2] > rise or b[0] > a[0] and a[2] - b[2] > rise

    def rank(i: int) -> tuple:
        e = left[i]
        others = [o for j, o in left.items() if j != i]
        near = [o for o in others if abs(o[1] - e[1]) <= column]
        above, below = max((o for o in near if o[2] < e[2]), key=lambda o: o[2], default=None), min((o for o in near if o[2] > e[2]), key=lambda o: o[2], default=None)
        cost = (above[0] - e[0] if above and above[0] >= e[0] else 0) + (e[0] - below[0] if below and below[0] <= e[0] else 0)
        peers = [o for o in others if not breaks(e, o)]
        ends = [max((o[0] for o in peers if o[0] < e[0]), default=None), min((o[0] for o in peers if o[0] > e[0]), default=None)]
        gap = min((abs(o[2] - e[2]) for o in peers if o[0] in ends), default=float("inf"))
        return sum(breaks(e, o) for o in others), cost, gap, e[0]

    while left:
        worst = max(left, key=rank)
        if not rank(worst)[0]:
            break
        del left[worst]
        out.add(worst)
    return out


def footer_outliers(labels: list[Line], last_free: int, height: float) -> list[Line]:
    """Labels numbered above the free text that don't make a footer: a close, strictly ordered group of at least FOOT_NUMBERS numbers at the foot; of a repeated number the lower one stays."""
    foot = [e for e in labels if (e.number or 0) > last_free]
    if not foot:
        return []
    low = max(e.y0 for e in foot)
    near = [e for e in foot if e.y0 >= low - FOOT * height]
    bad = {id(near[i]) for i in order_outliers([(e.number or 0, e.x0, e.y0) for e in near], FOOT_RISE * height)}
    kept: dict[int, Line] = {}
    for e in sorted((e for e in near if id(e) not in bad), key=lambda e: e.y0):
        kept[e.number or 0] = e
    return [e for e in foot if len(kept) < FOOT_NUMBERS or not any(e is k for k in kept.values())]


def extract(blocks: list[dict], t: Template, height: float | None = None) -> tuple[list[dict], list[str]]:
    """Fields of a form (``number``, ``label``, ``value``, ``checked``, ``source``) and the lines that belong to none.

    Labels are found by number and likeness, those out of order and loose footers are
    dropped. A value is what follows the label in its line, else up to VALUE_LINES short
    lines below it in its column (a line over several empty columns is parted at words if
    each part looks like a value), else a line beside it. Lines with boxes below a label
    are its options. Print, speech and rejected labels are never values.
    """
    lines = lines_of(blocks)
    if not lines:
        return [], []
    height, width = height or max(e.y1 for e in lines), max(e.x1 for e in lines)
    labels, barriers = labels_of(lines, t, width)
    free = [e for e in labels if e.number in t.free]
    if free:
        top = min(free, key=lambda e: e.y0)
        labels = [e for e in labels if e in free or not (e.y0 > top.y0 and (e.number or 0) <= (top.number or 0))]
    bad = order_outliers([(e.number or 0, e.x0, e.y0) for e in labels], RISE * height, COLUMN * width + max((e.x1 - e.x0 for e in labels), default=0))
    labels = [e for i, e in enumerate(labels) if i not in bad]
    if t.free:
        out = footer_outliers(labels, max(t.free), height)
        labels = [e for e in labels if not any(e is x for x in out)]
    taken = {id(e.below) for e in labels if e.below is not None}
    label_at = {(e.y0, x.x0) for e in labels for x in (e,)}
    texts = [e for e in lines if id(e) not in taken and (e.y0, e.x0) not in label_at]
    texts = [e for e in texts if not any(e.text == x.text and e.y0 == x.y0 and x.x0 >= e.x0 and x.x1 <= e.x1 for x in labels)]
    labels.sort(key=lambda e: (e.y0, e.x0))
    done: set[int] = set()

    def stops(e: Line) -> bool:
        return e in barriers or is_printed(e.text, t) or _TURN.match(e.text) is not None or len(e.text) > VALUE_CHARS

    def column(e: Line) -> tuple[float, float]:
        after = [x.x0 for x in labels if x is not e and same_row(x, e) and x.x0 > e.x0]
        return e.x0 - LEFT * width, min([*after, e.right + max(REACH * width, e.x1 - e.right)])

    for e in labels:
        score, rest = max((label_match(e.label, c) for c in t.names(e.number or 0)), default=(0.0, ""))
        if rest and score >= CORRECT and len(rest) <= REST_CHARS and not is_printed(rest, t) and not _NUMBERED.fullmatch(rest) and e.number not in t.free:
            e.value = [rest]
    for e in labels:
        if e.number in t.free:
            continue
        lo, hi = column(e)
        bottom = (e.below or e).y1
        for x in sorted(texts, key=lambda x: (x.y0, x.x0)):
            if id(x) in done or x.y0 < bottom - 0.3 * (x.y1 - x.y0) or x.y0 - bottom > GAP * height:
                continue
            middle = (x.x0 + x.right) / 2
            if stops(x) or any(bottom - 1 <= y.y0 <= x.y0 and y is not e and _same_column(y, x, 0) and not same_row(y, e) for y in labels):
                if lo <= middle < hi:
                    break
                continue
            if _BOX.match(x.text) and lo <= x.x0 < hi:
                e.options += [(s.strip(), mark == "☒") for mark, s in re.findall("([☐☒])([^☐☒]*)", x.text)]
                done.add(id(x))
                bottom = x.y1
            elif not e.value or len(e.value) < VALUE_LINES and bottom != (e.below or e).y1:
                row = [y for y in labels if same_row(y, e) and not y.value and y.number not in t.free]
                parts = _parted(x, row, column)
                if parts:
                    for y, text in parts.items():
                        y.value.append(text)
                    done.add(id(x))
                elif lo <= middle < hi and x.x0 >= lo and (len(row) < 2 or value_like(x.text)):
                    e.value.append(x.text)
                    done.add(id(x))
                    bottom = x.y1
    for e in labels:
        if not e.value and not e.options and e.number not in t.free:
            lo, hi = column(e)
            beside = [x for x in texts if id(x) not in done and same_row(x, e) and e.right <= x.x0 <= min(hi, e.right + REACH * width) and value_like(x.text) and not stops(x)]
            if beside:
                x = min(beside, key=lambda x: x.x0)
                done.add(id(x))
                e.value = [x.text]
    fields = []
    for e in labels:
        raw = e.label or (e.below.text if e.below else "")
        score, rest = max((label_match(raw, c) for c in t.names(e.number or 0)), default=(0.0, ""))
        shown = t.labels[e.number or 0] if score >= CORRECT else raw
        value = " ".join(e.value)
        lost = rest if rest and rest not in value and score >= CORRECT else ""
        fields.append({"number": f"{e.number:02d}", "label": shown, "value": value, "checked": None, "source": lost})
        fields += [{"number": None, "label": s, "value": "", "checked": on, "source": ""} for s, on in e.options]
    return fields, [x.text for x in texts if id(x) not in done]


def _parted(x: Line, row: list[Line], column) -> dict[Line, str]:
    """A line below several empty labels of one row, parted by the columns its words begin in; nothing unless it reaches into two and each part looks like a value."""
    if len(row) < 2 or not x.width:
        return {}
    parts: dict[Line, list[str]] = {}
    for m in re.finditer(r"\S+", x.text):
        at = x.x0 + (m.start() + len(m[0]) / 2) * x.width
        home = next((y for y in row if column(y)[0] <= at < column(y)[1]), None)
        if home is None:
            return {}
        parts.setdefault(home, []).append(m[0])
    digits = any(map(str.isdigit, x.text))
    good = all(value_like(" ".join(w)) or digits and len(w) == 1 and w[0].isalpha() and len(w[0]) < SHORT for w in parts.values())
    return {y: " ".join(w) for y, w in parts.items()} if len(parts) > 1 and good else {}


def table_fields(rows: list[list[str]], t: Template) -> tuple[list[dict], list[str]] | None:
    """Fields of a table in which every cell is a label or the value below one, and the texts of free fields; None for any other table."""
    used, fields, free = set(), [], []

    def cell(r: int, c: int) -> str:
        return rows[r][c].strip() if r < len(rows) and c < len(rows[r]) else ""

    for r, row in enumerate(rows):
        for c in range(len(row)):
            m = _NUMBERED.match(cell(r, c))
            if not m or (r, c) in used or not likeness(t, int(m[1]), m[2] or cell(r + 1, c)):
                continue
            n, under = int(m[1]), cell(r + (1 if m[2] else 2), c)
            used |= {(r, c)} | (set() if m[2] else {(r + 1, c)})
            value = under if under and not _NUMBERED.match(under) and not is_printed(under, t) else ""
            if value:
                used.add((r + (1 if m[2] else 2), c))
            if value and n in t.free:
                free.append(value)
                value = ""
            fields.append({"number": f"{n:02d}", "label": t.labels[n], "value": value, "checked": None, "source": ""})
    cells = {(r, c) for r, row in enumerate(rows) for c, s in enumerate(row) if s.strip()}
    return (fields, free) if fields and cells <= used else None


def choose_template(texts: list[str], known: list[Template]) -> Template | None:
    """The template whose words stand on the page and that accepts most of its numbered lines, at least LEAST_LABELS; of equals the more alike, then the first."""
    page = " ".join(texts).upper()
    numbered = [(int(m[1]), m[2]) for s in texts for x in s.split("\n") if (m := _NUMBERED.match(x.strip())) and m[2]]
    best: tuple[tuple, Template] | None = None
    for i, t in enumerate(known):
        if all(w.upper() in page for w in t.match):
            scores = [s for n, x in numbered if (s := likeness(t, n, x) or max((label_match(x, c)[0] for c in t.names(n) if label_match(x, c)[0] >= CORRECT), default=0.0))]
            rank = (len(scores), sum(scores) / max(1, len(scores)), -i)
            if len(scores) >= LEAST_LABELS and (best is None or rank > best[0]):
                best = (rank, t)
    return best[1] if best else None


def read_form(blocks: list[dict], known: list[Template], height: float | None = None) -> tuple[str | None, list[dict], list[str]]:
    """Template, fields and other texts of a page, from its lines and its tables."""
    rows = [[[c["text"] or "" for c in r] for r in b["rows"]] for b in blocks if b.get("rows") is not None]
    texts = [b.get("text") or "" for b in blocks] + [c for table in rows for r in table for c in r]
    t = choose_template(texts, known)
    if t is None:
        return None, [], [x for x in texts if x]
    fields, left = extract(blocks, t, height)
    for table in rows:
        got = table_fields(table, t)
        if got:
            fields += got[0]
            left += got[1]
    return t.name, fields, left


def form_fields(pages: DataFrame, keys: list[str], blocks: str, known: list[Template], height: str | None = None) -> DataFrame:
    """keys, ``template``, ``place``, ``number``, ``label``, ``value``, ``checked`` of every field of every form page; ``blocks`` as in layout.BLOCK (text and bbox at least)."""
    with_package(pages.sparkSession)

    def one(bs: list | None, h: float | None) -> dict | None:
        name, fields, _ = read_form([b.asDict(True) if hasattr(b, "asDict") else dict(b) for b in bs or []], known, h)
        return {"template": name, "fields": [{k: f[k] for k in ("number", "label", "value", "checked")} for f in fields]} if name else None

    read = F.udf(one, "struct<template:string,fields:array<struct<number:string,label:string,value:string,checked:boolean>>>", useArrow=True)
    h = F.col(height).cast("double") if height else F.lit(None).cast("double")
    got = pages.select(*keys, read(F.col(blocks), h).alias("f")).where("f is not null")
    return got.select(*keys, "f.template", F.posexplode("f.fields").alias("place", "x")).select(*keys, "template", "place", "x.number", "x.label", "x.value", "x.checked")


def insert_masks(lines: Column, middles: Column, height: Column) -> Column:
    """Marks put among lines by height: ``middles`` are the marks' heights in pixels of a page ``height`` high."""
    n = F.size(lines)
    spots = F.transform(middles, lambda m: F.greatest(F.lit(0), F.least(n, F.bround(m / height * n, 0).cast("int"))))
    rows = F.concat(
        F.transform(lines, lambda s, i: F.struct((i + 1).cast("double").alias("at"), s.alias("s"))),
        F.transform(spots, lambda p: F.struct((p + 0.5).cast("double").alias("at"), F.lit(T.MASK).alias("s"))),
    )
    return F.when((F.size(middles) > 0) & (height > 0), F.array_join(F.transform(F.array_sort(rows), lambda r: r["s"]), "\n")).otherwise(F.array_join(lines, "\n"))


def overlaps(box: Column, other: Column) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share an area."""
    return (F.least(box[2], other[2]) > F.greatest(box[0], other[0])) & (F.least(box[3], other[3]) > F.greatest(box[1], other[1]))


def usage_fields(raw: Column) -> Column:
    """Token counts of a provider's usage report, whichever of the two usual shapes it has."""
    r = F.from_json(raw, "struct<prompt_tokens:long,completion_tokens:long,input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long,prompt_cache_hit_tokens:long,prompt_tokens_details:struct<cached_tokens:long>>")
    zero = lambda c: F.coalesce(r[c], F.lit(0))
    return F.struct(
        F.coalesce(r["prompt_tokens"], zero("input_tokens") + zero("cache_creation_input_tokens") + zero("cache_read_input_tokens")).alias("input"),
        F.coalesce(r["completion_tokens"], r["output_tokens"], F.lit(0)).alias("output"),
        F.coalesce(r["prompt_cache_hit_tokens"], r["prompt_tokens_details"]["cached_tokens"], r["cache_read_input_tokens"], F.lit(0)).alias("cached"),
    )


def header_fields(text: Column, labels: tuple[str, ...]) -> Column:
    """Metadata lines at a text's beginning as ``label``, ``value``; lines without a label go on with the one before; ends at the first empty line."""

    def read(t: str | None) -> list[dict]:
        out: list[dict] = []
        for line in (t or "").split("\n"):
            s = line.strip()
            if not s:
                break
            hit = next((x for x in sorted(labels, key=len, reverse=True) if s.lower().startswith(x.lower())), None)
            if hit:
                out.append({"label": hit, "value": s[len(hit) :].lstrip(" :")})
            elif out:
                out[-1]["value"] = f"{out[-1]['value']} {s}".strip()
            else:
                break
        return out

    return F.udf(read, "array<struct<label:string,value:string>>", useArrow=True)(text)
