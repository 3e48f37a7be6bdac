"""Layout of pages: blocks read from HTML, their text and Markdown, stored layouts, masks.

A block is a struct (see BLOCK). Reading HTML needs a parser and runs in Arrow batches;
all else is Column expressions over arrays of blocks.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.session import with_package

CELL = "struct<text:string,header:boolean,row_span:int,col_span:int>"
FIELD = "struct<number:string,label:string,value:string,checked:boolean,source:string>"
BLOCK = f"struct<kind:string,text:string,order:int,bbox:array<int>,level:int,rows:array<array<{CELL}>>,latex:string,fields:array<{FIELD}>,parts:array<array<int>>>"
# Kinds of blocks by the label a layout model gives, signs of boxes, limits.
KINDS = {
    "SectionHeader": "HEADING", "Text": "PARAGRAPH", "Bibliography": "PARAGRAPH", "ListGroup": "LIST_ITEM", "Table": "TABLE", "TableOfContents": "TABLE", "Form": "FORM", "Equation": "FORMULA", "Code": "CODE", "Caption": "CAPTION",
    "Footnote": "FOOTNOTE", "PageHeader": "PAGE_HEADER", "PageFooter": "PAGE_FOOTER", "Picture": "FIGURE", "Figure": "FIGURE", "Diagram": "FIGURE", "ChemicalBlock": "FIGURE",
}
BOX_OFF, BOX_ON, MAX_SPAN, HEADER_CHARS, OLD_DPI, LEVEL = "☐", "☒", 50, 200, 300, 2
_NEW_LINE = frozenset("p div ul ol li table tr h1 h2 h3 h4 h5 h6 section article blockquote pre caption thead tbody tfoot".split())
_SILENT = frozenset(("script", "style"))


class _Reader(HTMLParser):
    """One pass over a block's HTML: its lines, and apart the rows of its first table, list items, mathematics and what stands outside them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.rows: list[list[dict]] = []
        self.caption: list[str] = []
        self.before: list[str] = []
        self.after: list[str] = []
        self.items: list[tuple[bool, list[str]]] = []
        self.math: list[list[str]] = []
        self.unmath: list[str] = []
        self.level: int | None = None
        self.silent = self.tables = self.lists = self.maths = self.raw = 0
        self.cell: list[str] | None = None
        self.in_caption = self.table_done = False

    def _say(self, s: str) -> None:
        if self.silent:
            return
        self.text.append(s)
        if self.maths:
            self.math[-1].append(s)
        else:
            self.unmath.append(s)
        if self.lists:
            self.items[-1][1].append(s)
        elif not self.items or self.items[-1][0]:
            self.items.append((False, [s]))
        else:
            self.items[-1][1].append(s)
        if self.tables:
            if self.cell is not None:
                self.cell.append(s)
            elif self.in_caption:
                self.caption.append(s)
            elif self.tables == 1:
                self.after.append(s)
        else:
            (self.after if self.table_done else self.before).append(s)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        if tag in _SILENT:
            self.silent += 1
        elif tag == "br":
            self._say("\n")
        elif tag == "input" and a.get("type") == "checkbox":
            self._say(BOX_ON if "checked" in a else BOX_OFF)
        elif tag == "table":
            self.tables += 0 if self.table_done else 1
        elif tag == "caption" and self.tables == 1:
            self.in_caption = True
        elif tag == "tr" and self.tables == 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.tables == 1:
            if not self.rows:
                self.rows.append([])
            self.cell = []
            self.rows[-1].append({"text": "", "header": tag == "th", "row_span": _span(a.get("rowspan")), "col_span": _span(a.get("colspan"))})
        elif tag == "math":
            self.maths += 1
            self.math.append([])
        elif re.fullmatch("h[1-6]", tag) and self.level is None:
            self.level = int(tag[1])
        if tag == "li":
            self.lists += 1
            if self.lists == 1:
                self.items.append((True, []))
        if tag in _NEW_LINE:
            self._say("\n")
        self.raw += tag in ("pre", "code")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in ("td", "th"):
            if self.tables == 1 and self.cell is not None:
                self.rows[-1][-1]["text"] = _flat("".join(self.cell))
                self.cell = None
            self._say(" ")
        elif tag == "math":
            self.maths = max(0, self.maths - 1)
        elif tag == "caption":
            self.in_caption = False
        elif tag == "table" and self.tables:
            self.tables -= 1
            self.table_done = self.tables == 0
        if tag in _NEW_LINE:
            self._say("\n")
        if tag == "li" and self.lists:
            self.lists -= 1
        self.raw -= tag in ("pre", "code") and self.raw > 0

    def handle_data(self, data: str) -> None:
        self._say(data if self.raw else re.sub(r"\s+", " ", data))


def _span(value: str | None) -> int:
    return max(1, min(MAX_SPAN, int(value))) if value and value.strip().isdigit() else 1


def _flat(s: str) -> str:
    return " ".join(s.split())


def _lines(parts: list[str]) -> str:
    return "\n".join(x for x in (re.sub(r"[ \t]+", " ", s).strip() for s in "".join(parts).split("\n")) if x)


def read_block(label: str | None, source: str | None, bbox: list | None) -> tuple[list[dict], bool]:
    """Blocks that one raw block's HTML holds, and whether something was lost: a table's caption and loose text, a list's items and mathematics are blocks of their own."""
    r = _Reader()
    r.feed(source or "")
    r.close()
    kind = KINDS.get(label or "", "PARAGRAPH")
    box = [int(round(float(v))) for v in bbox] if bbox and len(bbox) == 4 and all(isinstance(v, (int, float)) and v == v and abs(v) < 2**31 for v in bbox) else None
    make = lambda k, text, **more: {"kind": k, "text": text, "bbox": box, "level": None, "rows": None, "latex": None, "fields": None, "parts": None, **more}
    text = _lines(r.text)
    if kind == "HEADING":
        return [make(kind, text, level=r.level or LEVEL)], False
    if kind == "LIST_ITEM" and any(is_item for is_item, _ in r.items):
        return [make(kind if is_item else "PARAGRAPH", _lines(x)) for is_item, x in r.items if _lines(x)], False
    if kind in ("TABLE", "FORM"):
        if not any(c["text"] for row in r.rows for c in row):
            return [make("FORM" if kind == "FORM" else "PARAGRAPH", text)], kind == "TABLE" and label == "Table"
        out = [make("PARAGRAPH", _lines(r.before)), make("CAPTION", _lines(r.caption)), make(kind, "\n".join("\t".join(c["text"] for c in row) for row in r.rows), rows=r.rows), make("PARAGRAPH", _lines(r.after))]
        return [b for b in out if b["text"]], False
    if kind == "FORMULA":
        maths = [m for m in map(_lines, r.math) if m]
        rest = _lines(r.unmath)
        return ([make(kind, "\n".join(maths), latex="\n".join(maths)), *([make("PARAGRAPH", rest)] if rest else [])] if maths else [make(kind, text, latex=text)]), False
    if kind == "CODE":
        return [make(kind, "".join(r.text).strip("\n").rstrip())], False
    return [make(kind, text)], False


def read_page(raw: list[dict] | None) -> dict:
    """Raw blocks of a page (``label``, ``html``, ``bbox``, ``reading_order``) in reading order, those without one last, empty ones gone."""

    def order(b: dict) -> tuple[bool, int]:
        o = b.get("reading_order")
        return (True, 0) if isinstance(o, bool) or not isinstance(o, (int, float)) or o != o or abs(o) == float("inf") else (False, int(o))

    out: list[dict] = []
    degraded = False
    for b in sorted((x for x in raw or () if isinstance(x, dict)), key=order):
        found, bad = read_block(b.get("label"), b.get("html"), b.get("bbox"))
        degraded |= bad
        out += [x for x in found if x["text"].strip()]
    return {"blocks": [{**b, "order": i} for i, b in enumerate(out)], "degraded": degraded}


def parsed(df: DataFrame, keys: list[str], raw: str) -> DataFrame:
    """keys, ``blocks``, ``degraded`` of pages with raw blocks as JSON; null and broken JSON give no blocks."""
    with_package(df.sparkSession)

    def one(s: str | None) -> dict:
        try:
            items = json.loads(s) if s else []
        except ValueError:
            items = []
        return read_page(items if isinstance(items, list) else [])

    page = F.udf(one, f"struct<blocks:array<{BLOCK}>,degraded:boolean>", useArrow=True)
    return df.select(*keys, page(F.col(raw)).alias("p")).select(*keys, "p.blocks", "p.degraded")


# ---- text and Markdown of blocks -------------------------------------------------


def fields_text(fields: Column) -> Column:
    """Fields as lines 'number label: value' (with the raw line below where it was rewritten), options with their boxes."""

    def line(f: Column) -> Column:
        head = F.concat_ws(" ", F.nullif(f["number"], F.lit("")), f["label"])
        named = F.concat(head, F.lit(": "), F.coalesce(f["value"], F.lit("")), F.when(F.coalesce(f["source"], F.lit("")) != "", F.concat(F.lit("\n"), f["source"])).otherwise(""))
        return F.when(f["checked"].isNotNull(), F.concat(F.when(f["checked"], BOX_ON).otherwise(BOX_OFF), F.lit(" "), f["label"])).otherwise(named)

    return F.array_join(F.transform(fields, line), "\n")


def block_text(b: Column) -> Column:
    return F.when(b["fields"].isNotNull(), fields_text(b["fields"])).otherwise(b["text"])


def page_text(blocks: Column) -> Column:
    """Text of all blocks, a line feed between."""
    return F.array_join(F.filter(F.transform(blocks, block_text), lambda t: t != ""), "\n")


def escaped(t: Column) -> Column:
    """Lines that Markdown would take for headings, quotes, lists or rules, escaped."""
    return F.regexp_replace(t, r"(?m)^(?=#|>|[-*+] |\d+\. |=+\s*$|-+\s*$|(?:[-*_]\s*){3,}$)", r"\\")


def _cell(t: Column) -> Column:
    return F.replace(T.squeeze(t), F.lit("|"), F.lit("\\|"))


def table_markdown(rows: Column) -> Column:
    """Rows of cells as a Markdown table; a cell over several columns or rows leaves the others empty."""
    # The column of each cell: a running position that skips what cells above reach down into.
    start = F.array().cast("array<struct<r:int,c:int,h:int,w:int,t:string>>")

    def place(acc: Column, row: Column, r: Column) -> Column:
        def one(a: Column, cell: Column) -> Column:
            mine = F.filter(a, lambda x: (x["r"] <= r) & (r < x["r"] + x["h"]))
            at = F.coalesce(F.array_max(F.transform(F.filter(mine, lambda x: x["r"] == r), lambda x: x["c"] + x["w"])), F.lit(0))
            free = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.size(mine) * MAX_SPAN), lambda k: at + k), lambda k: ~F.exists(mine, lambda x: (x["c"] <= k) & (k < x["c"] + x["w"]))))
            return F.concat(a, F.array(F.struct(r.alias("r"), free.cast("int").alias("c"), cell["row_span"].alias("h"), cell["col_span"].alias("w"), _cell(cell["text"]).alias("t"))))

        return F.aggregate(row, acc, one)

    numbered = F.transform(rows, lambda row, i: F.struct(row.alias("row"), i.alias("i")))
    placed = F.aggregate(numbered, start, lambda acc, x: place(acc, x["row"], x["i"]))
    width = F.array_max(F.transform(placed, lambda x: x["c"] + x["w"]))
    lines = F.transform(
        F.sequence(F.lit(0), F.size(rows) - 1),
        lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.coalesce(F.get(F.transform(F.filter(placed, lambda x: (x["r"] == r) & (x["c"] == c)), lambda x: x["t"]), F.lit(0)), F.lit(""))), " | "), F.lit(" |")),
    )
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(width > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, 2, F.greatest(F.size(rows) - 1, F.lit(0)))), "\n")).otherwise("")


def form_markdown(fields: Column) -> Column:
    """Fields with a value, and options of those with one ticked; the rest of a form is left out."""
    clean = lambda t: F.replace(escaped(T.squeeze(F.coalesce(t, F.lit("")))), F.lit("|"), F.lit("\\|"))
    n = F.size(fields)
    at = F.transform(fields, lambda f, i: F.struct(f.alias("f"), i.alias("i")))

    def options(i: Column) -> Column:
        """The options after position ``i`` up to the next field."""
        end = F.coalesce(F.array_min(F.transform(F.filter(at, lambda x: (x["i"] > i) & x["f"]["checked"].isNull()), lambda x: x["i"])), n)
        return F.filter(at, lambda x: (x["i"] > i) & (x["i"] < end))

    def lines(opts: Column) -> Column:
        return F.transform(opts, lambda o: F.rtrim(F.concat(F.lit("  - ["), F.when(o["f"]["checked"], "x").otherwise(" "), F.lit("] "), clean(o["f"]["label"]))))

    def group(x: Column) -> Column:
        opts = options(x["i"])
        head = F.rtrim(F.concat(F.lit("- **"), clean(F.concat_ws(" ", F.nullif(x["f"]["number"], F.lit("")), x["f"]["label"])), F.lit(":** "), clean(x["f"]["value"])))
        shown = (F.trim(F.coalesce(x["f"]["value"], F.lit(""))) != "") | F.exists(opts, lambda o: o["f"]["checked"])
        return F.when(shown, F.concat(F.array(head), lines(opts))).otherwise(F.array().cast("array<string>"))

    loose = options(F.lit(-1))
    first = F.when(F.exists(loose, lambda o: o["f"]["checked"]), lines(loose)).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(first, F.flatten(F.transform(F.filter(at, lambda x: x["f"]["checked"].isNull()), group))), "\n")


def block_markdown(b: Column) -> Column:
    """One block as Markdown."""
    kind, text = b["kind"], b["text"]
    fence = F.rpad(F.lit(""), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("(`+)"), 1), lambda x: F.length(x))), F.lit(0)) + 1), "`")
    return (
        F.when(kind == "HEADING", F.concat(F.repeat(F.lit("#"), F.coalesce(b["level"], F.lit(LEVEL))), F.lit(" "), T.squeeze(text)))
        .when(kind == "LIST_ITEM", F.concat(F.lit("- "), F.replace(escaped(text), F.lit("\n"), F.lit("\n  "))))
        .when((kind == "FORM") & b["fields"].isNotNull(), form_markdown(b["fields"]))
        .when(kind.isin("TABLE", "FORM") & b["rows"].isNotNull(), table_markdown(b["rows"]))
        .when(kind == "FORMULA", F.concat(F.lit("$$\n"), F.coalesce(b["latex"], text), F.lit("\n$$")))
        .when(kind == "CODE", F.concat(fence, F.lit("\n"), text, F.lit("\n"), fence))
        .when(kind == "CAPTION", F.concat(F.lit("*Bildtext:* "), escaped(text)))
        .when(kind == "FOOTNOTE", F.concat(F.lit("*Fotnot:* "), escaped(text)))
        .otherwise(escaped(text))
    )


# How a speaker's turn begins.
TURN = r"^(F|S|FL|M|J|[A-ZÅÄÖ]{1,3}|Fråga|Svar)\s*[:;]\s*"


def dialogue_markdown(text: Column) -> Column:
    """A paragraph as turns with their speakers in bold; as it is where nobody speaks."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.when(s.rlike(TURN), F.concat(F.lit("\x01**"), F.regexp_extract(s, TURN, 1), F.lit(":** "), escaped(F.regexp_replace(s, TURN, "")))).otherwise(escaped(s)))
    turns = F.filter(F.split(F.array_join(lines, "\n"), "\n?\x01"), lambda t: F.trim(t) != "")
    return F.array_join(F.transform(turns, lambda t: F.rtrim(t)), "\n\n")


def page_markdown(blocks: Column) -> Column:
    """Blocks as one Markdown text: page headers in a first line (at most HEADER_CHARS), footers left out, turns in bold."""
    headers = F.transform(F.filter(blocks, lambda b: (b["kind"] == "PAGE_HEADER") & (F.trim(b["text"]) != "")), lambda b: T.squeeze(b["text"]))
    head = F.when(F.size(headers) > 0, F.array(F.concat(F.lit("> Sidhuvud: "), F.substring(F.array_join(headers, " · "), 1, HEADER_CHARS)))).otherwise(F.array().cast("array<string>"))
    body = F.transform(F.filter(blocks, lambda b: ~b["kind"].isin("PAGE_HEADER", "PAGE_FOOTER")), lambda b: F.when((b["kind"] == "PARAGRAPH") & b["text"].rlike(f"(?m){TURN}"), dialogue_markdown(b["text"])).otherwise(block_markdown(b)))
    return F.array_join(F.filter(F.concat(head, body), lambda m: F.trim(m) != ""), "\n\n")


# ---- stored layouts and masks ----------------------------------------------------


def to_stored(blocks: Column, dpi: Column) -> Column:
    """A page's layout as it is stored: an object with resolution and blocks."""
    return F.to_json(F.struct(dpi.cast("int").alias("dpi"), blocks.alias("blocks")))


def from_stored(raw: Column) -> Column:
    """``dpi`` and ``blocks`` of a stored layout, in the newer form or as the bare list at OLD_DPI; null if it is neither or its resolution isn't a positive number."""
    new = F.from_json(raw, f"struct<dpi:int,blocks:array<{BLOCK}>>")
    old = F.struct(F.lit(OLD_DPI).alias("dpi"), F.from_json(raw, f"array<{BLOCK}>").alias("blocks"))
    got = F.when(F.ltrim(raw).startswith("["), old).otherwise(new)
    return F.when((got["dpi"] > 0) & got["blocks"].isNotNull(), got)


def has_mask(t: Column) -> Column:
    """Whether a text has a mark of blacked-out words, in either spelling."""
    return F.coalesce(t.contains(T.MASK) | t.rlike(r"(?i)\[\s*redacted\s*\]"), F.lit(False))


def replace_redacted(blocks: Column) -> Column:
    """The other spelling of the mark made the usual one, in texts and cells."""
    fix = lambda t: F.regexp_replace(t, r"(?i)\[\s*redacted\s*\]", r"\[MASKAD\]")
    rows = lambda b: F.transform(b["rows"], lambda row: F.transform(row, lambda c: c.withField("text", fix(c["text"]))))
    return F.transform(blocks, lambda b: b.withField("text", fix(b["text"])).withField("rows", rows(b)))


def with_redactions(blocks: Column, found: Column) -> Column:
    """Marks put among the blocks for blackened stripes ``found`` (arrays of top and bottom): after the last block whose middle is above; none where a block (of a form: a field) with a mark lies on the same height."""
    marked = F.flatten(
        F.transform(
            blocks,
            lambda b: F.when(b["fields"].isNotNull() & b["parts"].isNotNull(), F.transform(F.filter(F.arrays_zip(b["fields"].alias("f"), b["parts"].alias("p")), lambda z: z["p"].isNotNull() & has_mask(fields_text(F.array(z["f"])))), lambda z: z["p"])).otherwise(
                F.when(b["bbox"].isNotNull() & has_mask(block_text(b)), F.array(b["bbox"])).otherwise(F.array().cast("array<array<int>>"))
            ),
        )
    )
    new = F.filter(found, lambda y: ~F.exists(marked, lambda m: (y[0] <= m[3]) & (m[1] <= y[1])))
    middle = lambda box: (box[1] + box[3]) / 2
    at = F.transform(blocks, lambda b, i: F.struct((i + 1).cast("double").alias("at"), F.lit(0.0).alias("y"), b.alias("b")))

    def mark(y: Column) -> Column:
        mid = (y[0] + y[1]) / 2
        place = F.coalesce(F.array_max(F.transform(F.filter(at, lambda x: x["b"]["bbox"].isNotNull() & (middle(x["b"]["bbox"]) <= mid)), lambda x: x["at"])), F.lit(0.0))
        nothing = F.from_json(F.lit('{"kind":"PARAGRAPH"}'), BLOCK)
        block = nothing.withField("text", F.lit(T.MASK)).withField("bbox", F.array(F.lit(0), y[0].cast("int"), F.lit(0), y[1].cast("int")))
        return F.struct((place + 0.5).alias("at"), mid.cast("double").alias("y"), block.alias("b"))

    every = F.array_sort(F.concat(at, F.transform(new, mark)), lambda p, q: F.when(p["at"] < q["at"], -1).when(p["at"] > q["at"], 1).when(p["y"] < q["y"], -1).when(p["y"] > q["y"], 1).otherwise(0))
    return F.transform(every, lambda x, i: x["b"].withField("order", i))
