"""Texts into search chunks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from pagewright.functions import text as T
from pagewright.session import with_package

SIZE, OVERLAP, LEAST, ALNUM_SHARE = 800, 150, 80, 0.55
_SCHEMA = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("chunk", StringType())]))


def chunk(text: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Windows over one page that end at a line end, else a blank, of their second half where there is one."""
    s = re.sub(r"[^\S\n]+", " ", text or "").strip().replace("\f", " ")
    if len(s) <= size:
        return [(0, len(s), s)] if s else []
    out, at = [], 0
    while True:
        stop = min(at + size, len(s))
        if stop < len(s):
            cut = next((p for p in (s.rfind(c, at + size // 2, stop) for c in "\n ") if p >= 0), -1)
            stop = cut if cut > at + 100 else stop
        if piece := s[at:stop].strip():
            out.append((at, stop, piece))
        if stop == len(s):
            return out
        at = max(stop - overlap, at + 1)


def chunks(df: DataFrame, key: list[str], text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, ``chunk_idx``, ``start``, ``end``, ``chunk``; one pass per text, no shuffle."""
    with_package(df.sparkSession)
    cut = F.udf(lambda t: chunk(t, size, overlap), _SCHEMA, useArrow=True)
    return df.select(*key, F.posexplode(cut(F.col(text))).alias("chunk_idx", "c")).select(*key, "chunk_idx", "c.start", "c.end", "c.chunk")


def is_useful(c: Column, markdown: bool = False) -> Column:
    """Long enough and made of letters and digits enough; for Markdown its signs, blanks and the page header don't count."""
    c = F.when(c.startswith(HEADER_MARK), F.regexp_replace(c, r"^[^\n]*\n?", "")).otherwise(c) if markdown else c
    t = F.regexp_replace(c, r"[*#>|`\-\s]", "") if markdown else c
    return (F.length(c) >= LEAST) & (T.alnum_count(t) >= ALNUM_SHARE * F.length(t)) & (F.length(t) > 0)


# How a page's Markdown marks its header line, a form's field, a speaker's turn and a question.
HEADER_MARK, FIELD_MARK = "> Sidhuvud:", "- **"
_TURN = re.compile(r"\*\*(?:(?:[A-ZÅÄÖ]{1,3}|Fråga|Svar):|\[MASKAD\]:?)\*\*")
_QUESTION = re.compile(r"\*\*(?:F|FL|Fråga):\*\*")
_RULE = re.compile(r"\|[\s|:-]*-[\s|:-]*$")


def _table_head(lines: list[str]) -> str:
    """Head and rule of a table, '' if the lines are none."""
    return "\n".join(lines[:2]) if len(lines) > 1 and all(x.startswith("|") for x in lines) and _RULE.match(lines[1]) else ""


def markdown_units(md: str) -> list[tuple[str, str]]:
    """Kind and text of a page's blocks: 'table', 'form', and between empty lines and speaker turns 'question', 'turn' or 'text'."""
    units: list[tuple[str, str]] = []
    for block in re.split(r"\n(?:[ \t]*\n)+", md.strip("\n")):
        lines = block.split("\n")
        heads = [x for x in lines if not x.startswith(" ")]
        if not block.strip():
            continue
        if _table_head(lines):
            units.append(("table", block))
        elif lines[0].startswith(FIELD_MARK) and all(x.startswith(FIELD_MARK) for x in heads):
            units.append(("form", block))
        else:
            starts = [0, *(i for i in range(1, len(lines)) if _TURN.match(lines[i])), len(lines)]
            for i, j in zip(starts, starts[1:]):
                t = "\n".join(lines[i:j])
                units.append(("question" if _QUESTION.match(t) else "turn" if _TURN.match(t) else "text", t))
    return units


def _words(line: str, room: int) -> list[str]:
    """A line in parts at blanks; only a word longer than the room is cut itself."""
    out, cur = [], ""
    for w in line.split():
        while len(w) > room:
            out += [cur] if cur else []
            cur = ""
            out.append(w[:room])
            w = w[room:]
        if cur and w and len(cur) + 1 + len(w) > room:
            out.append(cur)
            cur = ""
        cur = f"{cur} {w}" if cur and w else cur or w
    return [*out, cur] if cur else out


def _cells(row: str, room: int) -> list[str]:
    """A table row in rows of fewer cells; a cell that is too long by itself is cut at blanks."""
    cells = [p for c in row.strip().strip("|").split("|") for p in ([c.strip()] if len(c.strip()) + 4 <= room else _words(c, max(1, room - 4)))]
    out, cur = [], ""
    for c in cells:
        longer = f"{cur[:-2]} | {c} |" if cur else f"| {c} |"
        if cur and len(longer) > room:
            out.append(cur)
            longer = f"| {c} |"
        cur = longer
    return [*out, cur] if cur else out


def _packed(atoms: list[str], room: int, head: str = "") -> list[str]:
    """Atoms (rows, fields, lines) in parts of at most ``room``; ``head`` leads each part that has place for it and a whole atom."""
    small = [(p, a is p) for a in atoms for p in ([a] if len(a) <= room else _cells(a, room) if a.startswith("|") and "\n" not in a else _packed(sum((_words(x, room) if len(x) > room else [x] for x in a.split("\n")), []), room) if "\n" in a else _words(a, room))]
    if head and not any(whole and len(head) + 1 + len(p) <= room for p, whole in small):
        return _packed([*head.split("\n"), *atoms], room)  # the head goes in as rows of its own
    out: list[str] = []
    cur = ""
    for p, whole in small:
        heads = bool(head) and whole and len(head) + 1 + len(p) <= room
        if cur and len(cur) + 1 + len(p) <= room and not (heads and not cur.startswith(head)):
            cur += "\n" + p
            continue
        out += [cur] if cur else []
        cur = f"{head}\n{p}" if heads else p
    return [*out, cur] if cur else out


def _parts(kind: str, unit: str, room: int, overlap: int) -> list[str]:
    """A unit within the room: tables by rows, forms by fields with their options, other text by windows."""
    if len(unit) <= room:
        return [unit]
    lines = unit.split("\n")
    if kind == "table":
        return _packed(lines[2:], room, _table_head(lines)) if len(lines) > 2 else _packed(lines, room)
    if kind == "form":
        starts = [i for i, x in enumerate(lines) if not x.startswith(" ")]
        return _packed(["\n".join(lines[i:j]) for i, j in zip(starts, [*starts[1:], len(lines)])], room)
    return [p for _, _, p in chunk(unit, room, min(overlap, room // 2))]


def _edge(text: str, limit: int, need: int, last: bool) -> str:
    """The end (or beginning) of a text within ``limit`` characters: whole lines if they give ``need`` characters, else whole words."""
    lines = text.split("\n")
    n, size = 0, -1
    for x in reversed(lines) if last else lines:
        if size + 1 + len(x) > limit:
            break
        n, size = n + 1, size + 1 + len(x)
    picked = lines[len(lines) - n :] if last else lines[:n]
    if last:  # an indented line belongs to the field above it
        own = next((picked[i:] for i, x in enumerate(picked) if x.strip() and not x.startswith(" ")), picked)
        picked = own if len("\n".join(own)) >= need else picked
    got = "\n".join(picked).strip("\n")
    if got and len(got) >= need or limit <= 0:
        return got if limit > 0 else ""
    if len(text) <= limit:
        return text.strip()
    cut = text[-limit:] if last else text[:limit]
    m = re.search(r"\s(?=\S)", cut) if last else re.search(r"\s(?=\S*$)", cut)
    return (cut if not m else cut[m.end() :] if last else cut[: m.start()]).strip()


def _borrowed(before: str, limit: int, need: int) -> str:
    """What a short chunk takes from the one before: its end; of a table the last rows with the head, or else the end of other text there."""
    *others, last = before.split("\n\n")
    lines = last.split("\n")
    head = _table_head(lines)
    if head:
        rows = _edge("\n".join(lines[2:]), limit - len(head) - 1, 0, True) if len(lines) > 2 else ""
        if rows and all(x.startswith("|") for x in rows.split("\n")) and len(head) + 1 + len(rows) >= need:
            return f"{head}\n{rows}"
        prose = _edge("\n\n".join(x for x in others if not _table_head(x.split("\n"))), limit, need, True)
        if len(prose) >= need:
            return prose
    return _edge(before, limit, need, True)


def _rescued(chunks: list[str], room: int, overlap: int) -> list[str]:
    """No chunk under LEAST characters stays so if that can be helped, as it would be dropped: it joins the one before or after, or takes over some of their text."""
    out: list[str] = []
    left = list(chunks)
    while left:
        c = left.pop(0)
        if len(c) < LEAST:
            if out and len(out[-1]) + 2 + len(c) <= room:
                out[-1] += "\n\n" + c
                continue
            if left and len(c) + 2 + len(left[0]) <= room:
                left[0] = f"{c}\n\n{left[0]}"
                continue
            limit, need = min(overlap, room - len(c) - 2), LEAST - len(c) - 2
            if out and (more := _borrowed(out[-1], limit, need)):
                c = f"{more}\n\n{c}"
            elif not out and left and (more := _edge(left[0], limit, need, False)):
                c = f"{c}\n\n{more}"
        out.append(c)
    return out


def chunk_markdown(md: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Chunks of at most ``size`` characters that keep units together and lose none of them.

    A question stays with its answer and the text between where they fit; a table's rows
    come with its head, a form's options with their field; a page header leads every chunk
    (cut to a quarter of the size if it takes half). Chunks that would be too short to be
    kept are joined with a neighbour or lengthened by its text (see _rescued). Null and
    blank give none.
    """
    md = (md or "").strip()
    if not md:
        return []
    header = ""
    if md.startswith(HEADER_MARK):
        first, _, md = md.partition("\n")
        header = first.rstrip() if 2 * len(first.rstrip()) < size else first[: size // 4]
        header += "\n"
    room = size - len(header)
    units = [(k, p) for k, u in markdown_units(md) for p in _parts(k, u, room, overlap)]
    whole: list[str] = []
    i = 0
    while i < len(units):
        kind, text = units[i]
        j = i + 1
        while kind == "question" and j < len(units) and units[j][0] == "text":
            j += 1
        answer = "\n\n".join(u for _, u in units[i : j + 1]) if kind == "question" and j < len(units) and units[j][0] == "turn" else ""
        whole.append(answer if answer and len(answer) <= room else text)
        i = j + 1 if answer and len(answer) <= room else i + 1
    chunks: list[str] = []
    for u in whole:
        if chunks and len(chunks[-1]) + 2 + len(u) <= room:
            chunks[-1] += "\n\n" + u
        else:
            chunks.append(u)
    return [header + c for c in _rescued(chunks, room, overlap)]


def markdown_chunks(df: DataFrame, key: list[str], markdown: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, ``chunk_idx``, ``chunk`` of every page's Markdown."""
    with_package(df.sparkSession)
    cut = F.udf(lambda t: chunk_markdown(t, size, overlap), "array<string>", useArrow=True)
    return df.select(*key, F.posexplode(cut(F.col(markdown))).alias("chunk_idx", "chunk"))


def vector_ok(v: Column) -> Column:
    """Whether a vector may be indexed: not empty, no value missing, none not a number or infinite, not all zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
