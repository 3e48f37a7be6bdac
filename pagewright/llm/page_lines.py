"""Line-level reading of a page: running text, rows of lists and tables, unreadable lines.

Used by every operator that must know prose from the rest; plain functions over one
text, called from Arrow batches.
"""

from __future__ import annotations

import re
from typing import NamedTuple

# Function words that tell the languages of the archive apart.
FUNCTION_WORDS = {
    "sv": frozenset("och att det som en ett den på av för med till var är inte jag om vid från men hade kan efter eller under då så han hon sig ut har de i mot".split()),
    "en": frozenset("the a an of and to in on at by was that it with for from had but not is as he she they his her this which before after near".split()),
    "de": frozenset("der die das und ein eine einen einer dem den des zu in im an am auf von vor nach mit für war nicht ist er sie aber sich neben hinter unter gegen".split()),
}

_MARK = re.compile(r"(?:[-–—*•·▪◦■+>]\s+\S|\(?\d{1,3}[.)]\s|\(?[a-zåäö][.)]\s|[^\W\d_]{1,6}\.? ?\d+[:.)]\s|\d+ st\b)")
_TURN = re.compile(r"(?:\*\*)?(?:FL|F|S|H|[^\W\d_]+(?: [^\W\d_]+)?)(?:\*\*|:\*\*)?(?::| - )\s*\S")
_GAP = re.compile(r"[|;\t]|  +|\.{3,}")
_INDEX = re.compile(r"\d+(?:\s*,\s*\d+)*(?:\s*ff\.?)?$")
_SENTENCE = re.compile(r"[^\W_][)\]]?[.?!](?=\s|$)")
#: For counting by deletion: bytes of Latin-1 that aren't letters, and vowels.
_OTHER = bytes(b for b in range(256) if not chr(b).isalpha() or chr(b) in "ªº")
_VOWELS = "aeiouyåäöéüàáâêëïAEIOUYÅÄÖÉÜ".encode("latin-1")

_WIDE = re.compile(r"[^\x00-\xff]")

PROSE, ROW, GARBAGE, NEUTRAL = "prose", "row", "garbage", "neutral"


def letters_of(text: str) -> tuple[int, int, int]:
    """Letters of any script, Latin-1 letters, Latin-1 vowels."""
    try:
        raw = text.encode("latin-1")
        latin = letters = len(raw.translate(None, _OTHER))
    except UnicodeEncodeError:
        raw = text.encode("latin-1", "replace")
        latin = len(raw.translate(None, _OTHER))
        letters = latin + sum(map(str.isalpha, _WIDE.findall(text)))
    return letters, latin, len(raw) - len(raw.translate(None, _VOWELS))


def kind(line: str) -> str:
    """What one stripped, non-empty line looks like by itself."""
    words = line.split()
    n = len(words)
    run = len([1 for w in words if w.islower() and len(w) > 1])
    turn = (":" in line or " - " in line) and _TURN.match(line) is not None
    # A word of letters alone begins no mark, unless a number follows it.
    if not turn and not (n and words[0].isalpha() and (n == 1 or not words[1][0].isdigit())) and _MARK.match(line):
        return ROW if n > 1 else NEUTRAL
    if "|" in line or ";" in line or "  " in line or "\t" in line or "..." in line:
        gaps = len(_GAP.findall(line))
        if gaps >= max(2 if n > 4 else 1, n // 6) and not (turn and run * 2 >= n):
            return ROW
    letters, latin, vowels = letters_of(line)
    solid = len(line) - n + 1
    if latin * 2 < letters:  # another script: letters without case count as small ones, the look of Latin words says nothing
        run = sum([w == w.lower() and w != w.strip("0123456789.,-") or w.isalpha() and w == w.lower() for w in words])
    if solid >= 12 and letters * 10 < solid * 6:
        signs = solid - letters - sum(map(str.isdigit, line))
        if signs * 20 > solid * 7:
            return GARBAGE
    if solid >= 12 and letters * 10 < solid * 6 and run * 3 < n:
        return GARBAGE if letters * 10 < solid * 4 or not _INDEX.search(line) else ROW
    if letters >= 12 and latin * 2 >= letters:
        if vowels * 100 < latin * 22 or vowels * 100 > latin * 62 or letters * 10 < n * 19:
            return GARBAGE
        if letters > n * 24 and run * 2 < n:
            return GARBAGE
    if turn or n >= 3 and run * 2 >= n or latin * 2 < letters and letters >= 12 and line[-1] in "。！？、":
        return PROSE
    if 1 < n <= 8 and run * 3 < n * 2 and not line[0].isdigit() and _INDEX.search(line):
        return ROW
    return NEUTRAL


class Page(NamedTuple):
    """Characters in running text, in rows, in unreadable lines; rows; lines; lines that end in punctuation; whether running text makes up most."""

    prose: int
    rows: int
    garbage: int
    n_rows: int
    n_lines: int
    n_ends: int
    running: bool


_ENDS = tuple(".!?:;,…»”\"')-‐‑–¬=\xad")
_BLANK = " \t\ufeff\xa0\u200b"


def read_lines(text: str) -> list[tuple[str, str]]:
    """The lines with something on them, stripped, each with its kind."""
    return [(s, kind(s)) for s in [x.strip(_BLANK) for x in text.splitlines()] if s]


def read_page(text: str) -> Page:
    """``weigh`` for a text."""
    return weigh(read_lines(text))


def weigh(lines: list[tuple[str, str]]) -> Page:
    """Characters of a page by the kind of their lines.

    A line that says nothing by itself counts with running text when it ends a
    sentence or follows such text; at the very edges of the page (headers, page
    numbers) it counts for nothing; elsewhere it is a row. Running text makes up most
    of a page when it has more characters than rows and unreadable lines together; one
    sentence above rows doesn't.
    """
    prose = rows = garbage = n_rows = n_ends = 0
    last, before, told = len(lines) - 1, NEUTRAL, []
    for i, (s, k) in enumerate(lines):
        size = len(s)
        n_ends += s.endswith(_ENDS)
        if k == NEUTRAL:
            if size > 8 and s[-1] in ".?!" or before == PROSE and (1 < i < last or s[0].islower()):
                k = PROSE
            elif i <= 1 or i == last:
                before = k
                continue
            else:
                k = ROW
        before = k
        if k == PROSE:
            prose += size
            told.append(s)
        elif k == ROW:
            rows += size
            n_rows += 1
        else:
            garbage += size
    other = rows + garbage
    running = prose > other
    if running and n_rows > 1 and prose < 3 * other:
        running = len(_SENTENCE.findall("\n".join(told))) > 1
    return Page(prose, rows, garbage, n_rows, last + 1, n_ends, running)
