"""Problem 4: pieces under a size limit, cut at natural boundaries by content-defined chunking."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches

MAX_CHARS, OVERLAP, MIN_CHARS = 800, 150, 300
LEVELS = ("paragraph", "line", "sentence", "word")
_PARAGRAPH = re.compile(r"(?<=\n)(?:[ \t]*\n)+")
_LINE = re.compile(r"\n")
_SENTENCE = re.compile(r"(?<=[.!?])[ \t]+")
_WORD = re.compile(r"[ \t\n]+")
_WINDOW = 16
_BASE = 0x9E3779B97F4A7C15


def cut_level(text: str, limit: int = MAX_CHARS) -> str:
    """The coarsest level at which no unit of ``text`` is longer than ``limit``, else 'none'."""
    lines = text.split("\n")
    size = most = 0
    for s in lines:
        if s.strip(" \t"):
            size += len(s) + (size > 0)
            most = max(most, size)
        else:
            size = 0
    if most <= limit:
        return "paragraph"
    long = [s for s in lines if len(s) > limit]
    if not long:
        return "line"
    if all(len(u) <= limit for s in long for u in _SENTENCE.split(s)):
        return "sentence"
    return "word" if all(len(u) <= limit for u in _WORD.split(text)) else "none"


def rolling_hash(text: str) -> np.ndarray:
    """For each character a hash of the 16 characters from it on (fewer at the end)."""
    h = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    h = (h + np.uint64(1)) * np.uint64(_BASE)
    power, span = 0xD6E8FEB86659FD93, 1
    while span < _WINDOW:
        mixed = h.copy()
        mixed[:-span] = h[:-span] * np.uint64(power) + h[span:] if len(h) > span else h[:0]
        h, power, span = mixed, power * power % 2**64, span * 2
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def boundaries(text: str) -> dict[str, list[int]]:
    """Positions at which a piece may begin, by level; each is the first character after the pause."""
    return {
        "paragraph": [m.end() for m in _PARAGRAPH.finditer(text)],
        "line": [m.end() for m in _LINE.finditer(text)],
        "sentence": [m.end() for m in _SENTENCE.finditer(text)],
        "word": [m.end() for m in _WORD.finditer(text)],
    }


def split_text(text: str, limit: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS) -> list[tuple[int, int, str]]:
    """Pieces ``(start, end, boundary)`` of ``text``; ``boundary`` is the level at which the piece ends ('end' for the last).

    Every piece has at most ``limit`` characters; consecutive pieces share at most
    ``overlap`` characters, from a word's beginning on, and together they cover the text.
    In the window ``least``..``limit`` the landmark is the place of the smallest rolling
    hash; the cut is the boundary nearest to it among those of the coarsest level with
    any boundary in the window. As landmarks depend on the characters around them alone,
    an edit moves only the pieces near it. Without any boundary the landmark is the cut.
    """
    if overlap >= least or least > limit:
        raise ValueError("0 <= overlap < least <= limit must hold")
    if len(text) <= limit:
        return [(0, len(text), "end")] if text else []
    marks, places, out, start = rolling_hash(text), boundaries(text), [], 0
    while len(text) - start > limit:
        low, high = start + least, start + limit
        landmark = low + int(np.argmin(marks[low : high + 1]))
        cut, level = landmark, "none"
        for name in LEVELS:
            at = places[name]
            i, j = bisect_left(at, low), bisect_right(at, high)
            if i < j:
                k = bisect_left(at, landmark, i, j)
                cut, level = min(at[max(i, k - 1) : min(j, k + 1)], key=lambda p: (abs(p - landmark), p)), name
                break
        out.append((start, cut, level))
        words = places["word"]
        i = bisect_left(words, cut - overlap)
        start = words[i] if i < len(words) and words[i] <= cut else cut - overlap
    out.append((start, len(text), "end"))
    return out


def split_items(df: DataFrame, key: str = "id", text: str = "text", limit: int = MAX_CHARS, overlap: int = OVERLAP, least: int = MIN_CHARS, with_text: bool = False) -> DataFrame:
    """One row per text of more than ``limit`` characters: key, ``cut`` (see cut_level) and
    ``pieces``, an array of ``start``, ``end`` (zero-based, in characters), ``boundary`` and,
    if wanted, ``text``.

    Null, empty and short texts have no row; repeated keys have a row each; other
    columns are not read. A very long text is cut in one task, in time linear in its
    length; no row depends on another, so nothing is shuffled.
    """
    of = dict(df.dtypes)[key]
    src = df.where(F.length(text) > limit).select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def batch(keys: list, texts: list) -> dict[str, list]:
        cuts = [split_text(t, limit, overlap, least) for t in texts]
        more = (lambda t, a, b: {"text": t[a:b]}) if with_text else (lambda t, a, b: {})
        return {
            "_key": keys,
            "cut": [cut_level(t, limit) for t in texts],
            "pieces": [[{"start": a, "end": b, "boundary": c, **more(t, a, b)} for a, b, c in cut] for t, cut in zip(texts, cuts)],
        }

    return map_batches(src, batch, f"_key {of}, cut string, pieces array<struct<start:int,end:int,boundary:string{',text:string' if with_text else ''}>>").withColumnRenamed("_key", key)
