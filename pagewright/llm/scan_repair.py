"""Problem 3: repair of text from scanned pages."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.page_lines import _BLANK, _GAP, _INDEX, _MARK, PROSE, ROW, read_lines, weigh
from pagewright.llm.pii import automaton, find_spans
from pagewright.session import materialize, release

#: A word seen this often in different texts is attested. Attested words from this share of all words on (at most 500,000) are known to all tasks; the others are looked up in a table.
LEAST_COUNT, WORD_SHARE = 4, 2e-6
#: A word this many times as frequent as one that looks the same to a scanner is the right one.
DOMINANCE = 8
#: A line on the page edges of so many documents, or on so many pages of one document, is page furniture if this share of its places is a page's first or last line or beside other furniture.
LEAST_DOCUMENTS, LEAST_PAGES, OUTER_SHARE = 3, 3, 0.8
#: Share of all documents from which a line of furniture is known to all of them (at most 25,000 such lines); others are known to the documents they stand in.
EDGE_SHARE = 2e-4
TOP, BOTTOM = 3, 2
_ENDING = frozenset(".,;?:-=‐¬\xad")

_HYPHENS = "-‐‑¬=\xad"
# The hyphen comes first, as signs that a match begins with are found fast.
_JOIN = re.compile(rf"[{_HYPHENS}](?<=[^\W\d_].)[ \t]*\r?\n[ \t]*(?=[a-zà-öø-ÿ])")
_TOKEN = re.compile(r"[^\W_]+(?:[-=|!][^\W_]+)*")
_TAIL = re.compile(rf"([^\W_]+(?:[-–][^\W_]+)*)[{_HYPHENS}][ \t]*$")
_HEAD = re.compile(r"[a-zà-öø-ÿ0-9][^\W_]*")
_NO_WORD = re.compile(r"[^\w\-=|!]|_")
_BREAKS = re.compile(rf"[{_HYPHENS}][ \t]*\r?\n")
_NUM = r"[0-9lIOoSB|]{1,4}"
_NUMBER_LINE = re.compile(
    rf"(?:[-–—~]\s*({_NUM})\s*[-–—~]|[\[({{]\s*({_NUM})\s*[\])}}]|(?:[sS5][iIl1|]d(?:an|a)?|[sS5]\.|[pP]\.|[bB8][lI1|]ad|[pP]age)\s*({_NUM})(?:\s*(?:av|/|\()\s*{_NUM}\)?)?|({_NUM})\s*\(\s*{_NUM}\s*\)|({_NUM})\s*(?:/|av)\s*{_NUM}|({_NUM}))\.?"
)
_SUFFIX = re.compile(r"\s*[·*.,–-]?\s*[sS5][iIl1|][dcl]{1,2}\.?\s*[0-9lIOoSB|]{1,4}$", re.I)
_SUFFIX_ENDS = frozenset("0123456789lIOoSB|LisbS")
_SPECK = re.compile(r"[^\w]{1,3}(?:\s[^\w]{1,2})*$")
_TURN_HEAD = re.compile(r"(?:\*\*)?(?:FL|F|S|H|[A-ZÅÄÖ][a-zåäö]+(?: [a-zåäö]+)?)(?:\*\*)?(?::| - )")

# What scanners confuse. Groups of letters, then single characters; the left side becomes the right side.
_GROUPS = (("ri", "n"), ("rn", "m"), ("lc", "k"), ("cl", "d"), ("ii", "u"), ("li", "h"), ("vv", "w"))
_SINGLE = str.maketrans({"0": "o", "ö": "o", "ó": "o", "ø": "o", "1": "i", "l": "i", "|": "i", "!": "i", "j": "i", "í": "i", "5": "s", "6": "b", "8": "b", "9": "g", "q": "g", "c": "e", "é": "e", "f": "t", "7": "t", "y": "v", "å": "a", "ä": "a", "à": "a", "ü": "u", "4": "a", "3": "e"})
#: A word may have been misread in one of these ways first, which hides the groups: (what, as what).
_FIRST = ((), (("1", "l"), ("|", "l"), ("0", "o")), (("l", "i"), ("1", "i"), ("|", "i")), (("c", "e"),), (("ii", "u"),), (("6", "o"),), (("lc", "k"), ("c", "e")), (("ii", "u"), ("c", "e")), (("l", "i"), ("c", "e")))
_LIGATURES = str.maketrans({"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})


def _as_bytes(table: dict[int, str]) -> bytes:
    """A table of characters as one of Latin-1 bytes."""
    return bytes(ord(table[i]) if i in table else i for i in range(256))


def _changed(s: str, table: dict[int, str], as_bytes: bytes) -> str:
    """``s.translate(table)``, by bytes where the text allows it, which is many times faster."""
    try:
        return s.encode("latin-1").translate(as_bytes).decode("latin-1")
    except UnicodeEncodeError:
        return s.translate(table)


_SINGLE_BYTES = _as_bytes({k: chr(v) if isinstance(v, int) else v for k, v in _SINGLE.items()})


def look(word: str) -> str:
    """What is left of a lower-case word when everything that scanners confuse is made alike."""
    for a, b in _GROUPS:
        if a in word:
            word = word.replace(a, b)
    return _changed(word, _SINGLE, _SINGLE_BYTES)


def looks(word: str) -> list[str]:
    """``look`` after each of the ways in which a misreading may hide another; each marked with its way."""
    plain = look(word)
    out = [plain]
    for i, first in enumerate(_FIRST[1:], 1):
        w = word
        for a, b in first:
            if a in w:
                w = w.replace(a, b)
        if w is not word or i in (2, 3):
            out.append(f"{'' if i != 2 else '2'}{'' if i != 3 else '3'}{plain if w is word else look(w)}")
    return out


_DIGITS = re.compile(r"\d[\d.,/-]*")
_KEY = _SINGLE | str.maketrans("#·*–—_-", "9      ")
_KEY_BYTES = _as_bytes({k: chr(v) if isinstance(v, int) else v for k, v in _KEY.items()})


def furniture_key(line: str) -> str:
    """A line as it recurs: page suffix off, digits and confusable characters alike, blanks single."""
    s = line.strip(_BLANK)
    m = _SUFFIX.search(s, max(0, len(s) - 24)) if s[-1:] in _SUFFIX_ENDS else None
    s = _DIGITS.sub("#", (s[: m.start()] if m else s).lower())
    for a, b in _GROUPS:
        if a in s:
            s = s.replace(a, b)
    return " ".join(_changed(s, _KEY, _KEY_BYTES).split())


def page_number(line: str) -> str | None:
    """The number if the line only gives a page number, with letters read as the digits they resemble."""
    m = _NUMBER_LINE.fullmatch(line) if len(line) <= 18 else None
    if not m:
        return None
    n = next(g for g in m.groups() if g)
    return n.translate(str.maketrans("lI|OoSB", "1110058")) if any(c.isdigit() for c in line) or m.lastindex != 6 else None


def _edge_lines(text: str) -> tuple[list[tuple[str, str]], set[int]]:
    """Lines at the edges of a page that don't end as sentences do, each with the line between it and the edge (page numbers aside): '' if there is none, ' ' if there is none but the line belongs to a sentence, '\\n' if it does and there is one; and the numbers that stand alone on a line at the edges."""
    every = text.splitlines()
    head, foot, numbers = [], [], []
    above = below = i = 0
    j = len(every)
    # Only the lines at the edges, with one more on either side for what is beside them, are looked at; what is between them says nothing.
    while i < j and len(head) <= TOP:
        s = every[i].strip(_BLANK)
        i += 1
        if s:
            number = page_number(s) if len(s) <= 18 else None
            if number is not None:
                numbers.append((above, number))
            elif s[0].isalnum() or not _SPECK.match(s):
                head.append(s)
            above += 1
    while i < j and len(foot) <= BOTTOM:
        j -= 1
        s = every[j].strip(_BLANK)
        if s:
            number = page_number(s) if len(s) <= 18 else None
            if number is not None:
                if below < BOTTOM:
                    numbers.append((0, number))
            elif s[0].isalnum() or not _SPECK.match(s):
                foot.append(s)
            below += 1
    n = above + below
    lines = head + foot[::-1]
    last, out = len(lines) - 1, []
    for i in {*range(min(TOP, last + 1)), *range(max(0, last + 1 - BOTTOM), last + 1)}:
        s = lines[i]
        if len(s) < 4 or s[-1] in _ENDING or _MARK.match(s) or ";" in s or len(_GAP.findall(s)) > 1 or s.count(",") > 1 and _INDEX.search(s):
            continue
        runs_on = s[0].islower() or i < last and lines[i + 1][0].islower() or s.count("(") > s.count(")")
        if i in (0, last):
            out.append((s, " " if runs_on else ""))
        else:
            out.append((s, "\n" if runs_on else lines[i - 1] if i < TOP and i <= last - i else lines[i + 1]))
    return out, {int(x) for k, x in numbers if (k < TOP or k >= n - BOTTOM) and x.isdigit()}


class Knowledge(NamedTuple):
    """What the corpus tells: ``words`` (frequent valid words and their counts), ``furniture`` (keys of running headers and footers of many documents) and ``own``, a table of the rest by text and document: ``digest``, ``doc``, ``own`` (furniture of the single document, and what is between its printed and counted page numbers), ``local`` (what is known of the text's other words)."""

    words: dict[str, int]
    furniture: frozenset[str]
    own: DataFrame | None = None


def corpus_words(df: DataFrame, text: str, key: str, places: DataFrame) -> DataFrame:
    """``word``, ``n`` over all different texts, broken words put together; counted per batch before the shuffle. Copies of a text count once, so a page copied many times can't make its misreadings words; ``places`` has the digest of each key's text."""

    def batch(texts: list) -> dict[str, list]:
        between: Counter[str] = Counter()  # what stands between blanks; no token holds a blank
        for t in texts:
            between.update((_JOIN.sub("", t) if _BREAKS.search(t) else t).split())
        c: dict[str, int] = defaultdict(int)
        for x, n in between.items():
            for w in (x.lower(),) if x.isalpha() and x.isascii() else _TOKEN.findall(x.lower()):
                c[w] += n
        return {"word": list(c), "n": list(c.values())}

    first = places.groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    # Written, so that its size is known: a short list of copies spares the texts a shuffle.
    copies = materialize(places.join(first, "digest").where("k > first").select("k"), "copies")
    src = df.where(F.col(text).isNotNull()).join(copies, F.col(key) == F.col("k"), "left_anti").select(text)
    return map_batches(src, batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word``, ``n`` of the valid words, and ``key``, ``right``: the valid word that looks so.

    Of the words that look the same to a scanner the most frequent is right, if it is
    attested; the others are misread where they are DOMINANCE times as rare, not attested
    or no plain words.
    """

    words = words.where(F.col("n") >= LEAST_COUNT)  # no other word is valid or right

    def keys(ws: list, ns: list) -> dict[str, list]:
        rows = [(k, w, n, w.isalpha()) for w, n in zip(ws, ns) for k in looks(w)]
        return dict(zip(("key", "word", "n", "alpha"), map(list, zip(*rows)))) if rows else {c: [] for c in ("key", "word", "n", "alpha")}

    like = materialize(map_batches(words.select("word", "n"), keys, "key string, word string, n long, alpha boolean"), "looks")
    best = like.groupBy("key").agg(F.max(F.struct("n", "alpha", "word")).alias("b")).select("key", F.col("b.n").alias("bn"), F.col("b.word").alias("right")).where(~F.col("right").rlike(r"\d"))
    best = materialize(best, "best")
    rare = (F.col("n") * DOMINANCE <= F.col("bn")) | ~F.col("alpha")
    wrong = like.join(best, "key").where((F.col("word") != F.col("right")) & rare).select("word").distinct()
    valid = materialize(words.join(wrong, "word", "left_anti"), "valid")
    rights = materialize(best.join(valid.select(F.col("word").alias("right")), "right", "left_semi").select("key", "right"), "rights")
    release(like, best)
    return valid, rights


def _suspect(token: str) -> str | None:
    """The word in a token of a text, small, if it may be a misread one."""
    low = token.strip(_STRIP).lower()
    if not low.isascii():
        low = low.translate(_LIGATURES)
    if low.isalpha():
        return low if len(low) > 2 else None
    # Words are letters, digits and what stands between or for them; any other sign stays in a look, so no word looks so.
    return None if len(low) < 3 or _NO_WORD.search(low) or sum(map(str.isdigit, low)) * 2 > len(low) else low


class _Suspects(dict):
    """The word of each token met, None for those that can't be misread or are among the common ones."""

    def __init__(self, common: dict[str, int]):
        super().__init__()
        self.common = common

    def __missing__(self, token: str) -> str | None:
        low = _suspect(token)
        low = self[token] = None if low in self.common else low
        return low


def _broken(text: str) -> Iterator[tuple[str, str]]:
    """For each word broken over lines the whole word and the compound it may be, whichever of the next lines goes on (page furniture may stand between)."""
    lines = text.splitlines()
    for i, s in enumerate(lines):
        tail = _TAIL.search(s[s.rstrip().rfind(" ") + 1 :]) if s.rstrip()[-1:] in _HYPHENS and s.strip() else None
        for x in lines[i + 1 : i + 5] if tail else ():
            head = _HEAD.match(x.strip(_BLANK))
            if head:
                yield (tail[1] + head[0]).lower(), f"{tail[1]}-{head[0]}".lower()


def lines_and_words(df: DataFrame, text: str, document: str, page: str, common: Broadcast[dict[str, int]]) -> DataFrame:
    """In one pass over the texts two tables. With ``what`` 'e': ``key``, ``doc``, ``page``, ``near``, ``n``, how often a line stands on the edges of a page's readings beside a line ``near`` ('' and ' ': the edge itself, see _edge_lines); a page number there has the key '#' and what it is ahead of the page. With 'w': ``key``, the words of a text (``doc`` is its digest) that aren't among the common ones; with 'h' those that its broken words may be."""

    def batch(docs: list, pages: list, digests: list, texts: list) -> dict[str, list]:
        words = common.value
        keys = {x: x for x in ("", " ", "\n")}
        seen: Counter[tuple] = Counter()
        known = _Suspects(words)
        postings: set[tuple[str, int]] = set()
        wholes: set[tuple[str, int]] = set()
        read: dict[str, tuple[list[tuple[str, str]], set[int]]] = {}
        for d, p, h, t in zip(docs, pages, digests, texts):
            copy = t in read
            if not copy:
                read[t] = _edge_lines(t)
            edges, numbers = read[t]
            for s, near in edges:
                for x in (s, near):
                    if x not in keys:
                        keys[x] = furniture_key(x)
                if len(keys[s]) > 3:
                    seen[keys[s], d, p, keys[near] or near and "\n"] += 1
            if p is not None:
                for n in numbers:
                    seen[f"#{n - p}", d, p, ""] += 1
            if copy:
                continue
            broken = _BREAKS.search(t) is not None
            postings.update((low, h) for low in set(map(known.__getitem__, (_JOIN.sub("", t) if broken else t).split())) if low is not None)
            if broken:
                wholes.update((w, h) for pair in _broken(t) for w in pair if w not in words)
        e, w = list(zip(*seen)), list(zip(*wholes, *(postings - wholes)))
        e, w = e or [()] * 4, w or [()] * 2
        k, m = len(e[0]), len(w[0])
        return {
            "what": ["e"] * k + ["h"] * len(wholes) + ["w"] * (m - len(wholes)), "key": e[0] + w[0], "doc": e[1] + w[1],
            "page": [*e[2], *[None] * m], "near": [*e[3], *[None] * m], "n": [*seen.values(), *[None] * m],
        }

    src = df.select(F.xxhash64(document).alias("d"), F.col(page).cast("long").alias("p"), F.xxhash64(text).alias("h"), F.col(text).alias("t")).where(F.col(text).isNotNull())
    return map_batches(src, batch, "what string, key string, doc long, page long, near string, n long")


def page_furniture(edges: DataFrame) -> DataFrame:
    """``doc``, ``key``, ``documents`` of the running headers and footers of every document.

    A line is one if it recurs over enough documents or over enough pages of this
    document, and mostly stands at the very edge; over the pages of one document only if
    it doesn't belong to a sentence, as sentences recur too. Lines beside furniture are at the edge
    as well, so headers of up to TOP lines are found one line after another. Page numbers
    that run on over the pages of a document have one key (see lines_and_words), which must
    be that of most of its numbered pages.
    """
    known = None
    # Most lines stand on one page only and can't be furniture whatever is beside them. A page counts here for each line that is beside it, which lets a few more pass; page numbers are beside none.
    pages_of = edges.groupBy("key", "doc").agg(F.count(F.lit(1)).alias("pages"))
    often = pages_of.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), F.max("pages").alias("most")).where((F.col("documents") >= LEAST_DOCUMENTS) | (F.col("most") >= LEAST_PAGES)).select("key")
    edges = materialize(edges.join(often, "key", "left_semi"), "recurring")
    numbered = edges.where(F.col("key").startswith("#")).groupBy("doc").agg(F.count_distinct("page").alias("numbered"))
    for _ in range(TOP):
        if known is None:
            rows = edges.withColumn("beside", F.lit(None).cast("boolean"))
        else:
            rows = edges.join(known.select("doc", F.col("key").alias("near"), F.lit(True).alias("beside")), ["doc", "near"], "left")
        outer = F.col("near").isin("", " ") | F.col("beside").isNotNull()
        per_document = rows.groupBy("key", "doc").agg(F.count_distinct("page").alias("pages"), F.sum(F.when(outer, F.col("n")).otherwise(0)).alias("outer"), F.sum(F.when(outer & (F.col("near") != " "), F.col("n")).otherwise(0)).alias("apart"), F.sum("n").alias("n"))
        per_document = materialize(per_document, "edges")
        per_key = per_document.groupBy("key").agg(F.count(F.lit(1)).alias("documents"), (F.sum("outer") / F.sum("n")).alias("share")).where(F.col("documents") >= LEAST_DOCUMENTS)
        wide = ~F.col("key").startswith("#") & (F.col("documents") >= LEAST_DOCUMENTS) & (F.col("share") >= OUTER_SHARE)
        single = (F.col("pages") >= LEAST_PAGES) & (F.col("apart") >= OUTER_SHARE * F.col("n"))
        single = single & (~F.col("key").startswith("#") | (F.col("pages") * 2 > F.col("numbered")))
        known = materialize(per_document.join(per_key, "key", "left").join(numbered, "doc", "left").where(F.coalesce(wide, F.lit(False)) | F.coalesce(single, F.lit(False))).select("doc", "key", F.when(wide, F.col("documents")).otherwise(0).alias("documents")), "furniture")
    return known


def learn(df: DataFrame, text: str = "text", document: str = "pdf_stem", page: str = "page_num", key: str = "id") -> Knowledge:
    """Vocabulary and page furniture of a corpus.

    What comes to the driver and goes to all tasks is bounded whatever the corpus: a word
    must make up WORD_SHARE of all words, a line recur in EDGE_SHARE of all documents. All
    else stays in tables: rarer furniture by document, and by text what is known of its
    rarer words, so the bounds decide where a thing is looked up, not whether it is known.
    """
    places = materialize(df.where(F.col(text).isNotNull()).select(F.col(key).alias("k"), F.xxhash64(text).alias("digest"), F.xxhash64(document).alias("doc")), "places")
    words = materialize(corpus_words(df, text, key, places), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    valid, rights = vocabulary(words)
    common = {r["word"]: r["n"] for r in valid.where(F.col("n") >= WORD_SHARE * total).collect()}
    assert len(common) <= 1 / WORD_SHARE + 1
    shared = df.sparkSession.sparkContext.broadcast(common)
    raw = materialize(lines_and_words(df, text, document, page, shared), "lines")

    edges = materialize(raw.where("what = 'e'").groupBy("key", "doc", "page", "near").agg(F.sum("n").alias("n")), "edgelines")
    documents = df.agg(F.approx_count_distinct(document)).first()[0] or 0
    lines = page_furniture(edges)
    wide = F.col("documents") >= max(LEAST_DOCUMENTS, EDGE_SHARE * documents)
    furniture = lines.where(wide).select("key").distinct().collect()
    own = materialize(lines.where(~wide).groupBy("doc").agg(F.collect_set("key").alias("own")), "own")

    postings = raw.where("what <> 'e'").select(F.col("key").alias("word"), F.col("doc").alias("digest"), "what")
    asked = materialize(postings.select("word").distinct().join(valid, "word", "left"), "asked")

    def keys(ws: list) -> dict[str, list]:
        return {"word": ws, "keys": [looks(w) for w in ws]}

    fixes = map_batches(asked.where("n is null").select("word"), keys, "word string, keys array<string>").select("word", F.posexplode("keys").alias("i", "key")).join(rights, "key").groupBy("word").agg(F.min_by("right", "i").alias("right"))
    told = asked.where("n is not null").select("word", "n", F.lit(None).cast("string").alias("right")).unionByName(fixes.where("word <> right").select("word", F.lit(0).cast("long").alias("n"), "right"))
    # How frequent a valid word is only matters for words broken over lines. Copies of a text say the same, so they are made one where little is left.
    told = postings.join(told, "word").where("right is not null or what = 'h'").select("digest", F.concat_ws("\t", "word", F.col("n").cast("string"), F.coalesce("right", F.lit(""))).alias("x"))
    local = materialize(told.groupBy("digest").agg(F.array_join(F.collect_set("x"), "\n").alias("local")), "local")
    # One table by text and document, so that the texts meet what is known of them in one join.
    told = places.select("digest", "doc").distinct().join(own, "doc", "left").join(local, "digest", "left").where("own is not null or local is not null")
    told = materialize(told.select("digest", "doc", "own", "local"), "told")
    release(raw, edges, words, valid, rights, asked, own, local, places)
    return Knowledge(common, frozenset(r["key"] for r in furniture), told)


class Repair(NamedTuple):
    text: str
    found: list[tuple[str, str]]


class Reader:
    """The knowledge of a corpus with what a task remembers of lines it has seen, and what is known of the words of the text at hand."""

    def __init__(self, know: Knowledge):
        self.know, self.anchors = know, automaton()
        self.parts: dict[tuple, list[str]] = defaultdict(list)
        for k in know.furniture:
            for i, part in enumerate(_thirds(k)):
                self.parts[i, len(k), part].append(k)
        self.lines: dict[str, bool] = {}
        self.lows: dict[str, str] = {}
        self.local: dict[str, tuple[int, str]] = {}

    def is_furniture(self, line: str, of: str) -> bool:
        """Whether a line (of a kind) recurs at page edges, up to two slips of the scanner; no sentence's end is learned as such."""
        if of == PROSE and line[-1] in _ENDING:
            return False
        known = self.lines.get(line)
        if known is None:
            if len(self.lines) > 100_000:
                self.lines.clear()
            key = furniture_key(line)
            known = key in self.know.furniture or len(key) >= 8 and of != PROSE and self._like(key)
            self.lines[line] = known
        return known

    def _like(self, key: str) -> bool:
        """Whether a key is two slips at most from one of the furniture: one of three parts of that is then untouched, moved by a character at most."""
        size = len(key)
        for n in (size - 1, size, size + 1):
            a, b = n // 3, 2 * n // 3
            for i, (s, e) in enumerate(((0, a), (a, b), (b, n))):
                for move in (0,) if n == size else (0, size - n):
                    if any(_slips(k, key) <= 2 for k in self.parts.get((i, n, key[s + move : e + move]), ())):
                        return True
        return False

    def is_own(self, line: str, of: str, own: list[str]) -> bool:
        """Whether a line at an edge is furniture of its document, up to two slips of the scanner."""
        key = furniture_key(line)
        return key in own or len(key) >= 8 and of != PROSE and any(abs(len(k) - len(key)) <= 1 and k[0] != "#" and _slips(k, key) <= 2 for k in own)

    def count(self, word: str) -> int:
        """How often a valid word occurs, 0 for any other."""
        return self.know.words.get(word) or self.local.get(word, (0, ""))[0]

    def misread(self, token: str) -> tuple[str, str] | None:
        """The core of a token and the word it should be, if the token is a misread word."""
        low = self.lows.get(token)
        if low is None:
            if len(self.lows) > 100_000:
                self.lows.clear()
            low = token.strip(_STRIP).lower()
            low = self.lows[token] = low if low.isascii() else low.translate(_LIGATURES)
        got = self.local.get(low)
        return (token.strip(_STRIP), got[1]) if got and got[1] else None


def _thirds(key: str) -> tuple[str, str, str]:
    a, b = len(key) // 3, 2 * len(key) // 3
    return key[:a], key[a:b], key[b:]


def _slips(a: str, b: str) -> int:
    """Edit distance of strings that differ little, 3 when it is more than 2."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return min(3, sum(map(str.__ne__, a, b)))
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return min(3, 1 + sum(map(str.__ne__, a[i:], b[i + 1 :])))


def repair(lines: list[tuple[str, str]], text: str, page: int | None, reader: Reader, own: list[str] | None = None) -> Repair:
    """One page of prose as continuous paragraphs, and what was wrong with it."""
    runs_on = {str(page + int(k[1:])) for k in own or () if k[0] == "#"} if page is not None else ()
    found: list[tuple[str, str]] = []
    kept: list[tuple[str, str] | None] = []
    last, at = len(lines) - 1, 0
    blanks = _blank_before(text, last + 1)
    for i, (s, k) in enumerate(lines):
        if blanks[i]:
            kept.append(None)
        edge = i < TOP or i > last - BOTTOM
        if len(s) <= 18 and (n := page_number(s)) is not None:
            if page is not None and n == str(page) or edge and (n in runs_on or not s.isalnum()):
                found.append(("page_number", s))
                continue
        if not s[0].isalnum() and _SPECK.match(s):
            continue
        if (edge or k != PROSE) and reader.is_furniture(s, k) or own and edge and reader.is_own(s, k, own):
            found.append(("header", s))
            continue
        kept.append((s, k))
    paragraphs = _join(kept, reader, found)
    body = "\n".join(s for s, _ in paragraphs)
    suspects, at = [], 0
    wanted = [w for w, (_, right) in reader.local.items() if right]
    for s, is_row in paragraphs if wanted else ():
        if not is_row:
            suspects += sorted((at + start, token, x) for start, token in _tokens_with(s, wanted) if (x := reader.misread(token)))
        at += len(s) + 1
    out, at = [], 0
    if suspects:
        spans = find_spans(body.replace("\x02", " "), reader.anchors)
        for start, token, (core, right) in suspects:
            a = start + token.index(core)
            b = a + len(core)
            if any(s < b and a < e for s, e, _ in spans):
                continue
            out += [body[at:a], _cased(right, core)]
            at = b
            if not (body[a - 1 : a] == "\x02" or body[b : b + 1] == "\x02"):
                found.append(("chars", core))
    fixed = "".join([*out, body[at:]])
    if any(c in fixed for c in "ﬁﬂﬀﬃﬄ"):
        fixed = fixed.translate(_LIGATURES)
    return Repair(fixed.replace("\x02", "").strip("\n"), found)


def _blank_before(text: str, lines: int) -> list[bool]:
    """For each of the ``lines`` with something on them whether an empty one stands before it."""
    every = text.splitlines()
    if len(every) == lines:
        return [False] * lines
    out, blank = [], False
    for x in every:
        if x.strip(_BLANK):
            out.append(blank)
            blank = False
        else:
            blank = True
    return out


def _join(lines: list[tuple[str, str] | None], reader: Reader, found: list[tuple[str, str]]) -> list[tuple[str, bool]]:
    """Paragraphs and rows (marked) from lines (None for an empty one); words broken over two lines are put together, with \x02 at their ends."""
    out: list[str] = []
    rows: list[bool] = []
    open_ = False
    for x in lines:
        if x is None:
            open_ = False
            continue
        s, k = x
        tail = out and out[-1][-1:] in _HYPHENS and _TAIL.search(out[-1], max(out[-1].rfind(" "), out[-1].rfind("\x02")) + 1) or None
        head = _HEAD.match(s) if tail else None
        if tail and head and not tail[1].isdigit() and not head[0].isdigit():
            left, right = tail[1], head[0]
            whole, own = (left + right).lower(), f"{left}-{right}".lower()
            if reader.count(own) > reader.count(whole) or left.split("-")[-1].isupper() and len(left) < 5 and not reader.count(whole):
                out[-1] = out[-1][: tail.end(1)] + "-" + s
            else:
                found.append(("hyphen", whole))
                out[-1] = out[-1][: tail.start(1)] + "\x02" + left + right + "\x02" + s[head.end() :]
            open_ = True
            continue
        if out and rows[-1] and k != ROW and s[0].islower():  # what looked like a row goes on as a sentence
            rows[-1], open_ = False, True
        if open_ and k != ROW and not _TURN_HEAD.match(s):
            out[-1] += " " + s
        else:
            out.append(s)
            rows.append(k == ROW)
        open_ = k != ROW
    return list(zip(out, rows))


_WORDS = re.compile(r"[^\s\x02]+")
_STRIP = ".,;:!?()[]{}\"'»«”“’*…–-\x02"


_LIGATURE = re.compile("[ﬁﬂﬀﬃﬄ]")


def _tokens_with(text: str, words: list[str]) -> set[tuple[int, str]]:
    """Places and tokens of a text that hold one of the (small) words; all tokens where small letters aren't at the same places."""
    low = text.lower()
    if len(low) != len(text) or _LIGATURE.search(text):
        return {(m.start(), m[0]) for m in _WORDS.finditer(text)}
    out = set()
    for w in words:
        p = low.find(w)
        while p >= 0:
            start = p
            while start and not text[start - 1].isspace() and text[start - 1] != "\x02":
                start -= 1
            m = _WORDS.match(text, start)
            if m:
                out.add((start, m[0]))
            p = low.find(w, p + len(w))
    return out


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word[:1].upper() + word[1:] if like[:1].isupper() else word


def scan_repair(df: DataFrame, know: Knowledge, key: str = "id", text: str = "text", page: str = "page_num", document: str = "pdf_stem") -> DataFrame:
    """key, ``repaired`` and ``found`` (array of ``kind``, ``item``) of every text that is mainly running prose.

    Kinds: 'hyphen', 'chars', 'header', 'page_number' as TESTDATA.md states them. Null,
    empty and blank texts and those that aren't prose have no row; repeated keys have a
    row each; a null page number only weakens the check of page numbers; other columns
    are not read. Rows don't depend on each other beyond ``know``.
    """
    spark: SparkSession = df.sparkSession
    shared: Broadcast[Knowledge] = spark.sparkContext.broadcast(know._replace(own=None))
    of = dict(df.dtypes)[key]

    def batch(reader: Reader, keys: list, texts: list, pages: list, owns: list, locals_: list) -> dict[str, list]:
        done: list[tuple[object, Repair]] = []
        last, got = None, None
        for i, *known in zip(keys, texts, pages, owns, locals_):
            if known != last:  # copies mostly follow each other, as texts meet what is known of them by digest
                t, p, own, local = last = known
                lines, got = read_lines(t), None
                if weigh(lines).running:
                    reader.local = {w: (int(n), r) for w, n, r in [x.split("\t") for x in local.split("\n")]} if local else {}
                    got = repair(lines, t, p, reader, own)
            if got is not None:
                done.append((i, got))
        return {"_key": [i for i, _ in done], "repaired": [r.text for _, r in done], "found": [[{"kind": a, "item": b} for a, b in r.found] for _, r in done]}

    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_t"), F.col(page).alias("_p"), F.xxhash64(document).alias("doc"), F.xxhash64(text).alias("digest")).where(F.col(text).isNotNull())
    # Spark broadcasts the table only where it is small.
    src = src.join(know.own, ["digest", "doc"], "left") if know.own is not None else src.withColumns({"own": F.lit(None).cast("array<string>"), "local": F.lit(None).cast("string")})
    return map_batches(src.select("_key", "_t", "_p", "own", "local"), batch, f"_key {of}, repaired string, found array<struct<kind:string,item:string>>", lambda: Reader(shared.value)).withColumnRenamed("_key", key)
