"""Citations in answers, and the documents they mean."""

from __future__ import annotations

import html
import re
from base64 import urlsafe_b64encode
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.session import with_package

# How answers cite. A number with pages, with or without brackets; a number alone in brackets; a reference back.
# Both dialects of patterns read these: named groups would differ, so they are counted.
NUMBER = r"[\p{L}\p{N}_\-]+(?:[.,_][\p{L}\p{N}_\-]+)*"
PAGES = r"\d+(?:\s*,\s*\d+)*"
CUT = r"…|\.\.\."
WITH_PAGES = rf"\[?(?:Nr\s+)?({NUMBER})({CUT})?,\s*sida\s*({PAGES})\]?"
WHOLE = rf"\[Nr\s+({NUMBER})({CUT})?(?:,[^\[\]]*)?\]"
BACK = rf"\[[sS]amma\s+(dokument|källa|sida)(?:,\s*sida\s*({PAGES}))?\]"
ANY = f"{WITH_PAGES}|{WHOLE}|{BACK}"
_ANY = re.compile(ANY.replace(r"\p{L}\p{N}_", r"\w"))
#: Folders of documents, the later the better, and what parts the number from the rest of a long name.
FOLDERS, ALIAS = ("downloaded/files", "downloaded/wpu_files", "generated/ocr"), "_-_"


class Cite(NamedTuple):
    """A citation: where it stands, the number ('' for a reference back), whether it is cut, its pages, what it refers back to."""

    start: int
    end: int
    nr: str
    cut: bool
    pages: list[int]
    back: str


def citations_of(answer: str | None) -> list[Cite]:
    """All citations of an answer in their order."""
    out = []
    for m in _ANY.finditer(answer or ""):
        pages = [int(p) for p in re.findall(r"\d+", m[3] or m[7] or "")]
        out.append(Cite(m.start(), m.end(), m[1] or m[4] or "", bool(m[2] or m[5]), pages, m[6] or ""))
    return out


def cited(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """keys, ``place``, ``nr``, ``cut``, ``pages``, ``back`` of every citation of an answer; JVM patterns only."""
    found = F.regexp_extract_all(F.col(answer), F.lit(f"({ANY})"), 1)
    part = lambda i: F.regexp_extract("c", ANY, i)
    return df.select(*keys, F.posexplode(found).alias("place", "c")).select(
        *keys, "place", F.concat(part(1), part(4)).alias("nr"), (F.concat(part(2), part(5)) != "").alias("cut"),
        F.transform(F.regexp_extract_all(F.concat(part(3), part(7)), F.lit(r"(\d+)"), 1), lambda p: p.cast("int")).alias("pages"), part(6).alias("back"),
    )


def number_map(paths: DataFrame, path: str = "path") -> DataFrame:
    """``nr``, ``path``: the documents by their number, later folders first; a long name's beginning counts where no document has it as its number."""
    place = F.coalesce(*[F.when(F.col(path).contains(f"{d}/"), F.lit(i)) for i, d in reversed(list(enumerate(FOLDERS)))], F.lit(-1))
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", "")
    named = paths.select(F.trim(F.element_at(F.split(stem, " — "), 1)).alias("nr"), F.col(path).alias("path"), place.alias("_place")).where("nr <> '' and _place >= 0")
    best = named.groupBy("nr").agg(F.max_by("path", F.struct("_place", "path")).alias("path"))
    short = best.where(F.col("nr").contains(ALIAS)).select(F.element_at(F.split("nr", ALIAS), 1).alias("nr"), "path").where("nr <> ''")
    return best.unionByName(short.groupBy("nr").agg(F.min("path").alias("path")).join(best, "nr", "left_anti"))


def stem_of(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?i)\.pdf$", "")


def resolved(cites: DataFrame, documents: DataFrame, nr: str = "nr", stem: str = "stem") -> DataFrame:
    """Citations with the document each number means: the name itself, else the names that go on after a boundary.

    Names are cut at each boundary, so the prefix search is an equi join. A number that
    has the form of a long archive id (``Pol-…_…``) may be followed by letters at once;
    those few are looked for by all prefixes of the names that begin so.
    """
    size = F.length(stem)
    ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | F.substring(F.col(stem), i + 1, 1).rlike(r"[^\p{L}\p{N}]") | (F.col(stem).startswith("Pol-") & F.substring(F.col(stem), F.lit(1), i).contains("_")))
    heads = documents.select(stem, F.explode(F.transform(ends, lambda i: F.substring(F.col(stem), F.lit(1), i))).alias("_head"))
    hits = cites.join(heads, cites[nr] == heads["_head"])
    exact = F.col(stem) == F.col("_head")
    best = hits.groupBy(*cites.columns).agg(F.max(exact).alias("_exact"), F.collect_set(F.when(exact, F.col(stem))).alias("_e"), F.collect_set(stem).alias("_all"))
    return best.select(*cites.columns, F.explode(F.when(F.col("_exact"), F.col("_e")).otherwise(F.col("_all"))).alias(stem))


def resolved_cut(cites: DataFrame, documents: DataFrame, known: DataFrame | None = None, nr: str = "nr", stem: str = "stem") -> DataFrame:
    """Citations whose number was cut off, with the one document they can mean; others are gone.

    Every beginning of a name is a candidate; of several those among ``known`` (the
    documents that were searched) count if there are any; what stays ambiguous is never
    guessed. Names are cut at the lengths that occur among the numbers only.
    """
    sizes = cites.select(F.length(nr).alias("_size")).where("_size > 0").distinct()  # at most as many as a name has characters
    heads = documents.select(stem).distinct().join(F.broadcast(sizes), F.length(stem) >= F.col("_size")).select(stem, F.expr(f"substring({stem}, 1, _size)").alias("_head"))
    hits = cites.join(heads, cites[nr] == heads["_head"]).drop("_head")
    hits = hits.join(known.select(stem).distinct().withColumn("_known", F.lit(True)), stem, "left") if known is not None else hits.withColumn("_known", F.lit(None).cast("boolean"))
    w = hits.groupBy(*cites.columns).agg(F.count(F.lit(1)).alias("_n"), F.count("_known").alias("_k"), F.min(stem).alias("_any"), F.min(F.when(F.col("_known"), F.col(stem))).alias("_own"))
    return w.where("_n = 1 or _k = 1").select(*cites.columns, F.when(F.col("_n") == 1, F.col("_any")).otherwise(F.col("_own")).alias(stem))


def cited_sources(cites: DataFrame, documents: DataFrame, keys: list[str], stem: str = "stem") -> DataFrame:
    """keys, ``source``, ``page``, ``nr``, ``titel``: each document an answer cites, by its first citation; references back give none."""
    c = cites.where("back = ''").select(*keys, "place", "nr", "cut", F.try_element_at("pages", F.lit(1)).alias("page"))
    hits = resolved(c.where("not cut"), documents, stem=stem).unionByName(resolved_cut(c.where("cut"), documents, stem=stem))
    first = hits.groupBy(*keys, stem).agg(F.min_by(F.struct("page", "nr"), "place").alias("f"), F.min("place").alias("place"))
    parts = F.transform(F.split(stem, " — "), lambda p: F.trim(p))
    return first.select(*keys, "place", F.concat(stem, F.lit(".txt")).alias("source"), "f.page", "f.nr", F.coalesce(F.get(parts, F.lit(1)), F.col(stem)).alias("titel"))


def tool_sources(text: Column) -> Column:
    """The distinct sources that a search tool's output names, in lines ``source: "…"``."""
    lines = F.filter(F.split(text, "\n"), lambda s: s.rlike(r'^source: ".*"\s*$'))
    read = F.transform(lines, lambda s: F.get_json_object(F.concat(F.lit('{"s":'), F.substring(F.trim(s), 9, 2**31 - 1), F.lit("}")), "$.s"))
    return F.array_sort(F.array_distinct(F.filter(read, lambda s: s.isNotNull() & (s != ""))))


def anchor(path: str, label: str, title: str = "Öppna PDF", page: int | None = None) -> str:
    """A link that opens a document at a page; ``label`` is HTML already."""
    token = urlsafe_b64encode(path.encode()).decode().rstrip("=")
    return f'<a href="?pdf={token}{f"&page={page}" if page and page > 0 else ""}" target="pdf_opener" title="{html.escape(title)}">{label}</a>'


def linkify(answer: str | None, resolve: Callable[[str, bool], list[str]]) -> str | None:
    """An answer with its citations as links, one for each document that a citation may mean.

    ``resolve(nr, cut)`` gives the paths. A reference back takes the last citation that
    meant one document; one that meant none or several ends that.
    """
    if answer is None:
        return None
    out, at, before = [], 0, None
    for c in citations_of(answer):
        label = html.escape(answer[c.start : c.end], quote=False)
        out.append(answer[at : c.start])
        at = c.end
        page = c.pages[0] if c.pages else None
        if c.back:
            if before is None:
                out.append(label)
                continue
            path, old = before
            shown = old if page is None and c.back == "sida" else page
            before = (path, old if page is None else page)
            out.append(anchor(path, label, page=shown))
            continue
        paths = resolve(c.nr, c.cut)
        before = (paths[0], page) if len(paths) == 1 else None
        if len(paths) < 2:
            out.append(anchor(paths[0], label, page=page) if paths else label)
        else:
            out.append(" ".join(anchor(p, label if not i else f"({i + 1})", p.rsplit("/", 1)[-1], page) for i, p in enumerate(paths)))
    return "".join([*out, answer[at:]])


def linked(df: DataFrame, keys: list[str], answer: str, documents: DataFrame, stem: str = "stem") -> DataFrame:
    """keys and ``linked``: every answer with its citations as links to the documents (``path``).

    What an answer's citations mean is joined to it, so no list of all documents travels.
    """
    with_package(df.sparkSession)
    c = cited(df, keys, answer).where("back = ''").select(*keys, "nr", "cut").distinct()
    names = documents.select(stem)
    hits = resolved(c.where("not cut"), names, stem=stem).unionByName(resolved_cut(c.where("cut"), names, stem=stem)).join(documents, stem)
    links = hits.groupBy(*keys).agg(F.collect_list(F.struct("nr", "cut", stem, "path")).alias("_links"))

    def one(text: str | None, found: list | None) -> str | None:
        paths: dict[tuple[str, bool], list] = {}
        for x in found or ():
            paths.setdefault((x["nr"], x["cut"]), []).append((x[stem], x["path"]))
        return linkify(text, lambda nr, cut: [p for _, p in sorted(paths.get((nr, cut), ()))])

    return df.join(links, keys, "left").select(*keys, F.udf(one, "string", useArrow=True)(answer, "_links").alias("linked"))


def merged_hits(df: DataFrame, key: str, order: str) -> DataFrame:
    """Hits of one source together, sources in the order in which they are first met: ``key``, ``first``, ``hits``."""
    return df.groupBy(key).agg(F.min(order).alias("first"), F.sort_array(F.collect_list(order)).alias("hits"))
