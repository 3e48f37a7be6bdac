"""What is shown of hits, entries, documents and observations, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T


def escaped(t: Column) -> Column:
    """Text as HTML."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def or_blank(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def stem_of_source(source: Column) -> Column:
    """A source's name without .txt."""
    return F.regexp_replace(source, r"\.txt$", "")


def page_at(text: Column, page: Column) -> Column:
    """The page of that number of a document (pages are parted by form feeds); null where there is none."""
    return F.when(page >= 1, F.get(T.split_pages(text), page - 1))


def page_count(text: Column) -> Column:
    return F.size(T.split_pages(text))


def excerpt(source: Column, needles: list[Column], radius: int = 180) -> Column:
    """What stands around the first of the needles that a text holds, whatever the case, … where it is cut; its beginning if it holds none."""
    low = F.lower(source)
    clean = [F.trim(F.coalesce(n, F.lit(""))) for n in needles]
    hits = [F.when((n != "") & (F.instr(low, F.lower(n)) > 0), F.struct((F.instr(low, F.lower(n)) - 1).alias("at"), F.length(n).alias("n"))) for n in clean]
    hit = F.coalesce(*hits, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")))
    a, b = F.greatest(F.lit(0), hit["at"] - radius), F.least(F.length(source), hit["at"] + hit["n"] + radius)
    cut = F.concat(F.when(a > 0, "…").otherwise(""), T.strip(F.substring(source, a + 1, b - a)), F.when(b < F.length(source), "…").otherwise(""))
    return F.when(F.coalesce(source, F.lit("")) == "", "Källtext saknas.").otherwise(cut)


def entry_title(note: Column, question: Column, longest: int = 72) -> Column:
    """A saved answer's title: its note or question on one line, cut at a word."""
    text = T.squeeze(F.coalesce(F.nullif(note, F.lit("")), F.nullif(question, F.lit("")), F.lit("Sparat svar")))
    head = F.substring(text, 1, longest - 3)
    cut = F.regexp_replace(F.when(head.contains(" "), F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head), r"[.,;: ]+$", "")
    return F.when(F.length(text) <= longest, text).otherwise(F.concat(F.coalesce(F.nullif(cut, F.lit("")), head), F.lit("...")))


def source_title(title: Column, source: Column, page: Column) -> Column:
    """A source's title, or its stem, with its page where it is known."""
    t = F.coalesce(F.nullif(title, F.lit("")), F.nullif(stem_of_source(source), F.lit("")), F.lit("Källa"))
    return F.when(F.coalesce(page, F.lit(0)) != 0, F.concat(t, F.lit(", sida "), page.cast("string"))).otherwise(t)


def bookmark(source: Column, page: Column, nr: Column, title: Column) -> Column:
    """What is kept of a source as a bookmark."""
    stem = stem_of_source(F.coalesce(source, F.lit("")))
    number = F.when(stem != "", F.trim(F.element_at(F.split(stem, " — "), 1)))
    return F.struct(source.alias("source"), F.nullif(page, F.lit(0)).alias("page"), F.coalesce(F.nullif(nr, F.lit("")), number).alias("nr"), F.coalesce(F.nullif(title, F.lit("")), stem).alias("title"))


def masks_label(stem: Column, masks: Column, pages: Column) -> Column:
    """A document with how often and on how many pages words are blacked out."""
    return F.concat(stem, F.lit(" — "), F.coalesce(masks, F.lit(0)).cast("string"), F.lit(" maskeringar på "), F.coalesce(pages, F.lit(0)).cast("string"), F.when(pages == 1, " sida").otherwise(" sidor"))


def hit_block(nr: Column, page: Column, title: Column, text: Column, source: Column | None = None) -> Column:
    """A hit with its citation in front, and its file where a tool needs it."""
    head = F.concat(F.lit("[Nr "), nr.cast("string"), F.lit(", sida "), page.cast("string"), F.lit(', "'), F.substring(F.coalesce(title, F.lit("")), 1, 60), F.lit('"]'))
    if source is not None:
        name = F.concat(F.lit('"'), F.replace(F.replace(source, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
        head = F.concat(head, F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("\nsource: "), name)).otherwise(""))
    return F.concat(head, F.lit("\n"), text)


def joined_hits(hits: DataFrame, order: str, block: Column) -> DataFrame:
    """Hits (a short list) as one text in their order."""
    one = hits.select(F.struct(F.col(order).alias("o"), block.alias("t")).alias("x"))
    return one.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def compare_prompt(topic: str, context: Column) -> Column:
    """Hits with the topic they are to be compared on."""
    return F.concat(F.lit(f"Ämne att jämföra källorna kring: {topic}\n\nUtdrag ur arkivet:\n\n"), context)


def mask_hint(text: Column, hint: str) -> Column:
    """The hint where a text has blacked-out words, else nothing."""
    return F.when(text.contains(T.MASK), F.concat(F.lit("\n\n"), F.lit(hint))).otherwise("")


def fraction(done: Column, total: Column) -> Column:
    """How much of a job is done, null where its size isn't known."""
    return F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total)))


def had_text(text: Column, least: int = 200) -> Column:
    """Whether a document's own text layer held more than so many characters other than blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S")) > least, F.lit(False))
