"""Column expressions over text. All null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the page score: weights of the ratios, the vowel share of good text, punctuation that isn't junk.
SCORE_WEIGHTS = {"junk": 200, "short": 80, "long": 100, "digit": 150, "vowel": 100, "dictionary": 60}
VOWEL_TARGET = 0.40
MASK = "[MASKAD]"
# Characters and what stands for them in clean text.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ĳ": "ij", "­": "", "﻿": ""}

ALNUM = r"[\p{L}\p{N}]"


def strip(c: Column) -> Column:
    """Without white space at the ends (not only blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def ratio(a: Column, b: Column) -> Column:
    return F.round(a / F.greatest(b, F.lit(1)), 3)


def text_counts(t: Column) -> dict[str, Column]:
    """The counts the page score rests on. Whole-text patterns only: no arrays of words are built, so this stays one pass per count."""
    w = r"A-Za-zÅÄÖåäö\-"
    return {
        "chars": F.length(t),
        "junk": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s.,;:!?\"'()\-–—…/\\\[\]{}<>]")),
        "tokens": F.regexp_count(t, F.lit(r"\S+")),
        "words": F.regexp_count(t, F.lit(rf"[{w}]+")),
        "short": F.regexp_count(t, F.lit(rf"(?<![{w}])[{w}]{{1,2}}(?![{w}])")),
        "long": F.regexp_count(t, F.lit(rf"[{w}]{{18,}}")),
        "mixed": F.regexp_count(t, F.lit(r"(?<!\S)(?:(?=\S*?\d)(?=\S*?[A-Za-zÅÄÖåäö])\S+)")),
        "letters": F.length(F.regexp_replace(t, r"\P{L}+", "")),
        "vowels": F.length(t) - F.length(F.translate(t, "aeiouyåäöAEIOUYÅÄÖ", "")),
    }


def score_from(c: dict[str, Column], dictionary_share: Column | None = None) -> Column:
    """The page score 0..100 (larger is better) from ``text_counts``; 0 without any token."""
    w = SCORE_WEIGHTS
    raw = (
        100
        - ratio(c["junk"], c["chars"]) * w["junk"]
        - ratio(c["short"], c["words"]) * w["short"]
        - ratio(c["long"], c["words"]) * w["long"]
        - ratio(c["mixed"], c["tokens"]) * w["digit"]
        - F.abs(ratio(c["vowels"], c["letters"]) - VOWEL_TARGET) * w["vowel"]
    )
    if dictionary_share is not None:
        raw = raw - F.coalesce((1 - F.round(dictionary_share, 3)) * w["dictionary"], F.lit(0.0))
    return F.when(c["tokens"] > 0, F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 1)).otherwise(0.0)


def alnum_count(t: Column) -> Column:
    return F.regexp_count(t, F.lit(ALNUM))


def layer_usable(t: Column) -> Column:
    """Whether a text layer can stand: enough letters and digits, few short and few mixed tokens; false when empty or blank."""
    tokens = F.regexp_extract_all(t, F.lit(r"(\S+)"), 1)
    n = F.size(tokens)
    short = F.size(F.filter(tokens, lambda w: F.length(w) <= 2))
    mixed = F.size(F.filter(tokens, lambda w: w.rlike(r"\d") & w.rlike(r"\p{L}")))
    return F.coalesce((n > 0) & (alnum_count(t) >= 0.55 * F.length(t)) & (short <= 0.30 * n) & (mixed <= 0.10 * n), F.lit(False))


def clean_characters(t: Column) -> Column:
    """Ligatures spelled out, line ends as line feeds, control characters gone (tabs, line and form feeds stay)."""
    for a, b in LIGATURES.items():
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(t, r"[\x00-\x08\x0b\x0e-\x1f\x7f]", "")


def untagged(line: Column) -> Column:
    """A line without tags and outer blanks."""
    return strip(F.regexp_replace(strip(line), r"<[^>]{1,100}>", ""))


def is_content(s: Column) -> Column:
    """Whether an untagged line is empty or more than decoration."""
    return (s == "") | s.rlike(ALNUM) | ~((F.length(s) <= 2) | s.rlike(r"^(?:[\s|]+|[-~=_·•.]{3,}|[\s·•.]+)$"))


def normalize_text(t: Column) -> Column:
    """Characters and lines of every page cleaned, at most one empty line in a row; idempotent on its own output."""

    def page(p: Column) -> Column:
        lines = F.filter(F.transform(F.split(p, "\n"), untagged), is_content)  # two steps, so that each line is cleaned once
        return F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n")

    return F.array_join(F.transform(F.split(clean_characters(t), "\f"), page), "\f")


def normalize_markdown(t: Column) -> Column:
    """Characters of Markdown cleaned, at most one empty line in a row; lines and their indents stay, as they are structure."""
    return F.regexp_replace(clean_characters(t), r"\n{3,}", "\n\n")


def markdown_is_fresh(stored: Column, page: Column) -> Column:
    """Whether a page's Markdown still belongs to its text: the stored text, cleaned, is the page as it is; false where there is none."""
    return F.coalesce(normalize_text(stored) == page, F.lit(False))


def nfc(t: Column) -> Column:
    """Accents composed with their letters; Spark has no function for it, so this is an Arrow batch. For input that may come decomposed, before ``normalize_text``."""

    @F.pandas_udf("string")
    def compose(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x and unicodedata.normalize("NFC", x))

    return compose(t)


def marker_count(t: Column, marker: str = MASK) -> Column:
    """How often a marker stands in the text."""
    return F.size(F.split(t, F.concat(F.lit(r"\Q"), F.lit(marker), F.lit(r"\E")), -1)) - 1


def marker_snippets(t: Column, marker: str = MASK, window: int = 80) -> Column:
    """An array with the surroundings of each marker, white space squeezed, … where they are cut."""
    n, size = len(marker), F.length(t)
    parts = F.split(t, F.concat(F.lit(r"\Q"), F.lit(marker), F.lit(r"\E")), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.length(F.array_join(F.slice(parts, 1, i), marker)))

    def snippet(s: Column) -> Column:
        a, b = F.greatest(s - window, F.lit(0)), F.least(s + n + window, size)
        return F.concat(F.when(a > 0, "…").otherwise(""), squeeze(F.substring(t, a + 1, b - a)), F.when(b < size, "…").otherwise(""))

    return F.when(F.size(parts) > 1, F.transform(starts, snippet)).otherwise(F.array().cast("array<string>"))


def search_tokens(t: Column) -> Column:
    """Lower-case runs of digits and letters, in order."""
    return F.regexp_extract_all(F.lower(t), F.lit(r"([0-9a-zåäöéèü]+)"), 1)


def vocabulary_words(t: Column, least: int = 4) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(rf"([a-zåäö]{{{least},}})"), 1)


def split_pages(t: Column) -> Column:
    """Pages of a document, which are parted by form feeds."""
    return F.split(t, "\f")


def filename_fields(stem: Column) -> Column:
    """Six fields of a document's name, parted by a dash between blanks; missing ones are empty, a missing number is the name's beginning."""
    parts = F.transform(F.split(stem, " — "), strip)
    get = lambda i: F.coalesce(F.get(parts, i), F.lit(""))
    names = ("nr", "titel", "datum", "avsandare", "mottagare", "anmarkning")
    first = F.when(get(0) != "", get(0)).otherwise(F.substring(stem, 1, 40))
    return F.struct(first.alias("nr"), *[get(i).alias(n) for i, n in enumerate(names) if i])


def clean_part(c: Column) -> Column:
    """A part of a file name: blanks squeezed, characters file systems refuse as a dash."""
    return F.regexp_replace(squeeze(c), r'[\\/:*?"<>|\r\n\t]+', "-")


def build_filename(parts: list[Column], longest: int = 180) -> Column:
    """Non-empty parts joined by a dash between blanks, without outer dots and blanks, cut; 'fil' if there are none."""
    kept = F.filter(F.array(*[F.coalesce(clean_part(p), F.lit("")) for p in parts]), lambda p: p != "")
    name = F.when(F.size(kept) > 0, F.array_join(kept, " — ")).otherwise("fil")
    return F.substring(F.regexp_replace(name, r"^[. ]+|[. ]+$", ""), 1, longest)


def drive_id(url: Column) -> Column:
    """The id in a sharing link, null if there is none."""
    by_path, by_query = F.regexp_extract(url, r"/d/([A-Za-z0-9_-]+)", 1), F.regexp_extract(url, r"[?&]id=([A-Za-z0-9_-]+)", 1)
    return F.coalesce(F.nullif(by_path, F.lit("")), F.nullif(by_query, F.lit("")))


def archive_keys(name: Column) -> Column:
    """All ``PREFIX####-NN[-SUFFIX]`` in a name as structs; a suffix of several letters gives a key for each."""
    found = F.regexp_extract_all(name, F.lit(r"(?<![A-Za-z0-9])([A-Z]{1,4}\d{3,7}-\d{1,3}(?:-[A-Z]{1,4})?)(?![A-Za-z0-9])"), 1)

    def keys(m: Column) -> Column:
        part = lambda i: F.regexp_extract(m, r"^([A-Z]+)(\d+)-(\d+)(?:-([A-Z]+))?$", i)
        letters = F.when(part(4) == "", F.array(F.lit(""))).otherwise(F.filter(F.split(part(4), ""), lambda x: x != ""))
        return F.transform(letters, lambda s: F.struct(part(1).alias("prefix"), part(2).cast("int").alias("base"), part(3).cast("int").alias("version"), s.alias("suffix")))

    return F.array_distinct(F.flatten(F.transform(found, keys)))


# How models write that words are blacked out. Beginnings of words, then whole expressions.
MASK_STEMS = ("svärta", "maskera", "maskad", "överstr", "censur", "redact")
MASK_PHRASES = ("blacked", "blacked out", "svart fält", "svärtad text", "maskerad text")


def normalize_mask_markers(t: Column) -> Column:
    """All the ways a model writes that words are blacked out as the one marker: in brackets, with a word after it or not, or as a run of black signs."""
    said = [rf"{w}\p{{L}}*" for w in MASK_STEMS] + [r"\s+".join(p.split()) for p in sorted(MASK_PHRASES, key=len, reverse=True)]
    return F.regexp_replace(t, rf"(?iu)\[\s*(?:{'|'.join(said)})(?:\s+[\p{{L}}\p{{N}}_]+)?\s*\]|[█■]{{2,}}", r"\[MASKAD\]")


def markdown_to_text(md: Column) -> Column:
    """Markdown without signs that have no text of their own; table rows become cells between tabs."""

    def line(s: Column) -> Column:
        row = s.rlike(r"^\s*\|.*\|\s*$")
        cells = F.array_join(F.transform(F.split(F.regexp_replace(strip(s), r"^\|+|\|+$", ""), r"\|"), strip), "\t")
        plain = F.regexp_replace(F.regexp_replace(s, r"^\s{0,3}>\s?", ""), r"^\s{0,3}#{1,6}\s+", "")
        return F.regexp_replace(F.replace(F.replace(F.when(row, cells).otherwise(plain), F.lit("**"), F.lit("")), F.lit("__"), F.lit("")), r"\s+$", "")

    rule = lambda s: s.rlike(r"^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$") & s.contains("|")
    return F.array_join(F.transform(F.filter(F.split(md, "\n"), lambda s: ~rule(s)), line), "\n")


# Conjunctions before which a hyphen at a line's end is one of a pair of compounds.
CONJUNCTIONS = ("och", "eller", "som", "till", "samt")


def dehyphenate(t: Column) -> Column:
    """Words broken over two lines put together, unless a conjunction follows the hyphen."""
    return F.regexp_replace(t, rf"(?<=[\p{{L}}\p{{N}}_])-\n(?=[a-zåäöéü])(?!(?:{'|'.join(CONJUNCTIONS)})(?![\p{{L}}\p{{N}}_]))", "")


def normalize_name(name: Column) -> Column:
    """The key of a name: 'Family, Given' turned round (one comma, no digit), blanks squeezed, lower case."""
    return F.lower(display_name(name))


def display_name(name: Column) -> Column:
    parts = F.split(name, ",")
    a, b = strip(F.get(parts, F.lit(0))), strip(F.get(parts, F.lit(1)))
    turn = (F.size(parts) == 2) & (a != "") & (b != "") & ~name.rlike(r"\p{N}")
    return squeeze(F.when(turn, F.concat_ws(" ", b, a)).otherwise(name))


def compact_count(n: Column) -> Column:
    """512, 335k, 1.5m: thousands and millions, halves rounded up."""
    k, m = F.floor(n / 1000 + 0.5), n / 1_000_000
    return (
        F.when(F.abs(n) < 1000, n.cast("string"))
        .when(F.abs(k) < 1000, F.concat(k.cast("string"), F.lit("k")))
        .when(F.abs(m) < 10, F.concat(F.format_string("%.1f", m.cast("double")), F.lit("m")))
        .otherwise(F.concat(F.floor(m + 0.5).cast("string"), F.lit("m")))
    )


def cost_text(cost: Column) -> Column:
    return F.when(F.abs(cost) < 1, F.format_string("$%.4f", cost.cast("double"))).otherwise(F.format_string("$%.2f", cost.cast("double")))


def duration_text(seconds: Column) -> Column:
    """'2 h 5 min', '5 min 3 s' or '3 s'; a span that runs backwards is 0 s."""
    s = F.greatest(seconds.cast("long"), F.lit(0))
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(h > 0, F.format_string("%d h %d min", h, m)).when(m > 0, F.format_string("%d min %d s", m, r)).otherwise(F.format_string("%d s", r))


def usage_summary(calls: Column, inputs: Column, outputs: Column, cost: Column, partial: Column) -> Column:
    """Calls, tokens and cost of a profile on one line; a missing cost is unknown, not nothing."""
    head = F.concat(calls.cast("string"), F.lit(" anrop · ↑"), compact_count(inputs), F.lit(" ↓"), compact_count(outputs))
    c = F.coalesce(cost, F.lit(0.0))
    money = F.concat(F.lit(" · ≈ "), cost_text(c), F.when(partial, " (ofullständig — anrop utan pris)").otherwise(""))
    return F.when(F.coalesce(calls, F.lit(0)) == 0, "0 anrop").otherwise(F.concat(head, F.when((c == 0) & ~partial, "").when(c == 0, " · kostnad okänd").otherwise(money)))


def recognition_languages(text: Column, english: Column) -> Column:
    """The languages a page is to be read in, by the share of English (of a detector or of function words): both where there is no text."""
    return F.when(F.trim(F.coalesce(text, F.lit(""))) == "", "swe+eng").when(english > 0.80, "eng").otherwise("swe")


def time_of(value: Column) -> Column:
    """HH:MM from 'kl 9.05', '21:30' and the like; null if there is no time."""
    hour = F.regexp_extract(value, r"(?<!\d)([01]?\d|2[0-3])[ .:]([0-5]\d)(?!\d)", 1)
    return F.when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), F.regexp_extract(value, r"(?<!\d)([01]?\d|2[0-3])[ .:]([0-5]\d)(?!\d)", 2)))


def clock_minutes(hhmm: Column) -> Column:
    """Minutes since midnight of the night's first day: hours before noon belong to the next day; null if not HH:MM."""
    ok = hhmm.rlike(r"^([01]\d|2[0-3]):[0-5]\d$")
    h = F.substring(hhmm, 1, 2).try_cast("int")
    return F.when(ok, (h + F.when(h < 12, 24).otherwise(0)) * 60 + F.substring(hhmm, 4, 2).try_cast("int"))


def excluded_host(url: Column, domains: list[str]) -> Column:
    """Whether the host of a link is one of the domains or below one."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/:?#]+)", 1))
    out = F.lit(False)
    for d in domains:
        out = out | (host == d) | host.endswith(f".{d}")
    return out
