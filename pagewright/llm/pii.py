"""Problem 2: personal information in free text, by anchors and local parsers."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.given_names import GIVEN, NICKNAMES
from pagewright.llm.page_lines import FUNCTION_WORDS

# Titles before a person's name, words before a street's name, ends of street and family names.
TITLES = ("advokat", "kapten", "krim.insp.", "herr", "fru", "fröken", "dir.", "direktör", "dr", "doktor", "polisassistent", "kommissarie", "ing.", "prof.", "löjtnant", "major", "vittnet", "målsäganden")
DIRECTIONS = "Västra|Östra|Norra|Södra|Lilla|Stora|Gamla|Nya|Övre|Nedre|Inre|Yttre"
STREET_ENDS = ("gatan", "gata", "vägen", "väg", "gränd", "gränden", "stigen", "backen", "slingan", "gången", "allén", "torget", "torg", "leden", "esplanaden", "stråket", "terrassen")
SURNAME_ENDS = "skiöld|stierna|hjelm|kjär|[qk]vist|qwist|torn|brink|dahl|mark|hult|fors|[vw]all|näs|hage|sander|hammar|löv|rot|fjell|gård|son|ström|berg|lund|gren|sten|dal|holm|man|lind|kvist|blad|stedt|ling|kvarn"

_GAP = r"(?:[ \t\xa0]+(?:\r?\n[ \t]*)?|\r?\n[ \t]*)"
_BROKEN = r"(?:[-‐‑¬=\xad][ \t]*\r?\n[ \t]*[a-zåäöéü]+)?"
_UP, _LO = "A-ZÀ-ÖØ-Þ", "a-zß-öø-ÿā-ž"
_SURNAME = rf"(?:(?:af|von|de)[ ])?[{_UP}](?:[{_LO}]+{_BROKEN}(?:-[{_UP}]?[{_LO}]+)?|[{_UP}]+(?:-[{_UP}]+)?)(?![{_LO}{_UP}\d])"
_AFTER_GIVEN = re.compile(rf"(?:{_GAP}[{_UP}]\.)?{_GAP}({_SURNAME})")
_BEFORE_GIVEN = re.compile(rf"(?<![{_LO}{_UP}\d.-])({_SURNAME})(,?){_GAP}\Z")
_MIDDLE_AFTER = re.compile(rf"{_GAP}[{_UP}]\.(?!\w)")
_AFTER_INITIAL = re.compile(rf"[{_UP}][a-zåäöé]{{0,3}}\.(?:{_GAP}?[{_UP}]\.)?(?:{_GAP})?({_SURNAME})")
_COMMA_INITIAL = re.compile(rf"({_SURNAME}),{_GAP}[{_UP}]\.\Z")
_KNOWN_END = re.compile(rf"(?:{SURNAME_ENDS})$", re.I)
_NOT_SURNAME = re.compile(rf"(?:{'|'.join(STREET_ENDS)}|s|en|et)$|^(?:ab|hb|enligt|ring|förhör|bilen|uppgiften|svaret|den|det|och|dnr|akt|avd|bil|ja|nej|jo|hm|av|en|ett|tel|sid|blad)$", re.I)
_LOCAL = re.compile(r"[A-Za-z0-9ÅÄÖåäö](?:[A-Za-z0-9ÅÄÖåäö._%+-]*[A-Za-z0-9ÅÄÖåäö_])?[ \xa0]?\Z")
_DOMAIN = re.compile(r"[ \xa0]?[A-Za-z0-9ÅÄÖåäö](?:[A-Za-z0-9ÅÄÖåäö-]*[A-Za-z0-9ÅÄÖåäö])?(?:\.[A-Za-z0-9ÅÄÖåäö-]*[A-Za-z0-9ÅÄÖåäö])*\.[A-Za-z]{2,}")
_ONE = r"(?:[ \xa0]|[ \xa0]?\r?\n[ \t]*)"
_SEP = rf"(?:{_ONE}?[-–/]{_ONE}?|{_ONE})"
#: Subscriber digits in the groups people write, longest first.
_BODY = rf"(?:\d{{3}}{_ONE}\d{{2}}{_ONE}\d{{2}}|\d{{2}}{_ONE}\d{{2}}{_ONE}\d{{3}}|\d{{3}}{_ONE}\d{{3}}{_ONE}\d{{2}}|\d{{2}}{_ONE}\d{{2}}{_ONE}\d{{2}}|\d{{3}}{_ONE}\d{{4}}|\d{{3}}{_ONE}\d{{3}}|\d{{3}}{_ONE}\d{{2}}|\d{{5,8}})"
_PHONE = re.compile(
    rf"(?:\+(?!46)[1-9]\d{{0,2}}(?:[ \xa0.-]?(?:\(\d{{1,4}}\)|\d{{1,5}})){{2,6}}|\+\d{{2}}(?:{_ONE}?\(0\))?{_SEP}?\d{{1,3}}{_SEP}?{_BODY}|\(0\d{{1,3}}\){_SEP}?{_BODY}|0\d{{1,3}}{_SEP}{_BODY}|0\d{{1,3}}(?:\.\d{{3}}\.\d{{2}}\.\d{{2}}|\.\d{{3}}\.\d{{3,4}}|\.\d{{2}}\.\d{{2}}\.\d{{2,3}})|0\d{{6,14}})(?![\d])(?![.,]\d)"
)
_IDNUM = re.compile(rf"((?:1[89]|20)?\d{{2}})(\d{{2}})(\d{{2}})(?:{_GAP}?[-–+‐]{_GAP}?|{_GAP})?\d{{4}}(?![\d])(?![-/.]\d)")
_ID_CUE = re.compile(r"(?:pnr|personnummer|personnr|född|f\.|på|id|nr)[.:]?\s*\Z", re.I)
_PHONE_CUE = re.compile(r"(?:tel|telefon|tfn|mobil|ring|nås på telefon)[.:]?\s*\Z", re.I)
_HOUSE = re.compile(r"\d{1,3}(?:[ \xa0]?[A-Z](?![\w:])|[a-z](?!\w))?(?![\d])(?![-/.,:]\d)(?![A-Za-zåäö])(?![ \xa0]+st\b)(?!\s*/\s*\d)(?!,[ \xa0]*[1-9]\d{0,2}(?:,|[ \xa0]*ff|[ \xa0]*(?:\n|\Z)))")
_MARK_BEFORE, _PIECES = re.compile(r"[ \t]*\d{1,3}[.)][ \t]"), re.compile(r"[ \xa0]+\d+[ \xa0]+st\b")
_STREET = re.compile(rf"(?<![{_LO}{_UP}\d-])(?:(?:{DIRECTIONS}){_GAP})?(?:[{_UP}][{_LO}]*{_BROKEN}(?:-[{_UP}]?[{_LO}]+)?|[{_UP}]+)\.?{_GAP}(?:nr\.?{_GAP})?\Z", re.I)
_STREET_END = re.compile(r"(?:gat[ae]n?|v[äa]g(?:en)?|gr[äa]nd(?:en)?|stigen|backen|slingan|g[åa]ngen|(?:all[éè]|(?<![vh])alle)n|torget|torg|leden|esplanaden|stråket|terrassen)$|(?<=\w\w)[gv]\.$", re.I)

# Words that a person's name follows, beginnings of a capitalised pair and ends of its second word that no person has.
PERSON_CUES = ("med", "av", "ringde", "rör", "enligt", "heter", "hette", "namn:", "vittne:", "avsändare:", "mottagare:", "anmälare:", "kontakt:", "förhör med", "förhördes", "hörde", "mötte", "träffade", "by", "with", "von", "mit", "named")
_NO_GIVEN = re.compile(rf"^(?:{DIRECTIONS}|Hos|En|Ett|Den|Det|De|Han|Hon|Vid|Från|Till|Hotell|Kvarteret|Kv|AB|Firma|The|Der|Die|Das)$|\w{{3,}}(?:köping|torp|ryd|bo?da|sjö|mo|berg|berga|stad|hamn|vik|by)s?$", re.I)
_ORG_END = re.compile(r"(?:tjänst|förvaltning|handel|förlag|byrå|bank|åkeri|tryckeri|klubb|förening|station|industri|verkstad|distrikt|förmedling|fabrik|sjukhus|skola|polisen?|bolag|kyrka|museum|hotell|kiosk|centralen?|verket|nämnden?|myndigheten|kemiska|mekaniska|kommun|län|gatorna|AB|HB|KB)$", re.I)
_NO_NAMES = frozenset().union(*FUNCTION_WORDS.values(), *map(str.split, PERSON_CUES), "ring bilen uppgiften svaret ja nej jo hm förhör samtal mitt emot möte tips brev vittnet polisen".split())
#: A pair of capitalised words, or an initial and one, as a person's name may look.
_PAIR = re.compile(rf"([{_UP}](?:[{_LO}]+(?:-[{_UP}]?[{_LO}]+)?|[{_UP}]+|\.)){_GAP}?(?:[{_UP}]\.{_GAP}?)?({_SURNAME})(?![-\w@])")
_FAMILY_FIRST = re.compile(rf"({_SURNAME}),{_GAP}([{_UP}][{_LO}]+(?:-[{_UP}]?[{_LO}]+)?)(?:{_GAP}[{_UP}]\.)?(?![-\w@.])")
_ITEM_HEAD = re.compile(r"[ \t]*(?:[-–—*•·▪+|]+[ \t]*|\(?\w{1,3}[.)][ \t]*)?(?:\*\*)?")

KINDS = ("email", "id_number", "phone", "address", "name")


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def automaton() -> ahocorasick.Automaton:
    """Anchors over lower-case text: at-signs, beginnings of numbers, given names, initials, titles and other words that name a person."""
    a = ahocorasick.Automaton()
    for s in ("@", "＠", "(at)", "[at]", "{at}", "(a)t", "snabel-a"):
        a.add_word(s, ("at", len(s)))
    for before in " \n\t\xa0\r(:;,|*\"'[/":
        for d in "0123456789":
            a.add_word(before + d, ("digit", 1))
    a.add_word("+", ("digit", 1))
    a.add_word("(0", ("bracket", 2))
    for n in GIVEN | frozenset(NICKNAMES):
        a.add_word(n, ("given", len(n)))
    for before in " \n\t\xa0(:*|":
        for c in "abcdefghijklmnopqrstuvwxyzåäö":
            a.add_word(f"{before}{c}.", ("initial", 2))
    for t in TITLES:
        a.add_word(t + " ", ("title", len(t) + 1))
    for c in PERSON_CUES:
        a.add_word(f" {c} ", ("cue", len(c) + 2))
        a.add_word(f"\n{c} ", ("cue", len(c) + 2))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def _behind(pattern: re.Pattern, text: str, s: int, size: int, inner: str = "") -> re.Match | None:
    """A match that ends at ``s``; the window of ``size`` characters grows until it cuts no word (nor a run of ``inner``)."""
    a = max(0, s - size)
    while a and (text[a].isalnum() or text[a] in inner) and (text[a - 1].isalnum() or text[a - 1] in inner):
        a -= 1
    return pattern.search(text, a, s)


def _email(text: str, s: int, e: int) -> Span | None:
    left, right = _behind(_LOCAL, text, s, 80, "._%+-"), _DOMAIN.match(text, e)
    return Span(left.start(), right.end(), "email") if left and right else None


def _number(text: str, s: int) -> Span | None:
    """A phone number, identity number or house number that begins at ``s``."""
    c = text[s]
    if c in "+(" or c == "0":
        m = _PHONE.match(text, s)
        if m:
            d = re.sub(r"\D", "", m.group())
            size = len(d) - (2 if c == "+" else 4 if d.startswith("0046") else 0)
            good = 6 <= size <= 13 if c == "+" and not d.startswith("46") else 7 <= size <= 11 if c == "+" or d.startswith("0046") else 8 <= size <= 11 or 7 <= size and _behind(_PHONE_CUE, text, s, 20)
            if good and c == "0" and m.group().lstrip("0123456789")[:1].isspace() and m.group()[len(m.group()) - len(m.group().lstrip("0123456789")) :].lstrip()[:1].isdigit():
                good = _behind(_PHONE_CUE, text, s, 20)  # a blank after the area code is common in tables too
            if good and not (c == "0" and (i := _IDNUM.match(text, s)) and _valid(i) and _behind(_ID_CUE, text, s, 20)):
                return Span(s, m.end(), "phone")
        if c in "+(":
            return None
    m = _IDNUM.match(text, s)
    if m and _valid(m):
        return Span(s, m.end(), "id_number")
    m = _HOUSE.match(text, s)
    if m and not _opens_item(text, s, m.end()):
        left = _behind(_STREET, text, s, 60, "-")
        if left:
            word = re.sub(rf"{_GAP}(?:nr\.?{_GAP})?\Z", "", left.group(), flags=re.I)
            name = re.sub(r"[-‐‑¬=\xad]\s*\n\s*", "", word)
            if _STREET_END.search(name) and name[0].isupper():
                return Span(left.start(), m.end(), "address")
    return None


def _opens_item(text: str, s: int, e: int) -> bool:
    """Whether the number ``s``..``e`` begins a list item on a line of its own and not the rest of an address."""
    line = text.rfind("\n", 0, s) + 1
    if not line or text[line:s].strip() or text[e : e + 1] not in (".", ")"):
        return False
    return text[e] == ")" or _MARK_BEFORE.match(text, text.rfind("\n", 0, line - 1) + 1) is not None or _PIECES.match(text, e + 1) is not None


def _valid(m: re.Match) -> bool:
    return 1 <= int(m[2]) <= 12 and (1 <= int(m[3]) <= 31 or 61 <= int(m[3]) <= 91)


def _is_surname(s: str) -> bool:
    flat = re.sub(r"[-‐‑¬=\xad]\s*\n\s*", "", s)
    return len(flat) > 2 and (bool(_KNOWN_END.search(flat)) or not _NOT_SURNAME.search(flat))


def _name(text: str, low: str, s: int, e: int) -> Span | None:
    """A person around the given name at ``s``..``e``: given name first, or family name first."""
    if not text[s].isupper() or s and (low[s - 1].isalnum() or low[s - 1] in "-_@.") or e < len(low) and (low[e].isalnum() or low[e] in "-_@"):
        return None
    after = _AFTER_GIVEN.match(text, e)
    if after and not (_is_surname(after[1]) and _lower(after[1]) not in GIVEN):
        after = None
    if after and "\n" not in text[e : after.start(1)]:
        return Span(s, after.end(), "name")
    m = _behind(_BEFORE_GIVEN, text, s, 45, "-")
    if m and _is_surname(m[1]) and _lower(m[1]) not in GIVEN and (_KNOWN_END.search(m[1]) or m[2] or m[1].isupper()) and not (after and "\n" in m[0]):
        tail = _MIDDLE_AFTER.match(text, e)
        return Span(m.start(), tail.end() if tail else e, "name")
    return Span(s, after.end(), "name") if after else None


def _initial(text: str, s: int) -> Span | None:
    """An initial or shortened given name at ``s`` with a family name after it, or before it and a comma."""
    m = _AFTER_INITIAL.match(text, s)
    if m and _is_surname(m[1]) and (_KNOWN_END.search(m[1]) or s and text[s - 1] not in "\n"):
        return Span(s, m.end(), "name") if _KNOWN_END.search(re.sub(r"[-‐‑¬=\xad]\s*\n\s*", "", m[1])) else None
    m = _behind(_COMMA_INITIAL, text, s + 2, 47, "-.")
    return Span(m.start(), s + 2, "name") if m and text[s].isupper() and _KNOWN_END.search(m[1]) else None


def _named(text: str, s: int) -> Span | None:
    """A name by its shape alone at ``s``, where a cue says that a person is named: a capitalised given name or initial and a family name."""
    m = _PAIR.match(text, s)
    if not m or m[1].lower() in _NO_NAMES or len(m[1]) > 2 and m[1].isupper() != m[2].isupper() or _NO_GIVEN.search(m[1]) or m[1][-1:] == "s" and not _KNOWN_END.search(m[2]):
        return None
    return Span(s, m.end(), "name") if _plausible(m[2]) else None


def _plausible(surname: str) -> bool:
    flat = re.sub(r"[-‐‑¬=\xad]\s*\n\s*", "", surname)
    return len(flat) > 2 and not _ORG_END.search(flat) and not _STREET_END.search(flat) and flat.lower() not in _NO_NAMES


def _listed(text: str, at: int) -> Span | None:
    """A name by its shape alone at the head of the line that ``at`` is in, where personal data follow in that line."""
    head = _ITEM_HEAD.match(text, text.rfind("\n", 0, at) + 1)
    s = head.end()
    if s >= at:
        return None
    m = _FAMILY_FIRST.match(text, s)
    if m and m.end() <= at and _plausible(m[1]) and not _NO_GIVEN.search(m[2]) and not _ORG_END.search(m[2]):
        return Span(s, m.end(), "name")
    got = _named(text, s)
    return got if got and got.end <= at and re.match(r"\s*[,;:|(–-]", text[got.end : got.end + 3]) else None


def _again(text: str, new: list[Span]) -> list[Span]:
    """Other places of names that were found by a cue."""
    names = {text[x.start : x.end] for x in new}
    return [Span(m.start(), m.end(), "name") for n in names for m in re.finditer(rf"(?<!\w){re.escape(n)}(?!\w)", text)]


def find_spans(text: str, anchors: ahocorasick.Automaton) -> list[Span]:
    """Personal information in ``text``, in order and without overlaps.

    The automaton finds anchors in one pass; from each a local parser reads to both
    sides and validates what it reads. A given name needs no list after a title or cue,
    at the head of a line with other personal data, or where the same name stands so
    elsewhere in the text. Where spans overlap, the kind earlier in KINDS
    stands, then the longer one.
    """
    low = _lower(text)
    found: list[Span] = []
    by_cue: list[Span] = []
    for end, (what, size) in anchors.iter("\n" + low):
        e = end  # the added line feed makes the end exclusive
        s = e - size
        if what == "given":
            got = _name(text, low, s, e)
        elif what == "digit":
            got = _number(text, s)
        elif what == "bracket":
            got = _number(text, s) or _number(text, s + 1)
        elif what == "at":
            got = _email(text, s, e)
        elif what == "initial":
            got = _initial(text, s)
        elif not text[e : e + 1].isupper():
            continue
        else:
            if what == "title" and s and low[s - 1].isalnum():
                continue
            if got := _named(text, e):
                by_cue.append(got)
            continue
        if got:
            found.append(got)
    if any(x.kind != "name" for x in found):
        by_cue += [x for at in {x.start for x in found if x.kind != "name"} if (x := _listed(text, at))]
    if by_cue:
        held = {x.start for x in found if x.kind == "name"} | {x.end for x in found if x.kind == "name"}
        by_cue = [x for x in by_cue if x.start not in held and x.end not in held]
        found += by_cue and by_cue + _again(text, by_cue)
    if len(found) < 2:
        return found
    found.sort(key=lambda x: (KINDS.index(x.kind), x.start - x.end))
    starts: list[int] = []
    taken: list[Span] = []
    for x in found:
        i = bisect_left(starts, x.end)  # the last one that begins before the end of this one
        if i == 0 or taken[i - 1].end <= x.start:
            starts.insert(i, x.start)
            taken.insert(i, x)
    return taken


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]`` or ``[NAME]`` in place of each span."""
    out, at = [], 0
    for s, e, kind in spans:
        out += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


def personal_information(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("text", "markdown")) -> DataFrame:
    """One row per finding: key, ``field``, ``kind``, ``snippet`` (white space runs made one blank), ``start``, ``end``.

    Null and empty fields give nothing; a very long text is one pass; repeated keys
    have their own findings; other columns are not read. Rows don't depend on each
    other, so nothing is shuffled.
    """
    of = dict(df.dtypes)[key]
    src = df.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields]).where(F.greatest(*[F.coalesce(F.length(f"_{f}"), F.lit(0)) for f in fields], F.lit(0)) > 0)

    def batch(anchors: ahocorasick.Automaton, keys: list, *texts: list) -> dict[str, list]:
        rows = [(k, f, x.kind, " ".join(t[x.start : x.end].split()), x.start, x.end) for f, col in zip(fields, texts) for k, t in zip(keys, col) if t for x in find_spans(t, anchors)]
        return dict(zip(("_key", "field", "kind", "snippet", "start", "end"), map(list, zip(*rows)))) if rows else {c: [] for c in ("_key", "field", "kind", "snippet", "start", "end")}

    return map_batches(src, batch, f"_key {of}, field string, kind string, snippet string, start int, end int", automaton).withColumnRenamed("_key", key)


def redacted(df: DataFrame, key: str = "id", fields: tuple[str, ...] = ("text", "markdown")) -> DataFrame:
    """key and the fields with typed placeholders; nulls stay null, the rest of each text is unchanged."""
    of = dict(df.dtypes)[key]
    src = df.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in fields])

    def batch(anchors: ahocorasick.Automaton, keys: list, *texts: list) -> dict[str, list]:
        return {"_key": keys} | {f: [t and redact(t, find_spans(t, anchors)) for t in col] for f, col in zip(fields, texts)}

    return map_batches(src, batch, ", ".join([f"_key {of}", *[f"{f} string" for f in fields]]), automaton).withColumnRenamed("_key", key)
