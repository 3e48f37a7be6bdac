"""Problem 7: variant spellings of names, by a symmetric-delete index on tokens."""

from __future__ import annotations

import json
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.given_names import GIVEN, NICKNAMES
from pagewright.llm.pii import TITLES
from pagewright.llm.components import connected_components
from pagewright.session import broadcaster, materialize

# Legal forms, which say nothing about which organisation it is.
LEGAL = frozenset("ab hb kb aktiebolag handelsbolag kommanditbolag ek för filial".split())
_FOLD = str.maketrans("åäàáâöøóòéèêëüúùíìîñç", "aaaaaooooeeeeuuuiiinc")
_TITLE = re.compile(rf"^(?:(?:{'|'.join(map(re.escape, sorted(TITLES, key=len, reverse=True)))})\s+)+", re.I)
#: Edit distance (with transpositions) that two spellings of one token may have.
SLIPS = 1
#: Names with one key that are compared in one place; more are parted.
BLOCK = 1000
#: Cost of an abbreviation with a slip.
SLIPPED = 0.95


def fold(token: str) -> str:
    """A token as it sounds: lower case, no diacritics, ck/k, w/v, q/k, th/t alike."""
    t = token.lower().translate(_FOLD)
    return t.replace("ck", "k").replace("w", "v").replace("q", "k").replace("th", "t")


_GIVEN = frozenset(map(fold, GIVEN))
_NICK = {fold(k): tuple(map(fold, v)) for k, v in NICKNAMES.items()}


def _classes() -> dict[str, str]:
    """Names and their short forms, each with one of those it hangs together with."""
    of: dict[str, str] = {}
    for nick, names in _NICK.items():
        same = {nick, *names}
        same |= {k for k, v in of.items() if v in {of.get(x) for x in same}}
        of.update(dict.fromkeys(same, min(same)))
    return of


_CLASS = _classes()


def tokens_of(name: str, kind: str) -> list[str]:
    """The folded tokens that tell a name: without titles, legal forms, 'och', 'i' and genitive endings; initials and abbreviations keep their full stop."""
    if kind == "person":
        s = _TITLE.sub("", name.strip())
        if not re.search(r"[\s,]", s.strip(" ,")):
            s = name.strip()  # what looked like a title is a shortened given name
        out = [fold(t) for t in re.split(r"[\s,]+", s) if t.strip(".-")]
        joined: list[str] = []
        for t in out:
            if joined and f"{joined[-1]}-{t}" in _GIVEN:
                joined[-1] += f"-{t}"
            else:
                joined.append(t)
        return [t if t.endswith(".") or len(t) > 1 else t + "." for t in joined]
    raw = [t for t in re.split(r"[\s,]+", name.strip().lower()) if t.strip(".-")]
    out = [t for t in raw if t.rstrip(".") not in LEGAL and t not in ("i", "och", "&", "for")]
    return [fold(t if t.endswith(".") or len(t) < 5 or not t.endswith("s") else t[:-1]) for t in out]


def deletes(token: str) -> set[str]:
    """The token and what is left when up to SLIPS of its characters are taken out."""
    out = {token}
    if len(token) > 3 and not token.endswith("."):
        out.update(token[:i] + token[i + 1 :] for i in range(len(token)))
    return out


def within(a: str, b: str) -> bool:
    """Whether an edit or a transposition of neighbours at most parts two tokens."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :]


def _is_short(t: str) -> bool:
    return "." in t or re.fullmatch(r"[a-z]-[a-z]", t) is not None


def _short_of(short: str, full: str) -> bool:
    """Whether an initial or abbreviation (each part of it) can stand for ``full``."""
    parts = [p for p in re.split(r"[.\-]", short) if p]
    whole = full.split("-")
    if len(parts) == 2 and len(whole) == 2 and len(short) <= 4:
        return all(w.startswith(p) for p, w in zip(parts, whole))
    at = 0
    for i, p in enumerate(parts):
        if i == 0:
            if not full.startswith(p):
                return False
            at = len(p)
        else:
            j = full.find(p, at)
            if j < 0:
                return False
            at = j + len(p)
    return bool(parts)


def token_cost(a: str, b: str) -> float:
    """0 for the same token, up to 1 for a plausible one, 9 for another."""
    if a == b:
        return 0.0
    sa, sb = _is_short(a), _is_short(b)
    if sa and sb:
        x, y = a.rstrip("."), b.rstrip(".")
        if x.startswith(y) or y.startswith(x):
            return 0.9
        return SLIPPED if min(len(x), len(y)) > 2 and x.isalpha() and y.isalpha() and x[0] == y[0] and within(x, y) else 9
    if sa or sb:
        short, full = (a, b) if sa else (b, a)
        if _short_of(short, full) or any(_short_of(short, x) for x in _NICK.get(full, ())):
            return 0.8
        cut = short.rstrip(".")  # an abbreviation may have a slip as well, but for its first letter
        return SLIPPED if len(cut) > 2 and cut.isalpha() and cut[0] == full[0] and any(within(cut, full[:k]) for k in (len(cut) - 1, len(cut), len(cut) + 1)) else 9
    if b in _NICK.get(a, ()) or a in _NICK.get(b, ()) or _NICK.get(a) and set(_NICK[a]) & set(_NICK.get(b, ())):
        return 0.3
    return 0.5 if within(a, b) and not (a in _GIVEN and b in _GIVEN) else 9


def _assign(cost: list[list[float]]) -> list[int]:
    """The column of each row at least total cost (Hungarian method, square matrix)."""
    n = len(cost)
    u, v, row_of, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j = i, 0
        least, used = [float("inf")] * (n + 1), [False] * (n + 1)
        while row_of[j]:
            used[j] = True
            for k in range(1, n + 1):
                if not used[k] and (c := cost[row_of[j] - 1][k - 1] - u[row_of[j]] - v[k]) < least[k]:
                    least[k], way[k] = c, j
            nxt = min((k for k in range(1, n + 1) if not used[k]), key=least.__getitem__)
            d = least[nxt]
            for k in range(n + 1):
                if used[k]:
                    u[row_of[k]] += d
                    v[k] -= d
                else:
                    least[k] -= d
            j = nxt
        while j:
            row_of[j], j = row_of[way[j]], way[j]
    out = [0] * n
    for k in range(1, n + 1):
        out[row_of[k] - 1] = k - 1
    return out


def _assignments(a: list[str], b: list[str], cost: list[list[float]]) -> list[tuple[float, tuple[int, ...]]]:
    """Assignments of ``a`` to tokens of ``b``, the cheapest first: for each set of taken tokens, or the optimum alone for a long name."""
    if len(b) > 12:
        spare = [0.0 if y.endswith(".") and len(y) == 2 else 99.0 for y in b]
        way = _assign([[x if x < 9 else 99.0 for x in row] for row in cost] + [spare] * (len(b) - len(a)))[: len(a)]
        c = sum(row[j] for row, j in zip(cost, way))
        return [(c, tuple(way))] if all(row[j] < 9 for row, j in zip(cost, way)) else []
    best = {0: (0.0, ())}
    for row in cost:
        nxt: dict[int, tuple] = {}
        for taken, (c, way) in best.items():
            for j, x in enumerate(row):
                if not taken >> j & 1 and x < 9 and (t := taken | 1 << j) not in nxt or not taken >> j & 1 and x < 9 and nxt[t][0] > c + x:
                    nxt[t] = (c + x, (*way, j))
        best = nxt
    return sorted(best.values(), key=lambda x: x[0])


def align(a: list[str], b: list[str], kind: str = "person") -> tuple[float, int] | None:
    """Cost of the best assignment of tokens and what it rests on (0: whole words, 1: an initial or abbreviation, 2: one with a slip), or None if the names can't be one.

    The shorter list is assigned to distinct tokens of the longer one at least cost
    (see _assignments). Left over may be single initials only; at least one token must
    agree as a whole word, and be longer than three letters unless all tokens are equal.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return None
    cost = [[token_cost(x, y) for y in b] for x in a]
    for c, way in _assignments(a, b, cost):
        rest = [y for j, y in enumerate(b) if j not in way]
        if any(not (y.endswith(".") and len(y) == 2) for y in rest):
            continue
        pairs = list(zip(a, (b[j] for j in way)))
        whole = [p for p in pairs if not _is_short(p[0]) and not _is_short(p[1])]
        if not any(len(x) > 3 for x, _ in whole) and not (whole and not rest and all(x == y for x, y in pairs)) or sum(x != y and token_cost(x, y) in (0.5, SLIPPED) for x, y in pairs) > 1:
            continue
        if any(token_cost(x, y) == SLIPPED for x, y in pairs):
            return c, 2
        if kind != "person" and all(len(x.rstrip(".")) > 2 for p in pairs for x in p) and whole:
            return c, 0  # an abbreviated trade beside a place is no other's
        return c, int(len(whole) < len([x for x in a if not (x.endswith(".") and len(x) == 2)]) or len(whole) < 2)
    return None


def whole_keys(tokens: list[str]) -> set[str]:
    """Blocks of whole names: all whole tokens in order of the alphabet, one of them with a character taken out or none.

    Two names that differ by one slip or by short forms share such a key, so a block holds
    the spellings of about one person or organisation, however frequent their words are.
    """
    full = [t for t in tokens if not _is_short(t)]
    forms = [_CLASS.get(t, t) for t in full]
    out = {" ".join(sorted(forms))} if full else set()
    for i, t in enumerate(full):
        rest = " ".join(sorted([*forms[:i], *forms[i + 1 :]]))
        out.update(f"{d}|{rest}" for d in deletes(t))
    return out


def initial_keys(tokens: list[str]) -> set[str]:
    """Blocks in which a name with initials or abbreviations is looked for: a family name (or word) with a character taken out and the initial of another token."""
    full = [t for t in tokens if not _is_short(t)]
    out: set[str] = set()
    family = [t for t in full if t not in _GIVEN and t not in _NICK] or full
    for t in family:
        for u in tokens:
            if u is not t:
                for first in {u[0], *(x[0] for x in _NICK.get(u, ()))}:
                    out.update(f"{d}/{first}" for d in deletes(t))
    return out


def entity_names(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """Distinct ``kind`` ('person', 'organisation') and ``name`` of all readable payloads and targets.

    Null, empty and broken JSON gives nothing; names are as written.
    """
    payloads = entities.select(F.col("payload").alias("j")).unionByName(decisions.select(F.col("target_json").alias("j"))).where(F.col("j").isNotNull()).distinct()

    def batch(texts: list) -> dict[str, list]:
        seen: set[tuple[str, str]] = set()
        for t in texts:
            try:
                o = json.loads(t)
            except ValueError:
                continue
            if not isinstance(o, dict):
                continue
            listed = o.get("entiteter")
            for e in [*(listed if isinstance(listed, list) else []), o]:
                if isinstance(e, dict) and e.get("typ") in ("person", "organisation") and isinstance(e.get("namn"), str) and e["namn"].strip():
                    seen.add((e["typ"], e["namn"]))
        return {"kind": [k for k, _ in seen], "name": [n for _, n in seen]}

    return map_batches(payloads, batch, "kind string, name string").distinct()


def _pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct pairs ``a``, ``b`` of a name of ``left`` and another of ``right`` that share a key.

    The names of a key that has more than BLOCK of them on the right are parted into
    blocks, and the left ones meet each block by itself, so no task gets a whole hot key.
    """
    hot = materialize(right.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "hotkeys")  # at most 1 in BLOCK keys
    one, small = F.coalesce(F.col("blocks"), F.lit(1)), broadcaster(hot, 1_000_000)
    x = left.join(small(hot), "key", "left").select("key", F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), one - 1)).alias("block"))
    y = right.join(small(hot), "key", "left").select("key", F.col("node").alias("b"), F.pmod(F.xxhash64("node"), one).cast("int").alias("block"))
    return x.join(y, ["key", "block"]).where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def name_links(names: DataFrame) -> DataFrame:
    """Links ``a < b`` (names marked with their kind), ``weak`` (0, 1, 2) as in ``align``."""

    def keys(kinds: list, ns: list) -> dict[str, list]:
        out: dict[str, list] = {"key": [], "node": [], "how": []}
        for k, n in zip(kinds, ns):
            t = tokens_of(n, k)
            # 0: whole names among each other; 1: names with an initial or abbreviation; 2: what these may stand for
            for how, found in ((0, whole_keys(t)), (1 if any(map(_is_short, t)) else 2, initial_keys(t))):
                out["key"] += [xxhash.xxh64_intdigest(f"{k[0]}{x}") - 2**63 for x in found]
                out["node"] += [f"{k[0]}{n}"] * len(found)
                out["how"] += [how] * len(found)
        return out

    index = map_batches(names.select("kind", "name"), keys, "key long, node string, how int")
    index = materialize(index.join(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1), "key", "left_semi"), "nameindex")
    whole, short, any_ = index.where("how = 0"), index.where("how = 1"), index.where("how > 0")
    pairs = _pairs(whole, whole).unionByName(_pairs(short, any_)).distinct()

    def verify(a: list, b: list) -> dict[str, list]:
        out: dict[str, list] = {"a": [], "b": [], "weak": []}
        for x, y in zip(a, b):
            kind = "person" if x[0] == "p" else "organisation"
            got = align(tokens_of(x[1:], kind), tokens_of(y[1:], kind), kind)
            if got:
                out["a"].append(x)
                out["b"].append(y)
                out["weak"].append(got[1])
        return out

    return map_batches(pairs, verify, "a string, b string, weak int")


def _only_short(name: str, kind: str) -> bool:
    """Whether a name has a shortened token and fewer than two whole ones."""
    t = tokens_of(name, kind)
    return any(_is_short(x) and len(x) > 1 for x in t) and sum(not _is_short(x) for x in t) < 2


def link_names(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """``kind``, ``name``, ``entity`` (smallest whole spelling of its person or organisation), ``links``.

    Whole spellings are linked by the best assignment of their tokens. A spelling with
    an initial or abbreviation joins the one entity it can stand for; where it can stand
    for several, it stays alone, as relatives share surnames and initials.
    Names that no link reaches are their own entity.
    """
    names = materialize(entity_names(entities, decisions), "names")
    links = materialize(name_links(names), "namelinks")
    marked = map_batches(
        names.select("kind", "name"), lambda kinds, ns: {"node": [f"{k[0]}{n}" for k, n in zip(kinds, ns)], "kind": kinds, "name": ns, "only_short": [_only_short(n, k) for k, n in zip(kinds, ns)]},
        "node string, kind string, name string, only_short boolean",
    )
    strong = connected_components(links.where("weak = 0").select("a", "b"))
    base = materialize(marked.join(strong, "node", "left").select("node", "kind", "name", "only_short", F.coalesce("component", "node").alias("c")), "namebase")
    weak = links.where("weak > 0")
    weak = weak.unionByName(weak.select(F.col("b").alias("a"), F.col("a").alias("b"), "weak"))
    full = base.groupBy("c").agg(F.min("only_short").alias("only_short"))
    # Components that rest on short spellings alone, and all components of the other side they could join.
    side = weak.join(base.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(base.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where(F.col("ca") != F.col("cb")).groupBy("ca", "cb").agg(F.min("weak").alias("weak"))
    side = side.join(full.select(F.col("c").alias("ca"), F.col("only_short").alias("sa")), "ca").where("sa").join(full.select(F.col("c").alias("cb"), F.col("only_short").alias("sb")), "cb")
    side = materialize(side.select("ca", "cb", "sb", "weak"), "nameside")
    # What an abbreviation stands for as it is goes before what it may stand for with a slip.
    side = side.join(side.groupBy("ca", "sb").agg(F.min("weak").alias("weak")), ["ca", "sb", "weak"]).drop("weak")
    to_full = side.where("not sb").groupBy("ca").agg(F.min("cb").alias("cb"), F.count(F.lit(1)).alias("n"))
    reached = to_full.select("ca")
    lonely = side.where("sb").join(reached, "ca", "left_anti").join(reached.select(F.col("ca").alias("cb")), "cb", "left_anti").select("ca", "cb")
    merged = connected_components(to_full.where("n = 1").select("ca", "cb").unionByName(lonely), "ca", "cb")
    out = base.join(merged.withColumnRenamed("node", "c"), "c", "left").select("kind", "name", F.coalesce("component", "c").alias("entity"))
    counts = out.groupBy("entity").agg((F.count(F.lit(1)) - 1).alias("links"))
    return out.join(counts, "entity").select("kind", "name", F.expr("substring(entity, 2)").alias("entity"), "links")
