"""Problem 10: keyword-stuffed and link-list pages, by rank-frequency curves."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.page_lines import _BLANK, _MARK, _TURN, FUNCTION_WORDS, GARBAGE, kind, read_page
from pagewright.session import broadcaster, materialize, release

#: A word belongs to a language's prose model from this share on (at most 100,000 words a language); any other word counts as this rare.
MODEL_SHARE = 1e-5
#: Deviations from prose of the language and length beyond which a curve is extreme.
EXTREME = 2.0
#: Prose texts of a language and length from which their deviation is taken, else that of the whole language.
LEAST_PROSE = 20
#: Share of a candidate's characters in keywords, links, tags and offers from which it is spam.
SPAM_SHARE = 0.5

_WORD = re.compile(r"[^\W\d_]+")
# What stands behind a dot without a blank and isn't the end of a host.
_NO_SUFFIX = "nr|kl|st|kr|ex|tel|fören|pdf|txt|docx?|xlsx?|csv|jpe?g|png|gif|tiff?|bmp|html?|xml|json|zip|mp3|mp4|wav|avi"
_LINK = re.compile(
    r"<a\s[^>]*>.*?</a>|\[[^\]\n]*\]\([^)\n]*\)|(?:https?://|(?<![\w:])//|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:test|example|invalid|localhost|com|net|org|info|biz|shop|store|online|site|io|se|nu|no|dk|fi|de|at|ch|eu|co\.uk)\b(?:/\S*)?"
    # a host by its shape: any last label of letters, in small letters or all in capitals, that is no file kind and no abbreviation
    r"|(?<![\w.@-])(?-i:[\w-]{3,}(?:\.[\w-]+)*\.(?!(?:" + _NO_SUFFIX + r")\b)[a-z]{2,24}|[A-Z\d-]{3,}(?:\.[A-Z\d-]+)*\.(?!(?i:" + _NO_SUFFIX + r")\b)[A-Z]{2,24})(?![\w-]|\.\w)(?:/\S*)?",
    re.I,
)
_HINT = re.compile(r"[\w-]\.[a-z]{2}|//|\]\(|<a\s|www\.", re.I)
_TAG = re.compile(r"(?<!\w)#\w+")
_OFFER = re.compile(r"(?:\b\d[\d.,]*\s?(?:kr|sek|eur|usd|euro|€|\$|£)(?!\w)|[€$£]\s?\d)", re.I)
_SENTENCES = re.compile(r"(?<=[.!?])\s+")
_COMMON = frozenset().union(*FUNCTION_WORDS.values())


def spam_share(text: str) -> float:
    """Share of the solid characters in keyword runs, links or hosts, tags and offers.

    A line counts as a whole when links, tags or an offer make up most of what it says;
    a line or sentence counts as keywords when its content words recur throughout the
    text far more often than those of prose of that length do.
    """
    links = _HINT.search(text) is not None
    words = Counter(_WORD.findall((_LINK.sub(" ", text) if links else text).lower()))
    total = max(1, sum(words.values()))
    solid = spam = 0
    for line in text.splitlines():
        s = line.strip(_BLANK)
        if not s:
            continue
        size = len(s) - s.count(" ")
        solid += size
        linked = sum(len(m.group()) - m.group().count(" ") for m in _LINK.finditer(s)) if links and _HINT.search(s) else 0
        tagged = sum(map(len, _TAG.findall(s))) if "#" in s else 0
        if (linked + tagged) * 5 >= size * 2:
            rest = _LINK.sub(" ", _TAG.sub(" ", s))
            spam += linked + tagged if _MARK.match(s) or _is_sentence(rest) else size
            continue
        if _OFFER.search(s) and not _is_sentence(s):
            spam += size
            continue
        if _MARK.match(s) and not _TURN.match(s):
            continue  # an item of a list
        for part in _SENTENCES.split(_TURN.sub("", s, count=1) if _TURN.match(s) else s):
            if _is_keywords(part, words, total):
                spam += len(part) - part.count(" ")
    return spam / solid if solid else 0.0


def _is_sentence(s: str) -> bool:
    w = _WORD.findall(s.lower())
    return len(w) >= 6 and sum(map(_COMMON.__contains__, w)) * 6 >= len(w)


def _is_keywords(part: str, words: Counter, total: int) -> bool:
    w = _WORD.findall(part.lower())
    content = [x for x in w if len(x) > 2 and x not in _COMMON]
    n = len(content)
    if n < 2 or n * 2 < len(w):
        return False
    counts = sorted([words[x] for x in content])
    middle = counts[(n - 1) // 2]
    mean = sum(counts) / n
    if n * 10 >= len(w) * 9 and (n >= 8 or mean >= 3):
        enough = mean >= max(1.7, 0.015 * total)
    else:  # a word or two may recur in honest sentences, so most must
        enough = middle >= max(3, 0.005 * total) and mean >= (max(4.0, 0.02 * total) if n > 2 else max(5.0, 0.04 * total))
    if not enough or kind(part) == GARBAGE:
        return False
    return sum(map(str.isdigit, part)) * 8 <= len(part)


def word_counts(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """Of every text with a word: ``_row`` (unique), ``_key``, ``_digest``, ``tongue``, ``prose`` (mainly running text), ``n`` (words), ``terms`` (array of word and count) and ``curve`` (array of ``c``, ``m``: m words occur c times)."""
    of = dict(df.dtypes)[key]

    def batch(rows: list, keys: list, digests: list, claims: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("_row", "_key", "_digest", "tongue", "prose", "n", "terms", "curve")}
        for r, k, d, claim, t in zip(rows, keys, digests, claims, texts):
            w = _WORD.findall(t.lower())
            if not w:
                continue
            counts = Counter(w)
            common = {c: sum(map(counts.__getitem__, v & counts.keys())) for c, v in FUNCTION_WORDS.items()}
            tongue = max(common, key=common.get)
            out["_row"].append(r)
            out["_key"].append(k)
            out["_digest"].append(d)
            out["tongue"].append(tongue if common[tongue] else claim)
            out["prose"].append(sum(common.values()) * 8 >= len(w) and read_page(t).running)
            out["n"].append(len(w))
            out["terms"].append([{"word": x, "c": c} for x, c in counts.items()])
            out["curve"].append([{"c": c, "m": m} for c, m in Counter(counts.values()).items()])
        return out

    claimed = F.lower(F.trim(F.col(lang)))
    claimed = F.when(claimed.isin(*FUNCTION_WORDS), claimed).otherwise("sv")
    src = df.where(F.length(text) > 0).select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.xxhash64(text).alias("_digest"), claimed.alias("_claim"), F.col(text).alias("_t"))
    return map_batches(src, batch, f"_row long, _key {of}, _digest long, tongue string, prose boolean, n int, terms array<struct<word:string,c:int>>, curve array<struct<c:int,m:int>>")


def curves(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rank-frequency figures of every text: ``_key``, ``_digest``, ``tongue``, ``bucket`` (binary logarithm of its words), ``n``, ``prose``,
    ``slope`` and ``residual`` of log frequency over log rank, ``top`` (share of the most frequent word), ``divergence``
    from the prose of its language.

    Words that are equally frequent share their mean rank, so a curve is some ten points
    with weights, whatever the length of the text. Ranks are running sums in a window over
    the points of one text, the line is fitted by aggregates over them. Texts without
    function words take the language they claim, Swedish if none. Null and empty texts
    and those without a word have no row; repeated rows have a row each.
    """
    counted = materialize(word_counts(df, key, text, lang), "wordcounts")
    # The prose model: counts of whole words by language, aggregated before the shuffle; its size is bounded by MODEL_SHARE.
    prose = counted.where("prose").select("tongue", F.explode("terms").alias("t")).groupBy("tongue", F.col("t.word").alias("word")).agg(F.sum("t.c").alias("m"))
    prose = materialize(prose, "prosewords")
    total = prose.groupBy("tongue").agg(F.sum("m").alias("all"))
    model = materialize(prose.join(F.broadcast(total), "tongue").where(F.col("m") >= MODEL_SHARE * F.col("all")).select("tongue", "word", (F.col("m") / F.col("all")).alias("q")), "prosemodel")
    # The words of a text stand together, so nearly all of this is added up before the shuffle.
    terms = counted.select("_row", "tongue", "n", F.explode("terms").alias("t")).select("_row", "tongue", "t.word", (F.col("t.c") / F.col("n")).alias("p"))
    far = terms.join(broadcaster(model, 500_000)(model), ["tongue", "word"], "left").groupBy("_row").agg(F.sum(F.col("p") * F.log(F.col("p") / F.coalesce("q", F.lit(MODEL_SHARE)))).alias("divergence"))
    by_rank = Window.partitionBy("_row").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = counted.select("_row", F.explode("curve").alias("p")).select("_row", "p.c", "p.m")
    points = points.select("_row", "c", "m", F.log(F.sum("m").over(by_rank) - (F.col("m") - 1) / 2).alias("x"), F.log("c").alias("y"))
    sums = {"k": F.sum("m"), "sx": F.sum(F.expr("m * x")), "sy": F.sum(F.expr("m * y")), "sxx": F.sum(F.expr("m * x * x")), "sxy": F.sum(F.expr("m * x * y")), "syy": F.sum(F.expr("m * y * y")), "most": F.max("c")}
    fit = points.groupBy("_row").agg(*[v.alias(k) for k, v in sums.items()])
    dxx, dxy, dyy = (F.expr(f"s{a}{b} - s{a} * s{b} / k") for a, b in ("xx", "xy", "yy"))
    flat = dxx < 1e-9
    figures = fit.select(
        "_row", F.when(flat, 0.0).otherwise(dxy / dxx).alias("slope"),
        F.when(flat, 0.0).otherwise(F.sqrt(F.greatest(dyy - dxy * dxy / dxx, F.lit(0.0)) / F.col("k"))).alias("residual"), "most",
    )
    base = counted.select("_row", "_key", "_digest", "tongue", F.floor(F.log2("n")).alias("bucket"), "n", "prose")
    out = materialize(base.join(figures, "_row").join(far, "_row").withColumn("top", F.col("most") / F.col("n")).drop("_row", "most"), "curves")
    release(counted, prose, model)
    return out


def spam_pages(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per text with a word: key, the figures of ``curves``, ``extreme`` (largest deviation from prose), ``spam`` and ``is_spam``.

    A text is flagged when its slope, residual, top word or divergence lies EXTREME
    standard deviations from those of prose of the same language and length. Only flagged
    texts are looked at: one is spam when keywords, links, tags and offers make up more
    than SPAM_SHARE of it (``spam``; null for the others). Where a language has no prose
    of a length (its deviation isn't known from fewer than LEAST_PROSE texts), all prose
    of the language stands in, then all prose; without any prose every text is flagged.
    """
    got = curves(df, key, text, lang)
    names = ("slope", "residual", "top", "divergence")

    def norms(*by: str) -> DataFrame:
        aggs = [f(F.col(c)).alias(f"{p}_{c}") for c in names for f, p in ((F.avg, "m"), (F.stddev_pop, "s"))]
        return got.where("prose").groupBy(*by).agg(F.count(F.lit(1)).alias("k"), *aggs)

    out = got
    for i, by in enumerate((("tongue", "bucket"), ("tongue",), ())):
        ref = norms(*by)
        ref = ref.where(F.col("k") >= (LEAST_PROSE if i == 0 else 1)).select(*by, *[F.col(f"{p}_{c}").alias(f"{p}{i}_{c}") for c in names for p in "ms"])
        out = out.join(F.broadcast(ref), list(by), "left") if by else out.join(F.broadcast(ref), F.lit(True), "left")

    def z(c: str) -> Column:
        m, s = (F.coalesce(*[F.col(f"{p}{i}_{c}") for i in range(3)]) for p in "ms")
        return F.abs(F.col(c) - m) / F.greatest(s, F.lit(1e-3))

    extreme = F.greatest(*[F.coalesce(z(c), F.lit(99.0)) for c in names])
    scored = materialize(out.select("_key", "_digest", "tongue", "n", "slope", "residual", "top", "divergence", extreme.alias("extreme")), "extremes")
    flagged = scored.where(F.col("extreme") >= EXTREME).select("_digest").distinct()

    def check(digests: list, texts: list) -> dict[str, list]:
        seen: dict[int, float] = {}  # copies in a batch are looked at once
        for d, t in zip(digests, texts):
            if d not in seen:
                seen[d] = round(spam_share(t), 4)
        return {"_digest": list(seen), "spam": list(seen.values())}

    texts = df.where(F.length(text) > 0).select(F.xxhash64(text).alias("_digest"), F.col(text).alias("_t")).join(flagged, "_digest", "left_semi")
    shares = map_batches(texts, check, "_digest long, spam double").dropDuplicates(["_digest"])
    return scored.join(shares, "_digest", "left").select(
        F.col("_key").alias(key), "tongue", "n", "slope", "residual", "top", "divergence", "spam", "extreme", F.coalesce((F.col("extreme") >= EXTREME) & (F.col("spam") > SPAM_SHARE), F.lit(False)).alias("is_spam")
    )
