"""Problem 1: statistics that tell running prose from lists, tables and unreadable output."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.arrow import map_batches
from pagewright.llm.page_lines import FUNCTION_WORDS, letters_of, read_page
from pagewright.llm.ranks import exact_ranks
from pagewright.session import broadcaster, materialize

#: Statistics that enter the outlier score, with the tail that is suspicious.
TAILS = {"running_share": "low", "common_share": "low", "ending_share": "low", "symbol_ratio": "high", "mean_word_length": "both", "vowel_ratio": "both"}

#: A text whose score is as improbable as one in so many is a candidate, or, where a language has less prose, one beyond all its prose in one statistic.
ONE_IN = 10_000

_SCHEMA = "lang string, chars int, words int, mean_word_length double, symbol_ratio double, vowel_ratio double, ending_share double, common_share double, running_share double, runs boolean"


def statistics_of(text: str) -> tuple:
    """The statistics of one text, in the order of the result's columns; None if it is blank."""
    words = text.lower().split()
    if not words:
        return None
    n = len(words)
    solid = sum(map(len, words))
    letters, latin, vowels = letters_of(text)
    digits = sum(map(text.count, "0123456789"))
    common = {k: sum(map(v.__contains__, words)) for k, v in FUNCTION_WORDS.items()}
    lang = max(common, key=common.get)
    p = read_page(text)
    read = p.prose + p.rows + p.garbage
    return (
        lang, len(text), n, _grid(letters / n), round(max(0, solid - letters - digits) / solid, 3), round(vowels / latin, 3) if latin * 2 >= letters > 0 else None,
        round(p.n_ends / max(p.n_lines, 1), 3), round(common[lang] / n, 3), round(p.prose / max(read, 1), 3) if p.running else min(0.5, round(p.prose / max(read, 1), 3)), p.running,
    )


def _grid(x: float) -> float:
    """Two digits below 100, three significant ones above, so few values are possible."""
    return round(x, 2) if x < 100 else round(x, 2 - int(math.log10(x)))


def _batch(keys: list, texts: list) -> dict[str, list]:
    rows = [(k, *s) for k, t in zip(keys, texts) if t and (s := statistics_of(t)) is not None]
    names = ["_key", *[f.split()[0] for f in _SCHEMA.split(", ")]]
    return dict(zip(names, map(list, zip(*rows)))) if rows else {k: [] for k in names}


def page_statistics(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """One row per text with something in it: key, ``lang`` and the statistics.

    ``lang`` ('sv', 'en', 'de') by function words, 'sv' on a tie; ``chars``; ``words``
    (between blanks); ``mean_word_length`` (letters per word, two digits below 100, three
    significant ones above); ``symbol_ratio`` (solid characters that are neither letter nor
    digit), ``vowel_ratio`` (of letters; null where most aren't Latin), ``ending_share``
    (lines that end in punctuation), ``common_share`` (words that are function words of
    ``lang``), ``running_share`` (characters in lines of running text; at most one half
    where a sentence stands among rows only), each with three digits; ``runs``: whether
    running text makes up most of the text (see read_page).
    Null, empty and blank texts have no row; repeated keys have a row each. Columns
    other than the two named are not read, so clashing names can't matter.
    """
    of = dict(df.dtypes)[key]
    src = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col(text).isNotNull())
    return map_batches(src, _batch, f"_key {of}, {_SCHEMA}").withColumnRenamed("_key", key)


def outlier_scores(stats: DataFrame) -> DataFrame:
    """``stats`` with ``outlier_score`` and ``limit``, the score from which a text is an outlier.

    Per statistic the tail probability of a text's value among the prose of its language
    (texts with more than half in running text), from exact ranks; probabilities count
    the text itself, so a value beyond all n prose texts has 1 / (n + 1). The score is the
    sum of their negative logarithms, the limit that of one in ONE_IN, or of 1 / (n + 1)
    where the language has less prose. As only prose is ranked against, copies of a list
    don't make lists usual, and a text with little running text is always beyond the
    limit; ties share their probability; a language without prose has the limit 0.

    The ranked values lie on a fixed grid (three digits in 0..1, see _grid), so there are
    some 10,000 values per language and statistic whatever the number of texts: the rank
    table is small by construction and may be broadcast.
    """
    long = stats.select("lang", (F.col("running_share") > 0.5).alias("prose"), F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).alias("value")) for s in TAILS])).alias("x")).select("lang", "prose", "x.stat", "x.value")
    ranks = exact_ranks(long, ["lang", "stat"], "value", "prose")
    low, high = (F.col("below") + F.col("n") + 1) / (F.col("total") + 1), (F.col("total") - F.col("below") + 1) / (F.col("total") + 1)
    side = F.create_map(*[F.lit(x) for kv in TAILS.items() for x in kv])[F.col("stat")]
    tail = F.least(F.lit(1.0), F.when(side == "low", low).when(side == "high", high).otherwise(2 * F.least(low, high)))
    tails = materialize(ranks.select("lang", "stat", "value", (-F.log(tail)).alias("surprise"), "total"), "tails")
    small = broadcaster(tails, 500_000)  # some 50,000 a language by the grid
    out = stats
    for s in TAILS:
        one = tails.where(F.col("stat") == s).select(F.col("lang").alias("_l"), F.col("value").alias("_v"), F.col("surprise").alias(f"_{s}"))
        out = out.join(small(one), (F.col("lang") == F.col("_l")) & (F.col(s) == F.col("_v")), "left").drop("_l", "_v")
    prose = tails.where(F.col("stat") == "running_share").groupBy(F.col("lang").alias("_l")).agg(F.max("total").alias("_total"))
    out = out.join(F.broadcast(prose), F.col("lang") == F.col("_l"), "left")
    total = sum((F.coalesce(F.col(f"_{s}"), F.lit(0.0)) for s in TAILS), F.lit(0.0))
    limit = F.log(F.least(F.lit(float(ONE_IN)), F.coalesce("_total", F.lit(0)) + 1.0))
    return out.withColumns({"outlier_score": F.round(total, 4), "limit": F.round(limit - 1e-3, 4)}).drop("_l", "_total", *[f"_{s}" for s in TAILS])


def quality_statistics(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Statistics, ``outlier_score``, ``limit``, ``is_outlier`` and ``is_prose`` of every text (see page_statistics).

    Outliers (score not below the limit) are the candidates; a candidate isn't prose if,
    by the exact check, running text doesn't make up most of it.
    """
    scored = outlier_scores(materialize(page_statistics(df, key, text), "pagestats"))
    return scored.withColumn("is_outlier", F.col("outlier_score") >= F.col("limit")).withColumn("is_prose", ~F.col("is_outlier") | F.col("runs"))
