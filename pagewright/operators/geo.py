"""Places and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions import text as T
from pagewright.operators.display import escaped, or_blank
from pagewright.operators.retrieval import levenshtein_ratio, similarity

CONTAINED, ACCEPT = 0.86, 0.72


def aliases(places: DataFrame, name: str) -> DataFrame:
    """A place's name and its parts of at least four characters between / ( ) and commas."""
    parts = F.filter(F.transform(F.split(F.col(name), r"[/(),]"), T.squeeze), lambda p: F.length(p) >= 4)
    return places.select("*", F.posexplode(F.array_distinct(F.concat(F.array(F.col(name)), parts))).alias("alias_no", "alias")).withColumn("alias_norm", F.lower(T.squeeze(F.col("alias"))))


def match_places(raw: DataFrame, text: str, places: DataFrame, place: str, exact_ratio: bool = True) -> DataFrame:
    """The best place of each distinct raw text: ``text``, ``place``, ``score``, ``how``.

    The catalogue is a stated query list that is compared with every distinct text:
    equal names count 1, one containing the other 0.86, else their similarity; from
    0.72 on, the first best wins.
    """
    cat = aliases(places, place).select(F.col(place).alias("place"), "alias_no", "alias_norm")
    wanted = raw.select(text).where(F.trim(text) != "").distinct().withColumn("norm", F.lower(T.squeeze(F.col(text))))
    j = wanted.join(cat, F.lit(True), "inner")
    like = similarity(F.col("norm"), F.col("alias_norm")) if exact_ratio else levenshtein_ratio(F.col("norm"), F.col("alias_norm"))
    inside = F.col("norm").contains(F.col("alias_norm")) | F.col("alias_norm").contains(F.col("norm"))
    score = F.when(F.col("norm") == F.col("alias_norm"), 1.0).when(inside, CONTAINED).otherwise(like)
    best = j.withColumn("score", score).where(F.col("score") >= ACCEPT).groupBy(text).agg(F.min_by(F.struct("place", "score"), F.struct(-F.col("score"), F.col("place"), F.col("alias_no"))).alias("b"))
    return best.select(text, "b.place", F.round("b.score", 6).alias("score"), F.when(F.col("b.score") == 1.0, "exact").otherwise("fuzzy").alias("how"))


def violations(person: Column, lat: Column, lon: Column, time: Column, source: Column) -> Column:
    """What is wrong with an observation, in a fixed order."""
    bad = lambda c: F.coalesce(c, F.lit(True))
    return F.filter(
        F.array(
            F.when(bad(F.trim(person) == ""), "person"), F.when(bad(~lat.between(-90, 90)), "lat"), F.when(bad(~lon.between(-180, 180)), "lon"),
            F.when(time.isNotNull() & ~time.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), "time"), F.when(bad(F.trim(source) == ""), "source"),
        ),
        lambda v: v.isNotNull(),
    )


def ordered_tracks(obs: DataFrame, person: str, time: str, key: str) -> DataFrame:
    """Per person the observations in the order of the night: those without a time last."""
    m = T.clock_minutes(F.col(time))
    one = F.struct(m.isNull().cast("int").alias("none"), F.coalesce(m, F.lit(0)).alias("minutes"), F.col(key).alias("id"))
    return obs.groupBy(person).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["id"]).alias("track"))


def geojson(obs: DataFrame, person: str, lat: str, lon: str, minutes: str) -> DataFrame:
    """A GeoJSON line for each person with at least two points, in time order."""
    pts = obs.where(F.col(minutes).isNotNull()).groupBy(person).agg(F.array_sort(F.collect_list(F.struct(F.col(minutes).alias("m"), F.col(lon).alias("x"), F.col(lat).alias("y")))).alias("p"))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda q: F.array(q["x"], q["y"])).alias("coordinates")))
    return pts.where(F.size("p") > 1).select(person, F.size("p").alias("points"), line.alias("geometry"))


def color_index(name: Column, colors: int = 10) -> Column:
    """A steady colour number of a name."""
    return F.conv(F.substring(F.sha1(F.lower(name)), 1, 8), 16, 10).cast("long") % colors


#: The first day of the timeline; hours before noon belong to the day after.
BASE_DATE = "1986-02-28"


def iso_time(hhmm: Column, base: str = BASE_DATE) -> Column:
    """A clock time as an instant of the timeline, null where it is none."""
    start = F.unix_timestamp(F.lit(f"{base} 00:00:00"))
    return F.date_format(F.timestamp_seconds(start + T.clock_minutes(F.trim(hhmm)) * 60), "yyyy-MM-dd'T'HH:mm:ss")


def popup(person: Column, place: Column, time: Column, uncertainty: Column, nr: Column, page: Column, note: Column) -> Column:
    """An observation as HTML: who, where, when, by which source."""
    known = lambda c, instead: escaped(F.coalesce(F.nullif(or_blank(c), F.lit("")), F.lit(instead)))
    sure = F.when(or_blank(uncertainty) != "", F.concat(F.lit(" ("), escaped(or_blank(uncertainty)), F.lit(")"))).otherwise("")
    source = F.when((or_blank(nr) != "") & (or_blank(page) != ""), F.concat(F.lit("[Nr "), escaped(or_blank(nr)), F.lit(", sida "), escaped(or_blank(page)), F.lit("]"))).otherwise("[källa saknas]")
    more = F.when(or_blank(note) != "", F.concat(F.lit("<br><em>"), escaped(or_blank(note)), F.lit("</em>"))).otherwise("")
    return F.concat(F.lit("<strong>"), known(person, "Okänd"), F.lit("</strong><br>"), known(place, "Okänd plats"), F.lit("<br>kl "), known(time, "okänd tid"), sure, F.lit("<br>"), source, more)


def point(lat: Column, lon: Column, time: Column, shown: Column, color: Column) -> Column:
    """An observation as a GeoJSON point with its time."""
    at = iso_time(time)
    style = F.struct(color.alias("fillColor"), F.lit(0.9).alias("fillOpacity"), F.lit(True).alias("stroke"), color.alias("color"), F.lit(8).alias("radius"))
    about = F.struct(at.alias("time"), F.array(at).alias("times"), shown.alias("popup"), F.lit("circle").alias("icon"), style.alias("iconstyle"), F.struct(color.alias("color")).alias("style"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon.cast("double"), lat.cast("double")).alias("coordinates")).alias("geometry"), about.alias("properties")))


def source_card(nr: Column, page: Column, stem: Column, *titles: Column) -> Column:
    """The card of an observation's source, null where number, page or document isn't known."""
    s = or_blank(stem)
    name = F.when(s.endswith(".txt"), s).otherwise(F.concat(s, F.lit(".txt")))
    title = F.coalesce(*[F.nullif(or_blank(t), F.lit("")) for t in titles], or_blank(nr))
    return F.when((or_blank(nr) != "") & (or_blank(page) != "") & (s != ""), F.struct(name.alias("source"), page.alias("page"), or_blank(nr).alias("nr"), title.alias("title")))


def source_cards(obs: DataFrame, keys: list[str], card: str) -> DataFrame:
    """One card per observation and text, however often the same text is named."""
    return obs.where(F.col(card).isNotNull()).select(*keys, F.col(card).alias("c")).select(*keys, "c.*").dropDuplicates([*keys, "source"])


def candidates(obs: DataFrame, places: DataFrame, place: str = "name", exact_ratio: bool = True) -> DataFrame:
    """Observations as candidates: ``time`` and ``uncertainty`` from what was written, ``place_name``, ``lat``, ``lon`` and ``place_match`` from the catalogue; those without person, place or quote are gone."""
    full = obs.where((or_blank(F.col("person")) != "") & (or_blank(F.col("plats")) != "") & (or_blank(F.col("citat")) != ""))
    matched = match_places(full, "plats", places, place, exact_ratio).select("plats", F.col("place").alias("place_name"), F.col("how").alias("place_match"))
    j = full.join(matched, "plats", "left").join(places.select(F.col(place).alias("place_name"), "lat", "lon").dropDuplicates(["place_name"]), "place_name", "left")
    time = T.time_of(F.col("tid"))
    rest = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("tid", r"(?<!\d)([01]?\d|2[0-3])[ .:]([0-5]\d)(?!\d)", " "), r"(?i)\bkl\b\.?", " "), r"[\s,.;:-]+", " "))
    sure = F.when(time.isNull(), F.nullif(F.trim("tid"), F.lit(""))).otherwise(F.nullif(rest, F.lit("")))
    confidence = F.when(F.col("confidence").isin("low", "medium", "high"), F.col("confidence")).otherwise("medium")
    return j.select(*[c for c in obs.columns if c != "confidence"], time.alias("time"), sure.alias("uncertainty"), "place_name", "lat", "lon", F.coalesce("place_match", F.lit("none")).alias("place_match"), confidence.alias("confidence"))


def without_default(lat: Column, lon: Column, known_lat: Column, known_lon: Column, match: Column, default: tuple[float, float]) -> Column:
    """A candidate's place as it may be kept: a form's default coordinates are no finding where no place was matched."""
    same = (F.abs(lat - default[0]) <= 1e-9) & (F.abs(lon - default[1]) <= 1e-9)
    drop = F.coalesce(known_lat.isNull() & known_lon.isNull() & (match == "none") & same, F.lit(False))
    return F.struct(F.when(~drop, lat).alias("lat"), F.when(~drop, lon).alias("lon"))


def time_or_null(time: Column) -> Column:
    """A time, null if blank."""
    return F.nullif(F.trim(time), F.lit(""))


def form_defaults(selected: Column, picked: Column, click: Column, use_click: Column) -> Column:
    """Coordinates a form begins with: the last click if it is to be used, else the place picked, else the observation at hand (each a struct of lat and lon or null)."""
    return F.coalesce(F.when(use_click, click), picked, selected)
