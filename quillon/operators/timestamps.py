"""Free-text dates and times of many sources in one unambiguous form.

`published_norm` turns a text into 'YYYY', 'YYYY-MM', 'YYYY-MM-DD' or, with a time of day, 'YYYY-MM-DDTHH:MM:SSZ' in
UTC. Everything is built-in column expressions, so that the parser runs inside generated code in the scan's stage.

Zones: one in the text (offset, abbreviation or IANA name) goes first, then the source's declared zone, then the zone
estimated by `estimate_zones`, then `default_zone`. Local times follow the zone's rules: an hour that occurs twice is
its first occurrence, a skipped one moves forward by the gap.

Defined cases: null, blank and undated texts give null; so does a text whose date does not exist or lies outside
first_year..last_year; an unknown abbreviation is treated as no zone; a source without a date order is day first,
unless only the other order exists; two-digit years fall into the allowed range or give null; fractions are cut off.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import fresh, held, small, stage

MONTHS = {
    1: "jan january januar janvier janv enero ene janner",
    2: "feb february februar fevrier fevr febrero fev febr",
    3: "mar march marz maerz mars marzo mrz",
    4: "apr april avril avr abril abr",
    5: "may mai mayo",
    6: "jun june juni juin junio",
    7: "jul july juli juillet juil julio",
    8: "aug august aout agosto ago",
    9: "sep sept september septembre septiembre setiembre",
    10: "oct october oktober octobre octubre okt",
    11: "nov november novembre noviembre",
    12: "dec december dezember decembre diciembre dez dic",
}
#: Offsets in minutes of common abbreviations. Those in AMBIGUOUS mean something else in some zones.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "mez": 60, "mesz": 120, "eet": 120, "eest": 180, "msk": 180,
    "ist": 330, "jst": 540, "kst": 540, "hkt": 480, "sgt": 480, "awst": 480, "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600, "ast": -240, "adt": -180,
}
AMBIGUOUS = {("ist", "Asia/Jerusalem"): 120, ("ist", "Europe/Dublin"): 60, ("cst", "Asia/Shanghai"): 480, ("cst", "Asia/Taipei"): 480, ("est", "Australia/Sydney"): 600, ("est", "Australia/Melbourne"): 600}
#: Names preferred for an offset history that several zones share; others are named by their first zone in the alphabet.
KNOWN_ZONES = ["UTC", "Europe/London", "Europe/Berlin", "Europe/Athens", "Europe/Moscow", "Asia/Kolkata", "Asia/Kathmandu", "Asia/Shanghai", "Asia/Tokyo", "Australia/Sydney", "Pacific/Auckland", "America/St_Johns", "America/New_York", "America/Chicago", "America/Denver", "America/Phoenix", "America/Los_Angeles", "America/Sao_Paulo"]
_WEEK, _FIRST_SUNDAY = 604800, 946771200  # Sunday 2000-01-02, 00:00 UTC

_MARK = "\u0001"
#: What may follow a date: a clock time with an optional half of the day, then a zone.
_CLOCK = r"^[Tt ,]{0,2}(?:at |um |a las |, )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,]\d+)?)? ?(?:([AaPp])\.?[Mm]\.?(?![A-Za-z]))? ?(.*)$"
#: One rewriting per form of date, each into `form|year|month|day|rest`; a text that one of them took starts with _MARK,
#: so that the later ones leave it alone. ~NN~ is a month's name. N: numeric, order open. D: day. M: month. Y: year.
#: O: day of the year. W: ISO week and weekday. E: seconds since 1970.
_FORMS = [
    (r"(?i)^[^\d~]*(\d{1,2})(?:st|nd|rd|th|er)?[ .,\-]*(?:de )?~(\d\d)~[ .,\-]*(?:de )?(\d{4})(?!\d)(.*)$", "D|$3|$2|$1|$4"),
    (r"(?i)^[^\d~]*~(\d\d)~[ .]*(\d{1,2})(?:st|nd|rd|th)?,? +(\d{4})(?!\d)(.*)$", "D|$3|$1|$2|$4"),
    (r"(?i)^[^\d~]*~(\d\d)~[ .,\-]*(?:de )?(\d{4})\D*$", "M|$2|$1||"),
    (r"^[^\d~]*(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$", "D|$1|$2|$3|$4"),
    (r"^[^\d~]*(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)(.*)$", "N|$3|$1|$2|$4"),
    (r"^(\d{4}) ?年 ?(\d{1,2}) ?月 ?(\d{1,2}) ?日(.*)$", "D|$1|$2|$3|$4"),
    (r"^(\d{4}) ?年 ?(\d{1,2}) ?月$", "M|$1|$2||"),
    (r"^(\d{4})(\d{2})(\d{2})$", "D|$1|$2|$3|"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", "D|$1|$2|$3|T$4:$5:$6"),
    (r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})$", "D|$1|$2|$3|T$4:$5"),
    (r"^(\d{4})(\d{2})(\d{2})[Tt](\d{2}):?(\d{2}):?(\d{2})(?!\d)(.*)$", "D|$1|$2|$3|T$4:$5:$6$7"),
    (r"^(\d{4})-(\d{3})$", "O|$1||$2|"),
    (r"^(\d{4})-?[Ww](\d{2})-?(\d)$", "W|$1|$2|$3|"),
    (r"^[^\d~]*(\d{4})[-/.](\d{1,2})(?!\d)\D*$", "M|$1|$2||"),
    (r"^[^\d~]*(\d{1,2})[-/.](\d{4})(?!\d)\D*$", "M|$2|$1||"),
    (r"^(\d{10})(?:\d{3}|\d{6}|\d{9})?(?:\.\d*)?$", "E||||$1"),
    (r"^[^\d~]*(\d{4})[^\d~]*$", "Y|$1|||"),
]


def canonical(text: Column) -> Column:
    """The text as _MARK + form|year|month|day|rest, or something without the mark if it is no known form. A chain of
    replacements, each used once, so the expression grows with the number of forms and not with their combinations."""
    x = F.trim(F.regexp_replace(text, r"[\s\u00A0\u2007\u202F]+", " "))
    x = F.translate(x, "àáâäãéèêëíìîïóòôöõúùûüñçÀÁÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ" + _MARK, "aaaaaeeeeiiiiooooouuuuncAAAAAEEEEIIIIOOOOOUUUUNC")
    for month, words in MONTHS.items():
        names = "|".join(sorted(words.split(), key=len, reverse=True))
        x = F.regexp_replace(x, rf"(?i)(?<![a-z_/])(?:{names})(?![a-z_/])\.?", f"~{month:02d}~")
    for pattern, form in _FORMS:
        x = F.regexp_replace(x, pattern, _MARK + form)
    return x


def with_parsed(df: DataFrame, text: str, order: str, p: str, first_year: int = 1951, last_year: int = 2027) -> DataFrame:
    """df with p+form (year, month, day, local, epoch; null: no date), p+y, p+m, p+local (the wall time in seconds
    since 1970 as if it were UTC) and p+zone (what follows the clock). order: a column of dmy, mdy or null.

    The steps are projections whose inputs are used several times; Catalyst keeps those apart, so that no regular
    expression runs twice."""
    kept = [f"`{c}`" for c in df.columns]
    c, part = F.col(p + "c"), lambda i: F.get(F.col(p + "s"), F.lit(i))
    df = df.select(*kept, canonical(F.col(text)).alias(p + "c"))
    df = df.select(*kept, F.when(F.startswith(c, F.lit(_MARK)), F.split(F.substring(c, 2, 1_000_000), r"\|", 5)).alias(p + "s"))
    number = lambda x: x.try_cast("int")
    df = df.select(*kept, part(0).alias(p + "f"), number(part(1)).alias(p + "1"), number(part(2)).alias(p + "2"), number(part(3)).alias(p + "3"), part(4).alias(p + "r"))
    f, a, b, d, rest = (F.col(p + x) for x in "f123r")
    clock = F.regexp_extract(rest, _CLOCK, 0) != ""
    timed = f.isin("D", "N") & rest.rlike(r"\d:|\d{1,2} ?[AaPp][Mm]\b")
    year = F.when(f != "N", a).when(a >= 100, a).when(2000 + a <= last_year, 2000 + a).when(1900 + a >= first_year, 1900 + a)
    declared = F.lower(F.col(order))
    month_leads = (f == "N") & F.coalesce((declared == "mdy") | (~F.coalesce(declared.isin("dmy", "mdy"), F.lit(False)) & (d > 12) & (b <= 12)), F.lit(False))
    day = F.when((f == "N") & ~month_leads, b).otherwise(d)
    month = F.when((f == "N") & ~month_leads, d).otherwise(b)
    get = lambda i: F.regexp_extract(rest, _CLOCK, i)
    df = df.select(*kept, f.alias(p + "f"), year.alias(p + "y"), month.alias(p + "m"), day.alias(p + "d"), timed.alias(p + "t"), number(get(1)).alias(p + "hh"), number(get(2)).alias(p + "mi"), F.coalesce(number(get(3)), F.lit(0)).alias(p + "ss"), F.lower(get(4)).alias(p + "half"), get(5).alias(p + "zone"), (clock | ~timed).alias(p + "ok"), F.when(f == "E", rest.try_cast("long")).alias(p + "e"))
    f, y, m, d, t, hour, minute, second, half, ok, e = (F.col(p + x) for x in ("f", "y", "m", "d", "t", "hh", "mi", "ss", "half", "ok", "e"))
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    zero = F.lit(0)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    start_m, start_d = F.when(f.isin("D", "N"), m).otherwise(1), F.when(f.isin("D", "N"), d).when(f == "W", 4).otherwise(1)
    start = F.unix_seconds(F.try_make_timestamp(y, start_m, start_d, F.when(t, hour).otherwise(zero), F.when(t, minute).otherwise(zero), F.when(t, second).otherwise(zero).cast("decimal(16,6)"), F.lit("UTC")))
    df = df.select(*kept, f.alias(p + "f"), y.alias(p + "y"), m.alias(p + "m"), d.alias(p + "d"), t.alias(p + "t"), F.col(p + "zone"), ok.alias(p + "ok"), e.alias(p + "e"), leap.alias(p + "leap"), start.alias(p + "start"))
    start, leap = F.col(p + "start"), F.col(p + "leap")
    # for a week, start is 4 January, which lies in week 1; 1970-01-01 was a Thursday, so +3 makes Monday 0
    days = F.floor(start / 86400)
    weekday4 = (days + 3) % 7
    long_year = (weekday4 == 6) | (leap & (weekday4 == 5))  # 1 January is a Thursday, or a Wednesday in a leap year
    local = (
        F.when(f.isin("D", "N"), start)
        .when((f == "O") & d.between(1, F.when(leap, 366).otherwise(365)), start + (d - 1) * 86400)
        .when((f == "W") & m.between(1, F.when(long_year, 53).otherwise(52)) & d.between(1, 7), (days - weekday4 + (m - 1) * 7 + d - 1) * 86400)
        .when(f == "E", e)
    )
    inside = F.when(f == "E", e.between((first_year - 1970) * 31556952 - 86400, (last_year + 1 - 1970) * 31556952 + 86400)).otherwise(y.between(first_year, last_year))
    form = F.when(~F.coalesce(inside & ok, F.lit(False)), None).when(f == "Y", "year").when((f == "M") & m.between(1, 12), "month").when(f.isin("O", "W") & local.isNotNull(), "day").when(f.isin("D", "N") & start.isNotNull(), F.when(t, "local").otherwise("day")).when(f == "E", "epoch")
    return df.select(*kept, held(form).alias(p + "form"), y.alias(p + "y"), m.alias(p + "m"), local.alias(p + "local"), F.coalesce(F.col(p + "zone"), F.lit("")).alias(p + "zone"))


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def offset_in(zone_text: Column, source_zone: Column) -> Column:
    """Seconds east of UTC that the text itself states (number or abbreviation); null if it states none."""
    z = F.lower(zone_text)
    signed = r"^\(?(?:utc|gmt|z)? ?([+-])(\d{1,2}):?(\d{2})?(?!\d)"
    sign = F.when(F.regexp_extract(z, signed, 1) == "-", -1).otherwise(1)
    numeric = F.when(z.rlike(signed), sign * (_int(z, signed, 2) * 3600 + F.coalesce(_int(z, signed, 3), F.lit(0)) * 60))
    word = F.regexp_extract(z, r"^[\[(]?([a-z]{1,5})[\])]?$", 1)
    known = F.try_element_at(F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v * 60)]), word)
    for (name, zone), minutes in AMBIGUOUS.items():
        known = F.when((word == name) & (source_zone == zone), F.lit(minutes * 60)).otherwise(known)
    return F.coalesce(numeric, known)


def zone_in(spark: SparkSession, zone_text: Column) -> Column:
    """The IANA zone the text names, if the running JVM knows it."""
    ids = [x for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in x]
    name = F.regexp_extract(zone_text, r"([A-Z][A-Za-z_]+/[A-Za-z_+\-0-9/]+)", 1)
    return F.when(name.isin(ids), name)


def instant(local: Column, offset: Column, zone: Column) -> Column:
    """Seconds since 1970 UTC of a wall time."""
    by_zone = F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), zone))
    return F.when(offset.isNotNull(), local - offset).otherwise(by_zone)


def rendered(seconds: Column, day_only: Column) -> Column:
    """'YYYY-MM-DD' or 'YYYY-MM-DDTHH:MM:SSZ', whatever the session's zone."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int")).cast("string")
    rest = F.pmod(seconds, F.lit(86400))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.when(day_only, day).otherwise(F.concat(day, F.lit("T"), two(rest / 3600), F.lit(":"), two(rest % 3600 / 60), F.lit(":"), two(rest % 60), F.lit("Z")))


def offset_histories(spark: SparkSession, last_year: int = 2027) -> DataFrame:
    """(zone, name, offsets): every zone of the running JVM with the name of its offset history, and the offsets in
    seconds at noon of each Sunday from 2000 on, as clocks change on Sundays nearly everywhere."""
    ids = [x for x in spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds() if x == "UTC" or x.split("/")[0] in ("Africa", "America", "Antarctica", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific")]
    weeks = ((last_year + 1 - 2000) * 31556952) // _WEEK
    zones = spark.createDataFrame([(x, KNOWN_ZONES.index(x) if x in KNOWN_ZONES else 1000) for x in sorted(ids)], "zone string, preferred int").repartition(8)
    at = F.col("week") * _WEEK + _FIRST_SUNDAY + 43200
    points = zones.withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(weeks - 1)))).select("zone", "preferred", "week", (at - F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(at), F.col("zone")))).cast("int").alias("o"))
    lists = points.groupBy("zone", "preferred").agg(F.transform(F.array_sort(F.collect_list(F.struct("week", "o"))), lambda x: x["o"]).alias("offsets"))
    names = lists.groupBy("offsets").agg(F.min(F.struct("preferred", "zone"))["zone"].alias("name"))
    return lists.join(names, "offsets").select("zone", "name", "offsets")


def estimate_zones(rows: DataFrame, source: str, local: str, offset: str, ingested: str, candidates: list[str] | None = None, near_s: int = 172800, slack_s: int = 60, min_near: int = 5, significance: float = 5.0, alike: float = 0.01) -> DataFrame:
    """(source, zone, violations, evidence): for each source the offset history that its rows violate least.

    All distinct histories of the time zone database are candidates, or those of the given zones. A row without an
    offset, whose wall time lies within near_s of its ingestion, is evidence by its delay: under the right history rows
    are never ingested before they are written, and soon after. A negative delay (beyond slack_s) is a violation of 1; a
    longer one than need be is a violation of its share of near_s, so that a zone too far east, or one without the
    source's summer time, loses to the one that makes the delays short all year. A row with a stated offset violates
    every history that has another offset at that wall time by 1, less what the median source matches; an offset of 0 is how feeds of any zone write UTC and says nothing.

    `violations` counts rows. A source gets a row if min_near rows are evidence by delay, or if its stated offsets match
    the history more often than those of the others do, by `significance` standard deviations. Of histories
    that differ by less than `alike` of the stated offsets the one of the preferred name is taken. Sums per source and candidate leave each batch, so a frequent source is never in one task.
    """
    spark = rows.sparkSession
    histories = offset_histories(spark)
    if candidates is not None:
        histories = histories.where(F.col("zone").isin(candidates)).withColumn("name", F.col("zone"))
    kept = histories.groupBy("name").agg(F.first("offsets").alias("offsets")).collect()  # a few hundred
    kept = sorted(kept, key=lambda r: (KNOWN_ZONES.index(r["name"]) if r["name"] in KNOWN_ZONES else 1000, r["name"]))
    names, table = [r["name"] for r in kept], np.array([r["offsets"] for r in kept], dtype=np.int32)
    shared = spark.sparkContext.broadcast(table)

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        offsets = shared.value
        for df in batches:
            out = []
            for name, part in df.groupby("s", dropna=False, sort=False):
                own, at = part["l"].to_numpy(), part["at"].to_numpy()
                stated = part["o"].notna().to_numpy()
                there = offsets[:, np.clip((own - _FIRST_SUNDAY) // _WEEK, 0, offsets.shape[1] - 1)]
                delay = (at - own)[None, :] + there
                soft = np.where(delay < -slack_s, 1.0, np.clip(delay, 0, near_s) / near_s)
                match = there == part["o"].fillna(0).to_numpy()[None, :]
                out.append((name if isinstance(name, str) else None, soft[:, ~stated].sum(axis=1).tolist(), (delay[:, ~stated] < -slack_s).sum(axis=1).tolist(), match[:, stated].sum(axis=1).tolist(), int(stated.sum()), int((~stated).sum())))
            yield pd.DataFrame(out, columns=["s", "soft", "early", "matched", "stated", "near"])

    own, at = F.col(local), F.unix_seconds(F.col(ingested))
    evidence = rows.where(F.col(local).isNotNull() & (F.col(offset).isNotNull() | (F.abs(own - at) <= near_s)) & F.coalesce(F.col(offset) != 0, F.lit(True)) & (own >= _FIRST_SUNDAY))
    slim = evidence.select(F.col(source).alias("s"), own.alias("l"), F.col(offset).cast("double").alias("o"), at.alias("at")).where("o is not null or at is not null")
    parts = slim.mapInPandas(weigh, "s string, soft array<double>, early array<long>, matched array<long>, stated long, near long")
    each = parts.select("s", "stated", "near", F.posexplode(F.arrays_zip("soft", "early", "matched")).alias("i", "x")).groupBy("s", "i").agg(F.sum("x.soft").alias("soft"), F.sum("x.early").alias("early"), F.sum("x.matched").alias("matched"), F.sum("stated").alias("stated"), F.sum("near").alias("near"))
    # what an ordinary source matches, by offsets that are not its own, is no evidence for this one
    each = stage(each)
    many = F.when(F.col("stated") >= 10, F.col("matched") / F.col("stated"))
    overall = each.groupBy(F.col("i").alias("i2")).agg(F.when(F.count(many) >= 5, F.percentile_approx(many, 0.5)).otherwise(0.0).alias("rate"))
    each = each.join(F.broadcast(overall), F.col("i") == F.col("i2"))  # a row per candidate
    rate = F.col("rate")
    each = each.withColumn("chance", F.col("stated") * rate)
    cost = F.round(F.col("soft") + F.col("stated") - F.col("matched") + F.round("chance"), 6)
    clear = (F.col("matched") - F.col("chance")) / F.sqrt(F.col("chance") + 1)
    scored = each.select("s", "near", (F.col("near") + F.col("stated")).alias("evidence"), cost.alias("cost"), "i", clear.alias("clear"), (F.col("early") + F.col("stated") - F.col("matched")).alias("violations"))
    least = scored.groupBy(F.col("s").alias("s2")).agg((F.min("cost") + alike * (F.first("evidence") - F.first("near"))).alias("most"))
    close = scored.join(least, F.col("s").eqNullSafe(F.col("s2"))).where("cost <= most")
    ranked = close.groupBy("s").agg(F.first("near").alias("near"), F.first("evidence").alias("evidence"), F.min(F.struct("i", "cost", "clear", "violations")).alias("one"))
    best = ranked.where((F.col("near") >= min_near) | (F.col("one.clear") >= significance))
    zone = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("one.i") + 1)
    return best.select(F.col("s").alias(source), zone.alias("zone"), F.col("one.violations").alias("violations"), "evidence")


def published_norm(rows: DataFrame, sources: DataFrame, text: str = "published_date", source: str = "source_id", ingested: str = "fetched_at", out: str = "published_norm", default_zone: str = "UTC", max_sources: int = 100_000) -> DataFrame:
    """rows with a column `out`. sources has (id, time_zone, date_order); ids in it are unique. Sources whose zone is
    null or unknown get an estimated one; only their rows are aggregated for that."""
    spark = rows.sparkSession
    kept = [f"`{c}`" for c in rows.columns if c.lower() != out.lower()]
    zone, order, p, key, stated, named = (fresh(rows, x) for x in ("_zone", "_order", "_p_", "_source_key", "_stated", "_named"))
    ids = list(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds())
    meta = sources.select(F.col("id").alias(key), F.when(F.col("time_zone").isin(ids), F.col("time_zone")).alias(zone), F.lower("date_order").alias(order)).dropDuplicates([key])
    df = rows.join(small(meta, max_sources), F.col(source) == F.col(key), "left").drop(key)
    df = with_parsed(df, text, order, p)
    df = df.withColumns({stated: offset_in(F.col(p + "zone"), F.col(zone)), named: zone_in(spark, F.col(p + "zone"))})
    estimated = F.lit(None).cast("string")
    missing = meta.where(F.col(zone).isNotNull()).select(key)
    if rows.join(small(missing, max_sources), F.col(source) == F.col(key), "left_anti").limit(1).count():
        found, est = fresh(rows, "_found"), fresh(rows, "_est")
        lacking = df.where(F.col(zone).isNull() & (F.col(p + "form") == "local") & F.col(named).isNull()).select(F.col(source).alias(key), F.col(p + "local").alias("l"), F.col(stated).alias("o"), F.col(ingested).alias("i"))
        zones = estimate_zones(lacking, key, "l", "o", "i").select(F.col(key).alias(found), F.col("zone").alias(est))
        df = df.join(small(zones, max_sources), F.col(source) == F.col(found), "left").drop(found)
        estimated = F.col(est)
    used = F.coalesce(F.col(named), F.col(zone), estimated, F.lit(default_zone))
    form, local = F.col(p + "form"), F.col(p + "local")
    seconds = F.when(form == "local", instant(local, F.col(stated), used)).otherwise(local)
    df = df.withColumn(p + "at", seconds)
    y, m = F.col(p + "y").cast("string"), F.lpad(F.col(p + "m").cast("string"), 2, "0")
    value = F.when(form == "year", y).when(form == "month", F.concat(y, F.lit("-"), m)).when(form.isNotNull(), rendered(F.col(p + "at"), form == "day"))
    return df.select(*kept, held(value).alias(out))


def source_zones(rows: DataFrame, sources: DataFrame, text: str = "published_date", source: str = "source_id", ingested: str = "fetched_at") -> DataFrame:
    """(source_id, declared, zone, violations, evidence, agrees): the estimate for every source, declared or not, where
    there is enough evidence; agrees: whether it has the declared zone's offset history."""
    slim = rows.select(F.col(source).alias("source_id"), F.col(text).alias("text"), F.col(ingested).alias("i"), F.lit(None).cast("string").alias("order"))
    p = with_parsed(slim, "text", "order", "p_").where("p_form = 'local'")
    evidence = p.select("source_id", F.col("p_local").alias("l"), offset_in(F.col("p_zone"), F.lit(None).cast("string")).alias("o"), "i")
    names = sources.select(F.col("id").alias("source_id"), F.col("time_zone").alias("declared"))
    histories = offset_histories(rows.sparkSession).select(F.col("zone").alias("declared"), F.col("name").alias("history"))
    found = estimate_zones(evidence, "source_id", "l", "o", "i")
    joined = found.join(small(names, 100_000), "source_id", "left").join(histories, "declared", "left")
    return joined.select("source_id", "declared", "zone", "violations", "evidence", (F.col("zone") == F.coalesce("history", "declared")).alias("agrees"))
