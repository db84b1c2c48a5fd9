"""Time texts of many formats and zones, brought to one instant.

An ordered cascade of anchored patterns rewrites a text into named fields; the first pattern that matches decides.  Fields are then
checked strictly (real calendar days, hours under 24) and turned into UTC.  The zone comes from the text (offset, region,
abbreviation) or, where it has none, from the source's entry in a lookup table.

Local times around clock changes follow a policy: ``ambiguous`` is "first" or "last" (of the two instants) or "null";
``nonexistent`` is "null" or "shift" (forward by the gap).

Everything but the abbreviations of the lookup's zones is built-in column code, so it stays in the scan's stage.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Offsets in minutes of zone abbreviations in their usual sense.
USUAL = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "MEZ": 60, "CEST": 120, "MESZ": 120, "EET": 120, "EEST": 180,
    "MSK": 180, "MSD": 240, "SAST": 120, "IST": 330, "PKT": 300, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480, "JST": 540, "KST": 540, "ACST": 570,
    "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240,
    "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "ART": -180,
}

# Month names, January first: English, French, German, Spanish, Polish (both cases), Russian (both cases).
MONTHS = """
january february march april may june july august september october november december
jan feb mar apr may jun jul aug sep oct nov dec
janvier février mars avril mai juin juillet août septembre octobre novembre décembre
janv févr mars avr mai juin juil août sept oct nov déc
januar februar märz april mai juni juli august september oktober november dezember
jänner feber mär apr mai jun jul aug sept okt nov dez
enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre
ene feb mar abr may jun jul ago setiembre oct nov dic
stycznia lutego marca kwietnia maja czerwca lipca sierpnia września października listopada grudnia
styczeń luty marzec kwiecień maj czerwiec lipiec sierpień wrzesień październik listopad grudzień
января февраля марта апреля мая июня июля августа сентября октября ноября декабря
январь февраль март апрель май июнь июль август сентябрь октябрь ноябрь декабрь
"""
MONTH = {name: str(i % 12 + 1) for line in MONTHS.strip().splitlines() for i, name in enumerate(line.split())}

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([ap])\.?m\b\.?)?"
_OFFSET = r"(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?"
_REGION = r"[a-z_]+(?:/[a-z0-9_+-]+)+"
_ZONE = rf"(?:\s*({_OFFSET}|{_REGION}|[a-z]{{1,5}}))?(?:\s*\[({_REGION}|[a-z]{{1,5}})\])?"
_DAYNAME = r"(?:\p{L}{2,12}\.?,?\s+)?"

#: name, pattern over the lower-cased text, replacement that puts its groups in the order
#: date order | year | month | day | hour | minute | second | fraction | am or pm | zone | region
FORMATS: list[tuple[str, str, str]] = [
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})[t ]\s*{_TIME}{_ZONE}$", r"ymd|$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    ("basic", r"^(\d{4})(\d{2})(\d{2})t(\d{2})(\d{2})(\d{2})(?:[.,](\d{1,9}))?" + _ZONE + "$", r"ymd|$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    ("rfc", rf"^{_DAYNAME}(\d{{1,2}})[ -](\p{{L}}{{3,12}})\.?[ -](\d{{4}}|\d{{2}}),?\s+{_TIME}{_ZONE}$", r"ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    ("ctime", rf"^\p{{L}}{{2,12}}\.?,?\s+(\p{{L}}{{3,12}})\s+(\d{{1,2}})\s+{_TIME}(?:\s+({_OFFSET}|{_REGION}|[a-z]{{1,5}}))?\s+(\d{{4}})$", r"ymd|$9|$1|$2|$3|$4|$5|$6|$7|$8|"),
    ("slash", rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}),?\s+{_TIME}{_ZONE}$", r"node|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    ("dotted", rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}}),?\s+{_TIME}{_ZONE}$", r"ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    ("words", rf"^{_DAYNAME}(\d{{1,2}})\.?\s+(?:de\s+)?(\p{{L}}{{3,12}})\.?\s+(?:de\s+)?(\d{{4}}),?\s+{_TIME}{_ZONE}$", r"ymd|$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    ("digits14", r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$", r"ymd|$1|$2|$3|$4|$5|$6||||"),
]


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def zone_abbreviations(zones: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Abbreviations that a zone has used since 1990, with their offsets in seconds; of several offsets the latest."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    known: dict[str, dict[str, int]] = {}

    def of(name: str | None) -> dict[str, int] | None:
        if name not in known:
            out = {}
            try:
                zone = ZoneInfo(name)
                for k in range(46 * 24):
                    t = (datetime(1990, 1, 8, tzinfo=timezone.utc) + timedelta(days=15.2 * k)).astimezone(zone)
                    if t.tzname().isalpha():
                        out[t.tzname().upper()] = int(t.utcoffset().total_seconds())
            except (KeyError, ValueError, TypeError, OSError):
                pass
            known[name] = out
        return known[name]

    for s in zones:
        yield s.map(of)


def _regions(df: DataFrame) -> Column:
    """Map of the zone names that the JVM knows, by their lower-cased form; a few hundred, whatever the data."""
    ids = sorted(str(z) for z in df.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)
    return F.map_from_arrays(F.array(*[F.lit(z.lower()) for z in ids]), F.array(*[F.lit(z) for z in ids]))


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("bigint"))


def parsed_fields(text: Column) -> Column:
    """The cascade: the field list of the first pattern that matches, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.split(F.regexp_replace(text, p, to), r"\|", -1)) for _, p, to in FORMATS])


def format_name(text: Column) -> Column:
    """Name of the first pattern that matches, "epoch" for bare seconds, milliseconds or microseconds, else null."""
    s = tidy(text)
    return F.coalesce(F.when(s.rlike(r"^(?:\d{10}|\d{13}|\d{16})$"), F.lit("epoch")), *[F.when(s.rlike(p), F.lit(n)) for n, p, _ in FORMATS])


def tidy(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^[\s ]+|[\s ]+$", ""), r"[\s ]+", " "))


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a date of the Gregorian calendar, by integer arithmetic."""
    y2 = y - F.when(m <= 2, 1).otherwise(0)
    era = F.floor(y2 / 400)
    yoe = y2 - era * 400
    doy = F.floor((F.when(m > 2, m - 3).otherwise(m + 9) * 153 + 2) / 5) + d - 1
    return era * 146097 + yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy - 719468


def instants(df: DataFrame, text: str, zone: str, order: str, abbreviations: str, out: str = "utc_ms", ambiguous: str = "first", nonexistent: str = "null", only_instants: bool = False) -> DataFrame:
    """Add ``out``, the Unix time in milliseconds that column ``text`` means, or null.

    zone, order, abbreviations: columns with the source's zone, its date order ("dmy" or "mdy") and the map of
    zone_abbreviations; null in them leaves texts without an own zone, or with slashes, undecided (null).
    Null or empty text, text in no known format, days or times that don't exist and the instant zero give null.
    Rows are neither dropped nor repeated (with ``only_instants`` those without an instant are dropped); columns of df may have any names other than ``out``.
    """
    if ambiguous not in ("first", "last", "null") or nonexistent not in ("null", "shift"):
        raise ValueError("ambiguous: first, last or null; nonexistent: null or shift")
    months = F.map_from_arrays(F.array(*[F.lit(k) for k in MONTH]), F.array(*[F.lit(v) for v in MONTH.values()]))
    usual = F.map_from_arrays(F.array(*[F.lit(k) for k in USUAL]), F.array(*[F.lit(v * 60) for v in USUAL.values()]))
    regions, order_, abbr_, zone_ = _regions(df), F.col(f"`{order}`"), F.col(f"`{abbreviations}`"), F.col(f"`{zone}`")

    def read(f: Column) -> Column:
        """Fields of one text as numbers, null where they aren't sound."""
        at = lambda i: F.get(f, F.lit(i))
        swap = (at(0) == "node") & (order_ == "mdy")
        named = F.when(at(2).rlike(r"^\d+$"), at(2)).otherwise(F.try_element_at(months, at(2)))
        year, hour = _int(at(1)), _int(at(4))
        return F.struct(
            F.when(F.length(at(1)) == 2, year + F.when(year < 69, 2000).otherwise(1900)).otherwise(year).alias("y"),
            _int(F.when(swap, at(3)).otherwise(named)).alias("m"),
            _int(F.when(swap, at(2)).otherwise(at(3))).alias("d"),
            F.when(at(8) == "", F.when(hour < 24, hour)).when(hour.between(1, 12), hour % 12 + F.when(at(8) == "p", 12).otherwise(0)).alias("h"),
            _int(at(5)).alias("mi"), F.coalesce(_int(at(6)), F.lit(0)).alias("se"),
            F.when(at(7) != "", F.substring(F.rpad(at(7), 3, "0"), 1, 3).cast("bigint")).otherwise(0).alias("ms"),
            F.upper(at(9)).alias("z"), at(10).alias("r"), ((at(0) != "node") | order_.isNotNull()).alias("known"),
        )

    def place(t: Column) -> Column:
        """Local seconds, the offset or else the zone that holds."""
        y, m, day, z, r = t["y"], t["m"], t["d"], t["z"], t["r"]
        leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
        last = F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
        sound = t["known"] & (y >= 1) & m.between(1, 12) & (day >= 1) & (day <= last) & t["h"].isNotNull() & (t["mi"] < 60) & (t["se"] < 60)
        part = lambda i: F.regexp_extract(z, r"^(?:UTC|GMT)?([+-])(\d{1,2}?):?(\d{2})?$", i)
        oh, om = _int(part(2)), F.coalesce(_int(part(3)), F.lit(0))
        offset = F.when((oh <= 18) & (om < 60), (oh * 3600 + om * 60) * F.when(part(1) == "-", -1).otherwise(1))
        named = F.when(z.rlike("^[A-Z]+$"), F.coalesce(F.when(~z.isin("Z", "UTC", "GMT", "UT"), F.try_element_at(abbr_, z)), F.try_element_at(usual, z)))
        region = F.when(z.contains("/"), F.lower(z)).when(r.contains("/"), r)
        return F.struct(
            F.when(sound, _days(y, m, day) * 86400 + t["h"] * 3600 + t["mi"] * 60 + t["se"]).cast("bigint").alias("l"), t["ms"].alias("ms"),
            F.coalesce(offset, named, F.when((z == "") & r.isin("utc", "gmt", "z"), 0)).alias("o"),
            F.when(region.isNotNull(), F.try_element_at(regions, region)).when((z == "") & (r == ""), zone_).alias("tz"),
        )

    def resolve(u: Column) -> Column:
        local, tz = u["l"], u["tz"]
        shows = lambda at: F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(at), tz))

        def zoned(first: Column) -> Column:
            out = first if nonexistent == "shift" else F.when(shows(first) == local, first)
            if ambiguous != "first":  # the clock is put back by up to three hours: a later instant, if there is one, shows the same local time
                later = F.coalesce(*[F.when(shows(first + step) == local, first + step) for step in (1800, 3600, 5400, 7200, 10800)])
                out = F.coalesce(later, out) if ambiguous == "last" else F.when(later.isNull(), out)
            return out

        first = F.when(local.isNotNull() & tz.isNotNull(), F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), tz)))
        return F.when(u["o"].isNotNull(), local - u["o"]).otherwise(_let(first, zoned)) * 1000 + u["ms"]

    def whole(s: Column) -> Column:
        return (
            F.when(s.rlike(r"^\d{10}$"), s.cast("bigint") * 1000)
            .when(s.rlike(r"^\d{13}$"), s.cast("bigint"))
            .when(s.rlike(r"^\d{16}$"), F.floor(s.cast("bigint") / 1000))
            .otherwise(_let(_let(_let(parsed_fields(s), read), place), resolve))
        )

    ms = _let(tidy(F.col(f"`{text}`")), whole)
    done = df.withColumn(out, F.nullif(ms, F.lit(0)).cast("bigint"))
    if not only_instants:
        return done
    # the row number keeps the optimizer from pushing the filter below, which would parse every text twice
    return done.withColumn("__row", F.monotonically_increasing_id()).where((F.col("__row") >= 0) & F.col(out).isNotNull()).drop("__row")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_source_zone(df: DataFrame, nodes: DataFrame, node: str = "node") -> DataFrame:
    """Join each row with its source's tz_name, date_order and zone abbreviations (null for unknown sources); Spark broadcasts the lookup if it is small enough.

    Columns of df with one of those three names are kept with ``_own`` added.
    """
    df = df.withColumnsRenamed({c: f"{c}_own" for c in ("tz_name", "date_order", "abbreviations") if c in df.columns})
    dim = nodes.dropDuplicates([node]).select(node, "tz_name", "date_order").withColumn("abbreviations", zone_abbreviations("tz_name"))
    return df.join(dim, node, "left")
