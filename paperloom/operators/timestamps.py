"""Times in mixed notations, precisions and zones, as one UTC instant.

An ordered cascade of anchored patterns reads the text. Each pattern rewrites
a text it matches in full to one row of fields; what no pattern matches in
full is null. Fields are checked strictly (no 30 February, no 25:61), the zone
is what the text says or else the zone of its source, and a clock reading that
occurs twice or never in that zone follows an explicit policy.

Every step is a built-in expression over the row: no join, no shuffle and no
Python worker, so the work is spread like the scan.

Defined results: null, empty or unreadable text gives null; a text without
zone from a source without zone gives null; a day-month-year reading from a
source without a date order gives null; a relative day ("yesterday 18:06")
without ``captured`` gives null. Rounded values ("3 hours ago") give null.
Repeated rows and ties give equal results; other columns are not touched.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Names of months in the languages of the sources.
MONTHS = {
    "en": "january february march april may june july august september october november december",
    "de": "januar februar märz april mai juni juli august september oktober november dezember",
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
}
SHORT_MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec"
EXTRA_MONTHS = {"sept": 9, "okt": 10, "dez": 12, "mrz": 3, "maerz": 3}
# Day parts that turn a 12-hour reading.
AFTER_NOON = ["pm", "下午", "晚上", "傍晚"]
BEFORE_NOON = ["am", "上午", "早上", "凌晨"]
# Days named relative to the reading, as days back.
DAYS_BACK = {
    "today": 0, "yesterday": 1, "今天": 0, "昨天": 1, "前天": 2, "heute": 0, "gestern": 1, "vorgestern": 2,
    "aujourd'hui": 0, "hier": 1,
}

# Kinds of rows of fields: dated, epoch, day and month in the source's order, relative.
_ZONE = r"(Z|z|[A-Za-z]{2,5}|(?:UTC|GMT)?\s?[+-]\d{1,2}(?::?\d{2})?|\[?[A-Z][A-Za-z]+(?:/[A-Za-z_+-]+){1,2}\]?|[(（]?北京时间[)）]?)"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?: ?([AaPp])\.?[Mm]\.?)?"
_NAME = r"([A-Za-zÀ-ÿ]{3,9})\.?"


@dataclass(frozen=True)
class Pattern:
    """A notation: texts that match ``regex`` in full become ``fields``,
    ``kind|year|month|day|hour|minute|second|fraction|half|zone``."""

    name: str
    regex: str
    fields: str

    @property
    def anchored(self) -> str:
        return f"^(?:{self.regex})$"


CASCADE = (
    Pattern("epoch_s", r"(\d{10})(?:\.(\d{1,9}))?", "E|$1||||||$2||"),
    Pattern("epoch_ms", r"(\d{10})(\d{3})", "E|$1||||||$2||"),
    Pattern("epoch_us", r"(\d{10})(\d{6})", "E|$1||||||$2||"),
    Pattern("epoch_ns", r"(\d{10})(\d{9})", "E|$1||||||$2||"),
    Pattern("compact_day", r"((?:19|20)\d{2})(\d{2})(\d{2})", "D|$1|$2|$3||||||"),
    Pattern("compact", rf"((?:19|20)\d{{2}})(\d{{2}})(\d{{2}})[T ]?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,9}}))? ?{_ZONE}?", "D|$1|$2|$3|$4|$5|$6|$7||$8"),
    Pattern("year_first", rf"(\d{{4}})([-/.])(\d{{1,2}})\2(\d{{1,2}})(?:(?:[T ]| um | at |, ?){_CLOCK}{_HALF} ?{_ZONE}?)?", "D|$1|$3|$4|$5|$6|$7|$8|$9|$10"),
    Pattern("year_first_zh", r"(\d{4})年(\d{1,2})月(\d{1,2})[日号] ?(?:(上午|下午|凌晨|早上|晚上|傍晚)? ?(\d{1,2})(?::|时|点)(\d{1,2})(?:(?::|分)(\d{1,2}))?[分秒]? ?" + _ZONE + "?)?", "D|$1|$2|$3|$5|$6|$7||$4|$8"),
    Pattern("mail", rf"(?:[A-Z][a-z]{{2,8}}, )?(\d{{1,2}})(?:\.|st|nd|rd|th)? {_NAME} (\d{{4}}),?(?:(?: | at | um | à ){_CLOCK}{_HALF}(?: Uhr)? ?{_ZONE}?)?", "D|$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    Pattern("month_first", rf"(?:[A-Z][a-z]{{2,8}}, )?{_NAME} (\d{{1,2}})(?:st|nd|rd|th)?, (\d{{4}}),?(?:(?: | at ){_CLOCK}{_HALF} ?{_ZONE}?)?", "D|$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    Pattern("day_de", rf"(\d{{1,2}})\. {_NAME} (\d{{4}}),? (?:um )?(\d{{1,2}})\.(\d{{2}})(?:\.(\d{{2}}))? Uhr", "D|$3|$2|$1|$4|$5|$6|||"),
    Pattern("day_fr", rf"(\d{{1,2}})(?:er)? {_NAME} (\d{{4}}),? (?:à )?(\d{{1,2}}) ?h ?(\d{{2}})", "D|$3|$2|$1|$4|$5||||"),
    Pattern("source_order", rf"(\d{{1,2}})([-/.])(\d{{1,2}})\2(\d{{4}}|\d{{2}})(?:,? {_CLOCK}{_HALF} ?{_ZONE}?)?", "S|$4|$1|$3|$5|$6|$7|$8|$9|$10"),
    Pattern("relative", rf"(?i)(today|yesterday|heute|gestern|vorgestern|aujourd'hui|hier|今天|昨天|前天)(?:,? (?:at |um |à )?{_CLOCK}{_HALF}(?: Uhr)?)?", "R|$1|||$2|$3|$4|$5|$6|"),
    Pattern("relative_zh", r"(今天|昨天|前天)(上午|下午|凌晨|早上|晚上|傍晚)? ?(\d{1,2})[:点](\d{2})分?", "R|$1|||$3|$4|||$2|"),
)


@dataclass(frozen=True)
class Policy:
    """What to do where a clock reading isn't one instant.

    ``ambiguous`` (twice): ``null``, ``earlier`` or ``later``. ``nonexistent``
    (never): ``null`` or ``shift`` (by the length of the gap). Instants outside
    ``min_year``..``max_year`` are taken as stand-ins for a missing value.
    ``pivot``: two-digit years below it are of this century.
    """

    ambiguous: str = "null"
    nonexistent: str = "null"
    min_year: int = 1971
    max_year: int = 2099
    pivot: int = 70


@lru_cache(1)
def _months() -> dict[str, int]:
    found: dict[str, int] = dict(EXTRA_MONTHS)
    for names in (*MONTHS.values(), SHORT_MONTHS):
        found |= {n: i + 1 for i, n in enumerate(names.split())}
    return found


@lru_cache(1)
def zone_names() -> frozenset[str]:
    """Zones with a region, as the tz database lists them."""
    regions = {"Africa", "America", "Antarctica", "Arctic", "Asia", "Atlantic", "Australia", "Europe", "Indian", "Pacific", "Etc"}
    return frozenset(z for z in available_timezones() if z.split("/")[0] in regions and "/" in z) | {"UTC"}


@lru_cache(1)
def abbreviations() -> dict[str, int]:
    """Seconds east of UTC of each abbreviation, from the tz database:
    under ``zone|abbreviation`` as that zone uses it, and under
    ``|abbreviation`` where all zones agree on it."""
    used: dict[str, set[int]] = {}
    found: dict[str, int] = {"|UTC": 0, "|GMT": 0, "|Z": 0, "|z": 0}
    for zone in sorted(zone_names()):
        info = ZoneInfo(zone)
        for year in (2012, 2018, 2024):
            for month in (1, 7):
                at = datetime(year, month, 1, tzinfo=UTC).astimezone(info)
                name, seconds = at.tzname(), int(at.utcoffset().total_seconds())
                if name.isalpha():
                    found[f"{zone}|{name}"] = seconds
                    used.setdefault(name, set()).add(seconds)
    return {f"|{n}": next(iter(s)) for n, s in used.items() if len(s) == 1} | found


def java_zones() -> frozenset[str] | None:
    """The zones the JVM knows; None where there is none at hand."""
    spark = SparkSession.getActiveSession()
    try:
        return frozenset(spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds().toArray())
    except Exception:  # no classic session
        return None


def fields(text: Column) -> Column:
    """The cascade: the row of fields as text, null where no pattern fits."""
    plain = F.translate(text, "０１２３４５６７８９：／．，－\u3000\u00a0\u2009\u202f\u2007\u2002", "0123456789:/.,-" + " " * 6)
    plain = F.trim(plain)
    row: Column = F.lit(None).cast("string")
    for p in reversed(CASCADE):
        row = F.when(plain.rlike(p.anchored), F.regexp_replace(plain, p.anchored, p.fields)).otherwise(row)
    return row


def _number(field: Column) -> Column:
    return F.nullif(field, F.lit("")).try_cast("bigint")


def _shown_in(micros: Column, zone: Column) -> Column:
    """Microseconds of the clock reading at an instant in ``zone``, as if it were UTC."""
    return F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(micros), zone))


def with_utc_ms(
    df: DataFrame, text: str, zone: str, order: str, captured: str, out: str = "utc_ms", policy: Policy = Policy()
) -> DataFrame:
    """``df`` with ``out``: milliseconds since 1970-01-01 UTC of the one instant
    the column ``text`` names, or null.

    ``zone``, ``order`` (ymd, mdy or dmy) and ``captured`` (timestamp) are the
    columns that hold what is known of the text's source. Fractions below a
    millisecond are cut off. Steps are kept in columns under names that ``df``
    doesn't have, and dropped.
    """
    prefix = "_t"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    name = lambda s: f"{prefix}{s}"
    c = lambda s: F.col(name(s))
    zones = ", ".join(f"'{z}'" for z in sorted(zone_names() & (java_zones() or zone_names())))
    known = lambda column: F.expr(f"`{column}` IN ({zones})")
    null = F.lit(None).cast("bigint")
    lookup = lambda pairs: F.from_json(F.lit(json.dumps(pairs)), "map<string,int>")

    df = df.withColumn(name("row"), F.split(fields(F.col(f"`{text}`")), r"\|"))
    part = lambda i: c("row")[i]

    # the zone as written: an offset, an abbreviation or a name; else the source's
    df = df.withColumns(
        {
            name("kind"): part(0),
            name("half"): F.lower(part(8)),
            name("said"): F.regexp_replace(part(9), r"[\[\]()（）]", ""),
            name("home"): F.when(known(zone), F.col(f"`{zone}`")),
            name("order"): F.col(f"`{order}`"),
        }
    )
    offset = r"^(?:UTC|GMT)?\s?([+-])(\d{1,2}):?(\d{2})?$"
    sign = F.regexp_extract(c("said"), offset, 1)
    seconds = F.regexp_extract(c("said"), offset, 2).try_cast("int") * 3600 + F.coalesce(F.regexp_extract(c("said"), offset, 3).try_cast("int"), F.lit(0)) * 60
    short = lookup(abbreviations())
    by_name = F.coalesce(
        F.try_element_at(short, F.concat(F.coalesce(c("home"), F.lit("")), F.lit("|"), F.upper(c("said")))),
        F.try_element_at(short, F.concat(F.lit("|"), F.upper(c("said")))),
    )
    named = F.when(c("said") == "北京时间", "Asia/Shanghai").when(known(name("said")), c("said"))
    df = df.withColumns(
        {
            name("fixed"): F.when(sign != "", F.when(seconds <= 14 * 3600, F.when(sign == "-", -seconds).otherwise(seconds))).when(
                (c("said") != "") & named.isNull() & ~c("said").contains("/"), by_name
            ),
            name("zone"): F.when(c("said") != "", named).otherwise(c("home")),
        }
    )

    # the day, in microseconds, as if read in UTC
    third = part(1)
    month_text = F.when(c("kind") != "S", part(2)).when(c("order") == "mdy", part(2)).when(c("order") == "dmy", part(3))
    day_text = F.when(c("kind") != "S", part(3)).when(c("order") == "mdy", part(3)).when(c("order") == "dmy", part(2))
    century = F.when(F.length(third) == 2, F.when(_number(third) < policy.pivot, 2000).otherwise(1900)).otherwise(0)
    month = F.coalesce(_number(month_text), F.try_element_at(lookup(_months()), F.lower(month_text)).cast("bigint"))
    written = F.try_to_date(
        F.concat_ws("-", F.lpad((_number(third) + century).cast("string"), 4, "0"), F.lpad(month.cast("string"), 2, "0"), F.lpad(_number(day_text).cast("string"), 2, "0")),
        "yyyy-MM-dd",
    )
    there = F.when(c("home").isNotNull(), _shown_in(F.unix_micros(F.col(f"`{captured}`")), F.coalesce(c("home"), F.lit("UTC"))))
    back = F.try_element_at(lookup(DAYS_BACK), F.lower(third))
    df = df.withColumn(
        name("day"),
        F.when(c("kind") == "R", F.floor(there / DAY_US).cast("bigint") - back).when(c("kind") != "E", F.unix_date(written).cast("bigint")),
    )

    # the clock
    is_pm, is_am = c("half").isin("p", *AFTER_NOON), c("half").isin("a", *BEFORE_NOON)
    df = df.withColumns({name("h"): F.coalesce(_number(part(4)), F.lit(0)), name("mi"): F.coalesce(_number(part(5)), F.lit(0)), name("s"): F.coalesce(_number(part(6)), F.lit(0))})
    good = (c("h") <= F.when(is_pm | is_am, 12).otherwise(23)) & (c("mi") <= 59) & (c("s") <= 59)
    hour = F.when(is_pm, c("h") % 12 + 12).when(is_am, c("h") % 12).otherwise(c("h"))
    fraction = F.coalesce(F.substring(F.rpad(part(7), 9, "0"), 1, 6).try_cast("bigint"), F.lit(0))
    df = df.withColumn(
        name("local"),
        F.when(c("kind") == "E", _number(third) * 1_000_000 + fraction).when(
            good, c("day") * DAY_US + ((hour * 60 + c("mi")) * 60 + c("s")) * 1_000_000 + fraction
        ),
    )

    # a reading in a named zone: the instants that show it, by the offsets in force before and after
    at = F.when(c("zone").isNotNull() & c("fixed").isNull() & (c("kind") != "E"), c("local"))
    safe = F.coalesce(c("zone"), F.lit("UTC"))
    df = df.withColumns(
        {
            name("before"): at - (_shown_in(at - DAY_US, safe) - (at - DAY_US)),
            name("after"): at - (_shown_in(at + DAY_US, safe) - (at + DAY_US)),
        }
    )
    df = df.withColumns({name("in_b"): _shown_in(c("before"), safe) == c("local"), name("in_a"): _shown_in(c("after"), safe) == c("local")})
    twice = {"null": null, "earlier": F.least(c("before"), c("after")), "later": F.greatest(c("before"), c("after"))}[policy.ambiguous]
    never = {"null": null, "shift": F.greatest(c("before"), c("after"))}[policy.nonexistent]
    in_zone = (
        F.when(c("in_b") & c("in_a"), F.when(c("before") == c("after"), c("before")).otherwise(twice))
        .when(c("in_b"), c("before"))
        .when(c("in_a"), c("after"))
        .when(c("before").isNotNull(), never)
    )
    micros = F.when(c("kind") == "E", c("local")).when(c("fixed").isNotNull(), c("local") - c("fixed").cast("bigint") * 1_000_000).otherwise(in_zone)
    bounds = [int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) * 1_000_000 for y in (policy.min_year, policy.max_year + 1)]
    df = df.withColumn(name("us"), micros)
    df = df.withColumn(out, F.when((c("us") >= bounds[0]) & (c("us") < bounds[1]), F.unix_millis(F.timestamp_micros(c("us")))))
    return df.drop(*[x for x in df.columns if x.startswith(prefix) and x != out])
