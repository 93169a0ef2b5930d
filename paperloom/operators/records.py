"""Records read from semi-structured pages and notes: lots with prices and times, fines, fees, podcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """What a pattern's group finds first, null where it finds nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def amount(text: Column) -> Column:
    """A number written with separators, in units of ten thousand where it says so."""
    digits = F.regexp_replace(found(text, r"([\d,]+(?:\.\d+)?)"), ",", "").try_cast("double")
    return F.when(F.coalesce(text, F.lit("")).contains("万"), digits * 10000).otherwise(digits)


_BLANKS = r"[\s\u00a0]"
# Emission standards by their numerals, in the order in which they are looked for (six holds the sign of five).
EMISSION = (("国三", "三|3|III"), ("国四", "四|4|IV"), ("国六", "六|6|VI|Ⅵ"), ("国五", "五|5|V|Ⅴ"))
# How a lot is said to be mortgaged or not.
MORTGAGED, FREE = ("是", "已抵押", "有抵押", "有"), ("否", "未抵押", "无抵押", "无")


def emission_standard(text: Column) -> Column:
    """The standard's plain name; other texts as they are, null as the empty text."""
    plain = F.regexp_replace(text, r"[\s\u00a0（）()]", "")
    named = F.coalesce(*(F.when(plain.rlike(f"国({numeral})"), name) for name, numeral in EMISSION))
    return F.coalesce(named, F.trim(text), F.lit(""))


def mortgage(said: Column) -> Column:
    """是 or 否, and 未知 for whatever says neither."""
    plain = F.regexp_replace(said, r"[\s\u00a0；;]+", "")
    return F.when(plain.isin(*MORTGAGED), "是").when(plain.isin(*FREE), "否").otherwise("未知")


def mortgage_in(text: Column) -> Column:
    """What a longer text says of a mortgage behind that label."""
    plain = F.regexp_replace(text, _BLANKS, "")
    return mortgage(F.regexp_extract(plain, r"(?:是否)?抵押[:：]([^（(；;<]+?)(?=[（(；;]|\d+[、.]|其他|$)", 1))


def normal_day(text: Column) -> Column:
    """A text that is a day as year-month-day, anything else as the empty text."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, "")
    shape = r"^(\d{4})(?:[/\-.](\d{1,2})[/\-.](\d{1,2})|年(\d{1,2})月(\d{1,2})日?)$"
    part = lambda i, j: F.lpad(F.concat(F.regexp_extract(plain, shape, i), F.regexp_extract(plain, shape, j)), 2, "0")
    return F.when(plain.rlike(shape), F.concat_ws("-", F.regexp_extract(plain, shape, 1), part(2, 4), part(3, 5))).otherwise("")


def plain_date(text: Column) -> Column:
    """The first date a text says, as year-month-day."""
    y, m, d = (F.regexp_extract(text, r"(\d{4})\s*[年/.-]\s*(\d{1,2})\s*[月/.-]\s*(\d{1,2})", i) for i in (1, 2, 3))
    return F.when(y != "", F.concat(y, F.lit("-"), F.lpad(m, 2, "0"), F.lit("-"), F.lpad(d, 2, "0")))


def court(text: Column) -> Column:
    return found(text, r"([一-鿿]{2,20}?(?:人民法院|仲裁委员会|公安局))")


def labelled(paragraphs: Column, label: str) -> Column:
    """What follows a label in the first paragraph that has it."""
    hit = F.get(F.filter(paragraphs, lambda p: p.rlike(rf"{label}\s*[:：]")), 0)
    return F.nullif(F.trim(F.regexp_extract(hit, rf"{label}\s*[:：]\s*([^，。；;\n]*)", 1)), F.lit(""))


def years_since(day: Column, until: Column) -> Column:
    return F.format_string("%.1f", F.datediff(until, day) / 365.25)


# How fines are counted (起), with points (分) and amount (元), without points, and alone.
FINES = ((r"(\d+)起[，,]?(\d+)分[，,]?(\d+)元", "[；;]?", (0, 1, 2)), (r"(\d+)起[，,]?(\d+)元", "[；;]?", (0, 2)), (r"(\d+)起[；;]", "", (0,)))


def fines(text: Column) -> Column:
    """Counts, points and amounts of all fines summed; each way of saying them is looked for in what the ones before left."""
    total = [F.lit(0).cast("long")] * 3
    rest = F.regexp_replace(F.coalesce(text, F.lit("")), _BLANKS, "")
    for pattern, tail, which in FINES:
        for group, i in enumerate(which):
            numbers = F.transform(F.regexp_extract_all(rest, F.lit(pattern), F.lit(group + 1)), lambda x: F.coalesce(x.try_cast("bigint"), F.lit(0)))
            total[i] = total[i] + F.aggregate(numbers, F.lit(0).cast("long"), lambda a, b: a + b)
        rest = F.regexp_replace(rest, pattern + tail, "")
    return F.struct(total[0].alias("n"), total[1].alias("points"), total[2].alias("amount"))


_MONEY = r"(\d+(?:\.\d+)?)\s*元"
# Words that lead to a total, and how far before and after it its parts are named.
_TOTAL, PARTS_BEFORE, PARTS_AFTER = r"(?:车辆的费用)?(?:共|合|总)计(?:约|费用)?[：:]?\s*" + _MONEY, 100, 150


def _placed(text: Column, pattern: str) -> Column:
    """All matches of a pattern with a number in its group: their value and where they begin."""
    pieces, whole, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, x: a + F.length(x))
    return F.transform(values, lambda v, i: F.struct(v.cast("double").alias("value"), (size(pieces, i + 1) + size(whole, i)).alias("at")))


def fee_amounts(text: Column) -> Column:
    """The fees a text names: its totals, then the amounts that are no part of one, which stand near it."""
    text = F.coalesce(text, F.lit(""))
    fees, totals = _placed(text, _MONEY), _placed(text, _TOTAL)
    part = lambda f, t: ((f["at"] < t["at"]) & (t["at"] - f["at"] < PARTS_BEFORE)) | ((f["at"] > t["at"]) & (f["at"] - t["at"] < PARTS_AFTER))
    alone = F.filter(fees, lambda f: ~F.exists(totals, lambda t: part(f, t)))
    return F.transform(F.concat(totals, alone), lambda x: x["value"])


def fee_total(text: Column) -> Column:
    return F.aggregate(fee_amounts(text), F.lit(0.0), lambda a, b: a + b)


def total_price(price: Column, fees: Sequence[Column]) -> Column:
    out = F.coalesce(price, F.lit(0.0))
    for f in fees:
        out = out + F.coalesce(f, F.lit(0.0))
    return out


def fee_labels(df: DataFrame, text: str, suffix: str = "费", most: int = 80) -> DataFrame:
    """Words of two to eight ideographs that end so, most frequent first."""
    w = df.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(rf"([一-鿿]{{1,7}}{suffix})"), F.lit(1))).alias("label"))
    return w.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(most)


def key_information(pairs: Sequence[tuple[str, Column]]) -> Column:
    """A table of the values that are there."""
    rows = [F.when(F.coalesce(v.cast("string"), F.lit("")) != "", F.concat(F.lit(f"| {k} | "), v.cast("string"), F.lit(" |"))) for k, v in pairs]
    return F.concat_ws("\n", F.lit("| 项目 | 内容 |\n| - | - |"), *rows)


def podcast(schema: Column) -> Column:
    """An episode from its JSON-LD: name, show, duration in seconds, day, number."""
    get = lambda p: F.get_json_object(schema, p)
    iso = F.coalesce(get("$.timeRequired"), get("$.duration"))
    part = lambda u: F.coalesce(F.regexp_extract(iso, rf"(\d+){u}", 1).try_cast("long"), F.lit(0))
    return F.struct(
        get("$.name").alias("name"), get("$.partOfSeries.name").alias("show"), (part("H") * 3600 + part("M") * 60 + part("S")).alias("seconds"),
        F.left(get("$.datePublished"), F.lit(10)).alias("day"), F.regexp_extract(get("$.name"), r"(?:Vol\.?|E|EP|第)\s*(\d+)", 1).try_cast("int").alias("episode"),
    )


def list_items(pages: DataFrame, html: str, pattern: str, key: str = "id") -> DataFrame:
    """Identifiers that list pages link to, each once."""
    return pages.select(F.explode(F.regexp_extract_all(F.col(html), F.lit(pattern), F.lit(1))).alias(key)).distinct()
