"""Cues and chapters of recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "其他片段"


def in_chapters(cues: DataFrame, chapters: DataFrame, by: str, at: str = "from", width: float = 600.0) -> DataFrame:
    """Each cue with each chapter it begins in: ``from <= at < to``, open where
    ``to`` is null. Chapters are laid out in stretches of ``width`` up to the
    last cue of their recording, so cues meet only chapters of their stretch."""
    last = cues.groupBy(by).agg(F.max(at).alias("_last"))
    cell = lambda c: F.floor(c / width).cast("long")
    spans = chapters.join(last, by).withColumn("_to", F.coalesce(F.col("to"), F.col("_last") + 1)).where(F.col("_to") > F.col("chapter_from"))
    spans = spans.where(F.col("chapter_from") <= F.col("_last")).withColumn("_c", F.explode(F.sequence(cell(F.col("chapter_from")), cell(F.least(F.col("_to"), F.col("_last"))))))
    return cues.withColumn("_c", cell(F.col(at))).join(spans.drop("_last", "_to"), [by, "_c"]).where((F.col(at) >= F.col("chapter_from")) & (F.col("to").isNull() | (F.col(at) < F.col("to")))).drop("_c")


def in_none(cues: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """The cues that no chapter holds."""
    return cues.join(found.select(*key).distinct(), key, "left_anti")


#: Fixed value: the heading of what no chapter holds.
LEFTOVERS = "其他片段"


def as_markdown(cues: DataFrame, by: str, chapter: str, at: str, content: str, seconds: str | None = None) -> DataFrame:
    """Per recording: a heading for each chapter and its cues in their order
    (``at``) with the time at which they begin (``seconds``, else ``at``). Cues
    of no chapter (null) come last; without any chapter there is no heading."""
    line = F.concat(F.lit("- `"), clock(F.col(seconds or at)), F.lit("` "), F.coalesce(F.col(content), F.lit("")))
    chapters = cues.groupBy(by, chapter).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("a"), line.alias("c")))).alias("_q"))
    one = F.struct(F.col(chapter).isNull().alias("rest"), F.get("_q", 0)["a"].alias("a"), F.col(chapter).alias("k"), F.array_join(F.transform("_q", lambda q: q["c"]), "\n").alias("b"))
    parts = chapters.groupBy(by).agg(F.array_sort(F.collect_list(one)).alias("_p"))
    head = lambda x: F.when(~x["rest"], F.concat(F.lit("### "), x["k"], F.lit("\n\n"))).when(F.size("_p") > 1, F.lit(f"### {LEFTOVERS}\n\n")).otherwise("")
    return parts.select(by, F.array_join(F.transform("_p", lambda x: F.concat(head(x), x["b"])), "\n\n").alias("markdown"))


def segments(text: Column) -> Column:
    """Sentences, cut after their ends; ideographs need no blank after them."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?…])\s+|(?<=[。！？])"), lambda s: F.trim(s)), lambda s: s != "")


def clock(seconds: Column) -> Column:
    h, m, s = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, F.floor(seconds) % 60
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s))).otherwise(F.concat(two(m), F.lit(":"), two(s)))


# What the code and name of a track's language hold, and its rank.
TRACKS = ((("zh-cn", "中文", "汉语"), 5), (("zh-hans", "简体"), 4), (("zh",), 3), (("en",), 2))


def best_track(tracks: DataFrame, by: str, language: str = "lan", place: str = "place", name: str | None = None) -> DataFrame:
    """The subtitles of the best language, by its code and name, the first of equals."""
    said = F.lower(F.concat_ws(" ", F.coalesce(language, F.lit("")), *([F.coalesce(name, F.lit(""))] if name else [])))
    rank = F.coalesce(*(F.when(said.rlike("|".join(words)), score) for words, score in TRACKS), F.lit(1))
    return tracks.groupBy(by).agg(F.max_by(language, F.struct(rank, -F.col(place))).alias(language))


def interpolated(anchors: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Missing values between neighbours, in proportion to their distance."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(order)
    have = F.when(F.col(value).isNotNull(), F.struct(F.col(order).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    a = anchors.withColumn("_a", F.last(have, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first(have, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    part = F.try_divide(F.col(order) - F.col("_a.x"), F.col("_b.x") - F.col("_a.x"))
    filled = F.coalesce(F.col(value).cast("double"), F.col("_a.y") + part * (F.col("_b.y") - F.col("_a.y")))
    return a.withColumn("filled", filled).drop("_a", "_b")
