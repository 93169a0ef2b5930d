"""Passages marked in pages: merged, collapsed, counted, searched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.functions.urls import domain, normalized


def merged(marks: DataFrame, by: list[str], start: str = "start_offset", end: str = "end_offset", order: list[str] | None = None) -> DataFrame:
    """Marks of one place that overlap or touch, as one: ``<by>, <start>, <end>,
    n_marks``. A mark opens an island if it begins after all before it ended."""
    w = Window.partitionBy(*by).orderBy(start, end, *(order or []))
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)
    islands = marks.withColumn("_o", opens).withColumn("_i", F.sum("_o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_i").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_marks")).drop("_i")


def overlaps(marks: DataFrame, by: list[str], key: str, start: str = "start_offset", end: str = "end_offset", width: int = 64) -> DataFrame:
    """Pairs of marks of one place that overlap or touch, ``a < b`` by key.

    Offsets are cut into stretches of ``width``; a pair is found in the first
    stretch both lie in, so no place's marks are all compared with each other.
    """
    cell = lambda c: F.floor(F.col(c) / width).cast("long")
    m = marks.select(*by, F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.explode(F.sequence(cell(start), cell(end))).alias("_c"))
    a, b = (m.select(*by, "_c", *(F.col(f"_{x}").alias(f"{x}{n}") for x in "kse")) for n in (1, 2))
    first = F.greatest(F.floor(F.col("s1") / width), F.floor(F.col("s2") / width)).cast("long")
    pairs = a.join(b, [*by, "_c"]).where((F.col("k1") < F.col("k2")) & (F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")) & (F.col("_c") == first))
    return pairs.select(*by, F.col("k1").alias("a"), F.col("k2").alias("b"))


def stamp(identifier: Column, missing: int) -> Column:
    """The time in milliseconds that a mark's identifier begins with."""
    return F.coalesce(F.nullif(F.regexp_extract(identifier, r"^\s*(\d+)", 1), F.lit("")).try_cast("bigint"), F.lit(missing))


def collapsed(marks: DataFrame, url: str = "url", key: str = "id", group: str = "group_id", content: str = "content", notes: str = "notes") -> DataFrame:
    """Marks of a group as one: texts joined by blank lines, notes one after the other, the first one's identifier."""
    of = F.coalesce(F.col(group), F.col(key))
    order = F.struct(stamp(F.col(key), 0).alias("t"), F.col(key).alias("k"), F.col(content).alias("c"), F.coalesce(F.col(notes), F.array().cast("array<string>")).alias("n"))
    g = marks.groupBy(url, of.alias("_g")).agg(F.array_sort(F.collect_list(order)).alias("_m"))
    return g.select(
        url, F.get("_m", 0)["k"].alias(key), F.array_join(F.transform("_m", lambda m: m["c"]), "\n\n").alias(content), F.flatten(F.transform("_m", lambda m: m["n"])).alias(notes), F.size("_m").cast("long").alias("n_marks")
    )


def pages(marks: DataFrame, url: str = "url", title: str = "title", key: str = "id") -> DataFrame:
    """Marks per page, addresses of one page taken together; its first title that isn't empty."""
    own = F.when(F.col(title) != "", F.struct(stamp(F.col(key), 0).alias("t"), F.col(key).alias("k"), F.col(title).alias("v")))
    out = marks.groupBy(normalized(F.col(url)).alias("page")).agg(F.count("*").alias("n_marks"), F.min(own)["v"].alias("title"), F.max(stamp(F.col(key), 0)).alias("newest"), F.min(stamp(F.col(key), 2**53)).alias("oldest"))
    return out.withColumn("domain", domain(F.col("page")))


def domains(marks: DataFrame, url: str = "url", title: str = "title", key: str = "id") -> DataFrame:
    """Pages and marks per domain, and the newest and oldest."""
    return pages(marks, url, title, key).groupBy("domain").agg(
        F.count("*").alias("n_pages"), F.sum("n_marks").alias("n_marks"), F.max("newest").alias("newest"), F.min("oldest").alias("oldest")
    )


ORDERS = {"az": lambda: [F.col("domain").asc()], "za": lambda: [F.col("domain").desc()], "new": lambda: [F.col("newest").desc(), F.col("domain")], "old": lambda: [F.col("oldest").asc(), F.col("domain")]}


def ordered(groups: DataFrame, by: str) -> DataFrame:
    return groups.orderBy(*ORDERS[by]())


def searched(marks: DataFrame, words: str, url: str = "url", title: str = "title", content: str = "content", notes: str = "notes") -> DataFrame:
    """Marks that hold the words, and all marks of pages whose address or title does."""
    low = lambda c: F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(words.lower()))
    in_notes = F.coalesce(F.exists(F.col(notes), lambda n: F.contains(F.lower(n), F.lit(words.lower()))), F.lit(False))
    return marks.where(low(content) | in_notes | low(url) | low(title))


def exported(marks: DataFrame, url: str = "url", key: str = "id", content: str = "content") -> DataFrame:
    """A JSON text for each page: its marks in their order."""
    one = F.struct(stamp(F.col(key), 0).alias("t"), F.col(key).alias("id"), F.col(content).alias("content"))
    g = marks.groupBy(url).agg(F.array_sort(F.collect_list(one)).alias("_m"))
    return g.select(url, F.to_json(F.transform("_m", lambda m: F.struct(m["id"].alias("id"), m["content"].alias("content")))).alias("highlights"))


def undo_stack(changes: DataFrame, by: list[str], order: list[str], depth: int = 30) -> DataFrame:
    """The changes that can still be undone: the latest of each session."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return changes.withColumn("undo_rank", F.row_number().over(w)).where(F.col("undo_rank") <= depth)
