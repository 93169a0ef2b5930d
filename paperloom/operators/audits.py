"""Reports on what was extracted: worst status by page, profiles of columns, two readings compared."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From best to worst.
STATUSES = ("na", "pass", "unknown", "fail")


def rank(status: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATUSES)), status)


def worst(slices: DataFrame, by: str, checks: Sequence[str], extent: str | None = None) -> DataFrame:
    """Per page the worst status of each check, and how much of it was looked at."""
    named = F.array(*map(F.lit, STATUSES))
    aggs = [F.get(named, (F.max(rank(F.col(c))) - 1).cast("int")).alias(c) for c in checks]
    more = [F.sum(extent).alias("extent")] if extent else []
    return slices.groupBy(by).agg(*aggs, F.count("*").alias("n_slices"), *more)


def badge(audited: DataFrame, checks: Sequence[str]) -> DataFrame:
    """How many pages have each status in any check, and the overall one."""
    overall = F.get(F.array(*map(F.lit, STATUSES)), (F.greatest(*(rank(F.col(c)) for c in checks)) - 1).cast("int"))
    return audited.withColumn("overall", overall).groupBy("overall").agg(F.count("*").alias("n_pages"))


def profile(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """``field, value, n, place``: the most frequent values of each column, empty ones left out."""
    long = df.unpivot([], list(columns), "field", "value").where("value is not null and value <> ''")
    n = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field").orderBy(F.col("n").desc(), "value")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def completeness(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``field, n_filled, n_distinct``."""
    long = df.unpivot([], list(columns), "field", "value").where("value is not null and value <> ''")
    return long.groupBy("field").agg(F.count("*").alias("n_filled"), F.count_distinct("value").alias("n_distinct"))


def patterns(df: DataFrame, column: str, key: str, top: int = 50, samples: int = 5) -> DataFrame:
    """The most frequent values with a few keys; counts are of all rows."""
    n = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    best = n.orderBy(F.col("n").desc(), "value").limit(top)
    w = Window.partitionBy("value").orderBy(key)
    rows = df.select(F.col(column).alias("value"), F.col(key)).join(best, "value").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= samples)
    return rows.groupBy("value", "n").agg(F.array_sort(F.collect_list(key)).alias("samples"))


def compared(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str], tolerance: float = 0.01) -> DataFrame:
    """``<key>, field, left_value, right_value, same`` of two readings of records: numbers within a tolerance, texts exactly, records of one side not at all."""
    x = a.select(key, *(F.col(f).cast("string").alias(f"a_{f}") for f in fields))
    y = b.select(key, *(F.col(f).cast("string").alias(f"b_{f}") for f in fields))
    both = x.join(y, key, "full")
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("left_value"), F.col(f"b_{f}").alias("right_value")) for f in fields)))
    out = both.select(key, cells.alias("c")).select(key, "c.*")
    near = F.abs(F.col("left_value").try_cast("double") - F.col("right_value").try_cast("double")) < tolerance
    return out.withColumn("same", F.coalesce(near, F.col("left_value") == F.col("right_value"), F.col("left_value").isNull() & F.col("right_value").isNull()))


def agreement(cells: DataFrame) -> DataFrame:
    """Per field how often two readings are the same."""
    return cells.groupBy("field").agg(F.count("*").alias("n_records"), F.count_if("same").alias("n_same"))


def examples(cells: DataFrame, by: str, order: Sequence[str], most: int = 20) -> DataFrame:
    w = Window.partitionBy(by).orderBy(*order)
    return cells.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def plain(text: Column) -> Column:
    """A text as it is compared: links as their texts; letters, digits and ideographs in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"\[([^\[\]]*)\]\([^()]*\)", "$1"), r"[^\p{L}\p{N}]+", ""))


def covered(pages: DataFrame, notes: DataFrame, key: str, blocks: str, note_text: str) -> DataFrame:
    """Notes with ``n_blocks``, the blocks of their page (an array of texts), and
    ``n_covered``, those the note holds from beginning to end; blocks without
    letters and digits are compared but for blanks. A note without page, or whose
    page has no blocks, has none of either. ``key`` is unique in ``pages``."""
    tight = lambda c: F.regexp_replace(c, r"\s+", "")
    forms = F.transform(F.filter(blocks, lambda b: tight(b) != ""), lambda b: F.struct(plain(b).alias("plain"), tight(b).alias("tight")))
    both = notes.join(pages.select(key, forms.alias("_b")), key, "left")
    both = both.withColumns({"_n": plain(F.coalesce(note_text, F.lit(""))), "_t": tight(F.coalesce(note_text, F.lit("")))})
    held = F.filter("_b", lambda b: F.when(b["plain"] != "", F.contains(F.col("_n"), b["plain"])).otherwise(F.contains(F.col("_t"), b["tight"])))
    size = lambda c: F.coalesce(F.when(c.isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return both.withColumns({"n_blocks": size(F.col("_b")), "n_covered": size(held)}).drop("_b", "_n", "_t")


def all_points(points: Sequence[tuple[str, Column]]) -> Column:
    """The points of an audit that fail; none means passed."""
    return F.filter(F.array(*(F.when(~F.coalesce(test, F.lit(False)), name) for name, test in points)), lambda x: x.isNotNull())


# Beginnings of commit subjects and the sections they go to.
SECTIONS = {"feat": "Features", "fix": "Fixes", "docs": "Documentation", "perf": "Performance", "refactor": "Refactoring", "test": "Tests", "chore": "Chores"}


def changelog_section(subject: Column) -> Column:
    out = F.lit("Other")
    for prefix, name in SECTIONS.items():
        out = F.when(subject.rlike(rf"^{prefix}(\([^)]*\))?!?:"), name).otherwise(out)
    return out
