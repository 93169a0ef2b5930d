"""Pages, templates, notes, reports and settings from files."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEMPLATE = (
    "id string, name string, behavior string, noteNameFormat string, path string, noteContentFormat string, "
    "properties array<struct<id string, name string, value string, type string>>, triggers array<string>, vault string, context string"
)
SLICE = "url string, slice string, grid_range array<int>, status string, checklist map<string,string>, diffs array<struct<grid string, location string, category string, severity string, `desc` string>>, notes string"


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, html``: each file whole."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("html"))


def html_text(spark: SparkSession, url: str, html: str) -> DataFrame:
    """A page at hand, as from standard input."""
    return spark.createDataFrame([(url, html)], "url string, html string")


def templates(spark: SparkSession, path: str) -> DataFrame:
    """Templates of a file or folder; those without a name or content are left out."""
    df = spark.read.schema(TEMPLATE).json(path, multiLine=True, pathGlobFilter="*.json")
    return df.where("name is not null and noteContentFormat is not null").withColumn("file", F.input_file_name())


def as_template(row) -> object:
    """A row of :func:`templates` as the value the compiler takes."""
    from paperloom.operators.routing import Property, Template

    props = [Property(p.name, p.value or "", p.type) for p in row.properties or []]
    return Template(row.name, row.noteNameFormat or "{{title}}", row.noteContentFormat or "", props, row.triggers or [], row.behavior or "create", row.path or "")


def property_types(spark: SparkSession, path: str) -> DataFrame:
    """``name, type`` of a JSON object of names and types."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "type"))


def settings(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Settings with what is missing from ``defaults``."""
    return df.withColumns({k: F.coalesce(F.col(k), F.lit(v)) if k in df.columns else F.lit(v) for k, v in defaults.items()})


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """``id, markdown`` of a folder of notes, the file's name being the id."""
    df = spark.read.text(path, wholetext=True, pathGlobFilter="*.md")
    return df.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("id"), F.col("value").alias("markdown"))


def front_matter(df: DataFrame, markdown: str = "markdown") -> DataFrame:
    """``df`` with ``front`` (a map) and ``body``; lists of tags become one value."""
    front = F.regexp_extract(F.col(markdown), r"^---\r?\n([\s\S]*?)\r?\n---(?:\r?\n|$)", 1)
    lines = F.filter(F.split(front, r"\r?\n(?!\s)"), lambda x: x.contains(":"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(x, r"^[^:]+:[ \t]*", ""), r"\n\s+-\s*", ", ")), "^[\"'](.*)[\"']$|^, ", "$1")
    entries = F.transform(lines, lambda x: F.struct(F.regexp_replace(F.regexp_extract(x, r"^([^:]+):", 1), "^[\"'](.*)[\"']$", "$1").alias("key"), value(x).alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["key"] == e["key"]))
    return df.withColumns({"front": F.map_from_entries(last), "body": F.regexp_replace(F.col(markdown), r"^---\r?\n[\s\S]*?\r?\n---(?:\r?\n|$)\s*", "")})


def slices(spark: SparkSession, path: str) -> DataFrame:
    """Reports of slices, however deep; a file without what a report needs fails the read."""
    return spark.read.schema(SLICE).json(path, multiLine=True, mode="FAILFAST", recursiveFileLookup=True, pathGlobFilter="slice-*.json").where(
        F.when(F.col("url").isNull() | F.col("checklist").isNull(), F.raise_error(F.lit("a slice without url or checklist"))).otherwise(F.lit(True))
    )


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted, with doubled quotes; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    return df.withColumnsRenamed({c: c.lstrip("\ufeff") for c in df.columns})


def keyset_page(df: DataFrame, cursor, order: str, size: int) -> DataFrame:
    """The next page before a cursor, newest first."""
    return (df if cursor is None else df.where(F.col(order) < F.lit(cursor))).orderBy(F.col(order).desc()).limit(size)
