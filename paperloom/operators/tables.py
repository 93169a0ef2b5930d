"""Tables matched with tables: upserts, names that are nearest, names made unique, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def typed(properties: DataFrame, types: DataFrame, name: str = "name") -> DataFrame:
    """Properties with their type: the table's, else their own, else text."""
    t = types.groupBy(name).agg(F.max("type").alias("_t"))
    return properties.join(t, name, "left").withColumn("type", F.coalesce("_t", "type", F.lit("text"))).drop("_t")


def upserted(old: DataFrame, new: DataFrame, key: str = "name", value: str = "type") -> DataFrame:
    """New values over old ones; ``tags`` are always multitext."""
    both = old.select(key, F.col(value).alias("_o")).join(new.select(key, F.col(value).alias("_n")), key, "full")
    return both.select(key, F.when(F.col(key) == "tags", "multitext").otherwise(F.coalesce("_n", "_o")).alias(value))


def unused(types: DataFrame, used: DataFrame, name: str = "name") -> DataFrame:
    """Types no template uses; ``tags`` stay."""
    return types.join(used.select(name).distinct(), name, "left_anti").where(F.col(name) != "tags")


def nearest(unknown: DataFrame, known: DataFrame, name: str = "name", place: str = "place", most: int = 10_000) -> DataFrame:
    """``<name>, nearest, distance``: the known name with the fewest edits, the
    first of equals, if they are less than half of the longer. ``known`` is a
    vocabulary of at most ``most`` names: it is broadcast after it is counted."""
    if known.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} known names")
    k = known.select(F.col(name).alias("_k"), F.col(place).alias("_p"))
    pairs = unknown.select(name).distinct().join(F.broadcast(k), F.length("_k") >= 0)
    d = F.levenshtein(F.lower(F.col(name)), F.lower(F.col("_k")))
    best = pairs.groupBy(name).agg(F.min(F.struct(d.alias("d"), F.col("_p").alias("p"), F.col("_k").alias("k"))).alias("_b"))
    return best.where(F.col("_b.d") < F.greatest(F.length(name), F.length("_b.k")) / 2).select(name, F.col("_b.k").alias("nearest"), F.col("_b.d").cast("long").alias("distance"))


def unique_names(df: DataFrame, name: str, order: list[str], style: str = " {}") -> DataFrame:
    """Names that occur again get a number: ``name 2``, or ``name (1)``."""
    w = Window.partitionBy(name).orderBy(*order)
    n = F.row_number().over(w)
    number = F.replace(F.lit(style), F.lit("{}"), (n if "(" not in style else n - 1).cast("string"))
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(F.col(name), number)))


def numbered_prompts(prompts: DataFrame, by: str, prompt: str, place: str) -> DataFrame:
    """Different questions of a template in the order they first occur: ``prompt_1``, ..."""
    first = prompts.groupBy(by, prompt).agg(F.min(place).alias("_f"))
    w = Window.partitionBy(by).orderBy("_f", prompt)
    return first.select(by, prompt, F.concat(F.lit("prompt_"), F.row_number().over(w).cast("string")).alias("key"))


def answered(prompts: DataFrame, responses: DataFrame, key: list[str]) -> DataFrame:
    """Questions with their answers, empty where there is none."""
    r = responses.groupBy(*key).agg(F.max("response").alias("response"))
    return prompts.join(r, key, "left").withColumn("response", F.coalesce("response", F.lit("")))


def differing_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of one side only, with the side."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, key, "left_anti").withColumn("side", F.lit("right")))


def named_users(comments: DataFrame, users: DataFrame, key: str = "user_id", name: str = "user_name") -> DataFrame:
    """Comments with the name of who wrote them, or ``匿名#id``."""
    u = users.groupBy(key).agg(F.max(name).alias("_u"))
    return comments.join(u, key, "left").withColumn(name, F.coalesce("_u", F.concat(F.lit("匿名#"), F.col(key).cast("string")))).drop("_u")


def repaired_json(text: Column) -> Column:
    """JSON that a model wrote: as it is, without a fence, from the first brace to the last, without commas before ends."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    cut = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(cut, r",\s*([}\]])", "$1")
    quoted = F.regexp_replace(mended, r"([{,]\s*)([A-Za-z_]\w*)\s*:", '$1"$2":')
    good = lambda s: F.when(F.try_parse_json(s).isNotNull() & s.rlike(r"^\s*[\[{]"), s)
    return F.coalesce(good(text), good(bare), good(cut), good(mended), good(quoted))
