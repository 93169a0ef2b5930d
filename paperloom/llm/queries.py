"""The queries: operators applied to the whole tables."""

from __future__ import annotations

import secrets
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import mixing, packing, pii, quality, residue, tokens, unify, wrappers
from paperloom.session import settle, table


def block_text() -> F.Column:
    """The text of a block: its runs joined in order; null where it has no runs."""
    return F.when(F.col("elements").isNotNull(), F.array_join(F.transform("elements", lambda e: e["elem_text"]), "", ""))


def _texts(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, bool]]:
    comments = table(spark, sf_dir, "podcast_comments").select(F.lit("podcast_comments").alias("src_table"), F.col("comment_id").alias("rec_id"), F.col("body").alias("text"))
    blocks = table(spark, sf_dir, "feishu_blocks").select(F.lit("feishu_blocks").alias("src_table"), F.col("block_no").alias("rec_id"), block_text().alias("text"))
    pages = table(spark, sf_dir, "reader_pages").select(F.lit("reader_pages").alias("src_table"), F.col("page_id").alias("rec_id"), F.col("reader_html").alias("text"))
    return [(comments.unionByName(blocks), False), (pages, True)]


def fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [
        df.withColumn("_d", unify.fingerprints(markup)("text")).select("src_table", "rec_id", F.col("_d.form").alias("form"), F.col("_d.raw").alias("raw"))
        for df, markup in _texts(spark, sf_dir)
    ]
    return reduce(DataFrame.unionByName, parts)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.look_alike_pairs(settle(fingerprinted(spark, sf_dir), "p2"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.look_alike_classes(settle(fingerprinted(spark, sf_dir), "p2"))


def p2_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [df.select("src_table", "rec_id", unify.unified(markup)("text").alias("text")) for df, markup in _texts(spark, sf_dir)]
    return reduce(DataFrame.unionByName, parts)



def _records(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """Pages and notes with their title and host."""
    pages = table(spark, sf_dir, "reader_pages")
    notes = table(spark, sf_dir, "clip_results")
    source = F.regexp_extract("markdown", r"(?m)^source: \"?https?://([^/\"\s]+)", 1)
    return [
        pages.select(F.lit("reader_pages").alias("src_table"), F.col("page_id").alias("rec_id"), F.lit("page").alias("kind"), F.col("site").alias("host"), "title", F.col("reader_html").alias("text")),
        notes.select(F.lit("clip_results").alias("src_table"), F.col("clip_id").alias("rec_id"), F.lit("note").alias("kind"), source.alias("host"), F.col("note_name").alias("title"), F.col("markdown").alias("text")),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _records(spark, sf_dir)
    return residue.cases(reduce(DataFrame.unionByName, records), residue.learn(records))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records with real content, with their texts."""
    records = _records(spark, sf_dir)
    return residue.kept(reduce(DataFrame.unionByName, records), residue.learn(records))


def p3_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of the classifier with the weak labels on unseen hosts."""
    found = residue.validate(_records(spark, sf_dir))
    return spark.createDataFrame(sorted(found.items()), "measure string, value double")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_body(table(spark, sf_dir, "reader_pages"), residue.learn(_records(spark, sf_dir)))


def p5_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wrapper of each host, as a union-free regular expression."""
    read = settle(wrappers.read_pages(table(spark, sf_dir, "reader_pages"), residue.fit([], [])), "pages")
    return wrappers.expressions(read)


#: The key of the pseudonyms. Where it is unset a key is drawn for the process: values stay
#: linked within it, and nobody can turn pseudonyms back or link them with those of another.
KEY_SETTING = "spark.paperloom.pii.key"
_DRAWN = secrets.token_bytes(32)


def _comment_texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Each text of a comment with its slot: body, user, reply_0, reply_1, ..."""
    entry = lambda slot, text: F.struct(slot.alias("slot"), text.alias("text"))
    replies = F.transform(F.coalesce("reply_previews", F.array()), lambda r, i: entry(F.concat(F.lit("reply_"), i.cast("string")), r["reply_text"]))
    slots = F.concat(F.array(entry(F.lit("body"), F.col("body")), entry(F.lit("user"), F.col("user_name"))), replies)
    rows = table(spark, sf_dir, "podcast_comments").select("comment_id", *more, F.explode(slots).alias("s"))
    return rows.select("comment_id", *more, "s.slot", "s.text").where("text is not null and text <> ''")


def _replaced(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    names = pii.learn_names(table(spark, sf_dir, "podcast_comments").select("user_name"), table(spark, sf_dir, "name_parts"))
    named = spark.conf.get(KEY_SETTING, None)
    key = named.encode() if named else _DRAWN
    return pii.replace(_comment_texts(spark, sf_dir, *more), names, key)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = _replaced(spark, sf_dir).where(F.size("kinds") > 0)
    return kinds.select("comment_id", "slot", F.explode("kinds").alias("pii_kind")).distinct()


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all delivered comments with placeholders. Each is cleaned where it is read."""
    return _replaced(spark, sf_dir, "loaded_at").select("comment_id", "slot", "loaded_at", "clean", "kinds")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "common_words"))
    return kinds.where(~F.col("text_kind").isin("prose", "empty")).select("doc_id")


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics of each document."""
    rows = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"), table(spark, sf_dir, "common_words"))
    return rows.drop("text")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text or piece of one with its container of each kind."""
    sized = tokens.counted(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return packing.packed(sized, table(spark, sf_dir, "container_sizes"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    return packing.filled(p6_packed(spark, sf_dir), table(spark, sf_dir, "container_sizes"))


def p7_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the mixture, a row for each time one is used."""
    sized = tokens.counted(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.mixed(sized, table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares reached."""
    return mixing.shares(p7_mixture(spark, sf_dir), table(spark, sf_dir, "mix_targets"))
