"""Documents kept as blocks: runs styled, headings numbered, trees walked, notes written."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Types of blocks.
PAGE, TEXT, HEADINGS, BULLET, ORDERED, CODE, QUOTE, TODO, DIVIDER = 1, 2, range(3, 12), 12, 13, 14, 15, 17, 22


def run_text(elements: Column) -> Column:
    """The runs of a block as Markdown: bold, italic, links; equal styles side by side as one."""

    def one(e: Column) -> Column:
        t = F.coalesce(e["elem_text"], F.lit(""))
        t = F.when(F.coalesce(e["bold"], F.lit(False)) & (t != ""), F.concat(F.lit("**"), t, F.lit("**"))).otherwise(t)
        t = F.when(F.coalesce(e["italic"], F.lit(False)) & (t != ""), F.concat(F.lit("*"), t, F.lit("*"))).otherwise(t)
        return F.when(e["link_url"].isNotNull(), F.concat(F.lit("["), t, F.lit("]("), F.coalesce(F.try_url_decode(e["link_url"]), e["link_url"]), F.lit(")"))).otherwise(t)

    joined = F.array_join(F.transform(F.coalesce(elements, F.array()), one), "")
    return F.regexp_replace(joined, r"\*\*\*\*", "")


def plain_text(elements: Column) -> Column:
    return F.array_join(F.transform(F.coalesce(elements, F.array()), lambda e: F.coalesce(e["elem_text"], F.lit(""))), "")


def as_line(kind: Column, text: Column, number: Column | None = None) -> Column:
    """A block as a line of Markdown."""
    n = number.cast("string") if number is not None else F.lit("1")
    out = F.when(kind.between(3, 8), F.concat(F.repeat(F.lit("#"), kind - 2), F.lit(" "), text)).when(kind.between(9, 11), F.concat(F.lit("###### "), text))
    return (
        out.when(kind == BULLET, F.concat(F.lit("- "), text)).when(kind == ORDERED, F.concat(n, F.lit(". "), text)).when(kind == TODO, F.concat(F.lit("- [ ] "), text))
        .when(kind == CODE, F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(kind == QUOTE, F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))).when(kind == DIVIDER, "---").otherwise(text)
    )


def numbered_headings(blocks: DataFrame, by: str, place: str, level: str) -> DataFrame:
    """Headings of level 1 counted through the document, of level 4 anew after each of level 2."""
    w = Window.partitionBy(by).orderBy(place)
    section = F.sum(F.when(F.col(level) == 2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = blocks.withColumn("_s", section)
    n1 = F.sum(F.when(F.col(level) == 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    w4 = Window.partitionBy(by, "_s").orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    n4 = F.sum(F.when(F.col(level) == 4, 1).otherwise(0)).over(w4)
    return marked.withColumn("heading_number", F.when(F.col(level) == 1, n1).when(F.col(level) == 4, n4)).drop("_s")


def compacted_levels(headings: DataFrame, by: str, level: str, first: int = 4, last: int = 8) -> DataFrame:
    """Levels in use closed up: the highest becomes ``first``, none goes below ``last``."""
    w = Window.partitionBy(by).orderBy(level)
    return headings.withColumn("compact_level", F.least(F.dense_rank().over(w) + (first - 1), F.lit(last)))


def list_groups(blocks: DataFrame, by: str, place: str, kind: str) -> DataFrame:
    """List items side by side share a group; ordered ones are counted within it."""
    w = Window.partitionBy(by).orderBy(place)
    item = F.col(kind).isin(BULLET, ORDERED, TODO)
    starts = F.when(item & ~F.coalesce(F.lag(kind).over(w) == F.col(kind), F.lit(False)), 1).otherwise(0)
    g = blocks.withColumn("_s", starts).withColumn("list_group", F.when(item, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    n = F.row_number().over(Window.partitionBy(by, "list_group").orderBy(place))
    return g.withColumn("list_number", F.when(F.col(kind) == ORDERED, n)).drop("_s")


def walked(blocks: DataFrame, doc: str = "doc_token", key: str = "block_id", parent: str = "parent_id", place: str = "block_no") -> DataFrame:
    """Blocks with their ``depth`` and ``path`` from a root, the order of a walk
    depth first. A block whose parent isn't in the table is a root; a cycle's
    blocks have no path and are left out. Each round joins one level of all
    documents; rounds end when a level is empty."""
    from paperloom.session import settle

    b = settle(blocks.select(doc, key, parent, place).dropDuplicates([doc, key]), "blocks")
    step = lambda c: F.format_string("%020d", c)
    known = b.select(F.col(doc).alias("_d"), F.col(key).alias("_k"))
    level = b.join(known, (F.col(doc) == F.col("_d")) & (F.col(parent) == F.col("_k")), "left_anti").select(doc, key, place, F.lit(0).alias("depth"), F.array(step(F.col(place))).alias("path"))
    out = level = settle(level, "level")
    for d in count(1):
        up = level.select(doc, F.col(key).alias(parent), F.col("path").alias("_p"))
        level = settle(b.join(up, [doc, parent]).select(doc, key, place, F.lit(d).alias("depth"), F.concat("_p", F.array(step(F.col(place)))).alias("path")), "level")
        if level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def as_markdown(lines: DataFrame, doc: str, order: str, line: str) -> DataFrame:
    """Per document its lines in their order."""
    g = lines.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("_l"))
    return g.select(doc, F.array_join(F.transform("_l", lambda x: x["l"]), "\n\n").alias("markdown"), F.size("_l").cast("long").alias("n_blocks"))


def comment_callouts(comments: DataFrame, doc: str = "doc_token", key: str = "comment_id") -> DataFrame:
    """The comments on a document as folding callouts, solved ones marked, with
    their replies below; comments nobody wrote in have none."""
    nobody = "匿名"
    who = lambda r: F.coalesce(r["user_open_id"], F.lit(nobody))
    said = lambda r: F.when(F.coalesce(r["reply_text"], F.lit("")) != "", F.concat(F.lit("\n> "), F.replace(r["reply_text"], F.lit("\n"), F.lit("\n> ")))).otherwise("")
    head = F.concat(F.lit("> [!"), F.when(F.coalesce("is_solved", F.lit(False)), "success").otherwise("quote"), F.lit("]+ "))
    thread = F.transform("replies", lambda r, i: F.concat(F.when(i == 0, F.concat(head, who(r), F.lit(" · "), F.coalesce("create_time", F.lit("")))).otherwise(F.concat(F.lit(">\n> **"), who(r), F.lit("**"))), said(r)))
    one = F.when(F.size("replies") > 0, F.array_join(thread, "\n"))
    g = comments.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), one.alias("t")))).alias("_c"))
    threads = F.transform(F.filter("_c", lambda c: c["t"].isNotNull()), lambda c: c["t"])
    text = F.when(F.size(threads) > 0, F.concat(F.lit("---\n\n## 评论\n\n"), F.array_join(threads, "\n\n"))).otherwise("")
    return g.select(doc, text.alias("markdown"), F.size("_c").cast("long").alias("n_comments"))
