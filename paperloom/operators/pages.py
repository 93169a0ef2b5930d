"""Pages read whole: their facts, cleaned markup, Markdown brought in order, marks put into text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import dom

FACTS = "title author description favicon image published site language words content content_html schemas metas".split()


def _facts(html: str, url: str | None) -> tuple:
    raw = html
    root = dom.with_images(dom.parse(html))
    metas = [{"name": e.attributes.get("name"), "property": e.attributes.get("property"), "content": e.attributes.get("content")} for e in root.descendants() if e.tag == "meta" and "content" in e.attributes]
    by = {(m["property"] or m["name"] or "").lower(): m["content"] or "" for m in reversed(metas)}
    first = lambda css, attribute=None: next(iter(dom.extract(root, css, attribute)), "")
    some = lambda *values: next((v.strip() for v in values if v and v.strip()), "")
    schemas = []
    for e in root.descendants():
        if e.tag == "script" and e.attributes.get("type", "").lower() == "application/ld+json":
            try:
                data = json.loads(e.text())
                schemas += data if isinstance(data, list) else [data]
            except ValueError:
                continue
    graph = [x for s in schemas if isinstance(s, dict) for x in (s.get("@graph") if isinstance(s.get("@graph"), list) else [s]) if isinstance(x, dict)]
    schema = lambda k: next((str(s[k]) for s in graph if isinstance(s.get(k), str | int)), "")
    writer = next((a.get("name", "") if isinstance(a, dict) else a for s in graph for a in ([s["author"]] if isinstance(s.get("author"), dict | str) else s.get("author") or [])), "")
    base = url or ""
    absolute = lambda a: dom.absolute(a, base) if a and base else a
    body = dom.main_content(root)
    for e in [e for e in body.descendants() if e.tag in dom.ASIDE]:
        e.detach()
    inner = body.inner_html()
    text = body.text()
    words = len(re.findall(r"[一-鿿]|[^\W_一-鿿]+", text))
    lang = re.search(r"<html[^>]*\blang\s*=\s*[\"']?([\w-]+)", raw, re.I)
    return (
        some(by.get("og:title"), first("title"), schema("headline"), first("h1")), some(by.get("author"), by.get("article:author"), writer, first("[rel=author]"), first(".author")),
        some(by.get("description"), by.get("og:description"), schema("description")), absolute(first("link[rel~=icon]", "href")), absolute(some(by.get("og:image"), by.get("twitter:image"), schema("image"))),
        some(by.get("article:published_time"), schema("datePublished"), first("time", "datetime")), some(by.get("og:site_name"), by.get("application-name")), some(lang[1] if lang else "", by.get("og:locale")),
        words, dom.markdown(inner, base or None), inner, json.dumps(schemas, ensure_ascii=False) if schemas else None, metas,
    )


def facts(html: Column, url: Column) -> Column:
    """What a page says of itself and its main content, from one parse."""

    @F.pandas_udf(_struct())
    def each(pages: pd.Series, urls: pd.Series) -> pd.DataFrame:
        rows = [_facts(p, u if isinstance(u, str) else None) if isinstance(p, str) else (None,) * len(FACTS) for p, u in zip(pages, urls)]
        return pd.DataFrame(rows, columns=FACTS).astype({"words": "Int64"})

    return each(html, url)


def _struct():
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    s = StringType()
    kinds = {"words": LongType(), "metas": ArrayType(StructType([StructField(n, s) for n in ("name", "property", "content")]))}
    return StructType([StructField(n, kinds.get(n, s)) for n in FACTS])


def first_filled(*columns: Column) -> Column:
    """The first value that isn't empty."""
    return F.coalesce(*(F.when(F.trim(c) != "", c) for c in columns), F.lit(""))


def cleaned(html: Column, base: Column) -> Column:
    """Without scripts, styles and style attributes, addresses absolute, late images in place."""

    @F.pandas_udf("string")
    def each(pages: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([dom.cleaned(p, b if isinstance(b, str) else None) if isinstance(p, str) else None for p, b in zip(pages, bases)], dtype=object)

    return each(html, base)


# Markdown in order ------------------------------------------------------------------

_AUDIO = r"(?m)^!\[[^\]]*\]\((https?://[^)\s]+\.(?:m4a|mp3|wav|ogg|webm|flac|3gp|opus|oga))\)$"


def _fences(text: str) -> str:
    """Back quotes in fenced code unescaped, the fence made longer than any run in it."""

    def one(m: re.Match) -> str:
        if "\\`" not in m[2]:
            return m[0]
        body = m[2].replace("\\`", "`")
        longest = max(map(len, re.findall("`+", body)), default=0)
        fence = "`" * max(3, longest + 1)
        return f"{fence}{m[1]}\n{body}\n{fence}"

    return re.sub(r"^```([A-Za-z0-9_-]*)\n([\s\S]*?)\n```$", one, text, flags=re.M)


def _ordered(text: str) -> str:
    """Items of numbered lists that go on counting but slipped a level in, back at their level."""
    lines, last, fenced = text.split("\n"), None, False
    for i, line in enumerate(lines):
        if re.match(r"\s*```", line):
            fenced, last = not fenced, None
        elif not fenced:
            m = re.match(r"(\t*)(\d+)\.\s", line)
            if m:
                depth, n = len(m[1]), int(m[2])
                if last and n == last[1] + 1 and depth > last[0]:
                    lines[i], depth = "\t" * last[0] + line[depth:], last[0]
                last = (depth, n)
            elif line.strip():
                last = None
    return "\n".join(lines)


def tidied(markdown: Column) -> Column:
    """Callouts and footnotes unescaped, fences and numbered lists mended, audio as players."""
    s = F.regexp_replace(markdown, r"\\\[!(\w+)\\\]", "[!$1]")
    s = F.regexp_replace(s, r"\\\[\^(\d+)\\\]", "[^$1]")

    @F.pandas_udf("string")
    def each(values: pd.Series) -> pd.Series:
        return pd.Series([_ordered(_fences(v)) if isinstance(v, str) else None for v in values], dtype=object)

    return F.regexp_replace(each(s), _AUDIO, '<audio controls src="$1"></audio>')


def marked(content: Column, marks: Column, behavior: str = "highlight-inline") -> Column:
    """Marked passages (an array of text) put into a text: in place of it, or between ``==``, longest first; or not at all."""
    if behavior == "no-highlights":
        return content
    if behavior == "replace-content":
        return F.when(F.size(marks) > 0, F.array_join(marks, "")).otherwise(content)
    longest = F.array_sort(F.filter(marks, lambda m: m != ""), lambda a, b: F.length(b) - F.length(a))
    return F.aggregate(longest, content, lambda text, m: F.when(F.contains(text, F.concat(F.lit("=="), m)), text).otherwise(F.replace(text, m, F.concat(F.lit("=="), m, F.lit("==")))))


def pieces(selections: DataFrame, by: str = "selection_id", at: str = "epoch_ms") -> DataFrame:
    """Pieces of a selection over several blocks: an identifier each, one group for all where there are several."""
    from pyspark.sql import Window

    w = Window.partitionBy(by)
    i = F.row_number().over(w.orderBy("place")) - 1
    n = F.count("*").over(w)
    stamp = F.min(at).over(w).cast("string")
    return selections.withColumns({"id": F.concat(stamp, F.lit("_tx_"), i.cast("string")), "group_id": F.when(n > 1, F.concat(F.lit("g"), stamp))})


def expected_units(blocks: DataFrame) -> DataFrame:
    """What a note of a document must hold: a unit for each block with text, each link, each bold run."""
    text = F.array_join(F.transform(F.coalesce("elements", F.array()), lambda e: F.coalesce(e["elem_text"], F.lit(""))), "")
    whole = F.filter(F.array(F.struct(F.lit("text").alias("kind"), text.alias("value"))), lambda u: F.trim(u["value"]) != "")
    some = lambda test, kind, value: F.transform(F.filter(F.coalesce("elements", F.array()), test), lambda e: F.struct(F.lit(kind).alias("kind"), value(e).alias("value")))
    links = some(lambda e: e["link_url"].isNotNull(), "link", lambda e: e["link_url"])
    bold = some(lambda e: F.coalesce(e["bold"], F.lit(False)) & (F.coalesce(e["elem_text"], F.lit("")) != ""), "bold", lambda e: e["elem_text"])
    return blocks.select("doc_token", "block_no", F.explode(F.concat(whole, links, bold)).alias("u")).select("doc_token", "block_no", "u.kind", "u.value")


def inline_links(text: Column) -> Column:
    """Text with entity links as Markdown: hashtags, mentions and addresses kept readable."""
    s = F.regexp_replace(text, r'<e type="hashtag"[^>]*title="([^"]*)"[^>]*/?>', "$1")
    s = F.regexp_replace(s, r'<e type="mention"[^>]*title="([^"]*)"[^>]*/?>', "$1")
    s = F.regexp_replace(s, r'<e type="web"[^>]*href="([^"]*)"[^>]*title="([^"]*)"[^>]*/?>', "[$2]($1)")
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def autolinked(text: Column) -> Column:
    """Bare addresses as links."""
    return F.regexp_replace(text, r"(?<![\(\[<\"=])(https?://[^\s<>\)\]，。；]+)", "[$1]($1)")


def published(html: Column) -> Column:
    """The day an article says it was published: in a time element, else the seconds its script carries."""
    shown = F.nullif(F.regexp_extract(html, r'(?i)id="publish_time"[^>]*>\s*([0-9: -]{8,})', 1), F.lit(""))
    unix = F.regexp_extract(html, r'\bct\s*=\s*"(\d{9,10})"', 1).try_cast("bigint")
    return F.coalesce(F.trim(shown), F.date_format(F.timestamp_seconds(unix), "yyyy-MM-dd HH:mm"))


def nested_comments(rows: DataFrame, doc: str, key: str, parent: str, order: str, author: str, text: str) -> DataFrame:
    """Comments and their replies as one text per document: replies quoted under what they answer."""
    r = rows.select(F.col(doc), F.coalesce(F.col(parent), F.col(key)).alias("_top"), F.col(parent).isNotNull().cast("int").alias("_r"), F.col(order).alias("_o"), F.col(key).alias("_k"), F.concat(F.lit("**"), F.coalesce(F.col(author), F.lit("匿名")), F.lit("**: "), F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    line = F.when(F.col("_r") == 1, F.concat(F.lit("> "), F.replace("_t", F.lit("\n"), F.lit("\n> ")))).otherwise(F.col("_t"))
    thread = r.groupBy(doc, "_top").agg(F.array_sort(F.collect_list(F.struct("_r", "_o", "_k", line.alias("t")))).alias("_l"))
    body = F.array_join(F.transform("_l", lambda x: x["t"]), "\n")
    g = thread.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.get("_l", 0)["_o"].alias("o"), F.col("_top").alias("k"), body.alias("b")))).alias("_g"))
    return g.select(doc, F.array_join(F.transform("_g", lambda x: x["b"]), "\n\n").alias("markdown"))
