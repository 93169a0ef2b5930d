"""Joins, aggregates, windows, orders and records on the tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import dom, urls
from paperloom.operators import audits, blocks, highlights, notes, pages, records, routing, tables, transcripts, usage
from paperloom.operators.routing import Property, Template
from paperloom.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
AT = datetime(2025, 1, 15, 12, tzinfo=UTC)


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


# routing -------------------------------------------------------------------------

TEMPLATES = [
    Template("lamp", triggers=["https://paperlantern.test/"]),
    Template("deep", triggers=["https://clipfield.test/p/", "https://clipfield.test/"]),
    Template("hex", triggers=["/\\.example/p/[0-9a-f]+$/"]),
    Template("all", triggers=["https://", "http://"]),
]
_CASE = "CASE WHEN starts_with(url, 'https://paperlantern.test/') THEN 0 WHEN starts_with(url, 'https://clipfield.test/') THEN 1 WHEN regexp_matches(url, '\\.example/p/[0-9a-f]+$') THEN 2 WHEN starts_with(url, 'https://') OR starts_with(url, 'http://') THEN 3 END"


@query(f"SELECT page_id, {_CASE} AS template_idx FROM reader_pages")
def route_first_match(spark, d):
    return table(spark, d, "reader_pages").select("page_id", routing.first_match(TEMPLATES, F.col("url")).alias("template_idx"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://clipfield.test/p/') OR starts_with(url, 'https://clipfield.test/') THEN 1 WHEN starts_with(url, 'https://paperlantern.test/') THEN 0 WHEN starts_with(url, 'https://') OR starts_with(url, 'http://') THEN 3 WHEN regexp_matches(url, '\\.example/p/[0-9a-f]+$') THEN 2 END AS template_idx FROM reader_pages")
def route_longest_prefix(spark, d):
    return table(spark, d, "reader_pages").select("page_id", routing.longest_match(TEMPLATES, F.col("url")).alias("template_idx"))


def _triggers(spark):
    return spark.createDataFrame([(i, j, t) for i, x in enumerate(TEMPLATES) for j, t in enumerate(x.triggers)], "template_idx int, trigger_idx int, pattern string")


@query(f"SELECT page_id, {_CASE} AS template_idx FROM reader_pages WHERE {_CASE} IS NOT NULL")
def route_table(spark, d):
    return routing.routed(table(spark, d, "reader_pages"), _triggers(spark)).select("page_id", "template_idx")


@query("SELECT event_id, CASE WHEN json_extract_string(props, '$.k')::INT % 2 = 0 THEN 0 WHEN event_type = 'click' THEN 1 END AS template_idx FROM events")
def route_schema(spark, d):
    t = [Template("even", triggers=["schema:@Even.k"]), Template("click", triggers=["schema:@Odd.type=click"])]
    k = F.get_json_object("props", "$.k")
    schema = F.to_json(F.array(F.struct(F.when(k.cast("int") % 2 == 0, "Even").otherwise("Odd").alias("@type"), k.alias("k"), F.col("event_type").alias("type"))))
    return table(spark, d, "events").select("event_id", routing.first_match(t, F.col("event_id").cast("string"), schema).alias("template_idx"))


@query("SELECT page_id, CASE WHEN regexp_matches(site, '\\.test$') THEN 'test' WHEN regexp_matches(url, '/p/[0-9a-f]+') THEN 'paged' END AS kind FROM reader_pages")
def classify_url(spark, d):
    return table(spark, d, "reader_pages").select("page_id", urls.kind(F.col("url"), {"test": (r"\.test$", ""), "paged": ("", "^/p/[0-9a-f]+")}).alias("kind"))


@query("SELECT page_id, regexp_matches(url, '^https?:') AS is_clippable FROM reader_pages")
def clippable(spark, d):
    return table(spark, d, "reader_pages").select("page_id", urls.is_clippable(F.col("url")).alias("is_clippable"))


# notes ---------------------------------------------------------------------------


@query("SELECT page_id, array_to_string(list_slice(string_split(site, '.'), -2, -1), '.') AS domain FROM reader_pages")
def domain_of_url(spark, d):
    return table(spark, d, "reader_pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("SELECT page_id, regexp_replace(regexp_replace(url, '[?&](utm_source|ref)=[^&#]*', '', 'g'), '#.*$', '') AS url FROM reader_pages")
def normalize_url(spark, d):
    return table(spark, d, "reader_pages").select("page_id", urls.normalized(F.col("url")).alias("url"))


@query("SELECT page_id, trim(coalesce(title, '')) AS title, CASE WHEN author IS NULL THEN '' ELSE trim(author) END AS author, trim(string_split(coalesce(published, ''), ',')[1]) AS published, coalesce(word_count::VARCHAR, '0') AS words FROM reader_pages")
def preset_variables(spark, d):
    v = notes.variables({"title": F.col("title"), "author": F.col("author"), "published": F.col("published"), "url": F.col("url")}, AT, F.col("word_count"))
    return table(spark, d, "reader_pages").select("page_id", *(v[k].col.alias(k) for k in ("title", "author", "published", "words")))


_TYPES = "VALUES ('wiki','text'),('podcast','multitext'),('tags','list')"


@query(f"SELECT page_id, coalesce(t.type, CASE WHEN word_count > 300 THEN 'number' END, 'text') AS type FROM reader_pages LEFT JOIN ({_TYPES}) t(name, type) ON t.name = extractor_type")
def prop_type_join(spark, d):
    types = spark.createDataFrame([("wiki", "text"), ("podcast", "multitext"), ("tags", "list")], "name string, type string")
    p = table(spark, d, "reader_pages").select("page_id", F.col("extractor_type").alias("name"), F.when(F.col("word_count") > 300, "number").alias("type"))
    return tables.typed(p, types).select("page_id", "type")


@query(
    "SELECT page_id, '---' || chr(10) || 'title: \"' || replace(title, '\"', '\\\"') || '\"' || chr(10) || 'words:' || CASE WHEN word_count IS NULL THEN '' ELSE ' ' || word_count END || chr(10) || "
    "'\"my tags\":' || chr(10) || '  - \"a\"' || chr(10) || '  - \"' || site || '\"' || chr(10) || 'clipped: false' || chr(10) || '---' || chr(10) AS frontmatter FROM reader_pages"
)
def frontmatter(spark, d):
    v = [("title", F.col("title"), "text"), ("words", F.coalesce(F.col("word_count").cast("string"), F.lit("")), "number"), ("my tags", F.concat(F.lit("a, "), F.col("site")), "multitext"), ("clipped", F.lit("no"), "checkbox")]
    return table(spark, d, "reader_pages").select("page_id", notes.frontmatter(v).alias("frontmatter"))


@query("SELECT page_id, substr(regexp_replace(regexp_replace(regexp_replace(title, '[#|\\^\\[\\]<>:\"/\\\\?*\\x00-\\x1F]', '', 'g'), '[\\s.]+$', ''), '^\\.', '_'), 1, 245) || chr(10) || '---' || chr(10) || 'site: \"' || site || '\"' || chr(10) || '---' || chr(10) || '# ' || trim(title) AS note FROM reader_pages")
def clip_note(spark, d):
    t = Template("t", "{{title}}", "# {{title}}", [Property("site", "{{site}}")])
    out = notes.clip(table(spark, d, "reader_pages"), t, {k: F.col(k) for k in ("title", "site", "url")}, AT)
    return out.select("page_id", F.concat_ws("\n", "note_name", "full_content").alias("note"))


@query("SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN b.c WHEN b.p IS NULL THEN a.c ELSE a.c || chr(10) || b.c END AS content FROM (SELECT p_name AS p, min(p_type) AS c FROM part WHERE p_size < 30 GROUP BY 1) a FULL JOIN (SELECT p_name AS p, max(p_brand) AS c FROM part WHERE p_size > 20 GROUP BY 1) b ON a.p = b.p")
def write_behaviours(spark, d):
    p = table(spark, d, "part")
    old = p.where("p_size < 30").groupBy(F.col("p_name").alias("path")).agg(F.min("p_type").alias("content"))
    new = p.where("p_size > 20").groupBy(F.col("p_name").alias("path")).agg(F.max("p_brand").alias("content")).withColumn("behavior", F.lit("append-specific"))
    return notes.written(old, new)


@query()
def write_address(spark, d):
    return table(spark, d, "nation").select("n_nationkey", notes.write_address("note://", "create", F.lit("in/"), F.col("n_name"), F.lit("x")).alias("address"))


# use -----------------------------------------------------------------------------

_SPINE = "SELECT s.period::DATE AS period, coalesce(n, 0) AS n_events, (SELECT count(*) FROM events) AS total_count FROM (SELECT unnest(generate_series({lo}, {hi}, INTERVAL {step})) AS period) s LEFT JOIN (SELECT {p} AS period, count(*) AS n FROM events GROUP BY 1) c ON c.period = s.period::DATE"
_P = {"day": "ts::DATE", "week": "(ts::DATE - dayofweek(ts)::INT)", "month": "date_trunc('month', ts)::DATE"}
_SQL = {u: _SPINE.format(lo=f"(SELECT min({p})::TIMESTAMP FROM events)", hi=f"(SELECT max({p})::TIMESTAMP FROM events)", step={"day": "1 DAY", "week": "7 DAY", "month": "1 MONTH"}[u], p=p) for u, p in _P.items()}


@query(_SQL["day"])
def usage_daily(spark, d):
    return usage.counts(table(spark, d, "events"), "ts", "day")


@query(_SQL["week"])
def usage_weekly_sunday(spark, d):
    return usage.counts(table(spark, d, "events"), "ts", "week")


@query(_SQL["month"])
def usage_monthly(spark, d):
    return usage.counts(table(spark, d, "events"), "ts", "month")


@query(_SPINE.format(lo="(SELECT max(ts)::DATE - 29 FROM events)::TIMESTAMP", hi="(SELECT max(ts)::DATE FROM events)::TIMESTAMP", step="1 DAY", p="ts::DATE"))
def usage_recent_days(spark, d):
    return usage.counts(table(spark, d, "events"), "ts", "day", everything=False)


@query("SELECT event_type AS action, count(*) AS n_events FROM events GROUP BY 1")
def action_counts(spark, d):
    return usage.actions(table(spark, d, "events"), "event_type")


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def top_recent(spark, d):
    return usage.latest(table(spark, d, "events"), "ts", "event_id").select("event_id", "ts")


@query("SELECT doc_id, ceil(length(text) / 3.0)::BIGINT AS n FROM documents")
def token_count(spark, d):
    return table(spark, d, "documents").select("doc_id", usage.token_estimate(F.col("text")).alias("n"))


@query("SELECT doc_id, (len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]')) + len(regexp_extract_all(text, '[A-Za-z0-9]+')))::BIGINT AS n FROM documents")
def word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", usage.words_counted(F.col("text")).alias("n"))


@query("SELECT page_id, CASE WHEN parse_ms < 1000 THEN floor(parse_ms + 0.5)::BIGINT::VARCHAR || 'ms' ELSE format('{:.2f}s', parse_ms / 1000) END AS t FROM reader_pages")
def duration_text(spark, d):
    return table(spark, d, "reader_pages").select("page_id", usage.duration_text(F.col("parse_ms")).alias("t"))


# highlights ----------------------------------------------------------------------


def _marks(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), (F.col("l_partkey") % 40).alias("start_offset"), (F.col("l_partkey") % 40 + F.col("l_quantity").cast("int") % 7).alias("end_offset"))


_MARKS = "SELECT l_orderkey AS page, l_linenumber AS line, l_partkey % 40 AS s, l_partkey % 40 + trunc(l_quantity)::INT % 7 AS e FROM lineitem"


@query(
    f"WITH m AS ({_MARKS}), b AS (SELECT *, max(e) OVER (PARTITION BY page ORDER BY s, e, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m), "
    "i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY s, e, line ROWS UNBOUNDED PRECEDING) AS g FROM b) "
    "SELECT page, min(s) AS start_offset, max(e) AS end_offset, count(*) AS n_marks FROM i GROUP BY page, g"
)
def highlight_merge(spark, d):
    return highlights.merged(_marks(spark, d), ["page"], order=["line"])


@query(f"WITH m AS ({_MARKS}) SELECT x.page, x.line AS a, y.line AS b FROM m x JOIN m y ON x.page = y.page AND x.line < y.line AND x.s <= y.e AND y.s <= x.e")
def highlight_overlaps(spark, d):
    return highlights.overlaps(_marks(spark, d), ["page"], "line", width=8)


def _noted(spark, d):
    c = table(spark, d, "clip_results").dropDuplicates(["clip_id"])
    pages = table(spark, d, "reader_pages").select("page_id", "url", "title")
    j = c.select("clip_id", "page_id", "note_name").join(pages, "page_id")
    return j.select("url", "title", F.concat((F.col("clip_id") * 7 % 100003).cast("string"), F.lit("_tx_1")).alias("id"), F.when(F.col("clip_id") % 3 == 0, F.col("page_id").cast("string")).alias("group_id"), F.col("note_name").alias("content"), F.when(F.col("clip_id") % 2 == 0, F.array("note_name")).alias("notes"))


_NOTED = "(SELECT url, title, (c.clip_id * 7 % 100003)::VARCHAR || '_tx_1' AS id, CASE WHEN c.clip_id % 3 = 0 THEN page_id::VARCHAR END AS group_id, note_name AS content, CASE WHEN c.clip_id % 2 = 0 THEN [note_name] END AS notes FROM (SELECT DISTINCT ON (clip_id) clip_id, page_id, note_name FROM clip_results) c JOIN reader_pages USING (page_id))"
_STAMP = "regexp_extract(id, '^\\s*(\\d+)', 1)::BIGINT"
_NORM = "regexp_replace(regexp_replace(url, '[?&](utm_source|ref)=[^&#]*', '', 'g'), '#.*$', '')"


@query(f"SELECT url, coalesce(group_id, id) AS g, (array_agg(id ORDER BY {_STAMP}, id, content))[1] AS id, string_agg(content, chr(10) || chr(10) ORDER BY {_STAMP}, id, content) AS content, count(*) AS n_marks FROM {_NOTED} GROUP BY 1, 2")
def highlight_collapse(spark, d):
    m = _noted(spark, d)
    out = highlights.collapsed(m.withColumn("_g", F.coalesce("group_id", "id")))
    g = m.select("url", "id", F.coalesce("group_id", "id").alias("g")).distinct()
    return out.join(g, ["url", "id"]).select("url", "g", "id", "content", "n_marks")


@query(f"SELECT {_NORM} AS page, count(*) AS n_marks, max({_STAMP}) AS newest FROM {_NOTED} GROUP BY 1")
def highlight_pages(spark, d):
    return highlights.pages(_noted(spark, d)).select("page", "n_marks", "newest")


@query(f"WITH p AS (SELECT {_NORM} AS page, count(*) AS n, max({_STAMP}) AS newest, min({_STAMP}) AS oldest FROM {_NOTED} GROUP BY 1) SELECT array_to_string(list_slice(string_split(regexp_extract(page, '//([^/?]+)', 1), '.'), -2, -1), '.') AS domain, count(*) AS n_pages, sum(n)::BIGINT AS n_marks, max(newest) AS newest, min(oldest) AS oldest FROM p GROUP BY 1")
def domain_rollup(spark, d):
    return highlights.domains(_noted(spark, d))


@query(f"SELECT id, url FROM {_NOTED} WHERE contains(lower(content), 'queue') OR contains(lower(url), 'queue') OR contains(lower(title), 'queue')")
def highlight_search(spark, d):
    return highlights.searched(_noted(spark, d), "Queue").select("id", "url")


@query(f"SELECT url, '[' || string_agg('{{\"id\":\"' || id || '\",\"content\":' || to_json(content)::VARCHAR || '}}', ',' ORDER BY {_STAMP}, id, content) || ']' AS highlights FROM {_NOTED} GROUP BY url")
def highlight_export(spark, d):
    return highlights.exported(_noted(spark, d))


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 30")
def undo_stack(spark, d):
    return highlights.undo_stack(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


# recordings ----------------------------------------------------------------------


def _lines(spark, d):
    """A row for each line of an order."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("l_quantity"))


def _cues(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("rec"), F.col("l_linenumber").alias("cue"), F.col("l_quantity").cast("double").alias("from"))


def _chapters(spark, d):
    o = table(spark, d, "orders")
    first = o.select(F.col("o_orderkey").alias("rec"), F.lit("a").alias("chapter"), F.lit(5.0).alias("chapter_from"), F.lit(20.0).alias("to"))
    second = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("rec"), F.lit("b").alias("chapter"), F.lit(15.0).alias("chapter_from"), F.lit(None).cast("double").alias("to"))
    return first.unionByName(second)


_CH = "(SELECT o_orderkey AS rec, 'a' AS chapter, 5.0 AS f, 20.0 AS t FROM orders UNION ALL SELECT o_orderkey, 'b', 15.0, NULL FROM orders WHERE o_orderkey % 2 = 0)"


@query(f"SELECT l_orderkey AS rec, l_linenumber AS cue, chapter FROM lineitem JOIN {_CH} c ON c.rec = l_orderkey AND l_quantity >= f AND (t IS NULL OR l_quantity < t)")
def cue_chapter_join(spark, d):
    return transcripts.in_chapters(_cues(spark, d), _chapters(spark, d), "rec", width=10.0).select("rec", "cue", "chapter")


@query(f"SELECT l_orderkey AS rec, l_linenumber AS cue FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM {_CH} c WHERE c.rec = l_orderkey AND l_quantity >= f AND (t IS NULL OR l_quantity < t))")
def cue_leftovers(spark, d):
    cues = _cues(spark, d)
    return transcripts.in_none(cues, transcripts.in_chapters(cues, _chapters(spark, d), "rec", width=10.0), ["rec", "cue", "from"]).select("rec", "cue")


_SAID = "'- `00:' || lpad(l_quantity::INT::VARCHAR, 2, '0') || '` ' || l_linenumber::VARCHAR"


@query(
    f"WITH m AS (SELECT rec, l_linenumber AS n, {_SAID} AS c, chapter FROM lineitem JOIN {_CH} c ON c.rec = l_orderkey AND l_quantity >= f AND (t IS NULL OR l_quantity < t)), "
    f"r AS (SELECT l_orderkey AS rec, l_linenumber AS n, {_SAID} AS c, NULL AS chapter FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM {_CH} c WHERE c.rec = l_orderkey AND l_quantity >= f AND (t IS NULL OR l_quantity < t))), "
    "g AS (SELECT rec, chapter, min(n) AS a, string_agg(c, chr(10) ORDER BY n, c) AS b FROM (SELECT * FROM m UNION ALL SELECT * FROM r) GROUP BY 1, 2), k AS (SELECT *, count(*) OVER (PARTITION BY rec) AS many FROM g) "
    "SELECT rec, string_agg(CASE WHEN chapter IS NOT NULL THEN '### ' || chapter || chr(10) || chr(10) WHEN many > 1 THEN '### 其他片段' || chr(10) || chr(10) ELSE '' END || b, chr(10) || chr(10) ORDER BY chapter IS NULL, a, chapter) AS markdown FROM k GROUP BY rec"
)
def transcript_markdown(spark, d):
    cues = _cues(spark, d).withColumn("said", F.col("cue").cast("string"))
    inside = transcripts.in_chapters(cues, _chapters(spark, d), "rec", width=10.0).select("rec", "cue", "from", "said", "chapter")
    outside = transcripts.in_none(cues, inside, ["rec", "cue", "from"]).withColumn("chapter", F.lit(None).cast("string")).select(inside.columns)
    return transcripts.as_markdown(inside.unionByName(outside), "rec", "chapter", "cue", "said", "from")


@query()
def transcript_segments(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(transcripts.segments(F.col("text"))).alias("place", "sentence"))


@query()
def best_subtitle(spark, d):
    e = table(spark, d, "events").select("user_id", F.when(F.col("event_type") == "view", "en").otherwise("fr").alias("lan"), F.col("event_id").alias("place"))
    return transcripts.best_track(e, "user_id")


@query("WITH a AS (SELECT l_orderkey, l_linenumber AS i, CASE WHEN l_linenumber % 3 = 1 THEN l_quantity END AS v FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)), b AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER w AS ax, last_value(v IGNORE NULLS) OVER w AS ay, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER u AS bx, first_value(v IGNORE NULLS) OVER u AS by_ FROM a WINDOW w AS (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY l_orderkey ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT l_orderkey, i, coalesce(v, ay + (i - ax)::DOUBLE / nullif(bx - ax, 0) * (by_ - ay)) AS filled FROM b")
def interpolate_anchors(spark, d):
    li = _lines(spark, d).select("l_orderkey", F.col("l_linenumber").alias("i"), F.when(F.col("l_linenumber") % 3 == 1, F.col("l_quantity")).alias("v"))
    return transcripts.interpolated(li, "l_orderkey", "i", "v").select("l_orderkey", "i", "filled")


# tables --------------------------------------------------------------------------


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_unused(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    o = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("name"))
    return tables.unused(c, o).select(F.col("name").cast("long").alias("c_custkey"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_subset(spark, d):
    ids = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(ids, "o_custkey", "left_semi").select("o_orderkey")


@query("WITH p AS (SELECT r_name || 'X' AS name, n_name AS k, n_nationkey AS p, levenshtein(lower(r_name || 'X'), lower(n_name)) AS d FROM region, nation), b AS (SELECT name, (array_agg({'d': d, 'p': p, 'k': k} ORDER BY d, p))[1] AS x FROM p GROUP BY 1) SELECT name, x.k AS nearest, x.d AS distance FROM b WHERE x.d < greatest(length(name), length(x.k)) / 2.0")
def nearest_name(spark, d):
    known = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("place"))
    return tables.nearest(table(spark, d, "region").select(F.concat("r_name", F.lit("X")).alias("name")), known)


@query("SELECT coalesce(a.n, b.n) AS name, CASE WHEN coalesce(a.n, b.n) = 'tags' THEN 'multitext' ELSE coalesce(b.t, a.t) END AS type FROM (SELECT DISTINCT p_name AS n, 'text' AS t FROM part UNION ALL SELECT 'tags', 'text') a FULL JOIN (SELECT DISTINCT p_brand AS n, 'number' AS t FROM part UNION ALL SELECT 'tags', 'date') b ON a.n = b.n")
def upsert_types(spark, d):
    p = table(spark, d, "part")
    rows = lambda c, t, tag: p.select(F.col(c).alias("name")).distinct().withColumn("type", F.lit(t)).unionByName(spark.createDataFrame([("tags", tag)], "name string, type string"))
    return tables.upserted(rows("p_name", "text", "text"), rows("p_brand", "number", "date"))


@query("SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || ' ' || r END AS unique_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def unique_names(spark, d):
    return tables.unique_names(table(spark, d, "part"), "p_name", ["p_partkey"]).select("p_partkey", "unique_name")


@query("WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, 'prompt_' || row_number() OVER (PARTITION BY user_id ORDER BY f, event_type) AS key FROM f")
def prompt_keys(spark, d):
    return tables.numbered_prompts(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT n_nationkey, coalesce(r_name, '') AS response FROM nation LEFT JOIN region ON r_regionkey = n_nationkey")
def prompt_responses(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"), F.col("r_name").alias("response"))
    return tables.answered(table(spark, d, "nation").select("n_nationkey"), r, ["n_nationkey"])


@query("SELECT o_orderkey, coalesce(c_name, '匿名#' || o_custkey) AS user_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey")
def comment_users(spark, d):
    users = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"))
    return tables.named_users(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("user_id")), users).select("o_orderkey", "user_name")


@query("SELECT name, side FROM (SELECT n_name AS name, 'left' AS side FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_name, 'right' FROM nation WHERE n_nationkey > 9)")
def locale_keys(spark, d):
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return tables.differing_keys(n.where("n_nationkey < 10"), n.where("n_nationkey >= 5"), "name")


@query("SELECT event_id, props AS json FROM events")
def repair_json(spark, d):
    broken = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", tables.repaired_json(broken).alias("json"))


# audits --------------------------------------------------------------------------

_STATUS = "CASE l_linenumber % 4 WHEN 0 THEN 'na' WHEN 1 THEN 'pass' WHEN 2 THEN 'unknown' ELSE 'fail' END"
_STATUS2 = "CASE trunc(l_quantity)::INT % 4 WHEN 0 THEN 'na' WHEN 1 THEN 'pass' WHEN 2 THEN 'unknown' ELSE 'fail' END"
_WORST = "['na','pass','unknown','fail'][max(list_position(['na','pass','unknown','fail'], {}))]"


def _slices(spark, d):
    s = lambda c: F.get(F.array(*map(F.lit, audits.STATUSES)), c)
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("url"), s(F.col("l_linenumber") % 4).alias("heading"), s(F.col("l_quantity").cast("int") % 4).alias("table"), F.lit(1).cast("long").alias("extent"))


@query(f"SELECT l_orderkey AS url, {_WORST.format(_STATUS)} AS heading, {_WORST.format(_STATUS2)} AS \"table\", count(*) AS n_slices, count(*) AS extent FROM lineitem GROUP BY 1")
def audit_lattice(spark, d):
    return audits.worst(_slices(spark, d), "url", ["heading", "table"], "extent")


@query(f"WITH w AS (SELECT greatest(max(list_position(['na','pass','unknown','fail'], {_STATUS})), max(list_position(['na','pass','unknown','fail'], {_STATUS2}))) AS r FROM lineitem GROUP BY l_orderkey) SELECT ['na','pass','unknown','fail'][r] AS overall, count(*) AS n_pages FROM w GROUP BY 1")
def audit_badge(spark, d):
    return audits.badge(audits.worst(_slices(spark, d), "url", ["heading", "table"]), ["heading", "table"])


_LONG = "(SELECT 'p_name' AS field, p_name AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part)"


@query(f"SELECT * FROM (SELECT field, value, count(*) AS n, row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, value) AS place FROM {_LONG} WHERE value <> '' GROUP BY 1, 2) WHERE place <= 5")
def field_profile_top5(spark, d):
    return audits.profile(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query(f"SELECT field, count(*) AS n_filled, count(DISTINCT value) AS n_distinct FROM {_LONG} WHERE value <> '' GROUP BY 1")
def field_completeness(spark, d):
    return audits.completeness(table(spark, d, "part"), ["p_name", "p_brand", "p_type"])


@query("SELECT value, n, list(p_partkey ORDER BY p_partkey) AS samples FROM (SELECT p_type AS value, p_partkey, count(*) OVER (PARTITION BY p_type) AS n, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS r FROM part) WHERE r <= 5 GROUP BY 1, 2 ORDER BY n DESC, value LIMIT 50")
def value_patterns(spark, d):
    return audits.patterns(table(spark, d, "part"), "p_type", "p_partkey")


@query("SELECT p_partkey AS id, field, same FROM (SELECT p_partkey, 'price' AS field, abs(p_retailprice - (p_retailprice + p_partkey % 2)) < 0.01 AS same FROM part UNION ALL SELECT p_partkey, 'brand', p_partkey % 3 <> 0 FROM part)")
def dual_path_audit(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    b = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + F.col("p_partkey") % 2).alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("?").alias("brand"))
    return audits.compared(a, b, "id", ["price", "brand"]).select("id", "field", "same")


@query("SELECT field, count(*) AS n_records, count(*) FILTER (same) AS n_same FROM (SELECT 'price' AS field, p_partkey % 2 = 0 AS same FROM part UNION ALL SELECT 'brand', p_partkey % 3 <> 0 FROM part) GROUP BY 1")
def dual_path_agreement(spark, d):
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"))
    b = p.select(F.col("p_partkey").alias("id"), (F.col("p_retailprice") + F.col("p_partkey") % 2).alias("price"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("?").alias("brand"))
    return audits.agreement(audits.compared(a, b, "id", ["price", "brand"]))


@query("SELECT event_type, event_id, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r FROM events) WHERE r <= 20")
def mismatch_examples(spark, d):
    return audits.examples(table(spark, d, "events"), "event_type", ["value", "event_id"]).select("event_type", "event_id", "place")


@query("SELECT count(*) FILTER (o_orderstatus = 'F') AS n_pass, count(*) FILTER (o_orderstatus = 'O') AS n_fail, count(*) FILTER (o_orderstatus = 'P') AS n_error FROM orders")
def batch_stats(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(s == "F").alias("n_pass"), F.count_if(s == "O").alias("n_fail"), F.count_if(s == "P").alias("n_error"))


@query()
def block_coverage(spark, d):
    pages = table(spark, d, "reader_pages").select("page_id", dom.marked(F.col("reader_html"), "data-b").alias("blocks"))
    clips = table(spark, d, "clip_results").dropDuplicates(["clip_id"]).select("page_id", "clip_id", "markdown")
    return audits.covered(pages, clips, "page_id", "blocks", "markdown").select("clip_id", "n_blocks", "n_covered")


@query("SELECT p_partkey, list_filter([CASE WHEN NOT p_size > 10 THEN 'size' END, CASE WHEN NOT p_retailprice > 1000 THEN 'price' END], lambda x: x IS NOT NULL) AS failed FROM part")
def audit_points(spark, d):
    return table(spark, d, "part").select("p_partkey", audits.all_points([("size", F.col("p_size") > 10), ("price", F.col("p_retailprice") > 1000)]).alias("failed"))


@query("SELECT CASE WHEN n_nationkey % 3 = 0 THEN 'Features' WHEN n_nationkey % 3 = 1 THEN 'Fixes' ELSE 'Other' END AS section, count(*) AS n FROM nation GROUP BY 1")
def changelog_sections(spark, d):
    s = F.concat(F.when(F.col("n_nationkey") % 3 == 0, "feat(x): ").when(F.col("n_nationkey") % 3 == 1, "fix: ").otherwise(""), F.col("n_name"))
    return table(spark, d, "nation").groupBy(audits.changelog_section(s).alias("section")).agg(F.count("*").alias("n"))


# blocks --------------------------------------------------------------------------

_LEVEL = "CASE WHEN l_linenumber = 1 THEN 1 WHEN trunc(l_quantity)::INT % 3 = 0 THEN 2 WHEN trunc(l_quantity)::INT % 3 = 1 THEN 4 ELSE 9 END"


def _headings(spark, d):
    q = F.col("l_quantity").cast("int") % 3
    return _lines(spark, d).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.when(F.col("l_linenumber") == 1, 1).when(q == 0, 2).when(q == 1, 4).otherwise(9).alias("level"))


@query(f"WITH h AS (SELECT l_orderkey AS doc, l_linenumber AS place, {_LEVEL} AS level FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)), s AS (SELECT *, sum((level = 2)::INT) OVER (PARTITION BY doc ORDER BY place ROWS UNBOUNDED PRECEDING) AS s, sum((level = 1)::INT) OVER (PARTITION BY doc ORDER BY place ROWS UNBOUNDED PRECEDING) AS n1 FROM h) SELECT doc, place, CASE WHEN level = 1 THEN n1 WHEN level = 4 THEN sum((level = 4)::INT) OVER (PARTITION BY doc, s ORDER BY place ROWS UNBOUNDED PRECEDING) END::BIGINT AS heading_number FROM s")
def heading_numbering(spark, d):
    return blocks.numbered_headings(_headings(spark, d), "doc", "place", "level").select("doc", "place", "heading_number")


@query(f"SELECT l_orderkey AS doc, l_linenumber AS place, least(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY {_LEVEL}) + 3, 8) AS compact_level FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)")
def heading_levels(spark, d):
    return blocks.compacted_levels(_headings(spark, d), "doc", "level").select("doc", "place", "compact_level")


@query("WITH b AS (SELECT l_orderkey AS doc, l_linenumber AS place, CASE trunc(l_quantity)::INT % 3 WHEN 0 THEN 13 WHEN 1 THEN 12 ELSE 2 END AS kind FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2)), s AS (SELECT *, CASE WHEN kind IN (12, 13) AND coalesce(lag(kind) OVER (PARTITION BY doc ORDER BY place), -1) <> kind THEN 1 ELSE 0 END AS o FROM b), g AS (SELECT *, CASE WHEN kind IN (12, 13) THEN sum(o) OVER (PARTITION BY doc ORDER BY place ROWS UNBOUNDED PRECEDING) END AS list_group FROM s) SELECT doc, place, list_group::BIGINT AS list_group, CASE WHEN kind = 13 THEN row_number() OVER (PARTITION BY doc, list_group ORDER BY place) END AS list_number FROM g")
def list_grouping(spark, d):
    q = F.col("l_quantity").cast("int") % 3
    b = _lines(spark, d).select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("place"), F.when(q == 0, 13).when(q == 1, 12).otherwise(2).alias("kind"))
    return blocks.list_groups(b, "doc", "place", "kind").select("doc", "place", "list_group", "list_number")


@query("SELECT block_no, max(coalesce(array_to_string(list_transform(elements, lambda e: coalesce(e.elem_text, '')), ''), '')) AS text FROM feishu_blocks GROUP BY 1")
def block_text(spark, d):
    return table(spark, d, "feishu_blocks").groupBy("block_no").agg(F.max(blocks.plain_text(F.col("elements"))).alias("text"))


@query("WITH RECURSIVE b AS (SELECT DISTINCT doc_token, block_id, parent_id FROM feishu_blocks), w AS (SELECT doc_token, block_id, 0 AS depth FROM b WHERE NOT EXISTS (SELECT 1 FROM b p WHERE p.doc_token = b.doc_token AND p.block_id = b.parent_id) UNION ALL SELECT b.doc_token, b.block_id, w.depth + 1 FROM b JOIN w ON b.doc_token = w.doc_token AND b.parent_id = w.block_id) SELECT * FROM w")
def block_walk(spark, d):
    return blocks.walked(table(spark, d, "feishu_blocks")).select("doc_token", "block_id", "depth")


@query()
def block_markdown(spark, d):
    b = table(spark, d, "feishu_blocks").dropDuplicates(["block_no"])
    walk = blocks.walked(b).select("block_id", "path")
    line = blocks.as_line(F.col("block_type"), blocks.run_text(F.col("elements")))
    return blocks.as_markdown(b.join(walk, "block_id").withColumn("line", line).where("line <> ''"), "doc_token", "path", "line")


@query("SELECT doc_token, count(*) AS n_comments FROM (SELECT DISTINCT ON (comment_id) * FROM feishu_comments) GROUP BY 1")
def comment_callouts(spark, d):
    return blocks.comment_callouts(table(spark, d, "feishu_comments").dropDuplicates(["comment_id"])).select("doc_token", "n_comments")


@query()
def comment_callout_text(spark, d):
    return blocks.comment_callouts(table(spark, d, "feishu_comments").dropDuplicates(["comment_id"]))


# records -------------------------------------------------------------------------


@query("SELECT lot_id, total_price FROM (SELECT DISTINCT ON (lot_id) lot_id, coalesce(prices.start_price, 0) + coalesce(prices.deposit, 0) AS total_price FROM cbex_lots)")
def total_price(spark, d):
    p = F.col("prices")
    return table(spark, d, "cbex_lots").dropDuplicates(["lot_id"]).select("lot_id", records.total_price(p["start_price"], [p["deposit"]]).alias("total_price"))


@query("SELECT p_partkey, p_partkey % 7 + 3 AS n, p_partkey % 5 AS points, p_size * 10 + 200 AS amount FROM part")
def fines_summed(spark, d):
    text = F.concat(F.lit("目前可查违章记录：京内"), (F.col("p_partkey") % 7).cast("string"), F.lit(" 起，"), (F.col("p_partkey") % 5).cast("string"), F.lit("分， "), (F.col("p_size") * 10).cast("string"), F.lit("元；京外1起，200元；另2起；"))
    return table(spark, d, "part").select("p_partkey", records.fines(text).alias("f")).select("p_partkey", "f.n", "f.points", "f.amount")


@query("SELECT p_partkey, (p_size * 10 + 20 + 7)::DOUBLE AS fees, 2 AS n FROM part")
def fees_with_total(spark, d):
    far = F.lit("，由买受人自行承担。" + "其他事项以现场展示为准，" * 20)
    text = F.concat(F.lit("维修费"), (F.col("p_size") * 10).cast("string"), F.lit("元，停车费20元，共计约"), (F.col("p_size") * 10 + 20).cast("string"), F.lit(" 元（其中5元汇入另一账户）"), far, F.lit("拖车费7元"))
    return table(spark, d, "part").select("p_partkey", records.fee_total(text).alias("fees"), F.size(records.fee_amounts(text)).alias("n"))


@query(
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '国六' WHEN 1 THEN '国五' WHEN 2 THEN '国四' WHEN 3 THEN '国三' WHEN 4 THEN '国六' ELSE '其他 ' || p_brand END AS standard, "
    "CASE p_partkey % 3 WHEN 0 THEN '是' WHEN 1 THEN '否' ELSE '未知' END AS mortgage, CASE p_partkey % 2 WHEN 0 THEN '2018-03-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') ELSE '' END AS day FROM part"
)
def normalisers(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 6 == 0, " 国VI").when(k % 6 == 1, "国（Ⅴ）").when(k % 6 == 2, "国4").when(k % 6 == 3, "国三及以上").when(k % 6 == 4, "国Ⅵ").otherwise(F.concat(F.lit("其他 "), "p_brand"))
    said = F.when(k % 3 == 0, "3、是否抵押：已 抵押（如有）").when(k % 3 == 1, "抵押: 无 ；").otherwise("无此项")
    day = F.when(k % 2 == 0, F.concat(F.lit("2018年3月"), (F.col("p_size") % 28 + 1).cast("string"), F.lit(" 日"))).otherwise("不详")
    return table(spark, d, "part").select("p_partkey", records.emission_standard(text).alias("standard"), records.mortgage_in(said).alias("mortgage"), records.normal_day(day).alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def dates_in_text(spark, d):
    return table(spark, d, "orders").select("o_orderkey", records.plain_date(F.concat(F.lit("登记于"), F.date_format("o_orderdate", "yyyy年M月d日"))).alias("day"))


@query("SELECT p_partkey, p_brand AS value FROM part")
def label_values(spark, d):
    paras = F.array(F.col("p_name"), F.concat(F.lit("品牌："), F.col("p_brand"), F.lit("，其他")))
    return table(spark, d, "part").select("p_partkey", records.labelled(paras, "品牌").alias("value"))


@query("SELECT n_nationkey, '| 项目 | 内容 |' || chr(10) || '| - | - |' || chr(10) || '| name | ' || n_name || ' |' AS info FROM nation")
def key_information(spark, d):
    return table(spark, d, "nation").select("n_nationkey", records.key_information([("name", F.col("n_name")), ("none", F.lit(None))]).alias("info"))


@query("SELECT DISTINCT unnest(regexp_extract_all(full_html, 'href=\"/p/([0-9a-f]+)\"', 1)) AS id FROM reader_pages")
def list_ids(spark, d):
    return records.list_items(table(spark, d, "reader_pages"), "full_html", r'href="/p/([0-9a-f]+)"')


@query("SELECT lot_id, CASE WHEN any_value(bid_count) > 0 THEN 'bids' ELSE 'none' END AS kind FROM cbex_lots GROUP BY 1")
def lot_bids(spark, d):
    return table(spark, d, "cbex_lots").dropDuplicates(["lot_id"]).select("lot_id", F.when(F.col("bid_count") > 0, "bids").otherwise("none").alias("kind"))


@query("SELECT episode_id, count(*) AS n_comments, sum(greatest(total_reply_count, 0))::BIGINT AS n_replies FROM (SELECT DISTINCT ON (comment_id) comment_id, episode_id, total_reply_count FROM podcast_comments) GROUP BY 1")
def episode_comments(spark, d):
    c = table(spark, d, "podcast_comments").dropDuplicates(["comment_id"])
    return c.groupBy("episode_id").agg(F.count("*").alias("n_comments"), F.sum(F.greatest("total_reply_count", F.lit(0))).alias("n_replies"))


# pages ---------------------------------------------------------------------------


@query("SELECT page_id, replace(replace(replace(regexp_extract(full_html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title, regexp_extract(full_html, '<html lang=\"([a-z-]+)\"', 1) AS language FROM reader_pages WHERE full_html IS NOT NULL")
def page_facts(spark, d):
    p = table(spark, d, "reader_pages").where("full_html is not null")
    return p.select("page_id", pages.facts(F.col("full_html"), F.col("url")).alias("f")).select("page_id", "f.title", "f.language")


@query()
def page_notes(spark, d):
    """Pages to notes, from markup to front matter and Markdown."""
    p = table(spark, d, "reader_pages").where("full_html is not null").withColumn("f", pages.facts(F.col("full_html"), F.col("url")))
    f = {k: F.col(f"f.{v}") for k, v in {"title": "title", "author": "author", "content": "content", "description": "description", "published": "published", "language": "language", "site": "site"}.items()}
    t = Template("page", "{{title}}", "# {{title}}\n\n{{content}}", [Property("source", "{{url}}"), Property("words", "{{words}}", "number"), Property("lang", "{{language|upper}}")])
    return notes.clip(p, t, f | {"url": F.col("url")}, AT, words=F.col("f.words")).select("page_id", "note_name", "full_content")


@query()
def page_cleaned(spark, d):
    return table(spark, d, "reader_pages").where("full_html is not null").select("page_id", pages.cleaned(F.col("full_html"), F.col("url")).alias("html"))


@query("SELECT page_id, CASE WHEN trim(author) <> '' THEN author WHEN trim(description) <> '' THEN description ELSE '' END AS first FROM reader_pages")
def first_filled(spark, d):
    return table(spark, d, "reader_pages").select("page_id", pages.first_filled(F.col("author"), F.col("description")).alias("first"))


@query("SELECT n_nationkey, '> [!note] ' || n_name || ' [^1]' AS markdown FROM nation")
def markdown_tidied(spark, d):
    return table(spark, d, "nation").select("n_nationkey", pages.tidied(F.concat(F.lit("> \\[!note\\] "), F.col("n_name"), F.lit(" \\[^1\\]"))).alias("markdown"))


@query("SELECT n_nationkey, 'a ==' || n_name || '== b' AS marked FROM nation")
def highlights_inline(spark, d):
    return table(spark, d, "nation").select("n_nationkey", pages.marked(F.concat(F.lit("a "), F.col("n_name"), F.lit(" b")), F.array("n_name")).alias("marked"))


@query("SELECT event_id, min(event_id) OVER (PARTITION BY user_id)::VARCHAR || '_tx_' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS id, CASE WHEN count(*) OVER (PARTITION BY user_id) > 1 THEN 'g' || min(event_id) OVER (PARTITION BY user_id) END AS group_id FROM events")
def selection_pieces(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("selection_id"), F.col("event_id").alias("place"), F.col("event_id").alias("epoch_ms"))
    return pages.pieces(e).select("event_id", "id", "group_id")


@query()
def expected_units(spark, d):
    return pages.expected_units(table(spark, d, "feishu_blocks").dropDuplicates(["block_no"]))


@query("SELECT n_nationkey, 'see [https://x.test/' || n_nationkey || '](https://x.test/' || n_nationkey || ') there' AS text FROM nation")
def autolink(spark, d):
    return table(spark, d, "nation").select("n_nationkey", pages.autolinked(F.concat(F.lit("see https://x.test/"), F.col("n_nationkey"), F.lit(" there"))).alias("text"))


@query("SELECT n_nationkey, strftime(to_timestamp(1700000000 + n_nationkey * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M') AS published FROM nation")
def article_published(spark, d):
    return table(spark, d, "nation").select("n_nationkey", pages.published(F.concat(F.lit('<script>var ct = "'), (F.col("n_nationkey") * 86400 + 1700000000).cast("string"), F.lit('";</script>'))).alias("published"))


@query()
def nested_comments(spark, d):
    c = table(spark, d, "podcast_comments").dropDuplicates(["comment_id"])
    top = c.select("episode_id", F.col("comment_id").alias("id"), F.lit(None).cast("long").alias("parent"), F.col("comment_id").alias("place"), F.col("user_name").alias("author"), F.col("body").alias("text"))
    r = c.select("episode_id", "comment_id", F.posexplode("reply_previews").alias("i", "r"))
    replies = r.select("episode_id", (F.col("comment_id") * 10 + F.col("i")).alias("id"), F.col("comment_id").alias("parent"), F.col("i").cast("long").alias("place"), F.col("r.user_name").alias("author"), F.col("r.reply_text").alias("text"))
    return pages.nested_comments(top.unionByName(replies), "episode_id", "id", "parent", "place", "author", "text")


@query("SELECT n_nationkey, 'x #' || n_name || ' [t](https://x.test/) y' AS text FROM nation")
def inline_entities(spark, d):
    text = F.concat(F.lit('x <e type="hashtag" hid="1" title="%23'), F.col("n_name"), F.lit('" /> <e type="web" href="https%3A%2F%2Fx.test%2F" title="t" /> y'))
    return table(spark, d, "nation").select("n_nationkey", pages.inline_links(text).alias("text"))


@query("SELECT n_nationkey, n_name AS name, 'Show' AS show, 3723 AS seconds, '2024-05-06' AS day, n_nationkey AS episode FROM nation")
def podcast_record(spark, d):
    s = F.concat(F.lit('{"@type":"PodcastEpisode","name":"Vol. '), F.col("n_nationkey"), F.lit(' x","partOfSeries":{"name":"Show"},"timeRequired":"PT1H2M3S","datePublished":"2024-05-06T01:02:03Z"}'))
    out = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("name"), records.podcast(s).alias("r"))
    return out.select("n_nationkey", "name", "r.show", "r.seconds", "r.day", "r.episode")


@query()
def fee_labels(spark, d):
    text = F.concat(F.lit("停车费"), F.col("p_size").cast("string"), F.lit("元，"), F.when(F.col("p_partkey") % 2 == 0, "拖车费10元").otherwise("保管费5元"))
    return records.fee_labels(table(spark, d, "part").select(text.alias("t")), "t")


@query("SELECT episode_id, comment_id FROM (SELECT DISTINCT ON (comment_id) comment_id, episode_id FROM podcast_comments) WHERE comment_id < 5000010000 ORDER BY comment_id DESC LIMIT 100")
def keyset_page(spark, d):
    from paperloom.sources.readers import keyset_page

    c = table(spark, d, "podcast_comments").select("episode_id", "comment_id").distinct()
    return keyset_page(c, 5000010000, "comment_id", 100)


@query("SELECT clip_id, nullif(regexp_extract(regexp_extract(markdown, '^---\\n([\\s\\S]*?)\\n---', 1), '(?m)^source: *\"?([^\"\\n]*)\"?$', 1), '') AS source FROM (SELECT DISTINCT ON (clip_id) * FROM clip_results)")
def front_matter_read(spark, d):
    from paperloom.sources.readers import front_matter

    c = table(spark, d, "clip_results").dropDuplicates(["clip_id"])
    return front_matter(c).select("clip_id", F.nullif(F.try_element_at("front", F.lit("source")), F.lit("")).alias("source"))


@query("SELECT n_nationkey, n_name || ',\"a,\"\"b\"\"\"' AS line FROM nation")
def csv_lines(spark, d):
    from paperloom.sources.sinks import csv_line

    return table(spark, d, "nation").select("n_nationkey", csv_line([F.col("n_name"), F.lit('a,"b"')]).alias("line"))


@query("SELECT n_nationkey, placeholder FROM (SELECT n_nationkey, n_nationkey % 2 = 0 AS placeholder FROM nation)")
def placeholder_images(spark, d):
    src = F.when(F.col("n_nationkey") % 2 == 0, "https://x.test/img/blank.gif?v=1").otherwise("https://x.test/img/a.gif")
    return table(spark, d, "nation").select("n_nationkey", urls.placeholder_image(src).alias("placeholder"))


@query("SELECT n_nationkey, 'https://x.test/a/img.png' AS a, 'https://x.test/img.png' AS b, 'https://y.test/i' AS c FROM nation")
def absolute_urls(spark, d):
    base = F.lit("https://x.test/a/page?q=1")
    return table(spark, d, "nation").select("n_nationkey", urls.absolute(F.lit("img.png"), base).alias("a"), urls.absolute(F.lit("/img.png"), base).alias("b"), urls.absolute(F.lit("//y.test/i"), base).alias("c"))


@query("SELECT event_id, coalesce(value, 0.5) AS value, 'x' AS theme FROM events")
def settings_defaults(spark, d):
    from paperloom.sources.readers import settings

    return settings(table(spark, d, "events").select("event_id", "value"), {"value": 0.5, "theme": "x"})


@query("SELECT ts::DATE AS period, count(*) AS n_events FROM events GROUP BY 1")
def stream_daily(spark, d):
    """The daily view kept up to date by a stream, over all there is."""
    return _streamed(spark, d, lambda e: _views().daily(e, "ts", "40 days"), "complete")


@query()
def stream_sessions(spark, d):
    return _streamed(spark, d, lambda e: _views().sessions(e, "user_id", "ts"), "complete")


@query()
def stream_played(spark, d):
    """Seconds played per user: clicks start, views stop."""
    def view(e):
        t = e.select("user_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
        return _views().played(t, "user_id", "ts", "action", "click", "view")

    return _streamed(spark, d, view, "update")


def _views():
    from paperloom.streaming import views

    return views


def _streamed(spark, d, view, mode: str):
    """A view of the events as a stream of files, run to its end."""
    import uuid

    from paperloom.session import shared_dir

    schema = table(spark, d, "events").schema
    stream = view(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d))
    place = f"{shared_dir(spark)}/paperloom/stream-{uuid.uuid4().hex}"
    out = f"{place}/out"

    def keep(batch: DataFrame, i: int) -> None:
        # a batch run again after a failure writes the same folder again
        batch.write.mode("overwrite").parquet(f"{out}/batch={i:09d}" if mode == "update" else out)

    q = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.parquet(out)
    if mode != "update":
        return rows
    key, *values = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(key).agg(*(F.max_by(c, "batch").alias(c) for c in values))
