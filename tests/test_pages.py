"""Trees, selectors, notes, sources, sinks and streams on small inputs."""

from datetime import UTC, date, datetime

import pytest
from pyspark.sql import functions as F

from paperloom.functions import dom, urls
from paperloom.operators import audits, blocks, highlights, notes, pages, routing, tables, transcripts, usage
from paperloom.operators.routing import Property, Template
from paperloom.sources import readers, sinks
from paperloom.streaming import views

HTML = """<html lang="en"><head><title>T &amp; U</title><meta name="author" content="Me"><meta property="og:image" content="/i.png">
<script type="application/ld+json">{"@type":"Article","headline":"H","author":{"name":"W"},"tags":[{"n":1},{"n":2}]}</script><link rel="icon" href="f.ico"></head>
<body><nav>menu</nav><article><h1>T</h1><p>One <b>two<p>Three<ul><li>a<li>b<ul><li>c</ul></ul><table><tr><th>x<th>y<tr><td>1<td>2|3</table>
<pre><code class="language-py">x = 1</code></pre><blockquote>q<br>r</blockquote><img src="data:image/gif;x" data-src="/late.png" alt="A"></article><footer>f</footer></body></html>"""


def test_uneven_markup():
    root = dom.parse("<ul><li>a<li>b<ul><li>c</ul></ul><p>x<p>y<div>z")
    assert [e.tag for e in root.elements()] == ["ul", "p", "p", "div"]
    assert [e.text() for e in dom.select(root, "body > ul > li")] == ["a", "bc"] and [e.text() for e in dom.select(root, "ul > li")] == ["a", "bc", "c"]
    assert dom.extract(root, "p + p") == ["y"] and dom.extract(root, "p ~ div") == ["z"] and dom.extract(root, "li:not(:first-child)") == ["bc"]
    assert dom.extract(root, "p:hover") == [] and dom.extract(root, "::x") == [] and dom.extract(root, "li:nth-child(odd)") == ["a", "c"]


def test_markdown():
    got = dom.markdown(HTML, "https://x.test/p/q")
    assert got.startswith("menu\n\n# T\n\nOne **two**\n\nThree\n\n- a\n- b\n\t- c\n\n| x | y |\n| --- | --- |\n| 1 | 2\\|3 |\n\n```py\nx = 1\n```\n\n> q\n> r")


def test_facts(spark):
    df = spark.createDataFrame([(HTML, "https://x.test/p/q"), (None, None), ("", "u")], "html string, url string")
    a, b, c = [r.f for r in df.select(pages.facts(F.col("html"), F.col("url")).alias("f")).collect()]
    assert (a.title, a.author, a.language, a.image, a.favicon) == ("T & U", "Me", "en", "https://x.test/i.png", "https://x.test/p/f.ico")
    assert "menu" not in a.content and "![A](https://x.test/late.png)" in a.content and b.title is None and c.title == ""
    v = spark.createDataFrame([(a.schemas,), ("nope",), (None,)], "s string").select(notes.schema_variables("s").alias("v")).collect()
    assert v[0].v["schema:@Article:author.name"] == "W" and v[0].v["schema:@Article:tags[1].n"] == "2" and v[1].v == v[2].v == {}


def test_clip(spark):
    t = Template("t", "{{title|safe_name}}", "{{content}}\n", [Property("tags", "a, [[b,c]]", "multitext"), Property("n", "x 12.50", "number"), Property("on", "TRUE", "checkbox"), Property("day", "2024-03-05 10:00", "date"), Property("q 1", '{{title}} "q"'), Property("none", "")])
    df = spark.createDataFrame([("A: b?", "body", "https://u.test/")], "title string, content string, url string")
    r = notes.clip(df, t, {k: F.col(k) for k in df.columns}, datetime(2025, 1, 15, 12, tzinfo=UTC), {"on": "checkbox"}).collect()[0]
    assert r.note_name == "A b"
    assert r.full_content == '---\ntags:\n  - "a"\n  - "[[b,c]]"\nn: 12.5\n"on": true\nday: 2024-03-05\n"q 1": "A: b? \\"q\\""\nnone:\n---\nbody\n'
    assert notes.clip(df.limit(0), t, {"title": F.col("title")}, datetime(2025, 1, 1, tzinfo=UTC)).count() == 0


def test_meta_variables(spark):
    df = spark.createDataFrame([([("a", None, "1"), ("a", None, "2"), (None, "og:x", "3"), ("e", None, "")],), (None,)], "m array<struct<name string, property string, content string>>")
    got = [r.v for r in df.select(notes.meta_variables(F.col("m")).alias("v")).collect()]
    assert got == [{"meta:name:a": "2", "meta:property:og:x": "3"}, None]


def test_urls(spark):
    cases = {
        "https://www.a.co.uk/x?utm_source=f&q=1#h": ("a.co.uk", "https://www.a.co.uk/x?q=1"), "http://localhost:8/x": ("localhost", "http://localhost:8/x"), "http://10.0.0.1/": ("10.0.0.1", "http://10.0.0.1/"),
        "https://A.b.Test": ("b.test", "https://A.b.Test/"), "nope": ("", "nope"), "": ("", ""),
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "u string")
    got = {r.u: (r.d, r.n) for r in df.select("u", urls.domain(F.col("u")).alias("d"), urls.normalized(F.col("u")).alias("n")).collect()}
    assert {k: v for k, v in got.items() if k is not None} == cases and got[None] == ("", None)


def test_routing(spark):
    t = [Template("a", triggers=["https://x.test/", "/[bad/"]), Template("b", triggers=["https://x.test/p/"]), Template("c", triggers=["/\\.pdf$/"]), Template("d", triggers=["schema:@Recipe.author.name=W"]), Template("e", triggers=["schema:.tags=q"])]
    rows = [(1, "https://x.test/p/1", None), (2, "https://y.test/z.pdf", None), (3, "https://y.test/", '[{"@type":["Recipe","X"],"author":{"name":"W"}}]'), (4, "https://y.test/", '{"tags":["q"]}'), (5, "https://y.test/", "{}"), (6, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, s string")
    first = {r.page_id: r.i for r in df.select("page_id", routing.first_match(t, F.col("url"), F.col("s")).alias("i")).collect()}
    longest = {r.page_id: r.i for r in df.select("page_id", routing.longest_match(t, F.col("url"), F.col("s")).alias("i")).collect()}
    assert first == {1: 0, 2: 2, 3: 3, 4: 4, 5: None, 6: None} and longest == first | {1: 1}
    triggers = spark.createDataFrame([(i, j, p) for i, x in enumerate(t[:3]) for j, p in enumerate(x.triggers) if p != "/[bad/"], "template_idx int, trigger_idx int, pattern string")
    assert {r.page_id: r.template_idx for r in routing.routed(df, triggers, longest=True).collect()} == {1: 1, 2: 2}
    assert {r.page_id: r.template_idx for r in routing.routed(df, triggers).collect()} == {1: 0, 2: 2}


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"name": "N", "noteContentFormat": "x", "properties": [{"name": "p", "value": "{{url}}", "type": "text"}], "triggers": ["https://x"]}')
    (tmp_path / "b.json").write_text('{"name": "no content"}')
    found = readers.templates(spark, str(tmp_path))
    t = readers.as_template(found.collect()[0])
    assert found.count() == 1 and t.properties[0].name == "p" and t.triggers == ["https://x"]
    (tmp_path / "n.md").write_text("---\ntitle: \"A: b\"\ntags:\n  - x\n  - y\n---\n\nBody")
    r = readers.front_matter(readers.markdown_files(spark, str(tmp_path))).collect()[0]
    assert r.id == "n" and r.body == "Body" and r.front["title"] == "A: b" and r.front["tags"] == "x, y"
    (tmp_path / "types.txt").write_text('{"a": "date", "b": "number"}')
    assert {x.name: x.type for x in readers.property_types(spark, str(tmp_path / "types.txt")).collect()} == {"a": "date", "b": "number"}
    (tmp_path / "c.csv").write_text('﻿id,v\n1,"a ""q"", b"\n', encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "c.csv")).collect()[0].asDict() == {"id": "1", "v": 'a "q", b'}
    df = spark.createDataFrame([("one", "text\nlines"), ("two", 'a,"b"')], "note_name string, full_content string")
    assert sinks.note_files(df, str(tmp_path / "out")) == 2 and (tmp_path / "out" / "one.md").read_text() == "text\nlines"
    sinks.csv(df, str(tmp_path / "csv"))
    assert readers.csv(spark, str(tmp_path / "csv")).count() == 2
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "slice-1.json").write_text('{"url": "u", "slice": "1", "grid_range": [1, 3], "checklist": {"heading": "pass"}, "diffs": []}')
    assert readers.slices(spark, str(tmp_path / "s")).collect()[0].checklist == {"heading": "pass"}
    (tmp_path / "s" / "slice-2.json").write_text('{"slice": "2"}')
    with pytest.raises(Exception, match="slice without"):
        readers.slices(spark, str(tmp_path / "s")).collect()


def test_tidied_markdown(spark):
    text = "> \\[!note\\] x \\[^1\\]\n1. a\n\t2. b\n```js\n\\`\\`\\`x\n```\n![a](https://x.test/a.mp3)"
    got = spark.createDataFrame([(text,), (None,)], "m string").select(pages.tidied(F.col("m")).alias("m")).collect()
    assert got[0].m == '> [!note] x [^1]\n1. a\n2. b\n````js\n```x\n````\n<audio controls src="https://x.test/a.mp3"></audio>' and got[1].m is None


def test_empty_tables_and_nulls(spark):
    marks = spark.createDataFrame([], "url string, title string, id string, group_id string, content string, notes array<string>, start_offset int, end_offset int")
    for out in (highlights.merged(marks, ["url"]), highlights.overlaps(marks, ["url"], "id"), highlights.collapsed(marks), highlights.domains(marks), highlights.exported(marks), highlights.searched(marks, "x")):
        assert out.count() == 0
    events = spark.createDataFrame([], "ts timestamp, user_id int")
    assert usage.counts(events, "ts").count() == 0
    one = spark.createDataFrame([(datetime(2024, 2, 29),), (None,)], "ts timestamp")
    assert [(r.period, r.n_events) for r in usage.counts(one, "ts", "week").collect()] == [(date(2024, 2, 25), 1)]
    assert usage.counts(one, "ts", "day", date(2024, 3, 1), False).count() == 30
    assert transcripts.in_chapters(spark.createDataFrame([], "r int, `from` double"), spark.createDataFrame([], "r int, chapter string, chapter_from double, `to` double"), "r").count() == 0
    assert blocks.walked(spark.createDataFrame([("d", "a", "b", 1), ("d", "b", "a", 2), ("d", "c", None, 3), ("d", "e", "c", 4)], "doc_token string, block_id string, parent_id string, block_no long")).count() == 2
    assert audits.profile(spark.createDataFrame([(None, "")], "a string, b string"), ["a", "b"]).count() == 0
    assert tables.nearest(spark.createDataFrame([("zzzzzz",)], "name string"), spark.createDataFrame([("a", 0)], "name string, place int")).count() == 0


def test_streams(spark, tmp_path):
    rows = [(1, datetime(2024, 1, 1, 0, 0), "play"), (1, datetime(2024, 1, 1, 0, 1), "pause"), (1, datetime(2024, 1, 1, 0, 5), "play"), (2, datetime(2024, 1, 2), "play"), (2, datetime(2024, 1, 2, 0, 0, 30), "pause")]
    df = spark.createDataFrame(rows, "user_id int, ts timestamp, action string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = views.arriving(spark, str(tmp_path / "in"), df.schema)
    got = {r.user_id: (r.seconds, r.is_playing) for r in views.drained(views.played(stream, "user_id", "ts", "action"), "played", "update").collect()}
    assert got == {1: (60.0, True), 2: (30.0, False)}
    per = {r.period: r.n_events for r in views.drained(views.daily(stream, "ts"), "daily", "complete").collect()}
    assert per == {date(2024, 1, 1): 3, date(2024, 1, 2): 2}
    noted = views.notes_of(stream.withColumn("title", F.col("action")), Template("t", "{{title}}", "{{title|upper}}"), {"title": F.col("title")}, datetime(2025, 1, 1, tzinfo=UTC))
    assert {r.content for r in views.drained(noted.select("content"), "noted").collect()} == {"PLAY", "PAUSE"}


def test_blocks_of_every_kind_are_audited(spark):
    html = '<h1 data-b="1">A head</h1><p data-b="2">See <a href="/x">the <b>link</b></a> &amp; stay' + " on" * 30 + ' end</p><ul><li data-b="3">One<br>two<li data-b="4"></ul><dl><dt data-b="5">x<dd data-b="6">y</dl><pre data-b="7">{}</pre><p>no mark</p>'
    pages_ = spark.createDataFrame([(1, html), (2, None), (3, "<p>no mark</p>")], "page_id long, html string").select("page_id", dom.marked(F.col("html"), "data-b").alias("blocks"))
    whole = "# A head\n\nSee [the **link**](https://x.test/x) & stay" + " on" * 30 + " end\n\n- One\n  two\n\n`{ }`"
    notes_ = [(1, 1, whole), (2, 1, whole.replace(" end", "")), (3, 2, "a"), (4, 3, "a"), (5, None, "a"), (6, 1, None), (7, 9, "a")]
    got = audits.covered(pages_, spark.createDataFrame(notes_, "clip_id long, page_id long, m string"), "page_id", "blocks", "m")
    # y is in stay, and x in none
    assert {r.clip_id: (r.n_blocks, r.n_covered) for r in got.collect()} == {1: (6, 5), 2: (6, 4), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (6, 0), 7: (0, 0)}


def test_deep_outlines_are_walked_to_the_end(spark):
    rows = [("d", str(i), str(i - 1) if i else None, i) for i in range(40)] + [("d", "x", "y", 98), ("d", "y", "x", 99)]
    got = blocks.walked(spark.createDataFrame(rows, "doc_token string, block_id string, parent_id string, block_no long")).collect()
    assert sorted((r.depth, r.block_id) for r in got) == [(i, str(i)) for i in range(40)]
