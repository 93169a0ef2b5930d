import json

import pytest

from paperloom.llm import residue
from paperloom.llm import wrappers as w

PROSE = ["The queue was not careful at all, and nobody minded that much number {i}.", "We lost {i} pages of the thread, yet somebody gathered them again later on."]


def page(i, aside=True, layout="div", copies=1, title=None):
    title = title or f"How to compare notes {i}"
    nav = "".join(f'<li data-b="{k}"><a href="/n{k}">Menu {k}</a></li>' for k in range(1, 5))
    body = f'<h1 data-b="10">{title}</h1><p data-b="11">{PROSE[0].format(i=i)}</p><p data-b=12>{PROSE[1].format(i=i)}<li data-b="13"><a href="/p/x{i}">Linked {i}</a></li>'
    insert = '<div class="rel"><h4 data-b="20">Related</h4><p data-b="21"><a href="/p/a">Other {i}</a></p></div>' * copies
    side = f'<div class="side"><h3 data-b="30">Latest</h3><p data-b="31"><a href="/p/b{i}">Teaser {i}</a> A teaser text that runs on for quite a while, {i}.</p></div>' if aside else ""
    foot = '<div class="foot"><p data-b="40">All rights reserved by the owners of this place, which is a constant.</p><p data-b="41">Please enable JavaScript to continue reading.</p></div>'
    if layout == "table":
        return f"<body><table><tr><td colspan=3>{nav}</td></tr><tr><td valign=top>{side}</td><td valign=top>{body}{insert}</td></tr><tr><td colspan=3>{foot}</td></tr></table></body>", title
    return f'<!doctype html><html><head><title>x</title><script>if(a<b){{}}</script></head><body><div class="nav">{nav}</div><!-- c --><div class="foot2">{body}{insert}</div>{side}{foot}</body></html>', title


BODY = {10, 11, 12, 13}


@pytest.fixture(scope="module")
def model():
    return residue._fitted([])


def rows(spark, pages):
    return spark.createDataFrame(pages, "page_id long, site string, title string, full_html string, reader_html string, wrapper string, block_no int")


def test_body_of_hosts(spark, model):
    pages = []
    for i in range(12):
        for n, (site, layout) in enumerate((("a.test", "div"), ("b.test", "table"))):
            html, title = page(i, aside=i % 3 > 0, layout=layout, copies=i % 4)
            pages.append((100 * n + i, site, title, html, None, "clash", 1))
    html, title = page(77)
    pages += [(900, "alone.test", title, html, None, "", 0), (901, None, title, html, None, "", 0)]
    pages += [(902, "twice.test", title, html, None, "", 0), (903, "twice.test", title, html, None, "", 0)]
    reader = "".join(f'<p data-b="{b}">{t}</p>' for b, t in ((2, '<a href="/n2">Menu 2</a>'),)) + f'<h1 data-b="10">{title}</h1><p data-b="11">{PROSE[0].format(i=77)}</p><p data-b="40">All rights reserved by the owners of this place, which is a constant.</p>'
    pages += [(904, "a.test", title, None, f"<div>{reader}</div>", "", 0), (905, "a.test", title, None, None, "", 0), (906, "a.test", title, "", " ", "", 0)]
    error = html.replace(f'<h1 data-b="10">{title}</h1>', "").replace(PROSE[0].format(i=77), "502 Bad Gateway").replace(PROSE[1].format(i=77), "Error 502").replace('<li data-b="13"><a href="/p/x77">Linked 77</a></li>', "")
    pages += [(907, "a.test", title, error, None, "", 0)]
    long = html.replace(PROSE[0].format(i=77), PROSE[0].format(i=77) * 3000)
    pages += [(908, "a.test", title, long, None, "", 0), pages[0]]
    got: dict = {}
    for r in w.main_body(rows(spark, pages), model).collect():
        got.setdefault(r.page_id, set()).add(r.block_no)
    for n in (0, 1):
        for i in range(12):
            assert got[100 * n + i] == BODY, (n, i, got[100 * n + i])
    assert got[900] == got[901] == got[902] == got[903] == got[908] == BODY
    assert got[904] == {10, 11}
    assert not {905, 906, 907} & set(got)


def test_empty_table(spark, model):
    assert w.main_body(rows(spark, []), model).count() == 0


def test_folding_order_does_not_matter_for_the_rule():
    boxes = [w.skeleton(page(i, aside=i % 2 > 0)[0], "a.test") for i in range(20)]
    packed = [json.dumps(b.pack()) for b in boxes]
    fresh = lambda: [w.Box.unpack(json.loads(p)) for p in packed]

    def fold(items):
        out = items[0]
        for x in items[1:]:
            out = w.merge(out, x)
        return out

    whole = fold(fresh())
    halves = w.merge(fold(fresh()[10:]), fold(fresh()[:10]))
    assert whole.pages == halves.pages == 20
    assert sorted((b.sig, b.pages, tuple(b.stats)) for b in w._boxes(whole)) == sorted((b.sig, b.pages, tuple(b.stats)) for b in w._boxes(halves))
    assert "<div[class=side]>" in w.expression(whole) and "?" in w.expression(whole)


def test_constants_survive_the_summary():
    box = w.Box("x")
    box.texts = {}
    for i in range(6000):
        one = w.Box("x")
        one.stats = [2, 0, 0, 0]
        one.texts = {f"u{i}": [1, 40], "same" if i % 8 == 0 else f"v{i}": [1, 40]}
        box = w.merge(box, one)
    assert "same" in box.texts


def extracted(spark, model, pages):
    got: dict = {}
    for r in w.main_body(rows(spark, [(i, "a.test", title, html, None, "", 0) for i, (html, title) in enumerate(pages)]), model).collect():
        got.setdefault(r.page_id, set()).add(r.block_no)
    return got


def test_lists_tables_and_second_halves(spark, model):
    words = "harbour rope tar deck mast sail oar keel stern bow hull anchor".split()
    say = lambda i: " ".join(words[(i * k + k) % 12] for k in range(1, 9))
    both = lambda i: (PROSE[0].format(i=say(i)), PROSE[1].format(i=say(i + 5)))
    frame = '<body><nav><p data-b="90"><a href="/">Home</a></p></nav><div class="text">{}</div>{}<div class="foot"><p data-b="99">All rights reserved by the owners of this place, which is a constant.</p></div></body>'
    head = '<h1 data-b="1">Title {i}</h1><p data-b="2">{a}</p>'
    listed = [(frame.format(head.format(i=i, a=both(i)[0]) + f'<ul><li data-b="3">One thing of number {i}</li><li data-b="4">Another thing</li></ul><table><tr><td data-b="6">{i}</td><td data-b="7">{i * 7}</td></tr></table><p data-b="5">{both(i)[1]}</p>', ""), f"Title {i}") for i in range(20)]
    got = extracted(spark, model, listed)
    assert set(map(frozenset, got.values())) == {frozenset({1, 2, 3, 4, 5, 6, 7})} and len(got) == 20
    halves = [(frame.format(head.format(i=i, a=both(i)[0]) + f'<p data-b="5">{both(i)[1]}</p>', f'<div class="more"><p data-b="9">{both(i + 100)[0]} {both(i + 200)[1]}</p></div>'), f"Title {i}") for i in range(20)]
    assert set(map(frozenset, extracted(spark, model, halves).values())) == {frozenset({1, 2, 5, 9})}
    apart = [(f'<body><header><h1 data-b="1">Title {i}</h1></header>' + frame.format(f'<p data-b="2">{both(i)[0]}</p><p data-b="5">{both(i)[1]}</p>', "")[6:], f"Title {i}") for i in range(20)]
    assert set(map(frozenset, extracted(spark, model, apart).values())) == {frozenset({1, 2, 5})}


def test_expression_has_repeated_and_optional_groups():
    one = w.skeleton(page(1, copies=3)[0], "a.test")
    for i in range(2, 12):
        one = w.merge(one, w.skeleton(page(i, copies=i % 3, aside=i % 2 > 0)[0], "a.test"))
    text = w.expression(one)
    assert ")*" in text and ")?" in text and "<div[class=foot]>(#CONST)*</>" in text


def test_long_texts_are_told_by_all_of_them():
    a, b = ("x" * 120 + mid + "y" * 120 for mid in ("kite", "mast"))
    assert w.fingerprint(a, "a.test") != w.fingerprint(b, "a.test")


WORDS = "harbour rope tar deck mast sail oar keel stern bow hull anchor".split()


def said(i, n=14):
    return " ".join(WORDS[(i * k * k + k + i // 12) % 12] for k in range(1, n)) + f" {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}."


def test_rare_containers_of_wide_hosts_are_kept(spark, model):
    """Over 400 containers, and a notice on 1 % of the pages."""
    notice = "This notice stands on three pages of the host alone, word by word the same, and is as long as what they say themselves."
    pages = []
    for i in range(300):
        own = f'<div id="poll-{i}"><p data-b="20"><a href="/q/{i}">Vote {i}</a></p></div><div id="ad-{i}"><p data-b="21"><a href="/r/{i}">Buy {i}</a></p></div>'
        beside = f'<div class="notice"><p data-b="30">{notice}</p></div>' if i % 100 == 7 else ""
        pages.append((f'<body><div class="text"><h1 data-b="1">Title {i}</h1><p data-b="2">{said(i)}</p></div>{beside}{own}</body>', f"Title {i}"))
    got = extracted(spark, model, pages)
    assert len(got) == 300 and set(map(frozenset, got.values())) == {frozenset({1, 2})}
    read = w.read_pages(rows(spark, [(i, "a.test", title, html, None, "", 0) for i, (html, title) in enumerate(pages)]), model)
    host = w.infer(read).collect()
    assert len(host) == 1 and host[0].pages == 300 and host[0].boxes == 2 + 1 + 1 + 600
    text = w.expressions(read).collect()[0].expression
    assert all(f"<div[id=poll-{i}]>" in text for i in range(300)) and "(<div[class=notice]>(#CONST)*</>)?" in text


def test_a_container_of_one_page_says_nothing_of_the_others(spark, model):
    pages = [(f'<body><article id="post-{i}"><h1 data-b="1">Title {i}</h1><p data-b="2">{said(i, 400 if i == 5 else 14)}</p></article><div class="foot"><p data-b="9"><a href="/">Home</a></p></div></body>', f"Title {i}") for i in range(40)]
    got = extracted(spark, model, pages)
    assert len(got) == 40 and set(map(frozenset, got.values())) == {frozenset({1, 2})}


def test_texts_are_counted_exactly():
    box = w.Box("x")
    box.texts = {}
    for i in range(1000):
        one = w.Box("x")
        one.stats = [2, 0, 0, 0]
        one.texts = {f"u{i}": [1, 40], "same" if i % 16 == 0 else f"v{i}": [1, 40]}
        box = w.merge(box, one)
    assert box.texts["same"] == [63, 63 * 40] and "same" in w.constants(box) and len(w.constants(box)) == 1


def test_wide_wrappers_are_gathered_whole():
    stack: list = []
    for i in range(5000):
        w.gather(stack, w.Box("page", [w.Box("nav"), w.Box(f"div[id={i}]"), w.Box("foot")]), 4)
        assert len(stack) < 20
    root = w.joined(stack)
    assert root.pages == 5000 and len(root.kids) == 5002
    assert {k.sig: k.pages for k in root.kids if k.pages > 1} == {"nav": 5000, "foot": 5000}


def test_both_ways_to_align_rows_agree():
    for n in range(200):
        a, b = ([w.Box("abcdefgh"[(n * m + i * i * (m + 2)) % (1 + n % 8)], stats=[i % 3, 0, 40 * (i * m % 2), 0]) for i in range(n * m % 17)] for m in (5, 7))
        points = [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x.sig == y.sig]
        assert w._by_points(a, b, points) == w._by_grid(a, b)


def test_places_hold_what_is_aligned_to_them(spark, model):
    """Two layouts, met in one order in some tasks and in the other in the rest."""
    row = lambda kind, i: f'<tr><td class="{kind}"><h1 data-b="1">Title {i}</h1><p data-b="2">{said(i, 40)}</p></td></tr>'
    pages = [(f"<body><table><tr><th><p data-b=9>Home</p></th></tr>{row('ab'[(i + i // 4) % 2], i)}</table></body>", f"Title {i}") for i in range(32)]
    read = w.settle(w.read_pages(rows(spark, [(i, "a.test", title, html, None, "", 0) for i, (html, title) in enumerate(pages)]), model), "t")
    hosts = w.settle(w.infer(read), "t")
    host = w._counted(hosts, w.settle(w.place(read, hosts), "t")).collect()[0]
    found: dict = {}
    for b in w._boxes(w._filled(host.wrapper, host.held, host.fixed)):
        assert b.pages > 0
        found[b.sig] = found.get(b.sig, 0) + b.pages
    assert found["td[class=a]"] == found["td[class=b]"] == 16 and found["page"] == 32
    assert set(map(frozenset, extracted(spark, model, pages).values())) == {frozenset({1, 2})}
