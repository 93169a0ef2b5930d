import numpy as np
import pytest

from paperloom.llm import residue as r

PAGE = '<div><h1 data-b="1">{t}</h1>\n<p data-b="2">{a}</p>\n<p data-b="3">{b}</p></div>'
PROSE = "It took 31 attempts to link one practical diagram, and in the end the queue was not careful at all."
CASES = [
    ("page", "Queue or chapter?", PAGE.format(t="Queue or chapter?", a=PROSE, b=PROSE), False),
    ("page", "Queue or chapter?", PAGE.format(t="QUEUE OR CHAPTER?", a=PROSE, b="Please enable JavaScript to continue reading."), False),
    ("page", "Queue or chapter?", PAGE.format(t="Queue or chapter?", a=PROSE, b="By {{author|wikilink}}"), True),
    ("page", "Queue or chapter?", PAGE.format(t="[INSERT SUMMARY HERE]", a=PROSE, b=PROSE), True),
    ("page", "Queue or chapter?", PAGE.format(t="Queue or chapter?", a=PROSE, b="In the template, {{title}} is replaced by the heading of the page."), False),
    ("page", "The {{title}} variable", PAGE.format(t="The {{title}} variable", a=PROSE, b="<code>{{title}}</code>"), False),
    ("page", "Queue or chapter?", '<div><p data-b="4">502 Bad Gateway</p><p data-b="5">The session has expired.</p></div>', True),
    ("page", "Queue or chapter?", "<div><h1 data-b='4'>Scripts are blocked to view this page.</h1></div>", True),
    ("page", "Queue or chapter?", "", False),
    ("page", None, None, False),
    ("note", "A", "HTTP 429: no route matches this path.", True),
    ("note", "A", "---\ntitle: \"%%AUTHOR%%\"\nsource: \"https://x.test/\"\n---\n\n" + PROSE, True),
    ("note", "A", "---\ntitle: \"A\"\ntags: [\"{a}\", b]\n---\n\n# A\n\n" + PROSE, False),
    ("note", "A", PROSE + "\n\n```\n{% if published %}{{published}}{% endif %}\n```", False),
    ("note", "A", "Lorem ipsum dolor sit amet libero quisque lectus vitae.\n\nTempora libero augue quisque dictum semper.", True),
    ("note", "A", "测试测试测试测试测试测试测试测试", True),
    ("note", "A", "A 404 from the feed told us that the archive had moved.\n\n" + PROSE, False),
    ("note", "A", PROSE * 3000, False),
]


@pytest.fixture(scope="module")
def records(spark):
    from paperloom.llm.queries import _records

    return _records(spark, "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def model(records):
    return r.learn(records)


def test_cases(model):
    each = [r._segments(k, text, title) for k, title, text, _ in CASES]
    kinds = r.judged(model, each)
    got = [r.is_case(s, k, c[0] == "page") for s, k, c in zip(each, kinds, CASES)]
    assert [(c[1:3], g) for c, g in zip(CASES, got) if g != c[3]] == []


def test_unseen_hosts(records):
    found = r.validate(records)
    # a dozen notices on the unseen hosts of the small table
    assert found["accuracy"] > 0.95 and found["recall_residue"] > 0.9 and found["recall_notice"] > 0.5


def test_fit_is_deterministic_and_empty_fits():
    segs = [r.Segment("a b c", "text", 0), r.Segment("x y z", "text", 0)] * 5
    a, b = r.fit(segs, [0, 2] * 5), r.fit(segs, [0, 2] * 5)
    assert np.array_equal(a.weights, b.weights)
    assert a.scores(segs[:2]).argmax(axis=1).tolist() == [0, 2]
    assert r.fit([], []).scores(segs[:1]).argmax() == 0
    assert r.fit([], []).scores([]).shape == (0, 4)


def test_table(spark, model):
    rows = [("t", i, "page" if k == "page" else "note", t, x, "clash") for i, (k, t, x, _) in enumerate(CASES)]
    rows.append(rows[2])
    df = spark.createDataFrame(rows, "src_table string, rec_id long, kind string, title string, text string, label string")
    got = sorted(x.rec_id for x in r.cases(df, model).collect())
    assert got == [i for i, c in enumerate(CASES) if c[3]]
    assert r.cases(df.limit(0), model).count() == 0


LONG = [
    (f"{PROSE} This article was written by {{{{author}}}} and published on {{{{date}}}} in the evening edition of our magazine.", True),
    ("Queue or chapter? – {{site}}", True),
    (f"{PROSE} By <%= author %>. {PROSE}", True),
    ("Dieser Beitrag wurde von ${author} für die Leserinnen und Leser geschrieben und am ${date} veröffentlicht.", True),
    ("本文由{{author}}撰写，于{{date}}发表在本站的深度报道栏目。", True),
    (f"{PROSE} In the template, {{{{title}}}} is replaced by the heading of the page. {PROSE}", False),
    ("Write {{author|wikilink}} if you want a link instead of plain text.", False),
    (f"{PROSE} Under these rules the contract was null and void, and nobody minded.", False),
    ("This article was written by undefined and published on undefined in the weekly edition of undefined.", True),
]


def test_slots_in_long_segments(model):
    each = [r.page_segments(PAGE.format(t="Queue or chapter?", a=PROSE, b=t.replace("<", "&lt;")), "Queue or chapter?") for t, _ in LONG]
    got = [r.is_case(s, k, True) for s, k in zip(each, r.judged(model, each))]
    assert [(t, g) for (t, want), g in zip(LONG, got) if g != want] == []
    own = r.page_segments(PAGE.format(t="The {{title}} variable", a="Home › Help › The {{title}} variable", b=PROSE), "The {{title}} variable")
    assert not r.is_case(own, r.judged(model, [own])[0], True)


def test_phrases_it_was_not_told(monkeypatch):
    """Phrases and notations taken out of the lists are still found."""
    monkeypatch.setattr(r, "SCRIPT_PHRASES", tuple(t for t in r.SCRIPT_PHRASES if "needs" not in t and "Anwendung" not in t and "nécessite" not in t))
    monkeypatch.setattr(r, "LONG_SLOTS", tuple(t for t in r.LONG_SLOTS if "written" not in t and "geschrieben" not in t))
    monkeypatch.setattr(r, "FIELDS", [f for f in r.FIELDS if f not in ("Source", "Datum")])
    model = r._fitted([])
    notices = ["This app needs JavaScript.", "Diese Anwendung braucht JavaScript.", "Cette application nécessite JavaScript."]
    assert [t for t in notices if model.kinds([r.Segment(t, "text", 0)])[0] != r.NOTICE] == []
    slots = ["This article was written by ◆ and published on ◆.", "Source: undefined", "Datum: null"]
    assert [t for t in slots if model.kinds([r.Segment(t, "slot", 0)])[0] != r.RESIDUE] == []
    real = ["In the template, ◆ is replaced by the heading of the page.", "Die Variable ◆ steht für den Titel."]
    assert [t for t in real if model.kinds([r.Segment(t, "slot", 0)])[0] != r.REAL] == []


def test_probability_from_unseen_examples():
    p, labels = np.array([0.9, 0.8, 0.7, 0.65, 0.3, 0.1]), np.array([1, 1, 1, 0, 0, 0])
    assert 0.65 < r.least_likely(p, labels, 1) <= 0.7 and r.least_likely(p, labels, 2) == 0.5
    assert r.least_likely(np.array([0.9, 0.1]), np.array([1, 0]), 1) == 0.5


def test_kept_are_the_others(spark, model):
    rows = [("t", i, "page" if k == "page" else "note", t, x, "clash") for i, (k, t, x, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "src_table string, rec_id long, kind string, title string, text string, label string")
    out = r.kept(df, model)
    assert out.columns == ["src_table", "rec_id", "title", "text"]
    assert sorted(x.rec_id for x in out.collect()) == [i for i, c in enumerate(CASES) if not c[3] and c[2] is not None]
