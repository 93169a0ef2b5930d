import numpy as np
import pandas as pd
import pytest

from paperloom.llm import quality as q

COMMON = {"en": frozenset("the a of and to in is that it was for on with as be".split()), "zh": frozenset("的 了 是 在 我 有 和".split())}
EN = "It took 31 attempts to link one practical diagram, and in the end the queue was not careful at all."
LOW = "the variable rewrites the flexible sidebar in the weekly digest, so the night shift had kept a renderer for weeks"
ZH = "我们小组复盘那天试着核对草稿，花了很多天，最后留下的是一份安静的文档。"
PROSE = [
    EN, ZH, "\n\n".join([EN] * 2 + [ZH]), "\n".join([LOW, LOW.replace("variable", "note"), LOW.replace("digest", "report")]),
    f"# A heading\n\n{EN}\n\n- first\n- second\n- third\n\n{EN} {EN} {EN}",
    f"{EN} {EN} {EN}\n\n| a | b |\n|---|---|\n| x | 1 |\n\n{EN} {EN}",
    f"Host: {EN}\nGuest: {EN[:-1]} again.\nHost: {EN[:-2]}!",
    "From 71:12 on, the parser gets lost behind the toolbar, and only the\nrecorder is still faint. Last autumn the snapshot was long; Around\n24:45 the whole class explains why the queue and the quotation do\nnot agree.",
]
OTHER = {
    "table": ["| a | b |\n|---|---|\n| x | 1 |\n| y | 2 |", "a\t1\t-\nb\t2\tx\nc\t3\ty", "x,1,-\ny;2;3\nz,3,4", "ab    12    -\ncd    13    x\nef    14    y", "<tr><td>a</td></tr>\n<tr><td>b</td></tr>", f"{EN}\n1\t2\t3\n4\t5\t6\n7\t8\t9\n-\t-\t-"],
    "list": ["- [x] One thing\n- [ ] Another", "1. How to start\n2) Draft or note?\n3、 The rest", "The intro .......... 1\nThe middle ....... 4", "00:10 The start\n01:20 The middle\n100:03 The end", "note · index · map · board · cache · queue · tag", "笔记、索引、地图、表格、标签、草稿、文档", f"{EN}\n- one\n- two\n- three\n- four"],
    "pairs": ["size: 12\nname：box\ncolour: red\nweight: -"],
    "code": [".a{margin:1px;color:#fff}\n.b{margin:2px;color:#000}", 'var a=function(e){return e?y.push(1):null};\nvar b=function(e){return 2};', '{"a":{"id":1},"b":{"id":2}}', "<div class=x>\n<p>y</p>\n</div>"],
    "junk": ["※ ■■ ||| && ~ ### @@ ^_^ *** >>>", "gqkdxzgm bngphbdfjl fhzkd cqbnw jbk", "Home About\nHome About\nHome About\nHome About", "Jobs Shop > Jobs Shop > Jobs Shop > Jobs Shop", "vLSpEaEs6u/fqGRM/pG2K3/9Vc/4tSgAcLURcrGTgBktJmC/grQJg+74UN+4T3RtB5hMpRD9", "Ã¤hnlich fÃ¼r grÃ¶ÃŸe schÃ¶n", f"{EN}\n" * 8],
}


HASHED = q.prepared(COMMON)


def measure(text, weights=None):
    return q.measured_texts([text], HASHED, weights).iloc[0]


def kind(text, weights=None):
    return measure(text, weights).text_kind


@pytest.mark.parametrize("text", PROSE)
def test_prose(text):
    assert kind(text) == "prose"


@pytest.mark.parametrize("name", OTHER)
def test_other(name):
    found = q.measured_texts(OTHER[name], HASHED).text_kind
    assert [(t, k) for t, k in zip(OTHER[name], found) if k in ("prose", "empty")] == []
    assert sum(k == name for k in found) >= len(found) / 2, list(found)


def test_statistics():
    got = measure("The cat sat.\nA dog in 12 days!")
    assert got.n_words == 7 and got.n_lines == 2 and got.end_punct_share == 1.0 and got.n_sentences == 2
    assert got.mean_word_len == pytest.approx((3 + 3 + 3 + 1 + 3 + 2 + 4) / 7)
    assert got.common_share == pytest.approx(3 / 7) and got.digit_ratio == pytest.approx(2 / 23)
    assert measure(ZH).n_words == len(ZH) - 3 and measure("don't well-worn").n_words == 2


def test_autocorrelation():
    doc = np.array([0] * 8 + [1] * 6 + [2] * 2)
    best, deviation = q.autocorrelation(np.array([0.0, 2, 4, 0, 2, 4, 0, 2, 5, 5, 5, 5, 5, 5, 1, 9]), doc, 3)
    assert best[0] > 0.4 and best[1] == 0 and best[2] == 0 and deviation[1] == 0
    # against the definition, at lag 3
    x = np.array([0.0, 2, 4, 0, 2, 4, 0, 2]) - np.mean([0, 2, 4, 0, 2, 4, 0, 2])
    assert best[0] == pytest.approx((x[3:] * x[:-3]).sum() / (x * x).sum())


OUTLINE = "\n".join(f"{'  ' * (i % 3)}{w}" for i, w in enumerate("harbour rope tar deck mast sail oar keel stern bow hull anchor".split()))
COLUMNS = "\n".join(f"{a:<12}{b:<12}{c}" for a, b, c in [("rope", "tar", "deck"), ("mast", "sail", "oar"), ("keel", "stern", "bow"), ("hull", "anchor", "pier")])


def test_geometry_decides():
    """Without its geometry a table or list without marks is no longer told."""
    flat = lambda *names: {k: (0,) * 6 if k in names else w for k, w in q.WEIGHTS.items()}
    assert kind(OUTLINE) != "prose" and kind(COLUMNS) == "table"
    assert kind(COLUMNS, flat("columns")) != "table"
    assert kind(OUTLINE, flat("indent", "period", "evenness", "autocorrelation", "shortness")) == "prose"
    measures, _ = q.lines_of([OUTLINE], HASHED)
    assert measures["period"][0] > 0.4 and measures["indent"].max() == 0.5
    assert q.lines_of([COLUMNS], HASHED)[0]["columns"].min() > 0.6


def test_fit_tells_exemplars_apart():
    texts = [*PROSE[:4], *OTHER["table"][:2], *OTHER["pairs"]]
    measures, counts = q.lines_of(texts, HASHED)
    kinds = np.array([0 if d < 4 else 1 if d < 6 else 3 for d in counts["doc"]])
    assert (q.line_kinds(measures, q.fitted(measures, kinds, steps=400)) == kinds).all()


def test_wrong_bytes():
    assert kind(" ".join([LOW.replace("kept", "gemÃ¼htet Ã¼ber grÃ¶ÃŸe fÃ¼r")] * 2)) == "junk"
    assert kind(LOW + " in a café… été, déjà «passé» ") == "prose"


def test_empty_and_long():
    assert kind(None) == kind("") == kind(" \n\t") == "empty"
    assert kind((EN + " ") * 5000) == kind((EN + "\n" + LOW + ".\n") * 1) == "prose"
    assert kind(" ".join(f"{EN[:40]} {i} {LOW[i % 50 :]}." for i in range(4000))) == "prose"
    assert kind("x") == "prose" and measure("#").n_words == 0
    assert q.measured_texts([], HASHED).shape == (0, len(q.STATS))
    assert q.measured_texts([EN, "- a\n- b\n- c"], []).text_kind.tolist() == ["prose", "list"]


def test_texts_do_not_touch_each_other():
    texts = [t for ts in OTHER.values() for t in ts] + PROSE + [None, ""]
    together, alone = q.measured_texts(texts, HASHED), [measure(t) for t in texts]
    assert together.astype(object).where(together.notna(), None).values.tolist() == [[None if v is pd.NA or v != v else v for v in a] for a in alone]


def test_stretches_add_up(monkeypatch):
    text = "\n".join(x.format(i) for i in range(30) for x in (EN + " {}.", LOW + " {}.", "- one {}", "- two {}", EN[:60] + "{}.", ZH + "{}。"))
    whole = measure(text)
    monkeypatch.setattr(q, "STRETCH", 700)
    cut = measure(text)
    same = ["n_words", "mean_word_len", "symbol_ratio", "n_lines", "end_punct_share", "common_share", "n_sentences", "text_kind"]
    assert cut[same].tolist() == pytest.approx(whole[same].tolist())


def test_table(spark):
    df = spark.createDataFrame([(1, EN, "clash", 1), (2, None, "", 2), (3, OTHER["list"][1], "", 3), (1, EN, "clash", 1)], "doc_id int, text string, text_kind string, _stats int")
    common = spark.createDataFrame([("en", t, 1) for t in COMMON["en"]] + [(None, "x", 1)], "lang string, term string, term_rank int")
    out = q.measured(df, common)
    assert set(out.columns) == {"doc_id", "text", "_stats", *q.STATS}
    got = {r.doc_id: (r.text_kind, r.n_words) for r in out.collect()}
    assert got == {1: ("prose", 19), 2: ("empty", None), 3: ("list", 8)}
    assert q.measured(df.limit(0), common).count() == 0
