"""The template language and its functions: each case is a column of one projection."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions.values import Val
from paperloom.lang import ParseError, parse, render, show, tokenize, validate

PAGE = {
    "grid": '[["a","b"],["c"]]', "mail": "Tue, 05 Mar 2024 10:00:00 GMT", "named": "March 5, 2024 10:15 PM",
    "title": "The Great  Page", "words": '["b","a","b"]', "nums": "[3,1,2]", "obj": '{"fooBar":1,"b":"x y"}', "people": '[{"n":"A","t":{"u":"q"}},{"n":"B"}]',
    "empty": "", "one": '["only"]', "html": '<div id="m"><p class="x y">A &amp; <b>b</b></p><p>C</p><a href="/z">L</a></div>', "url": "https://a.example/p", "md": "# H\n\n**b** [l](http://x) `c`",
}
CASES = [
    ('{{low|replace:"/WAR/i":"hi"}}', "hi AND peace OF THE day"), ('{{title|replace:"/(G)(r)/":"$2$1<$&>"}}', "The rG<Gr>eat  Page"), ('{{obj|capitalize}}', '{"Foobar":1,"B":"X y"}'),
    ('{{nested|blockquote}}', "> a\n> > b\n> > c"), ('{{grid|table}}', "| 0 | 1 |\n| - | - |\n| a | b |\n| c |  |"), ('{{mail|date:"YYYY-MM-DD HH:mm"}}', "2024-03-05 10:00"), ('{{named|date:"YYYY-MM-DD HH:mm"}}', "2024-03-05 22:15"),
    ("plain", "plain"), ("{{title}}", "The Great  Page"), ("{{ title | upper }}!", "THE GREAT  PAGE!"), ("{{missing}}", ""), ("{{one}}", '["only"]'),
    ("{{title|lower|kebab}}", "the-great-page"), ("{{title|snake}}", "the_great_page"), ("{{title|camel}}", "theGreatPage"), ("{{title|pascal}}", "TheGreatPage"),
    ('{{empty ?? "x"}}', "x"), ("{{missing ?? title|upper}}", "THE GREAT  PAGE"), ("{{words|first}}{{words|last}}", "bb"), ("{{words|join}}", "b,a,b"), ('{{words|join:"\\n"}}', "b\na\nb"), ('{{words|join:""}}', "bab"),
    ("{{words|unique}}", '["b","a"]'), ("{{nums|reverse}}", "[2,1,3]"), ("{{nums|slice:1}}", "[1,2]"), ("{{nums|slice:-1}}", "2"), ("{{nums|nth:2}}", "[1]"), ("{{nums|nth:1,3:3}}", "[3,2]"), ("{{nums|length}}", "3"),
    ('{{nums|merge:("x","y z")}}', '[3,1,2,"x","y z"]'), ("{{title|reverse}}", "egaP  taerG ehT"), ("{{title|slice:0,3}}", "The"), ("{{title|length}}", "15"), ("{{obj|length}}", "2"),
    ("{{obj|object:keys}}", '["fooBar","b"]'), ("{{obj|object:values}}", '[1,"x y"]'), ("{{obj|object:array}}", '[["fooBar",1],["b","x y"]]'), ("{{obj|footnote}}", "[^foo-bar]: 1\n\n[^b]: x y"),
    ("{{words|footnote}}", "[^1]: b\n\n[^2]: a\n\n[^3]: b"), ("{{obj.b}}", "x y"), ('{{obj["fooBar"]}}', "1"), ("{{people[1].n}}", ""), ("{{words[1]}}", "a"), ("{{words[9]}}", ""),
    ('{{people|map:x => x.n|join:"+"}}', "A+B"), ('{{people|map:x => x.t.u|first}}', "q"), ('{{words|map:x => "<${x}>"|join:""}}', "<b><a><b>"), ('{{people|template:"n: ${n}\\n\\nu: ${t.u}"}}', "n: A\nu: q\n\nn: B\nu:"),
    ("{{words|list}}", "- b\n- a\n- b"), ("{{words|list:numbered}}", "1. b\n2. a\n3. b"), ("{{words|list:task}}", "- [ ] b\n- [ ] a\n- [ ] b"), ("{{title|list}}", "- The Great  Page"),
    ('{{nested|list:numbered}}', "1. a\n\t1. b\n\t1. c"), ("{{words|wikilink}}", '["[[b]]","[[a]]","[[b]]"]'), ('{{title|wikilink:"t"}}', "[[The Great  Page|t]]"), ("{{obj|wikilink}}", '["[[fooBar|1]]","[[b|x y]]"]'),
    ('{{url|link:"here"}}', "[here](https://a.example/p)"), ("{{obj|link}}", "[1](fooBar)\n[x y](b)"), ('{{url|image:"alt"}}', "![alt](https://a.example/p)"), ("{{words|table}}", "| Value |\n| - |\n| b |\n| a |\n| b |"),
    ("{{obj|table}}", "| fooBar | 1 |\n| - | - |\n| b | x y |"), ("{{people|table}}", '| n | t |\n| - | - |\n| A | {"u":"q"} |\n| B |  |'), ('{{words|table:("p","q")}}', "| p | q |\n| - | - |\n| b | a |\n| b |  |"),
    ("{{md|blockquote}}", "> # H\n> \n> **b** [l](http://x) `c`"), ('{{title|callout:("tip","T",false)}}', "> [!tip]+ T\n> The Great  Page"), ("{{title|callout}}", "> [!info]\n> The Great  Page"), ("{{md|strip_md}}", "H\n\nb l c"), ("{{md|stripmd}}", "H\n\nb l c"),
    ('{{title|replace:"Great":"Good"}}', "The Good  Page"), ('{{title|replace:"/a/g":"4"}}', "The Gre4t  P4ge"), ('{{title|replace:"/[a-z]/":"_"}}', "T_e Great  Page"), ('{{title|replace:"e":""," ":"."}}', "Th.Grat..Pag"), ('{{title|replace:"The|Page":"X"}}', "X Great  X"),
    ("{{title|title}}", "The Great Page"), ("{{low|title}}", "War and Peace of the Day"), ("{{words|capitalize}}", '["B","A","B"]'), ("{{low|capitalize}}", "War and peace of the day"), ("{{camelled|uncamel}}", "foo bar html page"),
    ('{{n|calc:"*2"}}', "5"), ('{{n|calc:"**2"}}', "6.25"), ('{{n|calc:"/0"}}', "Infinity"), ('{{title|calc:"+1"}}', "The Great  Page"), ("{{n|round}}", "3"), ("{{neg|round}}", "-2"), ("{{n|round:1}}", "2.5"), ('{{big|number_format:(2,",",".")}}', "1.234.567,80"), ("{{big|number_format}}", "1,234,568"),
    ("{{iso|duration}}", "01:02:03"), ("{{secs|duration}}", "01:15"), ('{{iso|duration:"H:mm"}}', "1:02"), ('{{day|date:"D MMM YYYY"}}', "31 Jan 2024"), ('{{day|date:"dddd, MMMM Do"}}', "Wednesday, January 31st"), ("{{title|date}}", "Invalid Date"), ('{{title|date:"YYYY"}}', "The Great  Page"),
    ('{{dmy|date:"YYYY-MM-DD","DD/MM/YYYY"}}', "2024-03-05"), ('{{day|date_modify:"+1 month"}}', "2024-02-29"), ('{{day|date_modify:"-1 week"}}', "2024-01-24"), ('{{day|date_modify:"+25 hours"}}', "2024-02-01"),
    ("{{enc|decode_uri}}", "a b+c"), ("{{badenc|decode_uri}}", "100%"), ("{{odd|safe_name}}", "_a b.c"), ("{{con|safe_name:windows}}", "_con.txt"), ("{{hashes|safe_name}}", "Untitled"), ("{{pad|trim}}", "x y"), ("{{esc|unescape}}", 'a"b\nc'), ('{{title|split:" "}}', '["The","Great","","Page"]'), ("{{abc|split}}", '["a","b","c"]'),
    ("{{html|strip_tags}}", "A & bCL"), ('{{html|strip_tags:("b")}}', "A & <b>b</b>CL"), ("{{html|strip_attr}}", "<div><p>A &amp; <b>b</b></p><p>C</p><a>L</a></div>"), ('{{html|strip_attr:("href")}}', '<div><p>A &amp; <b>b</b></p><p>C</p><a href="/z">L</a></div>'), ('{{html|remove_attr:("class,id")}}', '<div><p>A &amp; <b>b</b></p><p>C</p><a href="/z">L</a></div>'),
    ('{{html|remove_tags:("p,a")}}', '<div id="m">A &amp; <b>b</b>CL</div>'), ('{{html|replace_tags:"p":"li"}}', '<div id="m"><li class="x y">A &amp; <b>b</b></li><li>C</li><a href="/z">L</a></div>'), ('{{html|remove_html:(".x","a")}}', '<div id="m"><p>C</p></div>'),
    ("{{html|markdown}}", "A & **b**\n\nC\n\n[L](https://a.example/z)"), ("{{small|html_to_json}}", '{"type":"element","tag":"p","children":[{"type":"text","content":"x"}]}'), ("{{small|fragment_link}}", '["<p>x</p> [link](https://a.example/p#:~:text=x)"]'),
    ("{{selector:p}}", '["A & b","C"]'), ("{{selector:p.x|upper}}", '["A & B"]'), ("{{selector:a?href}}", "/z"), ("{{selectorHtml:div > a}}", '<a href="/z">L</a>'), ("{{selector:p:nth-child(2)}}", "C"), ('{{selector:[href^="/"]}}', "L"), ("{{selector:h9}}", ""), ("{{selector:p:first-child, a|join:\"-\"}}", "A & b-L"),
    ("{% if title %}y{% else %}n{% endif %}", "y"), ("{% if empty %}y{% else %}n{% endif %}", "n"), ("{% if n > 2 and n <= 2.5 %}y{% endif %}", "y"), ('{% if title contains "great" %}y{% endif %}', "y"), ('{% if words contains "A" %}y{% endif %}', "y"), ("{% if not empty and !missing %}y{% endif %}", "y"),
    ('{% if n == "2.5" %}y{% endif %}', "y"), ('{% if title != "x" %}y{% endif %}', "y"), ("{% if missing == null %}y{% endif %}", "y"), ("{% if empty == 0 %}y{% endif %}", "y"), ('{% if n > 9 %}a{% elseif n == 2.5 %}b{% else %}c{% endif %}', "b"), ('{% if (n > 9 or title == "x") %}a{% else %}b{% endif %}', "b"), ("{% if obj %}y{% endif %}", "y"), ("{% if zero %}y{% else %}n{% endif %}", "y"),
    ("{% for w in words %}{{w}}{{loop.index}}{% if loop.last %}.{% endif %}{% endfor %}", "b1\na2\nb3."), ("{% for p in people %}{{p.n}}:{{p_index}}/{{loop.length}} {% endfor %}", "A:0/2\nB:1/2"), ("{% for x in missing %}a{% endfor %}b", "b"), ("{% for x in title %}a{% endfor %}b", "b"), ("{% for a in words %}{% for b in nums %}{{a}}{{b}}{% endfor %};{% endfor %}", "b3\nb1\nb2;\na3\na1\na2;\nb3\nb1\nb2;"),
    ("{% set v = title|lower %}\nx{{v}}", "xthe great  page"), ("{% set title = 'n' %}{{title}}", "The Great  Page"), ("a{% if empty %}x{% endif %}  \nb", "ab"), ("a{% if title %}x{% endif %}\n\nb", "ax\nb"), ("a{% if empty %}x{% else %}z{% endif %}\nb", "az\nb"),
    ("{{schema:@Article:headline}}", "Head"), ("{{schema:headline}}", "Head"), ("{{schema:@Article:tags[*].n|join}}", "p,q"), ("{{schema:@Article:tags[1].n}}", "q"), ("{{meta:name:author}}", "Me"), ('{{"ask"|upper}}', "ANSWER"), ('{{"other"}}', ""),
    ("{{ broken", ""), ("{% if x %}", ""), ("{{ a | }}", ""), ("{{title|nosuch:1}}", "The Great  Page"), ('{{ "a\\"b" }}', ""), ("{{ title | replace:\"a\":\"}}\" }}", "The Gre}}t  P}}ge"),
]
EXTRA = {
    "nested": '["a",["b","c"]]', "low": "war AND peace OF THE day", "camelled": "fooBarHTMLPage", "big": "1234567.8", "neg": "-2.5", "iso": "PT1H2M3S", "secs": "75", "day": "2024-01-31", "dmy": "05/03/2024", "enc": "a%20b+c", "badenc": "100%",
    "odd": ".a: b?.c", "con": "con.txt", "hashes": "#|^", "pad": "  x y\n", "esc": 'a\\"b\\nc', "abc": "abc", "small": "<p>x</p>", "zero": "0",
}


def test_cases(spark):
    rows = PAGE | EXTRA
    df = spark.createDataFrame([(*rows.values(), 2.5)], ", ".join(f"`{k}` string" for k in rows) + ", n double")
    df = df.withColumn("vars", F.create_map(*[F.lit(x) for pair in {"schema:@Article:headline": "Head", "schema:@Article:tags": '[{"n":"p"},{"n":"q"}]', "meta:name:author": "Me"}.items() for x in pair])).withColumn("answers", F.create_map(F.lit("ask"), F.lit("answer")))
    presets = {k: F.col(k) for k in rows} | {"n": Val(F.col("n"), "num")}
    bad = []
    for at in range(0, len(CASES), 50):
        part = CASES[at : at + 50]
        out = render(df, {f"c{i}": t for i, (t, _) in enumerate(part)}, presets, html="html", table="vars", responses="answers")
        got = out.select([f"c{i}" for i in range(len(part))]).collect()[0]
        bad += [(t, want, got[f"c{i}"]) for i, (t, want) in enumerate(part) if got[f"c{i}"] != want]
    assert bad == []


def test_null_and_empty_tables(spark):
    df = spark.createDataFrame([(None, None), ("", "x")], "a string, _selected string")
    out = render(df, {"o": "[{{a|upper|split:\",\"|first}}{{selector:p}}]"}, {"a": "a"}, html="a")
    assert out.columns == ["a", "_selected", "o"] and [r.o for r in out.collect()] == ["[]", "[]"]
    assert render(df.limit(0), {"o": "{{a}}"}, {"a": "a"}).count() == 0


def test_fields_stay_in_generated_code(spark):
    df = spark.createDataFrame([("x",)], "a string")
    plan = render(df, {"o": "{% for x in a %}{{x|upper|kebab}}{% endfor %}{{a|date:\"YYYY\"}}"}, {"a": "a"})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan
    two = render(df, {"o": "{{selector:p}}", "q": "{{selector:a?href}}{{selector:p}}"}, {"a": "a"}, html="a")
    assert two._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython ") == 1


def test_places_of_errors():
    with pytest.raises(ParseError) as e:
        parse("a\nb {{ x | }}")
    assert e.value.line == 2
    with pytest.raises(ParseError):
        parse("{% else %}")
    assert [t.kind for t in tokenize("a{{b}}{% if c %}")] == ["text", "value", "tag"]
    assert "Filter" in show(parse("{{a|b:1}}"))


def test_validation():
    assert validate.variables("{{tittle}}{% for x in highlights %}{{x}}{{loop.index}}{% endfor %}{% set q = url %}{{q}}") == ["unknown variable tittle, did you mean title?"]
    assert validate.used_filters('{{a|uper}}{{a|calc:"x"}}{{a|slice:1,2}}{{a|replace:b}}') == ["unknown filter uper, did you mean upper?", "calc can't use 'x'", "replace needs quoted pairs"]
