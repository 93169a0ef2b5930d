from pyspark.sql import functions as F

from paperloom.operators import blocks, records, transcripts


def each(spark, values, column):
    """What an expression makes of texts, in their order."""
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_normalisers(spark):
    standards = {"国三": "国三", "国3": "国三", "国III": "国三", "国三及以上": "国三", "国IV": "国四", "国4": "国四", "国V": "国五", "国Ⅴ": "国五", "国5": "国五", "国VI": "国六", "国Ⅵ": "国六", "国六": "国六", " 别的 ": "别的", "": "", None: ""}
    assert each(spark, list(standards), records.emission_standard) == list(standards.values())
    said = {"是": "是", "已抵押": "是", "有": "是", "否": "否", "未抵押": "否", "无": "否", "": "未知", "别的": "未知", None: "未知", "有 ；": "是"}
    assert each(spark, list(said), records.mortgage) == list(said.values())
    longer = {"3、是否抵押：否（如有抵押）": "否", "3、是否抵押：是": "是", "抵押：未抵押；": "否", "抵押：无抵押 ；": "否", "（没有此项）": "未知", None: "未知"}
    assert each(spark, list(longer), records.mortgage_in) == list(longer.values())
    days = {"2015/2/11": "2015-02-11", "2018-05-17": "2018-05-17", "2015.2.11": "2015-02-11", "2018年3月6日": "2018-03-06", "2018年3月6": "2018-03-06", "不详": "", "": "", None: "", "x 2015/2/11": ""}
    assert each(spark, list(days), records.normal_day) == list(days.values())


def test_fines(spark):
    texts = {"记录：0起，0分，0元；": (0, 0, 0), "记录：7起，0分，300元，以实际为准；": (7, 0, 300), "京内1起，1分，100元；京外2起；": (3, 1, 100), "记录：1起，200元；": (1, 0, 200), "（没有）": (0, 0, 0), "3 起 2 分 50 元": (3, 2, 50), None: (0, 0, 0)}
    assert [tuple(x) for x in each(spark, list(texts), records.fines)] == list(texts.values())


def test_fees(spark):
    texts = {"停车费 3011元": [3011], "维修费11378元，停车费2715元，共计14093元": [14093], "停车费960元、维修费4015元，共计约4975元": [4975], "车辆的费用共计16132元由竞买人负担（其中12980元汇入一处，3152元汇入另一处）": [16132], "维修费用4100元、停车费用约12768元": [4100, 12768], "": [], None: []}
    assert each(spark, list(texts), records.fee_amounts) == list(texts.values())
    assert each(spark, list(texts), records.fee_total) == [float(sum(v)) for v in texts.values()]


def test_best_track(spark):
    rows = [(1, "en", "English", 0), (1, "zh-Hans", "简体", 1), (1, "zh-CN", "", 2), (2, "fr", "", 0), (2, "en-US", "", 1), (3, "ai-zh", "中文（自动）", 1), (3, "zh-Hans", "", 0), (4, "de", None, 1), (4, "fr", None, 0)]
    df = spark.createDataFrame(rows, "v int, lan string, lan_doc string, place int")
    assert {r.v: r.lan for r in transcripts.best_track(df, "v", name="lan_doc").collect()} == {1: "zh-CN", 2: "en-US", 3: "ai-zh", 4: "fr"}


def test_transcript_markdown(spark):
    df = spark.createDataFrame([(1, "a", 0.0, "x"), (1, "a", 65.2, "y"), (1, None, 3700.0, "z"), (2, None, 5.0, None)], "r int, chapter string, at double, said string")
    got = {r.r: r.markdown for r in transcripts.as_markdown(df, "r", "chapter", "at", "said").collect()}
    assert got == {1: "### a\n\n- `00:00` x\n- `01:05` y\n\n### 其他片段\n\n- `1:01:40` z", 2: "- `00:05` "}


def test_comment_callouts(spark):
    reply = "array<struct<user_open_id string, reply_text string>>"
    rows = [("d", 1, "2024", True, [("u", "a\nb"), (None, "c")]), ("d", 2, None, None, [("v", "")]), ("d", 3, "2024", False, []), ("e", 4, "2024", False, None)]
    df = spark.createDataFrame(rows, f"doc_token string, comment_id int, create_time string, is_solved boolean, replies {reply}")
    got = {r.doc_token: (r.markdown, r.n_comments) for r in blocks.comment_callouts(df).collect()}
    assert got["d"] == ("---\n\n## 评论\n\n> [!success]+ u · 2024\n> a\n> b\n>\n> **匿名**\n> c\n\n> [!quote]+ v · ", 3)
    assert got["e"] == ("", 1)
