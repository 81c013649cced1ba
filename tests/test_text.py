"""Tokens, splits, overlaps, question understanding, evidence: worked examples."""

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.functions import understanding as U
from chunkloom.functions import vectors as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    got = one(spark, T.token_set(F.lit("支持什么语音助手")))
    assert {"支持什么语音助手", "语音助手", "支持"} <= set(got)
    assert one(spark, T.token_set(F.lit("Größe 7 OK"))) == ["gr", "e", "7", "ok"]
    assert one(spark, T.term_bag(F.lit("语音 a a"))) == ["a", "a", "语音", "语音"]
    assert one(spark, T.token_set(F.lit("猫"))) == ["猫"]


def test_splits(spark):
    assert one(spark, T.sentences(F.lit("A b. C!  D\nE；f"))) == ["A b.", "C!", "D", "E；", "f"]
    assert one(spark, T.paragraphs(F.lit("a\n \n b\nc\n\n\n"))) == ["a", "b\nc"]
    assert one(spark, T.normal_lines(F.lit("  a \r\n\n\n\n b  \n"))) == "a\n\nb"


def test_labels(spark):
    assert one(spark, T.reader_section(F.lit(3), F.lit("page_3"))) == "" and one(spark, T.reader_section(F.lit(2), F.lit("page_3"))) == "第3页"
    assert one(spark, T.reader_section(F.lit(None).cast("int"), F.lit("Slide_4"))) == "第4张" and one(spark, T.reader_section(F.lit(1), F.lit("maintenance"))) == "maintenance"
    assert one(spark, T.reference_line(F.lit("x" * 50), F.lit(6), F.lit("sheet_2"))) == "x" * 20 + "..." + "x" * 17 + " · 第6页 · 工作表2"
    assert one(spark, T.cited_numbers(F.lit("b [3] a [1][3]"))) == [1, 3]
    assert one(spark, T.json_text(F.lit(None).cast("struct<a:int>"))) == ""


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1), ([1.0, 0.0], [0.0, 1.0], 0), ([1.0, 0.0], [-1.0, 0.0], -1), ([1.0], [1.0, 0.0], 0), ([0.0], [1.0], 0)])
def test_cosine(spark, a, b, want):
    assert one(spark, V.cosine(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))) == want


def test_parse(spark):
    assert [one(spark, V.parse(F.lit(x).cast("string"))) for x in ("[1, 2.5]", "", "{}", None)] == [[1.0, 2.5], [], [], []]


def understood(spark, *questions):
    rows = spark.createDataFrame(list(enumerate(questions)), "i int, question string")
    return [r.intent.asDict(True) for r in U.with_intent(rows).orderBy("i").collect()]


def test_rewrites(spark):
    got, chatty, none, blank = understood(spark, "扫地机器人支持什么语音助手", "我家里有小爱同学，不知道可以控扫地机器人吗", None, "  ")
    assert got["question_type"] == "list" and got["relation"] == "支持"
    forms = [(f["text"], f["weight"]) for f in got["forms"]]
    assert forms[:3] == [("扫地机器人支持什么语音助手", 1.0), ("扫地机器人 支持 语音助手", 0.96), ("扫地机器人 语音助手", 0.86)]
    assert {t for t, w in forms if w == 0.72} == {f"扫地机器人 {a} 语音助手" for a in ("兼容", "适用", "能用", "可以用")}
    assert forms[-1] == ("扫地机器人 语音助手 列表", 0.59) and len(forms) == 8
    said = " ".join(f["text"] for f in chatty["forms"])
    assert "小爱同学" in said and "扫地机器人" in said
    assert none["forms"] == [] and blank["question_type"] == "fact" and blank["normalized_query"] == ""


def test_terms_of_all_types(spark):
    """One question of each type: its terms in order, its relation, its two sides."""
    got = understood(spark, "多久清理一次主刷", "如何添加自定义地图", "APP支持哪些语言", "设备是否兼容天猫精灵吗？", "主刷寿命")
    assert [g["question_type"] for g in got] == ["frequency", "how_to", "list", "yes_no", "fact"]
    assert [g["relation"] for g in got] == ["", "设置", "支持", "支持", ""]
    assert got[0]["focus_terms"] == ["清理一次主刷", "一次主刷"] and got[4]["focus_terms"] == ["主刷寿命"]
    assert got[1]["focus_terms"][:4] == ["添加自定义地图", "自定义地图", "添加地图", "地图"]
    assert got[2]["subject_terms"] == ["app"] and got[2]["object_terms"] == ["语言"]
    assert got[3]["object_terms"] == ["天猫精灵"]


def test_each_relation(spark):
    """The longest alias of the first relation with one, in the order of the table."""
    for name, aliases in U.RELATIONS.items():
        first = {a: next(n for n, words in U.RELATIONS.items() if any(w in a for w in words)) for a in aliases}
        got = understood(spark, *[f"甲乙丙{a}丁戊己" for a in aliases])
        assert [g["relation"] for g in got] == [first[a] for a in aliases] and name in first.values()


@pytest.mark.parametrize("question, kind", [("多久清理一次", "frequency"), ("如何添加设备", "how_to"), ("有哪些功能", "list"), ("支持吗", "yes_no"), ("Is it?", "yes_no"), ("reset button", "fact")])
def test_types(spark, question, kind):
    assert one(spark, U.question_type(T.compact(F.lit(question)))) == kind


D1, D2, D3 = "本产品支持小爱同学、天猫精灵和 Google Assistant 等语音助手。", "维护保养时请定期清理主刷和边刷。", "扫地机器人和吸尘器怎么选？"


def scores(spark, question, texts):
    from chunkloom.operators import ranking as R

    q = U.with_intent(spark.createDataFrame([(1, question)], "question_id long, question string"))
    rows = spark.createDataFrame([(1, i, t, v) for i, (t, v) in enumerate(texts)], "question_id long, chunk_id long, content string, vector_score double")
    return [r.coarse_score for r in R.coarse_scores(rows.join(q, "question_id")).orderBy("chunk_id").collect()]


def test_coarse_order(spark):
    first, second = scores(spark, "支持什么语音助手", [(D1, 0.62), (D2, 0.66)])
    assert first > second
    first, second = scores(spark, "扫地机器人支持什么语音助手", [(D1, 0.62), (D3, 0.76)])
    assert first > second
    first, second = scores(spark, "我家里有小爱同学，不知道可以控扫地机器人吗", [("常见的有小爱同学、天猫精灵、Google Assistant 等语音助手。", 0.56), ("扫地机器人一般通过 APP 或按键操作，可以进行清扫和返回充电。", 0.68)])
    assert first > second


def test_overlaps(spark):
    assert one(spark, T.keyword_overlap(F.lit("a b c d"), F.lit("b d e"))) == 0.5
    assert one(spark, T.phrase_overlap(F.lit("支持 语音"), F.lit("可以支持语音助手"))) == 1.0 and one(spark, T.phrase_overlap(F.lit(""), F.lit("x"))) == 0.0
