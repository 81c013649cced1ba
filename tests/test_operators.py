"""Ranking, chunking, answers, parsing and imports on small examples."""

import re

import pytest
from pyspark.sql import functions as F

from chunkloom.functions import understanding as U
from chunkloom.operators import answers as A
from chunkloom.operators import chunking as C
from chunkloom.operators import neighbours as N
from chunkloom.operators import ranking as R
from chunkloom.operators import records as D
from chunkloom.sources import indexes, parsers, plugins
from chunkloom.streaming import imports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_vector_order(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0])], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(7, [0.99, 0.01]), (8, None)], "question_id long, question_vector array<double>")
    got = N.exact(asked, vectors, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [0, 1] and got[0].vector_score > got[1].vector_score


def test_reciprocal_ranks(spark):
    lists = [spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(names)], "question_id long, chunk_id string, rank int") for names in (["semantic", "literal", "other"], ["literal", "semantic", "keyword"])]
    got = {r.chunk_id: r.rrf_score for r in R.reciprocal_rank_fusion(lists).collect()}
    assert abs(got["semantic"] - got["literal"]) < 1e-12 and got["semantic"] > max(got["other"], got["keyword"])
    with pytest.raises(ValueError):
        R.reciprocal_rank_fusion(lists, -1)


def test_model_fusion(spark):
    hits = spark.createDataFrame([(1, 10, 0.90, 1, 0.10), (1, 11, 0.70, 2, 0.95)], "question_id long, chunk_id long, rule_score double, rank int, model_score double")
    assert [r.chunk_id for r in R.fuse_scores(hits, 2, model=0.8, rule=0.2).orderBy("rank").collect()] == [11, 10]
    assert R.shares(0, 0) == (0.65, 0.35)


def test_bm25_is_empty_without_chunks(spark):
    chunks = spark.createDataFrame([], "chunk_id long, chunk_index long, content string")
    asked = spark.createDataFrame([(1, "a b")], "question_id long, question string")
    assert R.bm25(chunks, R.question_terms(asked)).count() == 0


def test_packing(spark):
    assert one(spark, C.long_unit(F.lit("Aa bb. Cc dd. Ee ff."), 13)) == ["Aa bb. Cc dd.", "Ee ff."]
    assert one(spark, C.long_unit(F.lit("x" * 25), 10)) == ["x" * 10, "x" * 10, "x" * 5]
    assert one(spark, C.tail(F.lit("One two. Three four."), 5)) == "Three four." and one(spark, C.tail(F.lit("abcdef"), 3)) == "def"
    assert one(spark, C.heuristic_chunks(F.lit("First paragraph.\n\nSecond paragraph."), 500, 0)) == ["First paragraph.\n\nSecond paragraph."]
    got = one(spark, C.heuristic_chunks(F.lit("\n\n".join(f"Paragraph {i} " + "word " * 20 + "end." for i in range(6))), 200, 30))
    assert len(got) > 2 and all(f"Paragraph {i} " in " ".join(got) for i in range(6))
    with pytest.raises(ValueError):
        C.check(10, 10)


def test_breaks(spark):
    assert one(spark, C.breakpoints(F.array(*map(F.lit, (0.91, 0.88, 0.31, 0.86))), 25)) == [2]
    assert one(spark, C.breakpoints(F.array().cast("array<double>"))) == []
    four = F.array(*map(F.lit, ("Alpha one.", "Alpha two.", "Beta one.", "Beta two.")))
    assert one(spark, C.semantic_chunks(four, F.array(F.lit(1)), 500, 0)) == ["Alpha one. Alpha two.", "Beta one. Beta two."]


def test_tables(spark):
    rows = [f"| {i} | value |" for i in range(30)]
    got = one(spark, C.table_chunks(F.array(*map(F.lit, ["| a | b |", "| --- | --- |", *rows]))))
    assert [(r.row_from, r.row_to) for r in got] == [(1, 12), (13, 24), (25, 30)] and all(r.text.startswith("| a | b |\n| --- | --- |\n") for r in got)
    got = one(spark, C.table_chunks(F.array(F.lit("| a | b |"))))
    assert [(r.text, r.row_from, r.row_to) for r in got] == [("| a | b |", 1, 1)]


def test_parents_take_their_best_leaf(spark):
    hits = spark.createDataFrame([(1, 5, 0.9, 0.8, 0.1, 1, True), (1, 6, 0.4, 0.2, 0.7, 2, False), (1, 7, 0.3, 0.1, 0.2, 3, False)], "question_id long, chunk_id long, final_score double, vector_score double, keyword_score double, rank int, by_vector boolean")
    leaves = spark.createDataFrame([(5, 50, "five"), (6, 50, "six"), (7, None, "seven")], "chunk_id long, parent_chunk_id long, content string")
    parents = spark.createDataFrame([(50, "fifty")], "parent_chunk_id long, parent_content string")
    got = R.small_to_big(hits, leaves, parents, 5).orderBy("rank").collect()
    assert [(r.unit_id, r.unit_content, r.matched_child, r.keyword_score) for r in got] == [(50, "fifty", 5, 0.7), (7, "seven", 7, 0.2)]
    got = R.small_to_big(hits, leaves, parents, 5, carry_parent=False).orderBy("rank").collect()
    assert [r.unit_id for r in got] == [5, 50, 7]


def test_citations(spark):
    rows = [(1, 1, "m.pdf", 9, 1, 0, 6, "page_6", 0.9, "a"), (1, 2, "m.pdf", 9, 2, 1, 6, "page_6", 0.8, "b"), (1, 3, "m.pdf", 9, 3, 2, 7, "page_7", 0.7, "c")]
    hits = spark.createDataFrame(rows, "question_id long, rank int, document_name string, document_id long, chunk_id long, chunk_index long, source_page int, source_section string, score double, content string")
    cited = A.citations(hits)
    assert [(r.chunk_id, r.chunk_count, r.source_section) for r in cited.orderBy("place").collect()] == [(1, 2, ""), (3, 1, "")]
    lines = A.reference_lines(cited)
    assert [r.line for r in lines.orderBy("number").collect()] == ["m.pdf · 第6页", "m.pdf · 第7页"]
    told = spark.createDataFrame([(1, "As in [2].")], "question_id long, answer string")
    assert A.complete_citations(told, lines).first().answer == "As in [2].\n\n参考来源：\n[2] m.pdf · 第7页"
    kept = spark.createDataFrame([(1, "x\n参考来源：y")], "question_id long, answer string")
    assert A.complete_citations(kept, lines).first().answer == "x\n参考来源：y"
    assert A.context(A.context_blocks(hits)).first().context.startswith("[1] m.pdf | 第6页 | 相关度:0.90\na\n\n[2]")


def test_long_contexts_are_cut(spark):
    rows = [(1, i, "n", 1, "", 0.5, "x" * 5000) for i in range(1, 12)]
    blocks = A.context_blocks(spark.createDataFrame(rows, "question_id long, rank int, document_name string, source_page int, source_section string, score double, content string")).orderBy("rank").collect()
    assert A.CUT_MARK in blocks[0].content and sum(len(b.header) + 1 + len(b.content) for b in blocks) <= A.MOST_CONTEXT + 40


def test_scores_are_shown_by_their_binary_value(spark):
    shown = [k / 1000 for k in range(5, 1000, 5)] + [0.7449999, 0.745001, 0.9999, 1.0]  # 0.125 is an exact half, 0.745 lies below the half that it is written as
    rows = [(i, 1, "n", 1, "", x, "a") for i, x in enumerate(shown)]
    blocks = A.context_blocks(spark.createDataFrame(rows, "question_id long, rank int, document_name string, source_page int, source_section string, score double, content string"))
    assert {r.question_id: r.header for r in blocks.collect()} == {i: f"[1] n | 第1页 | 相关度:{x:.2f}" for i, x in enumerate(shown)}


def test_paths(spark):
    asked = spark.createDataFrame([(1, "从哪里购买"), (2, "是否支持小爱同学")], "question_id long, question string")
    contexts = spark.createDataFrame([(2, "本产品支持小爱同学等语音助手。", 0.9)], "question_id long, context string, top_score double")
    got = A.verdicts(U.with_intent(asked), contexts).select("question_id", A.decision_path().alias("path"), A.direct_answer(F.col("intent"), F.col("context"), F.col("conflict")).alias("answer"))
    got = {r.question_id: r for r in got.collect()}
    assert got[1].path == "refuse_no_context" and got[2].path == "direct_grounded_answer" and got[2].answer.startswith("支持小爱同学。")


def test_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("intro\n# One\nx\n\n\n\ny\n## Two\n")
    (tmp_path / "b.TXT").write_text("  hello \n")
    (tmp_path / "c.exe").write_text("?")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    got = {r.path.rsplit("/", 1)[1]: r for r in parsers.parse_files(spark, str(tmp_path)).collect()}
    assert got["a.md"].full_text == "[章节] 正文\nintro\n\n[章节] One\nx\n\ny" and [s.section for s in got["a.md"].sections] == ["正文", "One"]
    assert got["b.TXT"].full_text == "hello" and got["c.exe"].error == "unsupported file type" and got["d.pdf"].error


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("First paragraph. Second paragraph. Third paragraph. " * 40)
    (tmp_path / "in" / "copy.txt").write_text("First paragraph. Second paragraph. Third paragraph. " * 40)
    imports.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(90)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("chunk_index").collect()
    assert len({r.document_id for r in rows}) == 1 and [r.chunk_index for r in rows] == list(range(len(rows))) and rows[0].chunk_role == "parent"


def test_embedding_falls_back_to_smaller_batches(spark):
    class Picky:
        def __call__(self, texts):
            if len(texts) > 4 or any("bad" in t for t in texts):
                raise RuntimeError("no")
            return [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, "bad" if i == 3 else "" if i == 5 else "x" * i) for i in range(1, 20)], "id long, content string").coalesce(1)
    got = {r.id: r for r in plugins.embed(rows, "content", Picky()).collect()}
    assert got[3].error == "no" and got[3].vector is None and got[5].vector is None and got[5].error is None and got[7].vector == [7.0]


def test_index_tables(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5, [1.0]), (2, 6, [2.0])], "user_id int, chunk_id long, vector array<double>")
    indexes.write_index(rows, str(tmp_path / "i"))
    indexes.write_index(rows.where("user_id = 1").withColumn("chunk_id", F.lit(9).cast("long")), str(tmp_path / "i"))
    assert sorted(r.chunk_id for r in indexes.read_index(spark, str(tmp_path / "i")).collect()) == [6, 9] and indexes.read_index(spark, str(tmp_path / "i"), 2).count() == 1


def test_runs(spark):
    steps = spark.createDataFrame([(1, 1, "running"), (1, 2, "completed"), (2, 3, "running")], "run_id long, step_id long, status string")
    got = D.fail_open_steps(steps, spark.createDataFrame([(1,)], "run_id long")).orderBy("step_id")
    assert [r.status for r in got.collect()] == ["failed", "completed", "running"]
    assert one(spark, D.progress(F.lit("embedding"), F.lit(5), F.lit(10))) == 60 and one(spark, D.progress(F.lit("upload_failed"), F.lit(5), F.lit(10))) is None


def test_guarded_search(spark):
    """Hits whose words speak for them stand, twice as many; else the first k with a positive score."""
    asked = spark.createDataFrame([(1, "reset button"), (2, "voice"), (3, "")], "question_id long, question string")
    near = spark.createDataFrame([(q, q * 10 + i, s, i) for q in (1, 2, 3) for i, s in ((1, 0.9), (2, 0.5), (3, -0.1), (4, -0.2), (5, -0.3))], "question_id long, chunk_id long, vector_score double, rank int")
    tokens = spark.createDataFrame([(q * 10 + i, ["press", "reset"] if q == 1 and i == 3 else ["other"]) for q in (1, 2, 3) for i in range(1, 6)], "chunk_id long, tokens array<string>")
    got = sorted((r.question_id, r["rank"]) for r in N.guarded(asked, near, tokens, 2).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2), (3, 1), (3, 2)]


def test_instructions(spark):
    """Every state of evidence with every question type, strict and free."""
    kinds = ["yes_no", "list", "how_to", "frequency", "fact"]
    rows = [(f"{k}-{c}", (k,), text, weak, n) for k in kinds for c, text, weak, n in (("grounded", "x", False, 3), ("weak", "x", True, 3), ("none", " ", True, None))]
    judged = spark.createDataFrame(rows, "question_id string, intent struct<question_type:string>, context string, weak boolean, n_sources long")
    for strict in (True, False):
        for r in A.instructions(judged, strict).collect():
            kind, state = r.question_id.split("-")
            want = state if state == "grounded" else f"{state}_{'strict' if strict else 'open'}"
            assert r.state == want and r.style == ("" if want == "none_strict" else kind) and r.several == (want == "grounded")
            assert r.instruction.split("\n") == [A.WORDING[x] for x in (want, r.style, "several" if r.several else "") if x]


def test_probe_and_owner(spark):
    keys = spark.createDataFrame([(1, 5), (2, 5), (None, 5)], "id long, user_id long")
    rows = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (2, 6, "c")], "id long, user_id long, name string")
    assert sorted((str(r.id), r.in_use) for r in D.has_rows(keys, rows, "id").collect()) == [("1", True), ("2", True), ("None", False)]
    assert sorted((str(r.id), r.name or "", r.status) for r in D.owned(keys, rows, "id", "user_id").collect()) == [("1", "a", 200), ("1", "b", 200), ("2", "", 404), ("None", "", 404)]


def test_small_tables_are_dealt_to_all_cores(spark, tmp_path):
    from chunkloom.sources import tables

    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    assert tables.spread(one).count() == 100 and "RoundRobin" in tables.spread(one)._jdf.queryExecution().toString()
    spark.range(100).repartition(16).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert tables.spread(many) is many


def test_keyword_tasks_grow_with_the_tables(spark, monkeypatch):
    """Chunks times questions decide how many tasks score them, not bytes; the scores are the same with any number."""
    chunks = spark.range(2000).selectExpr("id as chunk_id", "id % 4 as chunk_index", "concat('lamp ', id % 7, ' stone') as content")
    asked = spark.range(4000).selectExpr("id as question_id", "concat('lamp ', id % 5) as question")
    plan = R.bm25(chunks, R.question_terms(asked))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(chunk_id#\d+L?, 8\), REPARTITION_BY_NUM", plan)  # 8 million pairs
    terms = R.question_terms(asked.limit(3))
    before = sorted(map(tuple, R.bm25(chunks, terms).collect()))
    monkeypatch.setattr(R, "TASK_PAIRS", 400)
    assert sorted(map(tuple, R.bm25(chunks, terms).collect())) == before and len(before) == 6000
