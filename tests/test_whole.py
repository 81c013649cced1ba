"""Operators that must not cut what they are given."""

from chunkloom.operators import chunking as C
from chunkloom.operators import records as D
from chunkloom.plans.queries import QUERIES
from chunkloom.streaming.imports import import_batch


def test_history_keeps_whole_messages(spark):
    long = "word " * 400 + "end"
    rows = spark.createDataFrame([(1, 1, "user", long), (1, 0, "system", "s" * 130)], "session_id long, turn int, role string, content string")
    assert [r.history for r in D.chat_history(rows).collect()] == ["system: " + "s" * 130 + "\nuser: " + long]


def test_scopes_grow_with_the_tables(spark):
    """Questions of every user, and hits in documents beyond any fixed id."""
    for name in ("q_vector_topk_by_user", "q_bm25_by_user"):
        got = QUERIES[name](spark, "/root/testdata/sf0.01").select("question_id", "chunk_id").collect()
        assert {r.question_id % 3 for r in got} == {0, 1, 2} and all(r.question_id % 3 == r.chunk_id // 4 % 3 for r in got)
        assert max(r.chunk_id // 4 for r in got) >= 60


def test_import_cuts_markdown_tables_by_rows(spark):
    rows = [f"| {i} | {'x' * 60} |" for i in range(30)]
    text = "\n".join(["# Stock", "All goods of the store.", "", "| id | name |", "| --- | --- |", *rows, "", "Told once a year.", "# Notes", "Nothing else."])
    files = spark.createDataFrame([("/a/stock.md", "md", bytearray(text.encode())), ("/a/plain.txt", "txt", bytearray(b"Plain words."))], "path string, file_type string, content binary")
    got = sorted((r for r in import_batch(files).collect() if r.document_id.endswith("stock.md")), key=lambda r: r.chunk_index)
    assert [r.block_type for r in got if r.chunk_role == "parent"] == ["text", "table", "text", "text"] and [r.chunk_index for r in got] == list(range(len(got)))
    table = [r for r in got if r.block_type == "table" and r.chunk_role == "leaf"]
    assert len(table) > 1 and all(r.content.startswith("| id | name |\n| --- | --- |\n| ") and "表格" in r.retrieval_content for r in table)
    assert [x for r in table for x in r.content.split("\n")[2:]] == rows
    assert [i for r in table for i in range(r.table_row_from, r.table_row_to + 1)] == list(range(1, 31))
    assert all(r.table_row_from is None for r in got if r.block_type == "text")
    assert import_batch(files).where("document_id like '%plain.txt'").count() == 2


def test_hierarchy_of_sheets_and_semantic_option(spark):
    sheet = "a | b\n" + "\n".join(f"{i} | {'y' * 80}" for i in range(20))
    prose = "Alpha one. Alpha two. Beta one. Beta two."
    rows = [(1, 0, "S", "table", sheet, None), (2, 0, "T", "text", prose, [0.9, 0.1, 0.9]), (3, 0, "T", "text", prose, [0.9]), (4, 0, "T", "text", prose, None), (5, 0, "T", "text", "One.", [])]
    segments = spark.createDataFrame(rows, "document_id long, segment int, title string, kind string, text string, similar array<double>")

    def leaves(document, **how):
        return [r.content for r in sorted(C.hierarchy(segments, 500, 0, **how).where(f"document_id = {document} and chunk_role = 'leaf'").collect(), key=lambda r: r.chunk_index)]

    assert len(leaves(1)) > 1 and all(x.startswith("a | b\n") for x in leaves(1))
    assert leaves(2) == [prose] and leaves(2, use_semantic=True) == ["Alpha one. Alpha two.", "Beta one. Beta two."]
    assert [leaves(i, use_semantic=True) for i in (3, 4, 5)] == [[prose], [prose], ["One."]]
