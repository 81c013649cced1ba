"""From ranked chunks to an answer: context, citations, reference lines, decision path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.functions import understanding as U

MOST_CHUNK, MOST_CONTEXT, LEAST_REST = 2000, 12_000, 200
WEAK, SURE_EVIDENCE, SURE_RELATION = 0.55, 0.92, 0.55
CUT_MARK = "\n...[内容过长已截断]...\n"


def context_blocks(hits: DataFrame) -> DataFrame:
    """hits(question_id, rank, document_name, source_page, source_section, score, content) -> rank, header, content, used: numbered blocks up to MOST_CONTEXT characters."""
    section = T.reader_section("source_page", "source_section")
    header = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] "),
        F.concat_ws(" | ", T.filled(F.coalesce(F.col("document_name"), F.lit(T.UNKNOWN_DOCUMENT))), F.concat(F.lit("第"), F.col("source_page").cast("string"), F.lit("页")), F.concat(F.lit("章节："), T.filled(section)), F.when(F.col("score") > 0, F.concat(F.lit("相关度:"), T.two_places("score")))),
    )
    body = T.strip("content")
    short = F.when(F.length(body) > MOST_CHUNK, F.concat(F.left(body, F.lit(MOST_CHUNK // 2)), F.lit(CUT_MARK), F.right(body, F.lit(MOST_CHUNK // 2)))).otherwise(body)
    w = Window.partitionBy("question_id").orderBy("rank")
    sized = hits.select("question_id", "rank", header.alias("header"), short.alias("content")).withColumn("n", F.length("header") + 1 + F.length("content"))
    after = sized.withColumn("after", F.sum("n").over(w))
    broken = F.max((F.col("after") > MOST_CONTEXT).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    placed = after.withColumn("broken", F.coalesce(broken, F.lit(0))).where("broken = 0")
    rest = F.lit(MOST_CONTEXT) - (F.col("after") - F.col("n"))
    kept = placed.withColumn("content", F.when(F.col("after") > MOST_CONTEXT, F.when(rest > LEAST_REST, F.substr("content", F.lit(1), rest))).otherwise(F.col("content")))
    return kept.where("content is not null").select("question_id", "rank", "header", "content")


def context(blocks: DataFrame) -> DataFrame:
    """question_id, context: the blocks one under the other."""
    own = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws("\n", "header", "content").alias("b"))))
    return blocks.groupBy("question_id").agg(F.array_join(F.transform(own, lambda x: x.b), "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    """One citation for each document, page and section: its best chunk (the first of equals), how many there are, 300 characters."""
    shown = hits.withColumn("page", T.page_number("source_page")).withColumn("section", T.reader_section("source_page", "source_section"))
    best = F.max_by(F.struct("document_name", "chunk_id", "chunk_index", "content"), F.struct("score", -F.col("rank")))
    grouped = shown.groupBy("question_id", "document_id", "page", "section").agg(best.alias("best"), F.max("score").alias("score"), F.count(F.lit(1)).alias("chunk_count"), F.min("rank").alias("first"))
    clean = F.left(F.regexp_replace(T.strip(F.col("best.content")), "\n{3,}", "\n\n"), F.lit(300))
    rows = grouped.select("question_id", "document_id", "best.document_name", "best.chunk_id", "best.chunk_index", F.col("page").alias("source_page"), F.col("section").alias("source_section"), "score", clean.alias("content"), "chunk_count", "first")
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("score"), F.asc("first")))
    return rows.withColumn("place", place).drop("first")


def reference_lines(cited: DataFrame) -> DataFrame:
    """question_id, number, line: references without repeats of a document and page, numbered in citation order."""
    first = F.row_number().over(Window.partitionBy("question_id", "document_id", "source_page").orderBy("place"))
    once = cited.withColumn("again", first).where("again = 1")
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("place"))
    return once.select("question_id", number.alias("number"), T.reference_line("document_name", "source_page", "source_section").alias("line"))


def complete_citations(answers: DataFrame, lines: DataFrame) -> DataFrame:
    """answers(question_id, answer) with references added: none if the answer has a reference block, the cited ones if it cites, else all."""
    listed = lines.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("lines"))
    both = answers.join(listed, "question_id", "left").withColumn("cited", T.cited_numbers("answer"))
    wanted = F.filter("lines", lambda x: (F.size("cited") == 0) | F.array_contains(F.col("cited"), x.number))
    shown = F.array_join(F.transform(wanted, lambda x: F.concat(F.lit("["), x.number.cast("string"), F.lit("] "), x.line)), "\n")
    done = F.rlike("answer", F.lit(r"(参考来源|参考文献|引用来源|资料来源)\s*[：:]"))
    return both.select("question_id", F.when(done | F.coalesce(F.size(wanted) == 0, F.lit(True)), F.col("answer")).otherwise(F.concat(F.col("answer"), F.lit("\n\n参考来源：\n"), shown)).alias("answer"))


def verdicts(questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """questions(question_id, intent) and their contexts(context, top_score) -> evidence, relation, conflict, weak."""
    both = questions.join(contexts, "question_id", "left").withColumn("normal", T.compact("context"))
    related = both.withColumn("relation_score", U.relation_evidence(F.col("intent"), F.col("normal")))
    scored = related.withColumn("evidence_score", U.evidence(F.col("intent"), F.col("normal"), F.col("relation_score")))
    conflict = (F.col("intent.question_type") == "yes_no") & U.any_in(F.col("normal"), U.SUPPORT) & U.any_in(F.col("normal"), U.UNSUPPORTED)
    return scored.withColumn("conflict", conflict).withColumn("weak", F.coalesce(F.col("top_score") < WEAK, F.lit(True)))


def decision_path(strict: bool = True) -> Column:
    """How an answer is to be made, from the columns of `verdicts`."""
    direct = (F.size("intent.focus_terms") > 0) & (F.col("evidence_score") >= SURE_EVIDENCE) & ~F.col("conflict")
    direct &= (F.col("intent.question_type") != "yes_no") | (F.col("intent.relation") == "") | (F.col("relation_score") >= SURE_RELATION)
    path = F.when(F.coalesce(F.col("context"), F.lit("")) == "", "refuse_no_context" if strict else "llm_generate").when(direct, "direct_grounded_answer")
    return path.when(F.col("weak"), "llm_weak_evidence").when(F.col("conflict"), "llm_with_conflict").otherwise("llm_generate")


def instruction_state(strict: Column | bool = True) -> Column:
    """Which instruction an answer gets, from context and weak of `verdicts`: grounded, weak_strict, weak_open, none_strict or none_open."""
    strict = F.lit(strict) if isinstance(strict, bool) else strict
    kind = F.when(T.strip(F.coalesce(F.col("context"), F.lit(""))) == "", "none").when(F.col("weak"), "weak").otherwise("grounded")
    return F.when(kind == "grounded", kind).otherwise(F.concat(kind, F.when(strict, F.lit("_strict")).otherwise(F.lit("_open"))))


#: What the instructions say, by state, by question type and for several sources; callers may hand in wordings of their own.
WORDING = {
    "grounded": "Answer from the passages only and cite them as [1][2].", "weak_strict": "The passages hardly bear on the question: say so, list what may help as reference only, conclude nothing.",
    "weak_open": "The passages hardly bear on the question: say so, list what may help, mark what you add as not from the knowledge base.", "none_strict": "Nothing was found: say so, invent nothing, cite nothing.",
    "none_open": "Nothing was found: say so first, mark what you add as not from the knowledge base, cite nothing.",
    "yes_no": "First a plain yes or no, then the ground for it, then limits.", "list": "A summarising sentence, then numbered items of one line each.", "how_to": "The aim in a sentence, then numbered steps of one action each.",
    "frequency": "First how often, then the ground for it.", "fact": "First the fact, then details.", "several": "Merge the sources, say each thing once, name contradictions.",
}


def instructions(judged: DataFrame, strict: bool = True, wording: dict[str, str] | None = None) -> DataFrame:
    """judged(question_id, intent, context, weak, n_sources) -> question_id, state, style, several, instruction: state, then style by question type, then several sources.

    A question without context that must not be answered freely gets neither style nor a word on sources; only grounded answers are told of several sources.
    """
    said = F.create_map(*[F.lit(x) for pair in (wording or WORDING).items() for x in pair])
    parts = judged.select("question_id", instruction_state(strict).alias("state"), F.col("intent.question_type").alias("type"), F.coalesce("n_sources", F.lit(0)).alias("n"))
    parts = parts.withColumn("style", F.when(F.col("state") == "none_strict", "").otherwise(F.col("type"))).withColumn("several", (F.col("state") == "grounded") & (F.col("n") >= 2))
    text = F.concat_ws("\n", F.try_element_at(said, F.col("state")), F.try_element_at(said, F.col("style")), F.when(F.col("several"), F.try_element_at(said, F.lit("several"))))
    return parts.select("question_id", "state", "style", "several", text.alias("instruction"))


def snippet(intent: Column, text: Column) -> Column:
    """The first line that holds a focus term (terms in order), else the first line; 220 characters."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), T.strip), lambda s: s != "")
    holding = F.flatten(F.transform(intent.focus_terms, lambda t: F.filter(lines, lambda s: F.contains(T.compact(s), t))))
    return F.left(F.coalesce(F.get(holding, F.lit(0)), F.get(lines, F.lit(0)), F.lit("")), F.lit(220))


def numbered_list(x: Column) -> Column:
    """Items parted by 、 as numbered lines under their heading."""
    parts = F.split(x, "[：:]", 2)
    head = F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).otherwise(F.lit("知识库中列出的相关内容"))
    body = F.when(F.size(parts) == 2, F.get(parts, F.lit(1))).otherwise(x)
    items = F.filter(F.transform(F.split(F.regexp_replace(T.strip(body), "[。.!！]+$", ""), "[、,，]", -1), T.strip), lambda s: s != "")
    lines = F.array_join(F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    return F.when(F.contains(x, F.lit("、")) & (F.size(items) >= 2), F.concat(head, F.lit("：\n"), lines)).otherwise(x)


def numbered_steps(x: Column) -> Column:
    """Up to five sentences of step-wise wording as numbered steps."""
    steps = F.filter(F.transform(F.split(x, "[。.;；]", -1), T.strip), lambda s: s != "")
    told = U.any_in(x, ("首先", "第一步", "步骤1", "步骤一", "1、", "1."))
    lines = F.array_join(F.transform(F.slice(steps, 1, 5), lambda s, i: F.concat(F.lit("步骤"), (i + 1).cast("string"), F.lit("："), s)), "\n")
    return F.when(told & (F.size(steps) >= 2), F.concat(F.lit("可以按以下步骤操作：\n"), lines)).otherwise(x)


def direct_answer(intent: Column, text: Column, conflict: Column) -> Column:
    """The answer that the context itself gives; '' where it gives none. Only for rows on the direct path."""
    term = F.coalesce(F.get(intent.focus_terms, F.lit(0)), F.lit(""))
    window = U.around(T.compact(text), term, 120)
    yes_no = F.when(conflict, "").when(U.any_in(window, U.UNSUPPORTED), F.concat(F.lit("不支持"), term, F.lit("。\n依据：知识库上下文中明确提到不支持或不兼容"), term, F.lit("。")))
    yes_no = yes_no.when(U.any_in(window, U.SUPPORT), F.concat(F.lit("支持"), term, F.lit("。\n依据：知识库上下文中已将"), term, F.lit("列为支持项目。"))).otherwise("")
    said = snippet(intent, text)
    often = F.regexp_extract(said, U.FREQUENCY_CUE, 0)
    told = F.when(intent.question_type == "frequency", F.when(often != "", F.concat(F.lit("建议"), often, F.lit("。\n依据："), said)).otherwise(F.concat(F.lit("知识库中提到："), said)))
    told = told.when(intent.question_type == "how_to", F.concat(F.lit("可以按知识库中的说明操作：\n"), numbered_steps(said))).when(intent.question_type == "list", F.concat(F.lit("知识库中列出的相关内容：\n"), numbered_list(said))).otherwise(F.concat(F.lit("知识库中提到："), said))
    return F.when(F.size(intent.focus_terms) == 0, "").when(intent.question_type == "yes_no", yes_no).when(said == "", "").otherwise(told)
