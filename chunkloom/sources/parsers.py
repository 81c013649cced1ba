"""Files -> parsed documents: full_text, pages, sections, metadata."""

from __future__ import annotations

import importlib.util
import io

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T
from chunkloom.operators import chunking as C

#: The file types that are read.
ALLOWED = ("txt", "md", "pdf", "docx", "xlsx", "xls", "pptx")
#: Libraries that the binary formats need; without them their files are reported as errors.
NEEDS = {"pdf": "pypdf", "docx": "docx", "xlsx": "openpyxl", "xls": "xlrd", "pptx": "pptx"}
PARSED = "path string, file_type string, full_text string, pages array<struct<page:int,text:string,section:string>>, sections array<struct<section:string,text:string>>, error string"


def file_type(name: Column | str) -> Column:
    """Lower-cased last suffix if it is one that is read, else NULL."""
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return F.when(kind.isin(*ALLOWED), kind)


def markdown_sections(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, number, section, text: Markdown cut at its headings; what stands before the first is the section 正文."""
    lines = texts.select(key, F.posexplode(F.split(T.normal_lines(text), "\n", -1)).alias("at", "line"))
    heading = F.rlike("line", F.lit(r"^#{1,6}\s+.*$"))
    numbered = lines.withColumn("number", F.sum(heading.cast("int")).over(Window.partitionBy(key).orderBy("at")))
    title = F.max(F.when(heading, T.strip(F.regexp_extract("line", r"^#{1,6}\s+(.*)$", 1))))
    body = F.array_sort(F.collect_list(F.when(~heading, F.struct("at", "line"))))
    joined = T.strip(F.array_join(F.transform(body, lambda x: x.line), "\n"))
    return numbered.groupBy(key, "number").agg(F.coalesce(title, F.lit("正文")).alias("section"), joined.alias("text")).where("text <> ''")


def section_text(sections: DataFrame, key: str) -> DataFrame:
    """key, full_text: sections under their labels, parted by blank lines."""
    own = F.array_sort(F.collect_list(F.struct("number", F.concat(F.lit("[章节] "), "section", F.lit("\n"), "text").alias("t"))))
    return sections.groupBy(key).agg(F.array_join(F.transform(own, lambda x: x.t), "\n\n").alias("full_text"))


def _binary(kind: str, data: bytes) -> tuple[list[dict], list[dict]]:
    """Pages and sections of a binary file, by the format's own library."""
    if kind == "pdf":
        from pypdf import PdfReader

        texts = [(p.extract_text() or "").strip() for p in PdfReader(io.BytesIO(data)).pages]
        return [{"page": i + 1, "text": t, "section": f"page_{i + 1}"} for i, t in enumerate(texts) if t], []
    if kind == "pptx":
        from pptx import Presentation

        slides = ["\n".join(s.text.strip() for s in slide.shapes if getattr(s, "text", "").strip()) for slide in Presentation(io.BytesIO(data)).slides]
        return [{"page": i + 1, "text": t, "section": f"slide_{i + 1}"} for i, t in enumerate(slides) if t], []
    if kind == "docx":
        from docx import Document

        sections: list[dict] = []
        for p in Document(io.BytesIO(data)).paragraphs:
            if p.style.name.lower().startswith("heading") and p.text.strip():
                sections.append({"section": p.text.strip(), "text": ""})
            elif p.text.strip():
                sections = sections or [{"section": "正文", "text": ""}]
                sections[-1]["text"] = f"{sections[-1]['text']}\n{p.text.strip()}".strip()
        return [], [s for s in sections if s["text"]]
    if kind == "xlsx":
        from openpyxl import load_workbook

        sheets = [(s.title, [[c.value for c in row] for row in s.iter_rows()]) for s in load_workbook(io.BytesIO(data), data_only=True, read_only=True)]
    else:
        import xlrd

        book = xlrd.open_workbook(file_contents=data)
        sheets = [(s.name, [s.row_values(i) for i in range(s.nrows)]) for s in book.sheets()]
    rows = [(name, [" | ".join(str(c).strip() for c in row if c is not None and str(c).strip()) for row in cells]) for name, cells in sheets]
    return [], [{"section": name, "text": "\n".join(filter(None, lines))} for name, lines in rows if any(lines)]


def parse_files(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path. Text is decoded in the JVM; binary formats go through their libraries; other types are errors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return parse_rows(files.withColumn("file_type", file_type("path")))


def parse_rows(files: DataFrame) -> DataFrame:
    """files(path, file_type, content) -> PARSED."""
    from pyspark.sql.pandas.types import to_arrow_schema

    plain = files.where("file_type in ('txt', 'md')").withColumn("full_text", T.normal_lines(F.decode("content", "utf-8")))
    md = plain.where("file_type = 'md'")
    sections = markdown_sections(md.select("path", "full_text"), "path", "full_text")
    listed = sections.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("number", "section", "text"))), lambda x: F.struct(x.section.alias("section"), x.text.alias("text"))).alias("sections"))
    whole = section_text(sections, "path").join(listed, "path")
    pages = F.array().cast("array<struct<page:int,text:string,section:string>>")
    none = F.array().cast("array<struct<section:string,text:string>>")
    as_text = plain.where("file_type = 'txt'").select("path", "file_type", "full_text", pages.alias("pages"), none.alias("sections"), F.lit(None).cast("string").alias("error"))
    as_md = md.select("path", "file_type", "full_text").join(whole.withColumnRenamed("full_text", "by_section"), "path", "left").select("path", "file_type", F.coalesce("by_section", "full_text").alias("full_text"), pages.alias("pages"), F.coalesce("sections", none).alias("sections"), F.lit(None).cast("string").alias("error"))
    kind = to_arrow_schema(as_text.schema)

    def run(batches):
        for batch in batches:
            out = []
            for path, name, data in zip(*(batch.column(c).to_pylist() for c in ("path", "file_type", "content"))):
                row = {"path": path, "file_type": name, "full_text": "", "pages": [], "sections": [], "error": None}
                if name not in NEEDS:
                    row["error"] = "unsupported file type"
                elif importlib.util.find_spec(NEEDS[name]) is None:
                    row["error"] = f"{NEEDS[name]} is not installed"
                else:
                    try:
                        row["pages"], row["sections"] = _binary(name, data)
                        row["full_text"] = "\n\n".join(x["text"] for x in row["pages"] + row["sections"])
                    except Exception as e:  # a broken file is that file's error, not the job's
                        row["error"] = str(e)[:500]
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, kind)

    rest = files.where("file_type is null or file_type not in ('txt', 'md')").select("path", "file_type", "content").mapInArrow(run, PARSED)
    return as_text.unionByName(as_md).unionByName(rest)


def segments(parsed: DataFrame, key: str) -> DataFrame:
    """key, segment, title, kind, text: pages, sheets or sections of a parsed document, else its whole text as 正文; Markdown sections in blocks of text and tables."""
    pages = F.transform("pages", lambda p: F.struct(p.section.alias("title"), F.lit("text").alias("kind"), p.text.alias("text")))
    kind = F.when(F.col("file_type").isin("xlsx", "xls"), "table").otherwise("text")
    sections = F.transform("sections", lambda s: F.struct(s.section.alias("title"), kind.alias("kind"), s.text.alias("text")))
    whole = F.array(F.struct(F.lit("正文").alias("title"), F.lit("text").alias("kind"), F.col("full_text").alias("text")))
    chosen = F.when(F.size("pages") > 0, pages).when(F.size("sections") > 0, sections).otherwise(whole)
    in_blocks = F.coalesce((F.col("file_type") == "md") & (F.coalesce(F.size("pages"), F.lit(0)) == 0) & (F.size("sections") > 0), F.lit(False))
    rows = parsed.where("error is null").select(key, in_blocks.alias("in_blocks"), F.posexplode(chosen).alias("segment", "s")).select(key, "in_blocks", "segment", "s.*").where("trim(text) <> ''")
    lines = rows.where("in_blocks").select(F.struct(F.col(key).alias("key"), "segment", "title").alias("section"), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    blocks = C.markdown_blocks(lines, "section", "at", "line")
    place = F.row_number().over(Window.partitionBy("section.key").orderBy("section.segment", "block")) - 1
    cut = blocks.select(F.col("section.key").alias(key), place.alias("segment"), "section.title", "kind", "text")
    return rows.where("not in_blocks").drop("in_blocks").unionByName(cut)
