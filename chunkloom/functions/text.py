"""Text expressions: tokens, n-grams, normal forms, splits, labels of sources. All are Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and words that results depend on.
LATIN = "[A-Za-z0-9]+"
CJK = "[\\u4e00-\\u9fff]+"
SENTENCE_ENDS = ".!?\n。！？；;"
PARENT_LABEL, KIND_LABEL = "[父级主题] ", "[内容类型] "
KINDS = {"text": "正文", "table": "表格"}
PHRASE_ANCHORS = ("支持", "如何", "怎么", "怎样", "是否", "可以", "能否", "有哪些", "有什么", "哪种", "哪几种", "什么")
UNKNOWN_DOCUMENT = "未知文档"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def filled(x: Column | str) -> Column:
    """NULL for the empty string, so that coalesce treats both alike."""
    return F.nullif(_col(x), F.lit(""))


def strip(x: Column | str) -> Column:
    """Without white space (Unicode) at both ends."""
    return F.regexp_replace(_col(x), r"(?U)^\s+|\s+$", "")


def compact(x: Column | str) -> Column:
    """Lower case without any white space: the form in which phrases and evidence are sought."""
    return F.lower(F.regexp_replace(F.coalesce(_col(x), F.lit("")), r"(?U)\s+", ""))


def normal_lines(x: Column | str) -> Column:
    """Lines stripped, runs of blank lines made one, ends stripped."""
    lines = F.transform(F.split(F.coalesce(_col(x), F.lit("")), r"\r\n|[\n\r\x0B\f\u001c-\u001e\u0085  ]", -1), strip)
    return strip(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"))


def latin_tokens(x: Column | str) -> Column:
    """Runs of ASCII letters and digits of the lower-cased text, with repeats, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(x), F.lit(""))), F.lit(LATIN), F.lit(0))


def cjk_runs(x: Column | str) -> Column:
    return F.regexp_extract_all(F.coalesce(_col(x), F.lit("")), F.lit(CJK), F.lit(0))


def grams(run: Column, least: int, most: int) -> Column:
    """Distinct substrings of least..most characters; a run shorter than `least` stands for itself."""
    n = F.length(run)
    sizes = F.filter(F.array(*map(F.lit, range(least, most + 1))), lambda k: k <= n)
    own = F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr(run, i, k))))
    return F.when(n < least, F.array(run)).otherwise(F.array_distinct(own))


def token_set(x: Column | str) -> Column:
    """Distinct Latin tokens, CJK runs and their 2- to 4-grams."""
    runs = cjk_runs(x)
    return F.array_distinct(F.concat(latin_tokens(x), runs, F.flatten(F.transform(runs, lambda r: grams(r, 2, 4)))))


def term_bag(x: Column | str) -> Column:
    """Terms for ranking: Latin tokens with repeats; of every CJK run the run and then its n-grams in order."""
    runs = cjk_runs(x)
    return F.concat(latin_tokens(x), F.flatten(F.transform(runs, lambda r: F.concat(F.array(r), F.array_sort(grams(r, 2, 4))))))


def phrase_terms(normal: Column) -> Column:
    """Of a compact text: Latin tokens and CJK 2- to 6-grams of at least two characters."""
    own = F.concat(F.regexp_extract_all(normal, F.lit(LATIN), F.lit(0)), F.flatten(F.transform(cjk_runs(normal), lambda r: grams(r, 2, 6))))
    return F.array_distinct(F.filter(own, lambda t: F.length(t) >= 2))


def phrase_forms(normal: Column) -> Column:
    """The compact question, and what follows the first anchor (in list order) that stands inside it, if long enough."""
    inside = F.filter(F.array(*map(F.lit, PHRASE_ANCHORS)), lambda a: F.instr(normal, a) > 1)
    anchor = F.get(inside, F.lit(0))
    tail = F.substr(normal, F.instr(normal, anchor))
    fits = F.length(tail) >= F.greatest(F.length(anchor) + 2, F.lit(4))
    return F.when(fits, F.array(normal, tail)).otherwise(F.array(normal))


def contains_all(x: Column, terms: Column) -> Column:
    return F.forall(terms, lambda t: F.contains(x, t))


def let(x: Column, use) -> Column:
    """use(x) with x evaluated once, however often `use` names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def prepared(x: Column | str) -> Column:
    """What overlaps need of a text: tokens, its compact form, and that form's phrase terms."""
    return let(compact(x), lambda c: F.struct(token_set(x).alias("tokens"), c.alias("compact"), phrase_terms(c).alias("terms")))


def keyword_share(question: Column, text: Column) -> Column:
    """keyword_overlap of two prepared texts."""
    return F.when(F.size(question.tokens) == 0, 0.0).otherwise(F.size(F.array_intersect(question.tokens, text.tokens)) / F.size(question.tokens))


def phrase_share(question: Column, text: Column) -> Column:
    """phrase_overlap of two prepared texts."""

    def once(form: Column) -> Column:
        def shares(own: Column) -> Column:
            forth = F.size(F.filter(own, lambda x: F.contains(text.compact, x))) / F.size(own)
            back = F.size(F.filter(text.terms, lambda x: F.contains(form, x))) / F.size(text.terms)
            return F.when(F.size(own) == 0, 0.0).when(F.size(text.terms) == 0, forth).otherwise(F.greatest(forth, 0.8 * back))

        return F.when(F.contains(text.compact, form), 1.0).otherwise(let(phrase_terms(form), shares))

    return F.when((question.compact == "") | (text.compact == ""), 0.0).otherwise(F.array_max(F.transform(phrase_forms(question.compact), once)))


def keyword_overlap(question: Column | str, text: Column | str) -> Column:
    """Share of the question's tokens that the text has."""
    return let(prepared(question), lambda q: let(prepared(text), lambda t: keyword_share(q, t)))


def phrase_overlap(question: Column | str, text: Column | str) -> Column:
    """1 if the text contains the question (or its focused form), else the better of two shares of common phrase terms."""
    return let(prepared(question), lambda q: let(prepared(text), lambda t: phrase_share(q, t)))


def sentences(x: Column | str) -> Column:
    """Pieces that end after one of SENTENCE_ENDS, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), "(?<=[.!?\n。！？；;])", -1), strip), lambda s: s != "")


def paragraphs(x: Column | str) -> Column:
    """Pieces between blank lines, stripped, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(_col(x), F.lit("")), r"(?U)\n\s*\n+", -1), strip), lambda s: s != "")


def recall_text(retrieval: Column | str, content: Column | str) -> Column:
    return strip(F.coalesce(filled(retrieval), _col(content), F.lit("")))


def retrieval_text(title: Column | str, kind: Column | str, content: Column | str) -> Column:
    """Parent topic, kind and content on lines of their own; absent parts are left out."""
    label = F.when(_col(kind) == "table", KINDS["table"]).otherwise(KINDS["text"])
    return F.concat_ws("\n", F.concat(F.lit(PARENT_LABEL), filled(title)), F.concat(F.lit(KIND_LABEL), label), filled(content))


def table_line(x: Column | str) -> Column:
    """Whether a line looks like a Markdown table row: a bar and two non-blank cells at least."""
    return F.contains(_col(x), F.lit("|")) & (F.size(F.filter(F.split(_col(x), r"\|", -1), lambda c: F.trim(c) != "")) >= 2)


def table_rule(x: Column | str) -> Column:
    return F.rlike(strip(x), F.lit(r"^\|?(?:\s*:?-{3,}:?\s*\|)+\s*$"))


def page_number(x: Column | str) -> Column:
    return F.expr(f"try_cast({x} as int)") if isinstance(x, str) else x.try_cast("int")


def reader_section(page: Column | str, section: Column | str) -> Column:
    """Section as readers see it: page_N is hidden where it repeats the page, slide_N and sheet_N are worded."""
    s = strip(F.coalesce(_col(section), F.lit("")))
    kind = F.lower(F.regexp_extract(s, r"(?i)^(page|slide|sheet)_(\d+)$", 1))
    number = F.regexp_extract(s, r"(?i)^(page|slide|sheet)_(\d+)$", 2).try_cast("int")
    words = F.when(kind == "slide", F.concat(F.lit("第"), number, F.lit("张"))).when(kind == "sheet", F.concat(F.lit("工作表"), number))
    as_page = F.when(page_number(page).eqNullSafe(number), F.lit("")).otherwise(F.concat(F.lit("第"), number, F.lit("页")))
    return F.when(kind == "", s).when(kind == "page", as_page).otherwise(words)


def two_places(x: Column | str) -> Column:
    """A number at two places, rounded by its exact binary value (halves to even) as C's and Python's %.2f; format_string rounds the shortest decimal form (0.745, binary below that, would be 0.75)."""
    return F.call_function("format_number", _col(x), F.lit("0.00"))


def short_name(x: Column | str, most: int = 40) -> Column:
    """A long name keeps its head and tail around three dots."""
    head = most // 2
    name = F.coalesce(_col(x), F.lit(""))
    return F.when(F.length(name) <= most, name).otherwise(F.concat(F.left(name, F.lit(head)), F.lit("..."), F.right(name, F.lit(most - head - 3))))


def reference_line(name: Column | str, page: Column | str, section: Column | str) -> Column:
    number = page_number(page)
    parts = short_name(F.coalesce(filled(name), F.lit(UNKNOWN_DOCUMENT))), F.concat(F.lit("第"), number, F.lit("页")), filled(reader_section(page, section))
    return F.concat_ws(" · ", *parts)


def cited_numbers(answer: Column | str) -> Column:
    """Distinct numbers in [n] marks, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(_col(answer), F.lit(r"\[(\d+)\]"), F.lit(1)), lambda n: n.try_cast("int"))))


def session_title(title: Column | str, first_message: Column | str, default: str = "新对话") -> Column:
    """The first 20 characters of the first message where the title is blank or the default."""
    blank = F.trim(F.coalesce(_col(title), F.lit(""))).isin("", default)
    return F.when(blank, F.left(strip(first_message), F.lit(20))).otherwise(_col(title))


def json_text(x: Column | str) -> Column:
    """JSON of a value; '' for NULL."""
    return F.coalesce(F.to_json(_col(x)), F.lit(""))
