"""Chunking as folds over arrays, inside Catalyst: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chunkloom.functions import text as T

LEAST_CHUNK, MOST_TABLE_ROWS, LEAST_TABLE = 120, 12, 700
_STATE = "struct<done:array<string>,now:string>"


def check(size: int, overlap: int) -> None:
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap from 0 to below size")


def _state(done: Column, now: Column) -> Column:
    return F.struct(done.alias("done"), now.alias("now")).cast(_STATE)


def _start() -> Column:
    return _state(F.array().cast("array<string>"), F.lit(""))


def _closed(s: Column) -> Column:
    return F.when(s.now == "", s.done).otherwise(F.array_append(s.done, s.now))


def hard_slices(x: Column, size: int) -> Column:
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(x) / size).cast("int") - 1, F.lit(0))), lambda i: T.strip(F.substr(x, i * size + 1, F.lit(size))))
    return F.filter(parts, lambda p: p != "")


def long_unit(x: Column, size: int) -> Column:
    """A text as pieces of up to `size`: sentences packed greedily with spaces; a single over-long sentence in slices, one among others whole."""
    return T.let(x, lambda v: _long_unit(v, size))


def _long_unit(x: Column, size: int) -> Column:
    def step(s: Column, sentence: Column) -> Column:
        over = (s.now != "") & (F.length(s.now) + 1 + F.length(sentence) > size)
        return F.when(over, _state(F.array_append(s.done, s.now), sentence)).otherwise(_state(s.done, F.when(s.now == "", sentence).otherwise(F.concat(s.now, F.lit(" "), sentence))))

    def cut(plain: Column) -> Column:
        packed = T.let(T.sentences(plain), lambda own: F.when(F.size(own) == 1, hard_slices(plain, size)).otherwise(F.aggregate(own, _start(), step, _closed)))
        return F.when(plain == "", F.array().cast("array<string>")).when(F.length(plain) <= size, F.array(plain)).otherwise(packed)

    return T.let(T.normal_lines(x), cut)


def tail(x: Column, overlap: int) -> Column:
    """The end of a chunk that the next one repeats: whole sentences from the last until `overlap` characters are reached."""
    if overlap <= 0:
        return F.lit("")
    own = T.sentences(x)
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("picked"))
    taken = F.aggregate(F.reverse(own), zero, lambda s, t: F.when(s.n >= overlap, s).otherwise(F.struct((s.n + F.length(t)).alias("n"), F.array_prepend(s.picked, t).alias("picked"))), lambda s: F.array_join(s.picked, " "))
    return F.when(F.length(x) <= overlap, x).when(F.size(own) <= 1, T.strip(F.right(x, F.lit(overlap)))).otherwise(taken)


def heuristic_chunks(x: Column | str, size: int = 500, overlap: int = 80) -> Column:
    """Paragraphs (long ones cut by long_unit) packed with blank lines; a chunk of LEAST_CHUNK or more is closed before it would pass `size`."""
    check(size, overlap)
    x = F.col(x) if isinstance(x, str) else x
    units = F.flatten(F.transform(T.paragraphs(x), lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(long_unit(p, size))))

    def step(s: Column, unit: Column) -> Column:
        cut = (s.now != "") & (F.length(s.now) + 2 + F.length(unit) > size) & (F.length(s.now) >= min(LEAST_CHUNK, size))
        carried = T.filled(tail(s.now, overlap))
        return F.when(cut, _state(F.array_append(s.done, s.now), F.concat_ws("\n\n", carried, unit))).otherwise(_state(s.done, F.concat_ws("\n\n", T.filled(s.now), unit)))

    return F.aggregate(units, _start(), step, _closed)


def semantic_chunks(units: Column, breaks: Column, size: int = 500, overlap: int = 0) -> Column:
    """Sentences joined with spaces, cut after a break (array of 0-based places) or at `size`, each piece through long_unit."""
    check(size, overlap)
    rows = F.transform(units, lambda s, i: F.struct(s.alias("s"), F.array_contains(breaks, i).alias("cut")))
    kind = "struct<done:array<string>,now:string,n:int>"
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(0).alias("n")).cast(kind)

    def step(a: Column, r: Column) -> Column:
        return T.let(F.concat_ws(" ", T.filled(a.now), r.s), lambda now: grown(a, r, now, a.n + 1))

    def grown(a: Column, r: Column, now: Column, n: Column) -> Column:
        enough = F.length(now) >= min(LEAST_CHUNK, size)
        cut = (enough & (r.cut | (F.length(now) >= size))) | (r.cut & (n >= 2))
        rest = tail(now, overlap)
        closed = F.struct(F.concat(a.done, long_unit(now, size)).alias("done"), rest.alias("now"), F.when(rest == "", 0).otherwise(1).alias("n")).cast(kind)
        return F.when(cut, closed).otherwise(F.struct(a.done.alias("done"), now.alias("now"), n.alias("n")).cast(kind))

    return F.aggregate(rows, zero, step, lambda a: F.when(a.now == "", a.done).otherwise(F.concat(a.done, long_unit(a.now, size))))


def breakpoints(similar: Column, percentile: float = 20.0) -> Column:
    """Places whose similarity to the next sentence is at or below the percentile (linear between ranks) of all of them."""
    share = min(max(percentile, 0.0), 100.0) / 100

    def limit(ordered: Column) -> Column:
        at = F.lit(share) * (F.size(ordered) - 1)
        low, high = F.get(ordered, F.floor(at).cast("int")), F.get(ordered, F.ceil(at).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    def places(s: Column) -> Column:
        return T.let(T.let(F.array_sort(s), limit), lambda t: F.filter(F.transform(s, lambda x, i: F.when(x <= t, i)), lambda i: i.isNotNull()))

    return T.let(similar, lambda s: F.when(F.size(s) == 0, F.array().cast("array<int>")).otherwise(places(s)))


def table_chunks(lines: Column, size: int = 500) -> Column:
    """Markdown table lines -> struct(text, row_from, row_to): header (and rule) repeated over three to twelve rows each, by their mean length."""
    def parted(kept: Column) -> Column:
        ruled = (F.size(kept) > 1) & T.table_rule(F.get(kept, F.lit(1)))
        return T.let(F.when(ruled, 2).otherwise(1), lambda n: F.struct(kept.alias("kept"), F.slice(kept, 1, n).alias("head"), F.slice(kept, n + 1, F.greatest(F.size(kept) - n, F.lit(0))).alias("rows")))

    def cut(t: Column) -> Column:
        mean = F.greatest(F.floor(F.aggregate(t.rows, F.lit(0), lambda s, r: s + F.length(r)) / F.size(t.rows)).cast("int"), F.lit(1))
        step = F.greatest(F.lit(3), F.least(F.lit(MOST_TABLE_ROWS), F.floor(F.lit(max(size, LEAST_TABLE)) / mean).cast("int")))
        piece = lambda i, n: F.struct(F.array_join(F.concat(t.head, F.slice(t.rows, i + 1, n)), "\n").alias("text"), (i + 1).alias("row_from"), F.least(i + n, F.size(t.rows)).alias("row_to"))
        parts = T.let(step, lambda n: F.transform(F.sequence(F.lit(0), F.size(t.rows) - 1, n), lambda i: piece(i, n)))
        whole = F.array(F.struct(F.array_join(t.kept, "\n").alias("text"), F.lit(1).alias("row_from"), F.lit(1).alias("row_to")))
        return F.when(F.size(t.rows) > 0, parts).otherwise(whole)

    return T.let(T.let(F.filter(F.transform(lines, T.strip), lambda s: s != ""), parted), cut)


def markdown_blocks(lines: DataFrame, by: str, at: str, line: str) -> DataFrame:
    """lines -> by, block, kind (text or table), text: a table begins where a table line stands before a rule, and lasts while table lines follow."""
    w = Window.partitionBy(by).orderBy(at)
    marked = lines.withColumn("is_row", T.table_line(line)).withColumn("next_rule", F.coalesce(F.lead(T.table_rule(line)).over(w), F.lit(False)))
    opens = F.col("is_row") & F.col("next_rule")
    run = F.sum(F.when(F.col("is_row"), 0).otherwise(1)).over(w)
    island = marked.withColumn("opens", opens).withColumn("run", run)
    inside = F.max(F.col("opens").cast("int")).over(Window.partitionBy(by, "run").orderBy(at))
    kinds = island.withColumn("kind", F.when(F.col("is_row") & (inside == 1), "table").otherwise("text"))
    changed = F.coalesce((F.col("kind") != F.lag("kind").over(w)) | (F.col("opens") & (F.lag("kind").over(w) == "text")), F.lit(True))
    numbered = kinds.withColumn("block", F.sum(changed.cast("int")).over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, line))), lambda x: x[line]), "\n")
    return numbered.groupBy(by, "block", "kind").agg(T.strip(text).alias("text")).where("text <> ''")


_PIECES = "array<struct<text:string,row_from:int,row_to:int>>"


def text_pieces(segments: DataFrame, size: int, overlap: int, use_semantic: bool) -> Column:
    """Heuristic chunks; or semantic ones, where `similar` (of each sentence and the next) is given and fits more than one sentence."""
    plain = heuristic_chunks("text", size, overlap)
    if not use_semantic or "similar" not in segments.columns:
        return plain
    fits = lambda own: (F.size(own) > 1) & (F.size("similar") == F.size(own) - 1)
    return T.let(T.sentences(F.col("text")), lambda own: F.when(F.col("similar").isNotNull() & fits(own), semantic_chunks(own, breakpoints(F.col("similar")), size, overlap)).otherwise(plain))


def hierarchy(segments: DataFrame, size: int = 500, overlap: int = 80, use_semantic: bool = False) -> DataFrame:
    """segments(document_id, segment, title, text) -> parent rows and their leaves with one running chunk_index a document.

    Segments whose kind (a column that may be absent) is table are cut by rows, with their header repeated; others by text_pieces.
    A leaf's offsets are found in its segment, or follow the leaf before where its text was put together anew.
    """
    none = F.lit(None).cast("int")
    prose = F.transform(text_pieces(segments, size, overlap, use_semantic), lambda s: F.struct(s.alias("text"), none.alias("row_from"), none.alias("row_to"))).cast(_PIECES)
    kind = F.col("kind") if "kind" in segments.columns else F.lit("text")
    cut = segments.withColumn("kind", kind).withColumn("pieces", F.when(F.col("kind") == "table", table_chunks(F.split("text", "\n"), size).cast(_PIECES)).otherwise(prose))
    zero = F.array().cast("array<struct<child:int,text:string,start:int,stop:int,row_from:int,row_to:int>>")

    def place(done: Column, p: Column) -> Column:
        cursor = F.when(F.size(done) == 0, 0).otherwise(F.element_at(done, F.when(F.size(done) == 0, 1).otherwise(-1)).stop)
        found = F.call_function("locate", p.text, F.col("text"), cursor + 1)
        start = F.when(found > 0, found - 1).otherwise(cursor)
        return F.array_append(done, F.struct(p.child.alias("child"), p.text.alias("text"), start.alias("start"), F.least(start + F.length(p.text), F.length(F.col("text"))).alias("stop"), p.row_from.alias("row_from"), p.row_to.alias("row_to")))

    rows = F.transform("pieces", lambda s, i: F.struct(i.alias("child"), s.text.alias("text"), s.row_from.alias("row_from"), s.row_to.alias("row_to")))
    leaves = F.aggregate(rows, zero, place)
    parent = F.array(F.struct(F.lit(-1).alias("child"), F.col("text").alias("text"), F.lit(0).alias("start"), F.length("text").alias("stop"), none.alias("row_from"), none.alias("row_to")))
    flat = cut.select("document_id", "segment", "title", "kind", F.explode(F.concat(parent, leaves)).alias("c")).select("document_id", "segment", "title", "kind", "c.*")
    indexed = flat.withColumn("chunk_index", F.row_number().over(Window.partitionBy("document_id").orderBy("segment", "child")) - 1)
    role = F.when(F.col("child") < 0, "parent").otherwise("leaf")
    return indexed.select("document_id", "chunk_index", role.alias("chunk_role"), "segment", F.col("child").alias("child_index"), "title", F.col("text").alias("content"), F.col("start").alias("start_offset"), F.col("stop").alias("end_offset"), T.retrieval_text("title", "kind", "text").alias("retrieval_content"), F.col("kind").alias("block_type"), F.col("row_from").alias("table_row_from"), F.col("row_to").alias("table_row_to"))
