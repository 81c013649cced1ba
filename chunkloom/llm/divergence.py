"""How far the sources of a language drift from each other, and which terms make it, by skybands of terms.

Terms are runs of letters: anything but ASCII characters that are no letters, A-Z lower-cased. A language keeps the terms
of at least LEAST_DOCS of its documents. A group (language, source) and the language as a whole give each kept term a share
p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)); two shares differ by floor((p - q)**2 / (p + q)). All numbers are integers.

- Part `pair`: the sum of the differences over all kept terms, for each two sources of a language. Counts are laid out in
  blocks of sources and of terms; a task compares a block of sources with another over one block of terms. Terms that
  neither block of sources has come in as a product, so absent terms cost nothing.
- Part `term`: the TOP terms that a group uses more than its language. The difference rises with the group's count and
  falls with the language's, and ties go to the term that is earlier in UTF-8. So a term that TOP others dominate in all
  three can't be among the first TOP: each partition keeps the skyband of its terms (those that fewer than TOP dominate),
  skybands of parts merge into those of groups, and only what is left is ranked exactly.

Defined results: null text, lang and source count as empty; a group without terms has count 0 for each kept term; a language
without kept terms has differences of 0; repeated rows count as documents of their own; very long texts are read whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, materialise, outlive, scratch

LEAST_DOCS, TOP = 10, 10
UNIT = 1_000_000_000
#: Different terms of all groups that a task counts before it hands them on.
HELD_TERMS = 400_000
#: Points of one group that wait for the next cut to its skyband, and points of all groups that a task holds.
WAITING, HELD_POINTS = 4_096, 200_000
#: Sources of a block, and counts of a block of terms on average.
SOURCE_BLOCK, BLOCK_COUNTS = 64, 20_000
#: Groups whose sums may be broadcast (some 200 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Parts in which the partitions' skybands of one group are merged first.
MERGES = 16

#: Every byte that no term holds becomes a space, A-Z become a-z.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    return data.translate(_LETTERS).split()


def count_terms(docs: DataFrame) -> DataFrame:
    """docs(text, lang, source) -> lang, source, term, n (occurrences), docs (documents with it); every group also has a row with an empty term."""
    names = F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")

    def handed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = [b"", *n]
            for at in range(0, len(terms), 50_000):
                own = terms[at : at + 50_000]
                same = [pa.array([x] * len(own)) for x in (lang, source)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([docs[t] for t in own], pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, free = {}, HELD_TERMS
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary())):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                terms, before = terms_of(text.as_py()), len(n)
                n.update(terms)
                docs.update(set(terms))
                free -= len(n) - before
                if free <= 0:
                    yield from handed(held)
                    held, free = {}, HELD_TERMS
        yield from handed(held)

    found = docs.select(*names, "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, terms: str = "v") -> Column:
    """p of a count; 1 where a language keeps no terms. Counts that leave 64 bits on the way are divided as decimals."""
    plain = F.expr(f"({UNIT} * ({count} + 2)) div ({total} + 2 * {terms})")
    large = F.expr(f"(cast({UNIT} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) div cast({total} + 2 * {terms} as decimal(20,0))")
    return F.when(F.col(terms) == 0, F.lit(1)).otherwise(1 + F.when(F.col(count) < 9_000_000_000, plain).otherwise(large)).cast("long")


def difference(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def band(first: np.ndarray, second: np.ndarray, third: np.ndarray, k: int) -> np.ndarray:
    """Places of the points that fewer than k others dominate: first no lower, second no higher, third (all different) lower."""
    order = np.lexsort((third, second, -first))
    kept = np.zeros(0, np.int64)
    for at in range(0, len(order), 1024):  # only earlier points in this order dominate; those that are cut away need not be asked
        block = order[at : at + 1024]
        over = (second[kept] <= second[block, None]) & (third[kept] < third[block, None])
        block = block[over.sum(1) < k]
        before = len(kept)
        for x in block.tolist():
            if ((second[kept] <= second[x]) & (third[kept] < third[x])).sum() < k if len(kept) > before else True:
                kept = np.append(kept, x)
    return kept


def _cut(points: list[tuple[bytes, int, int, int]], k: int) -> list[tuple[bytes, int, int, int]]:
    """The skyband of (term, count in the group, count in the language, value)."""
    points = sorted(points)
    count, lang_count = (np.array([p[i] for p in points], np.int64) for i in (1, 2))
    return [points[i] for i in band(count, lang_count, np.arange(len(points)), k)]


_POINTS = "lang string, source string, term string, n long, lang_n long, value long"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
    columns[2] = columns[2].cast(pa.string())
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in _POINTS.split(", ")])


def _points(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple]:
    columns = [batch.column(c).to_pylist() if c != "term" else batch.column(c).cast(pa.binary()).to_pylist() for c in ("lang", "source", "term", "n", "lang_n", "value")]
    return zip(*columns)


def skyband(points: DataFrame, k: int) -> DataFrame:
    """points(lang, source, term, n, lang_n, value) -> the points of each group that fewer than k others dominate."""

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0

        def handed() -> Iterator[pa.RecordBatch]:
            for group, own in held.items():
                if own:
                    yield _batch([(*group, *p) for p in _cut(own, k)])

        for batch in batches:
            for lang, source, *point in _points(batch):
                own = held.setdefault((lang, source), [])
                own.append(tuple(point))
                n += 1
                if len(own) >= WAITING:
                    cut = _cut(own, k)
                    n -= len(own) - len(cut)
                    if len(cut) > WAITING // 2:  # a wide skyband is handed on in pieces; the merge cuts it again
                        yield _batch([(lang, source, *p) for p in cut])
                        n, cut = n - len(cut), []
                    held[lang, source] = cut
            if n > HELD_POINTS:
                yield from handed()
                held, n = {}, 0
        yield from handed()

    def of_group(rows: pa.Table) -> pa.Table:
        group = rows.column("lang")[0].as_py(), rows.column("source")[0].as_py()
        return pa.Table.from_batches([_batch([(*group, *p) for p in _cut([x[2:] for x in _points(rows)], k)])])

    local = points.mapInArrow(of_partition, _POINTS)
    salt = F.pmod(F.xxhash64("term"), F.lit(MERGES)).alias("salt")
    return local.groupBy("lang", "source", salt).applyInArrow(of_group, _POINTS).groupBy("lang", "source").applyInArrow(of_group, _POINTS)


def _pair_sums(own: DataFrame, groups: DataFrame, n_blocks: int) -> DataFrame:
    """own(lang, source, term, p), groups(lang, source, p0) -> lang, source, item, value, seen: sums over the terms seen, both ways round, in parts."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    blocks = groups.select("lang", "source", "p0", F.floor(place / SOURCE_BLOCK).cast("int").alias("block"))
    blocks = materialise(blocks.withColumn("blocks", F.max("block").over(Window.partitionBy("lang"))), "blocks")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("bucket")  # a mark of each source for each block of terms
    marks = blocks.select("*", every).select("*", F.lit("").alias("term"), F.col("p0").alias("p"))
    cells = own.join(_hint(blocks), ["lang", "source"]).select(*blocks.columns, F.pmod(F.xxhash64("term"), F.lit(n_blocks)).cast("int").alias("bucket"), "term", "p")
    met = marks.unionByName(cells).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks"))))
    met = met.select("lang", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "bucket", "block", "source", "term", "p")

    def compare(rows: pa.Table) -> pa.Table:
        lang, low, high = (rows.column(c)[0].as_py() for c in ("lang", "low", "high"))
        block, source, term, p = (rows.column(c).to_pylist() for c in ("block", "source", "term", "p"))
        sources = sorted({(b, s) for b, s in zip(block, source)})
        line, column = {s: i for i, s in enumerate(sources)}, {t: i for i, t in enumerate(dict.fromkeys(t for t in term if t))}
        table = np.zeros((len(sources), 1 + len(column)), np.int64)
        lines = np.array([line[x] for x in zip(block, source)])
        columns = np.array([column[t] + 1 if t else 0 for t in term])
        p = np.array(p, np.int64)
        table[lines[columns == 0], 0] = p[columns == 0]
        table[:, 1:] = table[:, :1]
        table[lines, columns] = p
        out = [[], [], []]
        for i, (b, s) in enumerate(sources):
            if b == low:
                later = np.array([j for j, (c, _) in enumerate(sources) if j > i and c == high], np.int64)
                q = table[later, 1:]
                value = ((table[i, 1:] - q) ** 2 // (table[i, 1:] + q)).sum(1).tolist()
                for j, v in zip(later.tolist(), value):
                    out[0] += [s, sources[j][1]]
                    out[1] += [sources[j][1], s]
                    out[2] += [v, v]
        n = len(out[0])
        return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64()), "seen": pa.array([len(column)] * n, pa.int64())})

    return met.groupBy("lang", "low", "high", "bucket").applyInArrow(compare, "lang string, source string, item string, value long, seen long")


def _hint(groups: DataFrame) -> DataFrame:
    return F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part (pair or term), item, value, rank."""
    with scratch():
        counts = materialise(count_terms(docs), "counts")
        kept = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
        kept = materialise(kept.select("lang", "term", "lang_n"), "kept")
        own = materialise(counts.where("term <> ''").join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "own")
        totals = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
        sums = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", "source").join(sums, ["lang", "source"], "left").join(totals, "lang", "left").na.fill(0)
        groups = materialise(groups.withColumn("none", F.lit(0)).withColumn("p0", share("none", "total")).drop("none"), "groups")
        shares = own.join(_hint(groups), ["lang", "source"]).withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total"))
        shares = materialise(shares.select("lang", "source", "term", "n", "lang_n", "p", "q"), "shares")

        points = shares.where("n > 0 and p > q").withColumn("value", difference("p", "q")).select("lang", "source", "term", "n", "lang_n", "value")
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("term"))
        terms = skyband(points, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")

        parts = _pair_sums(shares, groups, max(1, -(-shares.count() // BLOCK_COUNTS)))
        pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
        of_item = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
        pairs = pairs.join(_hint(groups.select("lang", "source", "v", "p0")), ["lang", "source"]).join(_hint(of_item), ["lang", "item"])
        whole = F.col("value") + (F.col("v") - F.col("seen")) * difference("p0", "q0")  # terms that neither source has
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
        pairs = pairs.withColumn("value", whole).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
        return outlive(materialise(pairs.unionByName(terms), "divergence"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= 10
), totals AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS n FROM words GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, t.v, k.n AS lang_n, t.total AS lang_total
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN totals t ON t.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), shares AS (
  SELECT lang, source, term, n, CAST(1 + (1000000000 * (n + 2)) // (total + 2 * v) AS BIGINT) AS p, CAST(1 + (1000000000 * (lang_n + 2)) // (lang_total + 2 * v) AS BIGINT) AS q FROM cells
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms QUALIFY rank <= 10
"""
