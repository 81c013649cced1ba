"""Removal of repeated passages of words by recompression: locally consistent names for runs and pairs of names.

Every word has a name. A round names runs of one name (in the first round) and then pairs: a hash of a name says whether it
is a left or a right one, and a left name takes the right one behind it, both becoming one new name. New names are hashes of
what they replace, so all tasks of all Spark jobs give the same name to the same thing with nothing to exchange, and equal
stretches of words get equal names but near their ends. How near is known exactly: each name carries the stretch of words
that settled it (its reach), which grows by a neighbour where a neighbour was looked at. After ROUNDS rounds a name covers
some 8 words and has a reach of some 23.

A window of LENGTH words sees the names whose reach lies inside it; equal windows see equal names at equal places. Of these
one owns the window (the smallest hash, the leftmost of equals), so equal windows are owned by equal names, each of which
owns neighbouring windows. Only owners are exchanged, about one for 17 words:

- Spark groups owners by what they reach. Reaches of one document only, nearly all, are done with.
- Where all owners of a reach agree in all the words of their windows, the first document decides for all of them.
- Otherwise owners are grouped by these words too; all but the first document of each such class are settled, and that one's
  windows are compared one by one with those of the other classes of the same reach.

Windows that see no name (runs of one word, for the most part) are compared one by one from the start. Comparisons are of
64-bit hashes of reaches together with 64-bit hashes of all words, that is of 128 bits. Classes are counts and minima, never
lists of pairs; classes with very many members are dealt out (`common.join_split`).

A word is removed if a window that covers it also starts in a document with a smaller doc_id. Defined results: words are
runs of anything but ASCII white space, unchanged; null and empty texts have no words; texts shorter than a window keep all;
repeated rows, and rows that share a doc_id, don't count against each other; a row without doc_id keeps all and takes
nothing from others; long texts are read in overlapping pieces with the same result; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, join_split, map_rows, materialise, outlive, scratch
from chunkloom.llm.repeats import _powers

LENGTH = 50
ROUNDS = 7
#: Bytes of a text that are read at once, and words that are named at once.
PIECE_BYTES, PIECE_WORDS = 4 << 20, 400_000
#: Words whose names a task remembers.
KNOWN_WORDS = 500_000
#: Bytes up to which the spans found are broadcast to the reading of the texts; beyond them they are joined by shuffle.
BROADCAST_BYTES = 192 << 20
ENTRY_BYTES = 80

U = np.uint64
_LANES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
ROWS = "k long, u long, d long, t int, at int, w int"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every bit depends on all."""
    for _ in range(2):
        x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


class Names(dict):
    """Word -> its name; forgets all of them when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name


def stretches(data: bytes) -> Iterator[tuple[int, list[bytes]]]:
    """The words of a text, PIECE_BYTES at a time, each time with the number of the first of them."""
    first = at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        words = data[at:end].split()  # for bytes, white space is just \x20 and \x09-\x0D
        yield first, words
        first, at = first + len(words), end


def pieces(data: bytes, length: int) -> Iterator[tuple[int, list[bytes]]]:
    """stretches() that overlap by length - 1 words, so that every window lies in one of them."""
    held = []
    for first, words in stretches(data):
        held = held[-(length - 1) :] if length > 1 else []
        start = first - len(held)
        held = held + words
        for at in range(0, len(held) - length + 1, PIECE_WORDS):
            yield start + at, held[at : at + PIECE_WORDS + length - 1]


class Symbols:
    """Names over one sequence of words with walls between texts: name, reach (low, high) and wall of each."""

    def __init__(self, names: np.ndarray, walls: np.ndarray):
        n = np.arange(len(names))
        self.name, self.wall, self.low, self.high = names, walls, n, n + 1

    def _keep(self, at: np.ndarray) -> None:
        self.name, self.low, self.high, self.wall = self.name[at], self.low[at], self.high[at], self.wall[at]

    def runs(self) -> None:
        """Neighbours of one name become one, named by it and by their number; it takes both neighbours to see that a run ends."""
        n = len(self.name)
        first = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | self.wall[1:]]))
        end = np.append(first[1:], n)
        number, inner = end - first, ~self.wall[first]
        low, high = self.low[np.maximum(first - 1, 0)], self.high[np.minimum(end, n - 1)]
        low, high = np.where(inner, low, self.low[first]), np.where(inner, high, self.high[first])
        self._keep(first)
        self.low, self.high = low, high
        many = number > 1
        self.name[many] = mix(self.name[many] ^ mix(number[many].astype(U)))

    def pairs(self, turn: int) -> None:
        """A left name and a right one behind it become one; a name left alone has looked at the neighbour on its open side."""
        n, salt = len(self.name), mix(np.array([turn], U))[0]
        left = (mix(self.name ^ salt) & U(1)).astype(bool) & ~self.wall
        right = ~left & ~self.wall
        head = np.zeros(n, bool)
        head[:-1] = left[:-1] & right[1:]
        tail = np.concatenate([[False], head[:-1]])
        low, high, name = self.low.copy(), self.high.copy(), self.name.copy()
        looked = np.flatnonzero(left)  # at its right neighbour, whether it is taken or not
        high[looked] = self.high[looked + 1]  # a wall stands at the end
        alone = np.flatnonzero(right & ~tail)
        low[alone] = self.low[alone - 1]  # and one at the beginning
        at = np.flatnonzero(head)
        name[at] = mix(mix(name[at]) * U(3) + name[at + 1])
        self.name, self.low, self.high = name, low, high
        self._keep(np.flatnonzero(~tail))


def recompress(names: np.ndarray, walls: np.ndarray, rounds: int) -> Symbols:
    out = Symbols(names, walls)
    for turn in range(rounds):
        if turn == 0:
            out.runs()
        out.pairs(turn)
    return out


def owners(symbols: Symbols, windows: np.ndarray, length: int) -> np.ndarray:
    """For each window start (ascending): the place of the name that owns it, -1 if it sees none. Reaches are in order at both ends."""
    first = np.searchsorted(symbols.low, windows)
    seen = np.searchsorted(symbols.high, windows + length, "right") - first
    rank = mix(symbols.name ^ U(0x9E3779B97F4A7C15))
    own, least = np.full(len(windows), -1), np.full(len(windows), np.iinfo(U).max)
    for step in range(int(seen.max(initial=0))):
        at = np.flatnonzero(seen > step)
        value = rank[first[at] + step]
        less = (value < least[at]) | (own[at] < 0)
        own[at[less]], least[at[less]] = first[at[less]] + step, value[less]
    return own


class Sums:
    """Hashes of any stretch of the sequence, in two lanes."""

    def __init__(self, names: np.ndarray):
        self.lanes = []
        for i, factor in enumerate(_LANES):
            power, inverse = _powers(factor, len(names) + 1)
            own = mix(names ^ U(i)) * power[: len(names)]
            self.lanes.append((np.concatenate([np.zeros(1, U), np.cumsum(own)]), inverse))

    def of(self, lane: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums, inverse = self.lanes[lane]
        return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U))


class Sequence:
    """Pieces of texts one after another with walls between them, named together."""

    def __init__(self):
        self.names, self.starts, self.of = [0], [], []  # of: (d, t, number of the first word)
        self.known = Names()

    def add(self, d: int, t: int, first: int, words: list[bytes]) -> None:
        self.starts.append(len(self.names))
        self.of.append((d, t, first))
        known = self.known
        self.names += [known[w] for w in words]
        self.names.append(0)

    def take(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """names, walls, where pieces start, and whose they are; empties the sequence."""
        names = np.array(self.names, U)
        walls = np.zeros(len(names), bool)
        walls[[0, *(s - 1 for s in self.starts), len(names) - 1]] = True
        out = names, walls, np.array(self.starts, np.int64), np.array(self.of, np.int64).reshape(-1, 3)
        self.names, self.starts, self.of = [0], [], []
        return out


def _window_starts(walls: np.ndarray, length: int) -> np.ndarray:
    before = np.concatenate([np.zeros(1, np.int64), np.cumsum(walls)])
    return np.flatnonzero(before[length:] == before[:-length])


def _rows(k: np.ndarray, u: np.ndarray, at: np.ndarray, width: np.ndarray, starts: np.ndarray, of: np.ndarray) -> pa.RecordBatch:
    piece = np.searchsorted(starts, at, "right") - 1
    place = at - starts[piece] + of[piece, 2]
    columns = [pa.array(k.view(np.int64)), pa.array(u.view(np.int64)), pa.array(of[piece, 0]), pa.array(of[piece, 1].astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(width.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["k", "u", "d", "t", "at", "w"])


def owned(sequence: Sequence, length: int, rounds: int) -> pa.RecordBatch | None:
    """One row for each owner of windows, or for windows that no name owns and that are alike side by side."""
    names, walls, starts, of = sequence.take()
    if len(names) <= length:
        return None
    windows, sums, symbols = _window_starts(walls, length), Sums(names), recompress(names, walls, rounds)
    if not len(windows):
        return None
    own = owners(symbols, windows, length)
    one, two = (sums.of(lane, windows, windows + length) for lane in (0, 1))
    alike = np.where(own[1:] < 0, (own[:-1] < 0) & (one[1:] == one[:-1]) & (two[1:] == two[:-1]), own[1:] == own[:-1]) & (windows[1:] == windows[:-1] + 1)
    first = np.flatnonzero(np.concatenate([[True], ~alike]))
    at, last, by = windows[first], windows[np.append(first[1:], len(windows)) - 1], own[first]
    k, u = one[first], two[first]  # of a window alone
    at_name = by >= 0
    low, high = symbols.low[by[at_name]], symbols.high[by[at_name]]
    k[at_name] = mix(sums.of(0, low, high))
    whole = sums.of(1, at[at_name], last[at_name] + length)
    u[at_name] = mix(whole ^ mix(((low - at[at_name]) << 32 | (last - at)[at_name]).astype(U)))
    return _rows(k, u, at, last - at, starts, of)


def _keyed(docs: DataFrame) -> DataFrame:
    """t tells rows apart that share a doc_id."""
    return docs.select("doc_id", "text", F.col("doc_id").alias("d"), F.hash("text").alias("t"))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    return (x.as_py() or b"" for x in batch.column("text").cast(pa.binary()))


def _owner_rows(docs: DataFrame, length: int, rounds: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = Sequence()
        for batch in batches:
            for d, t, data in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), _texts(batch)):
                for first, words in pieces(data, length):
                    sequence.add(d, t, first, words)
                    if len(sequence.names) >= PIECE_WORDS:
                        out = owned(sequence, length, rounds)
                        if out is not None:
                            yield out
        out = owned(sequence, length, rounds)
        if out is not None:
            yield out

    return _keyed(docs).where("d is not null").select("d", "t", "text").mapInArrow(run, ROWS)


def _window_rows(docs: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """The windows of runs(d, t, at, w), one row each."""
    listed = runs.groupBy("d", "t").agg(F.collect_list(F.struct("at", "w")).alias("runs"))
    small = runs.count() * ENTRY_BYTES <= BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = Sequence()

        def handed() -> Iterator[pa.RecordBatch]:
            names, walls, starts, of = sequence.take()
            if len(names) > length:
                windows, sums = _window_starts(walls, length), Sums(names)
                yield _rows(sums.of(0, windows, windows + length), sums.of(1, windows, windows + length), windows, np.zeros_like(windows), starts, of)

        for batch in batches:
            for d, t, data, own in zip(batch.column("d").to_pylist(), batch.column("t").to_pylist(), _texts(batch), batch.column("runs").to_pylist()):
                wanted = sorted((r["at"], r["at"] + r["w"]) for r in own)
                for first, words in pieces(data, length):
                    last = first + len(words) - length
                    for low, high in wanted:
                        low, high = max(low, first), min(high, last)
                        # of two pieces that overlap, only the first has the windows that both could hold, as pieces share length - 1 words
                        if low <= high:
                            sequence.add(d, t, low, words[low - first : high - first + length])
                    if len(sequence.names) >= PIECE_WORDS:
                        yield from handed()
        yield from handed()

    texts = _keyed(docs).select("d", "t", "text").join(F.broadcast(listed) if small else listed, ["d", "t"])
    return texts.mapInArrow(run, ROWS)


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows -> those that an earlier document has too, and those in the first document of each class whose reach has several classes."""
    rows = materialise(rows, "owners")
    n = rows.count()
    reaches = rows.groupBy("k").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.min("u").alias("low"), F.max("u").alias("high"), F.count(F.lit(1)).alias("n"))
    reaches = materialise(reaches.where("first < last").select("k", "first", (F.col("low") != F.col("high")).alias("mixed"), "n"), "reaches")
    shared = materialise(join_split(rows, reaches, ["k"], ["d", "at"], n).drop("n"), "shared")
    mixed = shared.where("mixed").select("k", "u", "d", "t", "at", "w")
    classes = materialise(mixed.groupBy("k", "u").agg(F.min("d").alias("own"), F.count(F.lit(1)).alias("n")), "classes")
    marked = materialise(join_split(mixed, classes, ["k", "u"], ["d", "at"], n).drop("n"), "marked")
    sure = shared.where("not mixed and d > first").select("d", "t", "at", "w").unionByName(marked.where("d > own").select("d", "t", "at", "w"))
    return sure, marked.where("d = own").select("d", "t", "at", "w")


def repeated_windows(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> d, t, at, w: runs of w + 1 neighbouring windows that all start in an earlier document too."""
    sure, first = _settled(_owner_rows(docs, length, rounds))
    windows = materialise(_window_rows(docs, first, length), "windows")
    classes = windows.groupBy("k", "u").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where("first < last")
    classes = materialise(classes.select("k", "u", "first", "n"), "window-classes")
    again = join_split(windows, classes, ["k", "u"], ["d", "at"], windows.count()).where("d > first")
    return sure.unionByName(again.select("d", "t", "at", "w"))


def _merged(spans: list[int]) -> list[list[int]]:
    edges: list[list[int]] = []
    for s in sorted(spans):
        start, end = s >> 32, s & 0xFFFFFFFF
        if edges and start <= edges[-1][1]:
            edges[-1][1] = max(edges[-1][1], end)
        else:
            edges.append([start, end])
    return edges


def _left_over(data: bytes, edges: list[list[int]]) -> Iterator[tuple[int, list[bytes]]]:
    """Number of words and the kept ones, stretch by stretch."""
    for first, words in stretches(data):
        kept, at = [], 0
        for start, end in edges:
            if start < first + len(words) and end > first:
                kept += words[at : max(start - first, 0)]
                at = end - first
        yield len(words), kept + words[at:]


def remove_passages(docs: DataFrame, length: int = LENGTH, rounds: int = ROUNDS) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_removed, kept_sha256, spans (start, end in words), kept_text, one row per row of docs."""
    with scratch():
        spans = repeated_windows(docs, length, rounds)
        spans = outlive(materialise(spans.select("d", "t", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("at") + F.col("w") + length).alias("span")), "spans"))
    small = spans.count() * ENTRY_BYTES <= BROADCAST_BYTES
    listed = spans.groupBy("d", "t").agg(F.collect_list("span").alias("found"))

    def work():
        def step(batch):
            rows = [[] for _ in range(5)]
            for data, found in zip(_texts(batch), batch.column("found").to_pylist()):
                edges = _merged(found or [])
                parts = list(_left_over(data, edges))
                kept = b" ".join(w for _, words in parts for w in words)
                rows[0].append(sum(n for n, _ in parts))
                rows[1].append(sum(e - s for s, e in edges))
                rows[2].append(hashlib.sha256(kept).hexdigest())
                rows[3].append([{"start": s, "end": e} for s, e in edges])
                rows[4].append(kept)
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary()]
            columns = [pa.array(r, t) for r, t in zip(rows, types)]
            columns[4] = columns[4].cast(pa.string())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"])

        return step

    texts = _keyed(docs).join(F.broadcast(listed) if small else listed, ["d", "t"], "left").select("doc_id", "text", "found")
    return map_rows(texts, work, "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(documents(spark, sf_dir)).drop("spans", "kept_text")


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(w, i, i + 49) AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM words)
), first AS (
  SELECT win, min(doc_id) AS d FROM windows GROUP BY win
), covered AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS i FROM windows JOIN first USING (win) WHERE d < doc_id
), kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(c.i) AS n_removed, string_agg(w.word, ' ' ORDER BY w.i) FILTER (WHERE c.i IS NULL) AS text
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM words) w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id
)
SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM words LEFT JOIN kept USING (doc_id)
"""
