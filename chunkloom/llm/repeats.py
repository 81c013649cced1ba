"""Removal of long repeated strings by sampled hash grouping in three levels.

Every string of LENGTH bytes has one sample, which its own bytes choose (the smallest hash of 16 bytes among its first
WINDOW ones), so equal strings have equal samples at equal places. Samples are grouped by a hash of the bytes that all
strings of a sample share (Spark's aggregation, on disk where memory ends): samples alone in their class carry no repeat;
samples whose whole surroundings recur make all their strings repeats; what lies between is looked at again in cells of 16
starts, and only cells at the edge of a repeat string by string. Classes of any size are counts, never lists of pairs.
Texts are read again for the second and third level and for the removal, each with its own list of runs or maximal spans. Short
lists are broadcast; longer ones are joined by shuffle, and then only texts that a bit filter of fixed size finds listed move.

This is not an external induced suffix sort: nothing is sorted in suffix order and there are no common-prefix values. One
level of such a sort was measured (an 8-byte key, document and place of each leftmost S-type suffix, range-partitioned and
sorted by Spark): 0.30 suffixes a byte, 6.5 times the input in shuffle for the first key alone, where 4 times is the budget
of the whole operator; inducing the other suffixes moves more than three times that. The README has the figures.

A byte is removed if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another.
Texts are UTF-8; matches never cross documents. Defined results: null and empty texts have 0 bytes and no spans; texts
shorter than LENGTH keep everything; a text of 256 MB or more is refused with an error; repeated rows are repeats of each other; null doc_id is carried along; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, map_rows, materialise, outlive, scratch

LENGTH = 400
GRAM = 16
CELL = 16
#: Bytes up to which the lists for the next reading of the texts are broadcast; beyond them they are joined by shuffle.
BROADCAST_BYTES = 192 << 20
#: Bytes of one run in such a list, at most: its numbers, and the row of its text where it is the only one.
ENTRY_BYTES = 80
#: Bytes of one more span of a text that has a row.
SPAN_BYTES = 8
#: Words of 64 bits in the filter that tells which texts may be listed; that many rows are broadcast at most, whatever the input.
FILTER_WORDS = 1 << 22

U = np.uint64
_PLACE = U((1 << 28) - 1)
_FACTORS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def window_of(length: int) -> int:
    """Starts among which a string's sample is chosen."""
    return max(1, min(192, (length - GRAM) // 2))


def _powers(factor: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor and of its inverse modulo 2**64."""
    if factor not in _POWERS or len(_POWERS[factor][0]) < n:
        size = 1 << max(17, int(n - 1).bit_length())
        both = []
        for base in (factor, pow(factor, -1, 1 << 64)):
            steps = np.full(size, base, U)
            steps[0] = 1
            both.append(np.cumprod(steps))
        _POWERS[factor] = both[0], both[1]
    return _POWERS[factor]


def grams(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the 16 bytes from every place."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, U)
    words = np.zeros(len(data) - 7, U)
    for j in range(8):
        words |= data[j : j + len(words)].astype(U) << U(8 * j)
    h = words[:n] * U(0x9E3779B97F4A7C15)
    h ^= h >> U(32)
    h += words[8 : 8 + n]
    h *= U(0xC2B2AE3D27D4EB4F)
    h ^= h >> U(29)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(32)
    return h


def samples(h: np.ndarray, starts: int, window: int) -> np.ndarray:
    """For every string start below `starts`: place of the smallest gram hash among the `window` from it, the leftmost of equals."""
    if len(h) > int(_PLACE):
        raise ValueError(f"a text of more than {int(_PLACE)} bytes: places are kept in so many numbers")
    keys = (h & ~_PLACE) | np.arange(len(h), dtype=U)
    full = np.concatenate([keys, np.full(-len(h) % window, np.iinfo(U).max, U)]).reshape(-1, window)
    ahead = np.minimum.accumulate(full, 1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[:starts], ahead[window - 1 : window - 1 + starts]) & _PLACE).astype(np.int64)


class Prefixes:
    """Hashes of any stretch of a text of at least GRAM bytes."""

    def __init__(self, h: np.ndarray, factor: int = _FACTORS[0]):
        power, self.inverse = _powers(factor, len(h) + 1)
        self.sums = np.concatenate([np.zeros(1, U), np.cumsum(h * power[: len(h)])])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end - GRAM + 1] - self.sums[start]) * self.inverse[start]


def _mixed(h: np.ndarray, *numbers: np.ndarray) -> np.ndarray:
    for x in numbers:
        h = (h ^ x.astype(U)) * U(0x9E3779B97F4A7C15)
        h = h ^ (h >> U(31))
    return h


ROWS = "d long, t long, spots array<struct<start:int,n:int,k:int,nec:long,suf:long>>"
_SPOT = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32()), ("k", pa.int32()), ("nec", pa.int64()), ("suf", pa.int64())]))


def _spots(parts: list[tuple]) -> pa.Array:
    """Lists of (start, n, k, nec, suf), one list for each text."""
    edges = np.cumsum([0, *(len(p[0]) for p in parts)]).astype(np.int32)
    columns = [np.concatenate([p[i] for p in [_EMPTY, *parts]]) for i in range(5)]
    arrays = [pa.array(c.astype(np.int32)) for c in columns[:3]] + [pa.array(c.view(np.int64)) for c in columns[3:]]
    return pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays(arrays, ["start", "n", "k", "nec", "suf"]))


_EMPTY = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, np.int64, U, U))  # of the kinds of the others: numpy joins signed and unsigned as floats


def _sampled(data: np.ndarray, length: int) -> tuple:
    """Runs of string starts with the same sample: first start, how many, distance to the sample, hash of what all share, hash of all they span."""
    if len(data) < length:
        return _EMPTY
    h, window = grams(data), window_of(length)
    at = samples(h, len(data) - length + 1, window)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    place, hashes = at[first], Prefixes(h)
    n, k = last - first + 1, place - first
    return first, n, k, _mixed(hashes.of(place, place + length - window + 1), k * 0 + 1), _mixed(hashes.of(first, last + length), n, k)


def _cells(data: np.ndarray, runs: np.ndarray, length: int) -> tuple:
    """The runs (start, n, k) cut into cells of CELL distances from their sample."""
    hashes = Prefixes(grams(data))
    start, n, k = runs.T
    low, high = (k - n + 1) // CELL, k // CELL
    count = high - low + 1
    row = np.repeat(np.arange(len(runs)), count)
    cell = low[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    place = (start + k)[row]
    near, far = np.maximum((k - n + 1)[row], cell * CELL), np.minimum(k[row], cell * CELL + CELL - 1)
    shared = _mixed(hashes.of(place - cell * CELL, place - cell * CELL - CELL + 1 + length), cell + 2)
    return place - far, far - near + 1, far, shared, _mixed(hashes.of(place - far, place - near + length), near, far)


def _strings(data: np.ndarray, runs: np.ndarray, length: int) -> tuple:
    """Every string of the runs on its own, with two independent hashes."""
    h = grams(data)
    start, n, _ = runs.T
    row = np.repeat(np.arange(len(runs)), n)
    at = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    one = np.ones(len(at), np.int64)
    return at, one, one, Prefixes(h).of(at, at + length), Prefixes(h, _FACTORS[1]).of(at, at + length)


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of each text: doc_id (null: the smallest number) and a hash of the text."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("t"))


def _bytes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x or b"", np.uint8) for x in batch.column("text").cast(pa.binary()).to_pylist()]


def _maybe_listed(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """texts with a column listed: true for every (d, t) of listed(d, t, ...), and for a few others, as many as bits of the filter are set."""
    bit = F.pmod(F.xxhash64("d", "t"), F.lit(64 * FILTER_WORDS))
    word, place = F.shiftright(bit, 6).alias("word"), F.pmod(bit, F.lit(64)).cast("int")
    bits = listed.select(word, place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("mask"))
    found = texts.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    return found.withColumn("place", place).withColumn("listed", F.expr("coalesce(shiftrightunsigned(mask, place) & 1L, 0L) = 1L")).drop("word", "mask", "place")


def _first_rows(docs: DataFrame, length: int) -> DataFrame:
    def work():
        def step(batch):
            return pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), _spots([_sampled(x, length) for x in _bytes(batch)])], ["d", "t", "spots"])

        return step

    return map_rows(_keyed(docs).where("text is not null").select("d", "t", "text"), work, ROWS)


def _next_rows(docs: DataFrame, runs: DataFrame, cut, length: int) -> DataFrame:
    """runs(d, t, start, n, k) read in their texts again and cut finer."""
    listed = runs.groupBy("d", "t").agg(F.collect_set(F.struct("start", "n", "k")).alias("runs"))
    small = runs.count() * ENTRY_BYTES <= BROADCAST_BYTES
    texts = _keyed(docs).select("d", "t", "text")

    def work():
        def step(batch):
            lists = batch.column("runs").to_pylist()
            parts = [cut(x, np.array(sorted((r["start"], r["n"], r["k"]) for r in rs), np.int64), length) for x, rs in zip(_bytes(batch), lists)]
            return pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), _spots(parts)], ["d", "t", "spots"])

        return step

    texts = texts.join(F.broadcast(listed), ["d", "t"]) if small else _maybe_listed(texts, runs).where("listed").drop("listed").join(listed, ["d", "t"])
    return map_rows(texts, work, ROWS)


def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows(d, t, spots) -> runs all of whose strings are repeats, and runs to be cut finer.

    nec: equal for any two runs that hold equal strings; suf: equal only if all they span is equal.
    """
    spots = materialise(rows, "spots").select("d", "t", F.inline("spots"))
    classes = spots.groupBy("nec").agg(F.count(F.lit(1)).alias("c"), F.min("suf").alias("low"), F.max("suf").alias("high"))
    classes = materialise(classes.where("c > 1").select("nec", (F.col("low") != F.col("high")).alias("mixed")), "classes")
    shared = materialise(spots.join(classes, "nec"), "shared")
    mixed = shared.where("mixed").drop("mixed")
    kinds = mixed.groupBy("nec", "suf").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "t", "start")).alias("one"))
    kinds = materialise(kinds, "kinds")
    marked = materialise(mixed.join(kinds, ["nec", "suf"]).select("d", "t", "start", "n", "k", "c", (F.struct("d", "t", "start") == F.col("one")).alias("one")), "marked")
    sure = shared.where("not mixed").select("d", "t", "start", "n").unionByName(marked.where("c > 1").select("d", "t", "start", "n"))
    return sure, marked.where("c = 1 or one").select("d", "t", "start", "n", "k")


def repeated_runs(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> d, t, start, n: runs of n string starts that all begin repeats."""
    sure, runs = _settled(_first_rows(docs, length))
    surer, runs = _settled(_next_rows(docs, runs, _cells, length))
    strings = materialise(_next_rows(docs, runs, _strings, length), "strings").select("d", "t", F.inline("spots"))
    again = materialise(strings.groupBy("nec", "suf").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("nec", "suf"), "again")
    return sure.unionByName(surer).unionByName(strings.join(again, ["nec", "suf"]).select("d", "t", "start", "n"))


def _maximal(spans: DataFrame) -> DataFrame:
    """spans(d, t, span: start and end in one number) -> d, t, spans: those of a text in order, overlapping and touching ones as one."""

    def work():
        def step(batch):
            lists = []
            for packed in batch.column("spans").to_pylist():
                spans = np.sort(np.array(packed, np.int64))
                start, end = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
                first = np.flatnonzero(np.r_[True, start[1:] > end[:-1]])
                lists.append((start[first] << 32) + end[np.r_[first[1:] - 1, len(end) - 1]])
            edges = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
            return pa.RecordBatch.from_arrays([batch.column("d"), batch.column("t"), pa.ListArray.from_arrays(edges, pa.array(np.concatenate([np.zeros(0, np.int64), *lists])))], ["d", "t", "spans"])

        return step

    return map_rows(spans.groupBy("d", "t").agg(F.collect_list("span").alias("spans")), work, "d long, t long, spans array<long>")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes), one row per row of docs."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    with scratch():
        spans = repeated_runs(docs, length).select("d", "t", (F.shiftleft(F.col("start").cast("long"), 32) + F.col("start") + F.col("n") - 1 + length).alias("span"))
        listed = outlive(materialise(_maximal(spans), "spans"))
    small = listed.agg(F.coalesce(F.sum(ENTRY_BYTES + SPAN_BYTES * F.size("spans")), F.lit(0))).first()[0] <= BROADCAST_BYTES

    def work():
        def step(batch):
            rows = [[] for _ in range(5)]
            for data, packed in zip(_bytes(batch), batch.column("spans").to_pylist()):
                edges = [(s >> 32, s & 0xFFFFFFFF) for s in packed or []]
                kept, at = hashlib.sha256(), 0
                for start, end in edges:
                    kept.update(data[at:start])
                    at = end
                kept.update(data[at:])
                rows[0].append(len(data))
                rows[1].append(sum(e - s for s, e in edges))
                rows[2].append(len(edges))
                rows[3].append(kept.hexdigest())
                rows[4].append([{"start": s, "end": e} for s, e in edges])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, types))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

        return step

    texts = _keyed(docs)
    if small:
        found = texts.join(F.broadcast(listed), ["d", "t"], "left").select("doc_id", "text", "spans")
    else:
        marked = _maybe_listed(texts, listed)
        found = marked.where("listed").join(listed, ["d", "t"], "left").select("doc_id", "text", "spans")
        found = found.unionByName(marked.where("not listed").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("spans")))
    return map_rows(found, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("spans")
