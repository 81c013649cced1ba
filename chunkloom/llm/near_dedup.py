"""Near duplicates: universal hash minima, banding, signature verification, exact confirmation, connected components.

Documents with the same shingle set are one class, and only its representative goes on. Bands of minima put classes in
buckets; each class meets the smallest one of each bucket; pairs whose signatures agree enough are confirmed on their full
sets; confirmed links give components. Classes whose buckets still hold several components are compared across components
on their full sets, so that no link inside a bucket is missed: in blocks of one size stratum and, where it fills a block, of one
component. Blocks of one component are never compared with each other, nor strata whose sizes are too far apart for a link, and
no bucket or cluster is gathered in one task.

Words are runs of anything but ASCII white space, after lower-casing A-Z. A document's set: distinct runs of `shingle`
words; with fewer words, all of them as one. Defined results: null, empty and blank texts have the empty set and are
linked with nothing; rows with the same doc_id are one document (of unlike texts under one doc_id the largest is compared, whatever
the order of rows); very long texts are read whole, their minima in slices; null doc_id has component null (a copy of a document
with an id takes that one's) and is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, map_rows, materialise, outlive, scratch
from chunkloom.llm.components import components

BANDS, ROWS = 32, 5
SEED = 7919
#: Agreement of signatures below which a pair is not confirmed: more than four standard deviations under the threshold.
SLACK = 0.14
#: Classes of a cluster that are compared as one block.
BLOCK = 256
#: Block group of the components that don't fill a block.
_POOL = -(1 << 63)
#: Document ids up to which the list of those to fetch is broadcast (some 30 bytes each in memory: 30 MB).
BROADCAST_ROWS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """Word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 20011)
        return h


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, ASCII white space only


def shingle_hashes(words: list[bytes], shingle: int, hashes: WordHash) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(shingle, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = (out ^ h[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingle_set(words: list[bytes], shingle: int) -> set:
    k = min(shingle, len(words))
    return set(zip(*(words[j:] for j in range(k)))) if k else set()


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of each multiply-add hash (upper 32 bits) over the set."""
    low = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 2048):
        np.minimum(low, (x[at : at + 2048, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, set_hash, signature, bands (null for the empty set)."""

    def work():
        hashes, (a, b) = WordHash(), _multipliers()

        def step(batch):
            rows = [[] for _ in range(4)]
            for text in batch.column("text").to_pylist():
                x = shingle_hashes(words_of(text), shingle, hashes)
                rows[0].append(len(x))
                if not len(x):
                    for r in rows[1:]:
                        r.append(None)
                    continue
                s = minima(x, a, b)
                keys = np.full(BANDS, 1, np.uint64) + np.arange(BANDS, dtype=np.uint64)
                for column in s.reshape(BANDS, ROWS).T.astype(np.uint64):
                    keys = (keys ^ column) * _MIX
                    keys ^= keys >> np.uint64(31)
                rows[1].append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                rows[2].append(s.tobytes())
                rows[3].append(keys.view(np.int64))
            types = [pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, t) for r, t in zip(rows, types))], ["doc_id", "n_shingles", "set_hash", "signature", "bands"])

        return step

    return map_rows(docs.select("doc_id", "text"), work, "doc_id long, n_shingles long, set_hash binary, signature binary, bands array<long>")


def _agreeing(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least `least` of the places."""

    def work():
        def step(batch):
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            kept = pa.array((one == two).mean(1) >= least)
            return pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

        return step

    sides = [reps.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}")) for k in "ab"]
    return map_rows(pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "sa", "sb"), work, "a long, b long")


def _confirmed(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    pairs = materialise(pairs, "pairs")
    n_pairs = pairs.count()
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    small = n_pairs <= BROADCAST_ROWS // 2
    texts = docs.select("doc_id", "text").join(F.broadcast(ids) if small else ids, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    texts = materialise(texts, "texts")

    def work():
        last: list = [None, None]

        def step(batch):
            kept = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "ta", "tb"))):
                if last[0] != a or a is None:
                    last[:] = a, shingle_set(words_of(ta), shingle)
                one, two = last[1], shingle_set(words_of(tb), shingle)
                both = len(one & two)
                kept.append(100 * both >= percent * (len(one) + len(two) - both))
            kept = pa.array(kept, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], ["a", "b"])

        return step

    one = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    return map_rows(pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb"), work, "a long, b long")


def _mixed_buckets(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, rep, component) of the buckets (first class a) that hold several components."""
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "a", "rep", F.coalesce("component", "rep").alias("component"))
    labelled = materialise(labelled, "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    return materialise(labelled.join(materialise(mixed, "mixed"), "bucket").select("a", "rep", "component").distinct(), "shared")


def _full_sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """ids(rep) -> rep, shingles: the full set of each, as ascending 64-bit hashes."""
    small = ids.count() <= BROADCAST_ROWS
    texts = docs.select(F.col("doc_id").alias("rep"), "text").join(F.broadcast(ids) if small else ids, "rep").groupBy("rep").agg(F.max("text").alias("text"))

    def work():
        hashes = WordHash()

        def step(batch):
            sets = [shingle_hashes(words_of(t), shingle, hashes).tobytes() for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(sets, pa.binary())], ["rep", "shingles"])

        return step

    return map_rows(texts, work, "rep long, shingles binary")


def similar_pairs(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union: intersections counted by products of incidence matrices, a slice of shingles at a time."""
    flat = [np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (left, right)]
    row = [np.repeat(np.arange(len(x)), [len(s) for s in x]) for x in (left, right)]
    common = np.intersect1d(*flat)
    both = np.zeros((len(left), len(right)), np.float32)
    kept = [np.isin(f, common) for f in flat]
    place = [np.searchsorted(common, f[k]) for f, k in zip(flat, kept)]
    row = [r[k] for r, k in zip(row, kept)]
    order = [np.argsort(p, kind="stable") for p in place]
    place, row = [p[o] for p, o in zip(place, order)], [r[o] for r, o in zip(row, order)]
    for at in range(0, len(common), 8192):
        sides = []
        for p, r, x in zip(place, row, (left, right)):
            i, j = np.searchsorted(p, [at, at + 8192])
            m = np.zeros((len(x), 8192), np.float32)
            m[r[i:j], p[i:j] - at] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    size = [np.array([len(s) for s in x], np.float64) for x in (left, right)]
    return 100 * both >= percent * (size[0][:, None] + size[1][None, :] - both)


def _met_blocks(own: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """own(cluster, rep, component, n_shingles) -> cluster, rep, component, low, high, first: each class once for every two blocks that it is compared in.

    A block holds classes of one stratum (sizes within a factor of 100 / percent) and of one component, or of components too
    small for a block of their own. Two blocks meet if their strata are equal or neighbours and they aren't of one component.
    """
    stratum = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(max(100 / percent, 1.01))) + 1e-9).cast("int")
    placed = own.withColumn("s", stratum)
    sizes = placed.groupBy("cluster", "s", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("g", F.when(F.col("n") >= block, F.col("component")).otherwise(F.lit(_POOL)))
    units = materialise(sizes.groupBy("cluster", "s", "g").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")), "units")
    homes = placed.join(sizes.drop("n"), ["cluster", "s", "component"]).join(units, ["cluster", "s", "g"])
    homes = homes.select("cluster", "rep", "component", F.struct("s", "g", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("i")).alias("me"))
    others = units.select("cluster", F.col("s").alias("t"), F.col("g").alias("h"), "blocks")
    near = (F.abs(F.col("me.s") - F.col("t")) <= 1) & ((F.col("me.g") != F.col("h")) | (F.col("h") == _POOL))
    met = homes.join(others, "cluster").where(near).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.withColumn("other", F.struct(F.col("t").alias("s"), F.col("h").alias("g"), F.col("j").alias("i")))
    pairs = met.select("cluster", "rep", "component", "me", F.least("me", "other").alias("low"), F.greatest("me", "other").alias("high"))
    return pairs.select("cluster", "rep", "component", "low", "high", (F.col("me") == F.col("low")).alias("first"))


def _across(members: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links between different components of one bucket that stars have not found.

    Classes that buckets of several components connect form a cluster; its blocks meet in tasks of their own, all pairs of
    different components are counted exactly on full sets, and of the links found only those that join what is not joined
    yet are returned.
    """
    shared = _mixed_buckets(members, found)
    clusters = materialise(components(shared.select("a", F.col("rep").alias("b"))).withColumnRenamed("node", "rep").withColumnRenamed("component", "cluster"), "clusters")
    own = materialise(shared.select("rep", "component").distinct().join(clusters, "rep").join(reps.select("rep", "n_shingles"), "rep"), "own")
    sets = materialise(_full_sets(docs, own.select("rep").distinct(), shingle), "sets")
    met = _met_blocks(own, percent).join(sets, "rep")

    def compare(table: pa.Table) -> pa.Table:
        first, rep, component = (table.column(c).to_numpy() for c in ("first", "rep", "component"))
        held = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
        left, right = np.flatnonzero(first), np.flatnonzero(~first)
        if table.column("low")[0] == table.column("high")[0]:
            right = left
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        hit = similar_pairs([held[x] for x in left], [held[y] for y in right], percent) & (component[left][:, None] != component[right][None, :])
        joined: dict[int, int] = {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        links = [[], []]
        for x, y in zip(*np.nonzero(hit)):
            one, two = root(int(component[left[x]])), root(int(component[right[y]]))
            if one != two:
                joined[max(one, two)] = min(one, two)
                links[0].append(min(rep[left[x]], rep[right[y]]))
                links[1].append(max(rep[left[x]], rep[right[y]]))
        return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})

    return met.groupBy("cluster", "low", "high").applyInArrow(compare, "a long, b long").distinct()


def link(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per row of docs."""
    with scratch():
        marked, names = _named(docs, shingle, percent)
        outlive(marked)
        outlive(names)
    ended = marked.select("doc_id", "n_shingles", "set_hash").join(names, "set_hash", "left")
    own = F.coalesce("component", "doc_id")
    return ended.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def _named(docs: DataFrame, shingle: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tables of all documents' signatures and of the component of each set_hash."""
    least = percent / 100 - SLACK
    marked = materialise(signatures(docs, shingle), "signatures")
    classes = materialise(marked.where("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "classes")
    own = F.min(F.struct("set_hash", "n_shingles", "signature", "bands"))  # one of them where a doc_id has several texts
    reps = marked.join(classes, ["set_hash"]).where("doc_id = rep").groupBy("rep").agg(own.alias("r")).select("rep", "r.n_shingles", "r.signature", "r.bands")
    reps = materialise(reps, "reps")
    bands = reps.select("rep", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("rep").alias("a"), F.max("rep").alias("top")).where("a < top").select("bucket", "a")
    shared = materialise(shared, "buckets")
    members = materialise(bands.join(shared, "bucket"), "members")
    stars = materialise(members.where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "stars")
    links = materialise(_confirmed(_agreeing(stars, reps, least), docs, shingle, percent), "links")
    found = materialise(components(links), "components")
    more = materialise(_across(members, found, reps, docs, shingle, percent), "across")
    if not more.isEmpty():
        found = materialise(components(links.unionByName(more)), "components")
    names = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    return marked, materialise(names, "names")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir), shingle=2, percent=80)
