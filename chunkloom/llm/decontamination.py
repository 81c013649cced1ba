"""Benchmark decontamination: a BM25 inverted index of test items, searched with block-max WAND by every passage.

Test items are cut into pieces of at most PIECE words and indexed: postings with their BM25 impacts in the order of pieces, and
for every term and block of BLOCK pieces that holds it the largest impact there. A training text is read as passages of two
neighbouring runs of PIECE words, so every piece that a text contains lies whole in some passage. A passage is a query. Its
terms are ordered by their largest impact; up to the pivot, where the running sum reaches the lowest threshold of all pieces,
terms raise no piece alone and only the blocks of the terms from the pivot on are opened; of these, blocks whose summed block
maxima and what the terms before the pivot may add stay under the block's lowest threshold are passed over. In the others exact
scores are taken, and every piece that reaches SHARE of its own full score is retrieved. An item retrieved for a text is verified on runs of five words: at least 0.8 of
the item's, or of both its question and its answer, must occur in the text. Runs may lie anywhere in the text, so the
passages alone don't find every such item: hashes of the runs of each item and of the longer of its two parts are looked
up in the whole text, and what holds 0.8 of either is retrieved as well. bm25 is then the item's best score in a passage.

Words are runs of letters, digits and non-ASCII characters, lower-cased. An item's question is its first line, or else
its first sentence; the rest is the answer. Defined results: null and empty texts and items match nothing; an item of
fewer than five words matches texts that hold its words in a row, and a question or answer of fewer than five words counts
as held where its words stand in a row; repeated rows give repeated results; null doc_id is carried
along; an empty table on either side gives no hits; other columns are ignored by the search and kept by the cleaning.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chunkloom.llm.common import documents, filter_rows, map_rows, table, texts_of

K1, B = 1.5, 0.75
PIECE = 48
BLOCK = 64
SHARE = 0.6
SHINGLE = 5
OVERLAP = 0.8
#: Items, and bytes of their texts, of one broadcast index (some 60 bytes of index for each byte of text); a larger set of items
#: is searched shard by shard, and an item larger than a shard is refused.
SHARD_ITEMS, SHARD_BYTES = 50_000, 8 << 20

_LETTERS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_QUESTION = re.compile(r".*?(?:\n|[.?!](?:\s|$)|$)", re.S)


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def run_hashes(terms: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """64-bit hashes of the n term numbers from each place."""
    h = np.full(len(at), n, np.uint64)
    for j in range(n):
        h = (h ^ (terms[at + j].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def spread(starts: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all entries of the keys in a list that starts at starts[key], and how many each key has."""
    n = starts[key + 1] - starts[key]
    return np.repeat(starts[key] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def runs_of(words: list[bytes], k: int) -> set:
    return set(zip(*(words[j:] for j in range(k)))) if k else set()


def shingles(words: list[bytes]) -> set:
    return runs_of(words, min(SHINGLE, len(words)))


class Index:
    """Inverted index over the pieces of a set of items."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [i for i, _ in items]
        self.parts = []  # (whole, question, answer) shingles and the number of words of each item
        pieces: list[list[bytes]] = []
        owner: list[int] = []
        for k, (_, text) in enumerate(items):
            question = _QUESTION.match(text)[0]
            words = words_of(text)
            self.parts.append((shingles(words), shingles(words_of(question)), shingles(words_of(text[len(question) :])), tuple(words) if len(words) < SHINGLE else None))
            n = -(-len(words) // PIECE)
            for j in range(n):
                pieces.append(words[j * len(words) // n : (j + 1) * len(words) // n])
                owner.append(k)
        self.owner = np.array(owner, np.int64)
        self.terms: dict[bytes, int] = {}
        postings: list[dict[int, int]] = []
        for p, words in enumerate(pieces):
            for w in words:
                t = self.terms.setdefault(w, len(self.terms))
                if t == len(postings):
                    postings.append({})
                postings[t][p] = postings[t].get(p, 0) + 1
        n = max(len(pieces), 1)
        length = np.array([len(p) for p in pieces], float)
        mean = length.mean() if len(pieces) else 1.0
        self.at = np.cumsum([0, *map(len, postings)])
        self.piece = np.fromiter((p for ps in postings for p in ps), np.int64, self.at[-1])
        tf = np.fromiter((c for ps in postings for c in ps.values()), float, self.at[-1])
        df = np.diff(self.at)
        idf = np.repeat(np.log(1 + (n - df + 0.5) / (df + 0.5)), df)
        self.impact = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.piece] / mean)) if len(tf) else tf
        self.threshold = SHARE * np.bincount(self.piece, self.impact, len(pieces)) - 1e-9
        # One entry for each term and block that holds it: the block, its largest impact, and where its postings start.
        term_block = np.repeat(np.arange(len(postings)), df) * (n // BLOCK + 1) + self.piece // BLOCK
        self.entry_from = np.flatnonzero(np.r_[True, term_block[1:] != term_block[:-1]]) if len(tf) else np.zeros(0, np.int64)
        self.entry_block = self.piece[self.entry_from] // BLOCK
        self.entry_max = np.maximum.reduceat(self.impact, self.entry_from) if len(tf) else np.zeros(0)
        self.entry_from = np.r_[self.entry_from, len(tf)]
        self.entries = np.searchsorted(self.entry_from[:-1], self.at)
        self.peak = np.maximum.reduceat(self.impact, self.at[:-1]) if len(tf) else np.zeros(0)
        self.own_terms = np.full((len(pieces), PIECE), -1, np.int64)
        self.own_impacts = np.zeros((len(pieces), PIECE))
        filled = [0] * len(pieces)
        for t, p, x in zip(np.repeat(np.arange(len(postings)), df).tolist(), self.piece.tolist(), self.impact.tolist()):
            self.own_terms[p, filled[p]], self.own_impacts[p, filled[p]] = t, x
            filled[p] += 1
        self._index_runs()
        self.least = np.minimum.reduceat(self.threshold, np.arange(0, len(pieces), BLOCK)) if len(pieces) else np.zeros(0)

    def _index_runs(self) -> None:
        """Hashed runs of the lists that an item must hold: its own, and those of the longer of question and answer."""
        self.list_owner, self.needed, lengths, keys = [], [], set(), []
        for k, (whole, question, answer, short) in enumerate(self.parts):
            longer = max(question, answer, key=lambda runs: (len(next(iter(runs), ())), len(runs)))
            for runs in [whole, longer] if question and answer else [whole]:
                n = len(next(iter(runs), ()))
                if not n or short is not None and runs is not whole:
                    continue
                terms = np.array([[self.terms[w] for w in run] for run in runs], np.int64).ravel()
                own = np.unique(run_hashes(terms, np.arange(0, len(terms), n), n))
                keys.append(own)
                lengths.add(n)
                self.list_owner.append(k)
                self.needed.append(OVERLAP * len(runs) - (len(runs) - len(own)) - 1e-9)
        self.run_lengths = sorted(lengths)
        self.list_owner, self.needed = np.array(self.list_owner, np.int64), np.array(self.needed)
        every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        self.run_keys, place = np.unique(every, return_inverse=True)
        self.run_lists = np.repeat(np.arange(len(keys)), [len(x) for x in keys])[np.argsort(place, kind="stable")]
        self.run_at = np.r_[0, np.cumsum(np.bincount(place, minlength=len(self.run_keys)))].astype(np.int64)
        self.shift = np.uint64(64 - max(16, (16 * len(self.run_keys)).bit_length()))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.run_keys >> self.shift] = True

    def numbered(self, texts_words: list[list[bytes]]) -> list[np.ndarray]:
        """Term numbers of the words; -1 for words of no item."""
        return [np.fromiter(map(self.terms.get, ws, repeat(-1)), np.int64, len(ws)) for ws in texts_words]

    def look_up(self, flat: list[np.ndarray]) -> set[tuple[int, int]]:
        """(text number, item number) wherever a text holds OVERLAP of the runs of an item or of the longer of its parts."""
        if not flat or not len(self.run_keys):
            return set()
        terms = np.concatenate([x for f in flat for x in (f, [-1])])
        text = np.repeat(np.arange(len(flat)), [len(f) + 1 for f in flat])
        gaps = np.r_[0, np.cumsum(terms < 0)]
        held = []
        for n in self.run_lengths:
            at = np.flatnonzero(gaps[n:] == gaps[:-n])
            h = run_hashes(terms, at, n)
            some = self.seen[h >> self.shift]
            at, h = at[some], h[some]
            key = np.minimum(np.searchsorted(self.run_keys, h), len(self.run_keys) - 1)
            same = self.run_keys[key] == h
            held.append(text[at[same]] * len(self.run_keys) + key[same])
        held = np.unique(np.concatenate(held))
        spot, n = spread(self.run_at, held % len(self.run_keys))
        pairs, hits = np.unique(np.repeat(held // len(self.run_keys), n) * len(self.needed) + self.run_lists[spot], return_counts=True)
        row, own = pairs // len(self.needed), pairs % len(self.needed)
        enough = hits >= self.needed[own]
        return set(zip(row[enough].tolist(), self.list_owner[own[enough]].tolist()))

    def best_score(self, terms: np.ndarray, item: int) -> float:
        """The best score of the item's pieces in a passage of the text."""
        pieces = np.flatnonzero(self.owner == item)
        passages = [terms[j : j + 2 * PIECE] for j in range(0, len(terms), PIECE)]
        known = self.own_terms[pieces] >= 0
        return max((float(np.where(known & np.isin(self.own_terms[pieces], p), self.own_impacts[pieces], 0).sum(1).max()) for p in passages), default=0.0)

    def retrieve(self, flat: list[np.ndarray]) -> dict[tuple[int, int], float]:
        """(text number, item number) -> best share of a piece's full score, for all pieces above their threshold."""
        sizes = [-(-len(f) // PIECE) for f in flat]
        first = np.cumsum([0, *(s + 1 for s in sizes)])  # a run number left free after each text keeps passages apart
        runs = np.concatenate([np.arange(len(f)) // PIECE + s for f, s in zip(flat, first)]) if flat else np.zeros(0, np.int64)
        terms = np.concatenate(flat) if flat else runs
        known = terms >= 0
        runs, terms, v = runs[known], terms[known], max(len(self.terms), 1)
        if not len(runs):
            return {}
        # A passage is run r with run r+1: every word belongs to the passages of its own run and of the run before.
        pairs = np.unique(np.concatenate([runs + 1, runs]) * v + np.concatenate([terms, terms]))
        names, row = np.unique(pairs // v, return_inverse=True)
        terms = pairs % v
        # The pivot of each passage: terms in ascending order of their largest impact, while their sum stays under every threshold.
        order = np.lexsort((self.peak[terms], row))
        row, terms = row[order], terms[order]
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        total = np.cumsum(self.peak[terms])
        so_far = total - np.repeat(np.r_[0, total[heads[1:] - 1]], np.diff(np.r_[heads, len(row)]))
        weak = so_far < self.least.min() - 1e-6
        rest = np.bincount(row[weak], self.peak[terms[weak]], len(names))
        row, terms = row[~weak], terms[~weak]
        # Blocks of the terms from the pivot on, and those of them whose maxima can reach their lowest threshold.
        entry, n = spread(self.entries, terms)
        row, block = np.repeat(row, n), self.entry_block[entry]
        keys, place = np.unique(row * len(self.least) + block, return_inverse=True)
        live = np.bincount(place, self.entry_max[entry], len(keys)) + rest[keys // len(self.least)] >= self.least[keys % len(self.least)] - 1e-6
        row, entry = row[live[place]], entry[live[place]]
        spot, n = spread(self.entry_from, entry)
        row, piece, impact = np.repeat(row, n), self.piece[spot], self.impact[spot]
        keys, place = np.unique(row * len(self.owner) + piece, return_inverse=True)
        row, piece = keys // len(self.owner), keys % len(self.owner)
        use = np.bincount(place, impact, len(keys)) + rest[row] >= self.threshold[piece] - 1e-6
        row, piece = row[use], piece[use]
        wanted = names[row][:, None] * v + self.own_terms[piece]
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        score = np.where((pairs[at] == wanted) & (self.own_terms[piece] >= 0), self.own_impacts[piece], 0).sum(1)
        text_of = np.searchsorted(first, names, "right") - 1  # the run number left free belongs to the text before it
        found: dict[tuple[int, int], float] = {}
        for k in np.flatnonzero(score >= self.threshold[piece]):
            key = (int(text_of[row[k]]), int(self.owner[piece[k]]))
            found[key] = max(found.get(key, 0.0), float(score[k]))
        return found

    def matches(self, texts: list[str]) -> list[tuple[int, int, float, float, float, float]]:
        """(text number, item_id, bm25, overlap, question overlap, answer overlap) of all verified pairs."""
        words = [words_of(t) for t in texts]
        out = []
        held: tuple[int, dict[int, set]] = (-1, {})
        flat = self.numbered(words)
        scores = self.retrieve(flat)
        for k, item in sorted(scores.keys() | self.look_up(flat)):
            score = scores.get((k, item))
            whole, question, answer, short = self.parts[item]
            if held[0] != k:
                held = (k, {})
            share = []
            for part in (whole, question, answer):
                n = len(next(iter(part), ()))
                if n not in held[1]:
                    held[1][n] = runs_of(words[k], n)
                share.append(len(part & held[1][n]) / len(part) if part else None)
            if short is not None:
                share[1:] = share[0], share[0]
            q, a = share[1] if share[1] is not None else share[0], share[2] if share[2] is not None else share[0]
            if share[0] >= OVERLAP or min(q, a) >= OVERLAP:
                out.append((k, self.items[item], self.best_score(flat[k], item) if score is None else score, share[0], q, a))
        return out


def portions(texts: list[str], chars: int = 1 << 20):
    """(start, texts) in runs of about so many characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield start, texts[start : i + 1]
            start, size = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def indexes(items: DataFrame):
    """Broadcast indexes of all items(item_id, text), SHARD_ITEMS at a time."""
    spark = items.sparkSession
    rows = items.select("item_id", "text").where("text is not null")
    size = F.octet_length("text")
    n, size, largest = rows.agg(F.count(F.lit(1)), F.sum(size), F.max(size)).first()
    if (largest or 0) > SHARD_BYTES:
        raise ValueError(f"an item of {largest} bytes is larger than a shard of the index ({SHARD_BYTES})")
    shards = max(1, -(-n // SHARD_ITEMS), -(-2 * (size or 0) // SHARD_BYTES))
    for shard in range(shards):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == shard).collect()
        yield spark.sparkContext.broadcast(Index(sorted((-1 if r.item_id is None else r.item_id, r.text) for r in own if words_of(r.text))))


def search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs(doc_id, text), items(item_id, text) -> doc_id, item_id, bm25, overlap, question_overlap, answer_overlap of every leak."""
    found = None
    for shared in indexes(items):

        def work(shared=shared):
            index = shared.value

            def step(batch):
                rows = []
                for start, texts in portions(texts_of(batch)):
                    rows += [(start + k, *rest) for k, *rest in index.matches(texts)]
                ids = batch.column("doc_id").take(pa.array([r[0] for r in rows], pa.int64()))
                types = [pa.int64()] + [pa.float64()] * 4
                return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in rows], t) for i, t in enumerate(types))], ["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"])

            return step

        part = map_rows(docs.select("doc_id", "text"), work, "doc_id long, item_id long, bm25 double, overlap double, question_overlap double, answer_overlap double")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (all columns) in whose text no item is found."""
    for shared in indexes(items):

        def work(shared=shared):
            index = shared.value

            def step(batch):
                keep = [True] * batch.num_rows
                for start, texts in portions(texts_of(batch)):
                    for k, *_ in index.matches(texts):
                        keep[start + k] = False
                return keep

            return step

        docs = filter_rows(docs, work)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
